"""tidewater: data movement, CDC, document queries and monitoring analytics on Spark.

Every operator takes and returns DataFrames; the heavy lifting is left to
Catalyst (filter push-down, column pruning, partial aggregation, AQE).
"""

from tidewater.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
