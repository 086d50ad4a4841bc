"""Heartbeats and pauses of the change stream."""

import pytest

from tidewater.session import checkpoint_dir
from tidewater.streaming import cdc_stream as cst
from tidewater.streaming import progress

COLS = {"id": "bigint", "a": "string", "n": "bigint"}


def _message(op, k, t, **values):
    doc = ", ".join(f'"{c}":{v}' for c, v in {"id": k, **values}.items())
    return (f'{{"operationType":"{op}","ns":{{"db":"d","coll":"t"}},"documentKey":{{"_id":{k}}},"fullDocument":{{{doc}}},'
            f'"clusterTime":{{"t":{t},"i":{k}}}}}',)


def _log(spark, base, messages):
    spark.createDataFrame(messages, "value string").coalesce(1).write.mode("append").text(f"{base}/log")


def _seed(spark, name):
    base = checkpoint_dir(spark, name)
    cst.init_target(spark, f"{base}/target", spark.createDataFrame([], "id long, a string, n long"), "id")
    return base


def test_heartbeats_outlive_the_run_and_count_poison(spark):
    base = _seed(spark, "beats")
    for t, n in ((1, "1"), (2, '"x"'), (3, "3")):
        _log(spark, base, [_message("insert", k, t, n=n) for k in range(t)])
        cst.run_cdc_stream(spark, f"{base}/log", f"{base}/target", f"{base}/ck", "id", COLS, [("d", "t")])
    got = [(r.batch_id, r.events, r.dead, r.last_position.pos_hi, r.last_position.pos_lo) for r in cst.heartbeats(spark, f"{base}/target").orderBy("batch_id").collect()]
    assert got == [(0, 1, 0, 1, 0), (1, 2, 2, 2, 1), (2, 3, 0, 3, 2)]


def test_a_batch_run_again_replaces_its_heartbeat(spark):
    path = checkpoint_dir(spark, "beat")
    events = spark.createDataFrame([(1, 2, 0), (1, 3, 0)], "pos_hi long, pos_lo long, pos_seq long")
    for batch in (0, 1, 1):
        progress.beat(path, batch, events, events.limit(0))
    progress.beat(path, 2, events.limit(0), events.limit(0))
    got = [(r.batch_id, r.events, r.dead, r.last_position) for r in progress.heartbeats(spark, path).orderBy("batch_id").collect()]
    assert [g[:3] for g in got] == [(0, 2, 0), (1, 2, 0), (2, 0, 0)] and got[2][3] is None


def test_a_paused_stream_goes_on_where_it_stood(spark):
    base = _seed(spark, "pause")
    for t in range(1, 7):
        _log(spark, base, [_message("insert", k, t, n=t) for k in range(t)])
    args = (spark, f"{base}/log", f"{base}/target", f"{base}/ck", "id", COLS, [("d", "t")])
    stream = cst.PausableStream(*args)
    stream.start()
    with pytest.raises(RuntimeError, match="is running"):
        stream.start()
    assert stream.wait_for_batch()
    stream.pause()
    stream.pause()
    stood = stream.last_batch()
    again = cst.PausableStream(*args)                 # a new driver
    with pytest.raises(RuntimeError, match="is paused"):
        again.drain()
    assert again.last_batch() == stood
    again.drain(resume=True)
    assert [r.status for r in again.status().orderBy("seq").collect()] == ["running", "paused", "running", "finished"]
    assert {r.id: r.n for r in cst.read_target(spark, f"{base}/target").collect()} == dict.fromkeys(range(6), 6)
    assert [(r.batch_id, r.events) for r in cst.heartbeats(spark, f"{base}/target").orderBy("batch_id").collect()] == [(i, i + 1) for i in range(6)]


def test_change_tables_and_versions_give_one_table(spark):
    """The table is the same however often it is compacted, in any order of arrival, and after a repeated compaction."""
    from tidewater.operators import cdc
    event = "db string, coll string, op string, key long, doc string, pos_hi long, pos_lo long, pos_seq long"
    rows = []
    for t in range(1, 13):
        k = t % 5
        rows.append(("d", "t", "delete" if t % 4 == 0 else "update", k, None if t % 4 == 0 else f'{{"id":{k},"{"an"[t % 2]}":{t}}}', t, 0, 0))
    first = spark.createDataFrame([(0, "s", 1), (9, "stays", None)], "id long, a string, n long")
    want = {tuple(r) for r in cdc.apply_upsert(first, spark.createDataFrame(rows, event), "id", COLS).collect()}
    for every in (1, 3, 100):
        for order in (rows, rows[::-1] + rows[:4]):
            base = checkpoint_dir(spark, f"compact-{every}")
            cst.init_target(spark, f"{base}/t", first, "id")
            for i in range(0, len(order), 4):
                cst.apply_batch(spark, spark.createDataFrame(order[i:i + 4], event), f"{base}/t", "id", COLS, i // 4, compact_every=every)
            assert {tuple(r) for r in cst.read_target(spark, f"{base}/t").collect()} == want
            last = (len(order) - 1) // 4
            cst.compact(spark, f"{base}/t", last)
            cst.compact(spark, f"{base}/t", last)
            assert {tuple(r) for r in cst.read_target(spark, f"{base}/t").collect()} == want


def test_pg_log_streams_key_changes(spark):
    from tidewater.operators import cdc
    base = _seed(spark, "pg-log")
    msg = '{"lsn":"0/%d","action":"%s","schema":"d","table":"t"%s}'
    row = lambda k, n: f',"columns":{{"id":{k},"n":{n}}}'
    lines = [msg % (1, "I", row(1, 1)), msg % (1, "I", row(1, 1)), msg % (2, "B", ""), msg % (3, "U", row(2, 5) + ',"old":{"id":1}'),
             msg % (4, "I", row(3, 7)), msg % (5, "D", ',"identity":{"id":3}'), "not json", msg % (6, "I", row(4, '"x"'))]
    _log(spark, base, [(m,) for m in lines])
    cst.run_cdc_stream(spark, f"{base}/log", f"{base}/target", f"{base}/ck", "id", COLS, [("d", "t")], normalise=lambda raw: cdc.normalise_pg(raw, "id"))
    assert [(r.id, r.n) for r in cst.read_target(spark, f"{base}/target").collect()] == [(2, 5)]
    assert [r.key for r in cst.dead_letters(spark, f"{base}/target").collect()] == [4]
