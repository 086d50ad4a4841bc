"""Toxicity scores by weak supervision.

1. Voters. From the labelled training rows (a bounded sample, one row for each family of copies) words and word
   beginnings are counted by label; those that stand almost only in toxic texts make the lexicon. Its entries are dealt
   by hash into ``N_LISTS`` lexicon voters; pattern voters (several entries close together, a share of entries, shouted
   entries, an entry next to a word of address) come on top. Each voter says yes or no for each text.
2. Label model. A two-class generative model holds each voter's accuracies (how often it says yes in either class) and
   the correlations that remain between voters inside a class; expectation maximisation estimates both from the votes
   alone, a voter's weight being shared with those it is correlated with. Its posterior is a soft label for each text.
3. Classifier. A logistic regression on the lexicon entries a text has (and the pattern votes) is fitted to the soft
   labels, and scores all documents in one pass without a shuffle.

Rows whose crc32(doc_id as text) mod 3 is 1 are held out and never read for 1 to 3; the labels, lang, source and doc_id
are no inputs of a score.

Defined results: null and empty texts get the score of a text without any entry; repeated rows are scored one by one;
rows with a null label are not trained on; without any labelled row every score is 0; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import map_rows, read_table, texts_of

#: About how many labelled rows the lexicon, the label model and the classifier are fitted on.
MAX_TRAIN_ROWS = 20_000
#: Entries of the lexicon at most, the least toxic texts that have an entry, and the least share of toxic texts.
MAX_LEXICON, MIN_TEXTS, MIN_SHARE = 2000, 5, 0.8
N_LISTS = 12
PREFIXES = (4, 5, 6, 7, 8)
ADDRESS = frozenset(("you", "your", "he", "she", "they", "is", "are", "du", "sie", "er", "tu", "vous", "il", "elle", "usted", "es"))
PREDICT_FROM = 0.7
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text)


def entries_of(word: str) -> list[str]:
    """What a word can match: itself and its beginnings (marked by a star)."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def family(words: list[str]) -> int:
    """A number that copies and near copies of a text mostly share: the least hash of its four-word runs."""
    runs = zip(words, words[1:], words[2:], words[3:], strict=False)
    return min((xxhash.xxh3_64_intdigest(" ".join(r)) for r in runs), default=xxhash.xxh3_64_intdigest(" ".join(words))) >> 1


class Lexicon:
    """Finds entries in texts and casts the votes."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        self.index = {e: i for i, e in enumerate(entries)}
        self.lists = np.array([zlib.crc32(e.encode()) % N_LISTS for e in entries], np.int64)

    def find(self, text: str) -> tuple[set[int], np.ndarray]:
        """Indexes of the entries that a text has; the votes."""
        index, hits, places, shout, told, last = self.index, set(), [], False, False, ""
        words = words_of(text)
        for at, word in enumerate(words):
            low = word.lower()
            for e in entries_of(low):
                i = index.get(e)
                if i is not None:
                    hits.add(i)
                    if not places or places[-1] != at:
                        places.append(at)
                    shout |= len(word) > 2 and word.isupper()
                    told |= last in ADDRESS
            last = low
        votes = np.zeros(N_LISTS + 4, np.int8)
        votes[self.lists[list(hits)]] = 1
        votes[N_LISTS:] = (any(b - a <= 60 for a, b in zip(places, places[1:], strict=False)), len(places) * 200 >= len(words) > 0, shout, told)
        return hits, votes


def label_model(votes: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of class 1 for each row of 0/1 ``votes``: expectation maximisation of class shares and voters'
    accuracies; a voter counts 1 / (1 + its correlations inside the classes with the others), estimated along."""
    n, m = votes.shape
    if not n:
        return np.zeros(0)
    x = votes.astype(float)
    posterior = np.clip(x[:, :N_LISTS].sum(1) / 2, 0.02, 0.98)  # start: two lexicon voters make it likely
    weight = np.ones(m)
    for _ in range(rounds):
        share = np.clip(posterior.mean(), 1e-3, 0.5)
        yes = np.array([(x * posterior[:, None]).sum(0) + 1, (x * (1 - posterior)[:, None]).sum(0) + 0.01])
        yes /= np.array([[posterior.sum() + 2], [(1 - posterior).sum() + 2]])
        yes = np.clip(yes, 1e-5, 1 - 1e-5)
        rest = x - posterior[:, None] * yes[0] - (1 - posterior)[:, None] * yes[1]
        spread = rest.std(0)
        alike = (rest / np.where(spread > 1e-9, spread, 1)).T @ (rest / np.where(spread > 1e-9, spread, 1)) / n
        weight = 1 / (1 + np.clip(alike - np.diag(np.diag(alike)), 0, 1).sum(0))
        log_odds = np.log(share / (1 - share)) + x @ (weight * np.log(yes[0] / yes[1])) + (1 - x) @ (weight * np.log((1 - yes[0]) / (1 - yes[1])))
        posterior = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return posterior


def logistic(rows: list[np.ndarray], labels: np.ndarray, n: int, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias for rows of feature indexes and soft labels: gradient steps scaled by each weight's history."""
    size = np.array([len(r) for r in rows], np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    column = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    w, b, seen, seen_b = np.zeros(n), -2.0, np.full(n, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[column], len(rows)) + b)))
        error = (p - labels) / max(1, len(rows))
        g = np.bincount(column, error[row], n) + ridge * w
        gb = error.sum()
        seen, seen_b = seen + g * g, seen_b + gb * gb
        w, b = w - rate * g / np.sqrt(seen), b - rate * gb / np.sqrt(seen_b)
    return w, float(b)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, text, toxic of labelled rows that aren't held out, about ``max_rows`` of them by hash of the id."""
    known = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & ~held_out())
             .dropDuplicates(["doc_id"]))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    return docs.select("doc_id", "text").join(known, "doc_id")


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> tuple[Lexicon, np.ndarray, float]:
    """Lexicon, weights and bias."""
    rows = training_rows(docs, labels, max_rows)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
            words = [w.lower() for w in words_of(text)]
            out.append((family(words), toxic, sorted({e for w in words for e in entries_of(w)})))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.string()))], names=["family", "toxic", "entries"])

    each = map_rows(rows, lambda: count, "family long, toxic int, entries array<string>")
    one = each.groupBy("family").agg(F.min_by(F.struct("toxic", "entries"), F.struct("toxic", F.size("entries"))).alias("x")).select("x.*")
    counts = (one.select("toxic", F.explode("entries").alias("entry")).groupBy("entry")
              .agg(F.sum("toxic").alias("yes"), F.count(F.lit(1)).alias("n"))
              .where((F.col("yes") >= MIN_TEXTS) & (F.col("yes") >= MIN_SHARE * F.col("n"))))
    # the strongest entries; a word is no entry beside its own beginning
    best = [r.entry for r in counts.orderBy(F.desc("yes"), "entry").limit(MAX_LEXICON).collect()]
    chosen: set[str] = set()
    for e in sorted(best, key=lambda e: (len(e.rstrip("*")), not e.endswith("*"))):
        stem = e.rstrip("*")
        if not any(stem[:n] + "*" in chosen for n in range(1, len(stem) + 1)):
            chosen.add(e)
    lexicon = Lexicon(sorted(chosen))

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [lexicon.find(t) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([pa.array([sorted(h) for h, _ in found], pa.list_(pa.int32())), pa.array([v.tobytes() for _, v in found], pa.binary())], names=["hits", "votes"])

    got = map_rows(rows.select("text"), lambda: vote, "hits array<int>, votes binary").collect()
    votes = np.array([np.frombuffer(r.votes, np.int8) for r in got], np.int8).reshape(len(got), N_LISTS + 4)
    soft = label_model(votes)
    weights, bias = logistic([features(set(r.hits), v, lexicon) for r, v in zip(got, votes, strict=True)], soft, len(lexicon.entries) + 4)
    return lexicon, weights, bias


def features(hits: set[int], votes: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Indexes of a text's features: its entries, then the pattern voters that said yes."""
    return np.array([*sorted(hits), *(len(lexicon.entries) + np.flatnonzero(votes[N_LISTS:])).tolist()], np.int64)


def score(docs: DataFrame, model: tuple[Lexicon, np.ndarray, float]) -> DataFrame:
    """doc_id and the score of each text of ``doc_id, text``."""
    lexicon, weights, bias = model

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = np.array([bias + weights[features(*lexicon.find(t), lexicon)].sum() for t in texts_of(batch)])
        p = 1 / (1 + np.exp(-z)) if lexicon.entries else np.zeros(len(z))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])
    return map_rows(docs.select("doc_id", "text"), lambda: step, "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scores = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= PREDICT_FROM, 1).otherwise(0).alias("predicted"))
