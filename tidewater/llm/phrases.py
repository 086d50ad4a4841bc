"""Phrase collocations of each language by best-first branch-and-bound growth.

A phrase with the first word w is a cut of w and a rest that is no rarer than the phrase, so its score is at most
1000 n / f(w): words bound all phrases that grow from them. Words are expanded best bound first, that is rarest first
(among those frequent enough): a frontier takes all words up to a frequency, its phrases grow word by word from prefixes
that are frequent themselves, and are scored and held against longer ones. A language is settled when its last wanted
score is over the bound of every word not expanded (a tie could still move ranks), or when all its words are expanded;
the others go on with a frontier of ``STEP`` times the frequency.

The corpus is split into words once, and written as runs of word hashes with each run's word counts. (Should two words
of a language share a hash, that pass is done again with another seed, so counts are exact.) Every growth step reads
those runs, keeps the places where the prefix may be frequent by a Bloom filter of a set size (``BITS``, twice set per
phrase; what passes wrongly is counted and dropped later), and sums equal phrases of a run before they are shuffled. Nothing is
broadcast but filters; hot phrases are summed before and after the shuffle.

A phrase is inside a longer one as frequent exactly if all its occurrences have the same neighbour on one side, so each
count carries the least and greatest neighbour on both sides.

Defined results: a null or empty text has no words; a null lang is ``und``; rows that repeat count as often as they
are there, with or without doc_id; a text of any length is read whole, no phrase crosses two texts; ties in score go by
count, then by the phrase's UTF-8 bytes; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewater.llm.common import map_rows, mix64, read_table, saved, small_batches

MOST_WORDS, LEAST, WANTED = 5, 100, 2000
#: Frequency of the first frontier's words, in units of the least frequency, and its growth.
FIRST, STEP = 8, 16
#: Bits of a filter, and bytes of text in a run.
BITS, RUN_BYTES = 1 << 24, 1 << 20
#: Words whose hashes a task remembers.
KNOWN = 100_000
#: Bytes of rows passed to Python at a time, and rows read at a time: a run's row is about as long as its text.
BATCH, ROWS = "4m", 16
SEPARATORS = r"[.,;:!?\n\v\f\r]+"


def hash_of(word: str, seed: int) -> int:
    """A hash other than 0 as a signed number."""
    h = xxhash.xxh3_64_intdigest(word.encode(), seed) or 1
    return h - (1 << 64) if h >> 63 else h


class Hashes(dict):
    """The hash of a word and a second one that tells apart words of one hash. ``fresh`` gets the words not remembered."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed, self.fresh = seed, []

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= KNOWN:
            self.clear()
        self.fresh.append(word)
        self[word] = both = hash_of(word, self.seed), hash_of(word, ~self.seed & 0xFFFF)
        return both


def runs(docs: DataFrame, seed: int) -> DataFrame:
    """lang, tokens (64-bit hashes of words, 0 where a piece ends), hashes, seconds (second hashes), counts, and as words
    and named the words that the task didn't see before and their hashes, of runs of texts."""
    def make():
        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between batches
        known = Hashes(seed)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs = batch.column("lang").fill_null("und").dictionary_encode()
            out = []
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column("text").filter(pc.equal(langs.indices, k)).fill_null("")
                size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
                at = 0
                while at < len(texts):
                    to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + RUN_BYTES)))
                    out.append((lang, *coded(texts.slice(at, to - at), known)))
                    at = to
            longs = pa.list_(pa.int64())
            kinds = (pa.string(), pa.binary(), longs, longs, longs, pa.list_(pa.string()), longs)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["lang", "tokens", "hashes", "seconds", "counts", "words", "named"])

        return run

    return map_rows(docs.select("lang", "text"), make, "lang string, tokens binary, hashes array<long>, seconds array<long>, counts array<long>, words array<string>, named array<long>")


def coded(texts: pa.Array, known: Hashes) -> tuple:
    """The hashes of the words of texts with a 0 before each piece; both hashes and the count of each different word;
    the words that are new to ``known`` and their hashes."""
    texts = pc.replace_substring_regex(pc.ascii_lower(texts), SEPARATORS, " \n ")
    texts = pc.replace_substring(pc.binary_join_element_wise("\n", texts, " "), "\t", " ")
    words = pc.split_pattern(texts, " ").flatten().dictionary_encode()
    different = words.dictionary.to_pylist()
    codes = words.indices.to_numpy()
    count = np.bincount(codes, minlength=len(different))
    real = np.array([w not in ("", "\n") for w in different], bool)
    known.fresh = []
    both = np.array([known[w] if r else (0, 0) for w, r in zip(different, real.tolist(), strict=True)], np.int64).reshape(-1, 2)
    if "" in different:
        codes = codes[codes != different.index("")]
    return np.append(both[codes, 0], 0).tobytes(), both[real, 0], both[real, 1], count[real], known.fresh, [hash_of(w, known.seed) for w in known.fresh]


def start_of(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def grown(h: np.ndarray | np.uint64, words: np.ndarray) -> np.ndarray:
    """The hashes of phrases (any number of words; 0 words: ``start_of``) with one more word each."""
    return mix64((h ^ words.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))


def places_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(BITS - 1)).astype(np.int64), (h >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)


def filter_of(phrases: DataFrame):
    """A broadcast Bloom filter of phrases (lang, p: array of word hashes), of ``BITS`` bits whatever their number."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for lang, p in zip(batch.column("lang").to_pylist(), batch.column("p").to_pylist(), strict=True):
            h = start_of(lang)
            for word in np.array(p, np.int64):
                h = grown(h, np.array([word]))[0]
            out += [int(x[0]) for x in places_of(np.array([h]))]
        return pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["place"])

    place = F.col("place")
    bits = map_rows(phrases.select("lang", "p"), lambda: run, "place long").groupBy((place / 32).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int"))).alias("bits"))
    found = bits.toArrow()  # at most BITS / 32 rows
    filled = np.zeros(BITS // 32, np.uint32)
    filled[found.column("at").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return phrases.sparkSession.sparkContext.broadcast(filled.tobytes())


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = places_of(h)
    first = (bits[a >> 5] >> (a & 31).astype(np.uint32)) & 1
    return (first & (bits[b >> 5] >> (b & 31).astype(np.uint32))).astype(bool)


def summed(words: list[np.ndarray], h: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
    """Equal phrases of a run as one: words, count, least and greatest word before and after."""
    order = np.argsort(h, kind="stable")
    words, h, before, after = [w[order] for w in words], h[order], before[order], after[order]
    new = np.append(True, h[1:] != h[:-1])
    for w in words:  # unlike phrases of one hash stay apart, if perhaps in several rows
        new[1:] |= w[1:] != w[:-1]
    first = np.flatnonzero(new)
    return [np.stack([w[first] for w in words], 1), np.diff(np.append(first, len(h))), np.minimum.reduceat(before, first), np.maximum.reduceat(before, first), np.minimum.reduceat(after, first), np.maximum.reduceat(after, first)]


def counted(corpus: DataFrame, lengths: dict[int, dict], may_follow, least: int) -> DataFrame:
    """lang, p, a, alone: the phrases of each length in ``lengths`` that occur ``least`` times or more and pass its filters
    (length of a prefix -> filter of phrases); ``may_follow``: the filter of frequent words, others are in no phrase. ``alone``: no occurrence-wide neighbour on either side."""
    def make():
        pa.set_memory_pool(pa.system_memory_pool())
        filters = {m: {k: np.frombuffer(f.value, np.uint32) for k, f in each.items()} for m, each in lengths.items()}
        follow = np.frombuffer(may_follow.value, np.uint32)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            for lang, tokens in zip(batch.column("lang").to_pylist(), batch.column("tokens"), strict=True):
                t = np.frombuffer(tokens.as_buffer(), np.int64)
                t = np.append(t, np.zeros(MOST_WORDS, np.int64))
                starts: dict = {}
                for m, each in filters.items():
                    at, h = np.flatnonzero(t), None
                    for k in range(1, m + 1):
                        done = starts.get((k, id(each.get(1)))) if k == 1 else None
                        if done is not None:
                            at, h = done
                            continue
                        word = t[at + (k - 1)]
                        inside = word != 0
                        if k > 1:
                            inside[inside] = passes(follow, grown(start_of(lang), word[inside]))
                        at, word = at[inside], word[inside]
                        h = grown(start_of(lang) if h is None else h[inside], word)
                        if k in each:
                            held = passes(each[k], h)
                            at, h = at[held], h[held]
                        if k == 1:
                            starts[1, id(each.get(1))] = at, h
                    if len(at):
                        out.append((lang, *summed([t[at + j] for j in range(m)], h, t[at - 1], t[at + m])))
            if not out:
                return None
            n = [len(x[1]) for x in out]
            width = np.repeat([x[1].shape[1] for x in out], n)
            p = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(width)).astype(np.int32)), pa.array(np.concatenate([x[1].ravel() for x in out])))
            langs = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(out)), n).astype(np.int32)), pa.array([x[0] for x in out])).cast(pa.string())
            return pa.RecordBatch.from_arrays([langs, p, *(pa.array(np.concatenate([x[j] for x in out])) for j in range(2, 7))], names=["lang", "p", "c", "b0", "b1", "a0", "a1"])

        return run

    each = map_rows(corpus.select("lang", "tokens"), make, "lang string, p array<long>, c long, b0 long, b1 long, a0 long, a1 long")
    total = each.groupBy("lang", "p").agg(F.sum("c").alias("a"), F.min("b0").alias("b0"), F.max("b1").alias("b1"), F.min("a0").alias("a0"), F.max("a1").alias("a1")).where(F.col("a") >= least)
    alone = ~((F.col("b0") == F.col("b1")) & (F.col("b0") != 0)) & ~((F.col("a0") == F.col("a1")) & (F.col("a0") != 0))
    return total.select("lang", "p", "a", alone.alias("alone"))


def scored(found: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, p, a, l, r, n, score of phrases (lang, p, a): the cut of the lowest score, the first of equal ones."""
    size = F.size("p")
    cuts = found.select("lang", "p", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("x"), F.slice("p", F.col("k") + 1, size - F.col("k")).alias("y"))
    left = counts.select("lang", F.col("p").alias("x"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("p").alias("y"), F.col("a").alias("r"))
    cuts = cuts.join(left, ["lang", "x"]).join(right, ["lang", "y"]).join(totals.select("lang", "n"), "lang")
    return cuts.withColumn("score", lift("a", "n", "l", "r")).groupBy("lang", "p", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "p", "a", "best.l", "best.r", "n", "best.score")


def lift(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)) in decimals of up to 38 digits: exact for counts below 10^15."""
    wide = lambda c: f"cast({c} as decimal(15, 0))"
    return F.expr(f"(cast(1000 as decimal(4, 0)) * {wide(a)} * {wide(n)}) div ({wide(left)} * {wide(right)})")


def names(corpus: DataFrame) -> DataFrame:
    """hashes, word: one row for each word, however many runs name it."""
    each = corpus.select(F.inline(F.arrays_zip(F.col("named").alias("hashes"), F.col("words").alias("word"))))
    return each.groupBy("hashes").agg(F.min("word").alias("word"))


def collocations(docs: DataFrame, least: int = LEAST, wanted: int = WANTED, most_words: int = MOST_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``wanted`` phrases."""
    with small_batches(docs.sparkSession, BATCH, ROWS):
        return found_in(docs, least, wanted, most_words)


def found_in(docs: DataFrame, least: int, wanted: int, most_words: int) -> DataFrame:
    for seed in range(1 << 30):
        corpus = saved(runs(docs, seed), "phrases-corpus")
        each = corpus.select("lang", F.inline(F.arrays_zip("hashes", "seconds", "counts")))
        words = saved(each.groupBy("lang", "hashes").agg(F.sum("counts").alias("a"), F.min("seconds").alias("second"), F.max("seconds").alias("other")), "phrases-words")
        if words.groupBy("hashes").agg(F.min("second").alias("x"), F.max("other").alias("y")).where("x <> y").isEmpty():
            break
    often = words.where(F.col("a") >= least)
    frequent = saved(often.join(names(corpus), "hashes").select("lang", F.array("hashes").alias("p"), "a", "word"), "phrases-frequent")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"), F.max("a").alias("most"))
    open_langs = saved(totals.where(F.col("most") >= least), "phrases-langs")
    totals = open_langs
    may_follow = filter_of(frequent)
    counts, results = frequent.select("lang", "p", "a"), None
    low, high = least - 1, least * FIRST
    while not open_langs.isEmpty():
        frontier = frequent.where((F.col("a") > low) & (F.col("a") <= high)).join(open_langs.select("lang"), "lang", "left_semi").select("lang", "p", "a")
        here = corpus.join(F.broadcast(open_langs.select("lang")), "lang", "left_semi") if few(open_langs) else corpus.join(open_langs.select("lang"), "lang", "left_semi")
        filters, new = {1: filter_of(frontier)}, None
        for m in range(2, most_words + 1):
            level = counted(here, {m: filters}, may_follow, least)
            first = frontier.select("lang", F.col("p")[0].alias("first"))  # what passed wrongly belongs to another frontier
            level = saved(level.withColumn("first", F.col("p")[0]).join(first, ["lang", "first"], "left_semi").drop("first"), f"phrases-{m}")
            new = level if new is None else new.unionByName(level)
            if level.isEmpty():
                break
            filters = filters | {m: filter_of(level)}
        counts = counts.unionByName(new.select("lang", "p", "a"))
        size = F.size("p")
        kept = new.where(F.col("alone") | (size == most_words))
        ends = kept.where(size > 2).select("lang", F.explode(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.slice("p", k, F.lit(most_words)))).alias("p")).distinct()
        missing = saved(ends.join(counts, ["lang", "p"], "left_anti"), "phrases-missing")
        if not missing.isEmpty():
            starts = filter_of(missing.select("lang", F.slice("p", 1, 1).alias("p")).distinct())
            more = counted(here, {m: {1: starts, m: filter_of(missing.where(size == m))} for m in range(2, most_words)}, may_follow, least)
            counts = counts.unionByName(saved(more.join(missing, ["lang", "p"], "left_semi").select("lang", "p", "a"), "phrases-ends"))
        counts = saved(counts.groupBy("lang", "p").agg(F.max("a").alias("a")), "phrases-counts")
        fresh = scored(kept, counts, totals)
        named = fresh.select("*", F.posexplode("p").alias("at", "one")).withColumn("one", F.array("one")).join(frequent.select("lang", F.col("p").alias("one"), "word"), ["lang", "one"])
        named = named.groupBy("lang", "p", "a", "l", "r", "n", "score").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ").alias("phrase"))
        best = named.select("lang", "phrase", "a", "l", "r", "n", "score")
        if results is not None:
            best = results.select(*best.columns).unionByName(best)
        order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        results = saved(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted), "phrases-best")
        last = results.where(F.col("rank") == wanted).select("lang", "score")
        bound = F.expr(f"(cast(1000 as decimal(4, 0)) * cast(n as decimal(15, 0))) div cast({high + 1} as decimal(15, 0))")
        open_langs = saved(open_langs.where(F.col("most") > high).join(last, "lang", "left").where(F.col("score").isNull() | (F.col("score") <= bound)).drop("score"), "phrases-langs")
        low, high = high, high * STEP
    if results is None:
        return frequent.selectExpr("lang", "1 AS rank", "word AS phrase", "a", "a AS l", "a AS r", "a AS n", "a AS score").limit(0)
    return results.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def few(langs: DataFrame, most: int = 1000) -> bool:
    """At most ``most`` rows, so small enough to broadcast."""
    return langs.limit(most + 1).count() <= most


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, words FROM (
    SELECT lang, [x for x in string_split_regex(piece, '[\\x20\\x09]+') if x <> ''] AS words
    FROM (SELECT lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)))),
tokens AS (SELECT piece, lang, unnest(range(1, len(words) + 1)) AS pos, words FROM pieces),
grams AS (SELECT lang, m, list_slice(words, pos, pos + m - 1) AS p FROM tokens, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE pos + m - 1 <= len(words)),
counts AS (SELECT lang, m, p, count(*)::HUGEINT AS f FROM grams GROUP BY lang, m, p),
total AS (SELECT lang, sum(f)::HUGEINT AS n FROM counts WHERE m = 1 GROUP BY lang),
found AS (SELECT lang, m, p, f AS a FROM counts WHERE m > 1 AND f >= 100),
inside AS (
  SELECT lang, p, max(f) AS f FROM (
    SELECT lang, list_slice(p, 1, m - 1) AS p, a AS f FROM found WHERE m > 2 UNION ALL SELECT lang, list_slice(p, 2, m), a FROM found WHERE m > 2) GROUP BY lang, p),
cuts AS (
  SELECT c.lang, c.p, c.a, k, x.f AS l, y.f AS r, n, (1000 * c.a * n) // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM found) c
  JOIN counts x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, k) JOIN counts y ON y.lang = c.lang AND y.p = list_slice(c.p, k + 1, c.m) JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
kept AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.p = b.p WHERE i.f IS NULL OR 100 * i.f < 100 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
