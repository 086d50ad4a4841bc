"""HTML extraction, the Merkle manifest and phrase mining against brute force, on small rows with every awkward case."""

import collections
import hashlib
import html as H
import re
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SMALL
from tidewater.llm import catalog, html, merkle, phrases

# op11

WORDS = "the morning train left before anyone in the village had time to read what the paper said about it"
PARAGRAPH = f"<p>{WORDS.capitalize()}, and {WORDS}. </p>"
BLOCK = f"{WORDS.capitalize()}, and {WORDS}."
MENU = "<ul class='menu'>" + "".join(f"<li><a href='/{i}'>Section {i}</a>" for i in range(9)) + "</ul>"
SIDE = "<div class='sidebar widget'><h3>Most read</h3><p>" + WORDS * 3 + "</p></div>"
REPLIES = "<section id='comments'><h2>9 comments</h2>" + f"<article class='comment'><p>{WORDS * 2}</p></article>" * 5 + "</section>"
FOOT = "<div id='footer'>&copy; all of us <a href='/legal'>Legal</a></div>"


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("   \n", ""), ("only text &amp; more", "only text & more"), ("<p>a<p> b \n\t c<br>d", "a\nb c d"), ("a < b <i>c</i>d", "a < b cd"), ("<!-- never ends <p>x", ""),
    ('x<a href="never ends', "x"), ("<table><tr><td>x<td>y<tr><td>z</table>", "x\ny\nz"), ("<article></article>", ""), ("&eacute;&#233;&#xe9;&notit;&lt;b&gt;", "ééé¬it;<b>"),
    ("<script>var a='</p><p>';</script><style>p{}</style><p>x</p><noscript>please</noscript>", "x"),
    (f"<body><nav>{MENU}</nav><article><h1>T</h1>{PARAGRAPH * 2}</article><footer>f</footer>", f"T\n{BLOCK}\n{BLOCK}"),
    (f"<div>{MENU}</div><div class=page><div class=main-column><h1>T</h1>{PARAGRAPH * 3}<h2>S</h2>{PARAGRAPH}</div>{SIDE}</div>{REPLIES}{FOOT}", "\n".join(["T", *[BLOCK] * 3, "S", BLOCK])),
    (f"<main>{PARAGRAPH}<div class='cookie-notice'>we use them</div><form>mail <input></form><aside>z</aside><blockquote>{WORDS}</blockquote>{REPLIES}</main>", f"{BLOCK}\n{WORDS}"),
    (f"<article class='post has-comments'><header><h1>T</h1></header>{PARAGRAPH}{REPLIES}<footer>by us</footer></article>", f"T\n{BLOCK}"),
    (f"<div class='content with-sidebar'><article>{PARAGRAPH}</article>{SIDE}</div>", BLOCK),
    (f"<body>{MENU}<td><div id=c>{PARAGRAPH * 2}<pre>a  b\n c</pre><div class=advert>buy</div></div>{FOOT}", f"{BLOCK}\n{BLOCK}\na b c"),
    (f"<div hidden>{PARAGRAPH}</div><div role=navigation>{PARAGRAPH}</div><div style='display: none'>{PARAGRAPH}</div><p>{WORDS}</p>", WORDS),
])
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_pages_of_the_table_equal_their_article(spark):
    got = {r.page_id: r for r in html.op11_html_text(spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        article = re.search("<article>(.*)</article>", r.html, re.DOTALL)[1]
        blocks = (" ".join(H.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article))
        assert got[r.page_id].text == "\n".join(x for x in blocks if x) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


@pytest.mark.parametrize("page", ['<a "' * 50000, "<" * 100000, "<b>" * 50000 + "</i>" * 5000, "<!--" * 50000, "<p>" * 50000, "<li>" * 50000, "<a b='" * 50000, "<script>" * 20000, "<p>" + "x " * 1_000_000])
def test_hostile_and_long_pages_take_linear_time(page):
    began = time.time()
    assert len(html.main_text(page)) in (0, 100000, 1_999_999)
    assert time.time() - began < 20


def test_pages_with_nulls_repeats_and_clashing_columns(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, None, None, "x", "y"), (None, "u", f"<p>{WORDS}", "x", "y"), (2, "v", "<p>x</p>", "x", "y"), (2, "v", "<p>x</p>", "x", "y")]
    got = html.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, None, "", 0), (None, "u", WORDS, len(WORDS)), (2, "v", "x", 1), (2, "v", "x", 1)]))
    assert html.extract(spark.createDataFrame([], schema)).collect() == []


# op12

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row, tampered=False):
    row = dict(row)
    if tampered and row["text"] is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
        row["text"] = row["text"].replace("\n", "")
    return sha("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def brute_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def brute_up(levels, i, node):
    """The siblings of node i of the lowest level, and what it folds to."""
    others = []
    for level in levels[:-1]:
        first = i - i % 3
        run = level[first:first + 3]
        others += [x for j, x in enumerate(run) if j != i - first]
        node = sha("".join(node if j == i - first else x for j, x in enumerate(run)))
        i //= 3
    return others, node


def brute_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["source"]].append(((r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r)), r))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_levels([k[2] for k, _ in sorted(groups[s], key=lambda x: x[0])]) for s in sources}
    top = brute_levels([trees[s][-1][0] for s in sources])
    out = []
    for at, s in enumerate(sources):
        for i, (_, r) in enumerate(sorted(groups[s], key=lambda x: x[0])):
            low, node = brute_up(trees[s], i, brute_leaf(r, True))
            high, root = brute_up(top, at, node)
            out.append((r["doc_id"], trees[s][0][i], trees[s][-1][0], top[-1][0], sha("".join(low + high)), root, root == top[-1][0]))
    return sorted(map(str, out))


def run_merkle(df, tmp_path, spark):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(str(tuple(r)) for r in merkle.op12_merkle(spark, str(tmp_path)).collect())


def test_merkle_awkward_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, i long, n string, path string"
    rows = [(k, f"line {k}\n" * (k % 5) if k % 11 else None, "en" if k % 3 else None, ["b", "a", "ä", None, "", "b"][k % 6] if k < 300 else "hot", k if k % 4 else None, "t", "d", 1, "n", "p") for k in range(1100)]
    rows += [rows[5], rows[6], (5, "other\n\n", "en", "b", 1, "t", "d", 1, "n", "p"), (None, "x\ny", "en", "a", 1, "t", "d", 1, "n", "p"), (7000, "\n" * 300000, "en", "one", 1, "t", "d", 1, "n", "p")]
    df = spark.createDataFrame(rows, schema).repartition(5)
    assert run_merkle(df, tmp_path, spark) == brute_manifest([r.asDict() for r in df.collect()])


@pytest.mark.parametrize("n", [0, 1, 2, 27, 28, 82])
def test_merkle_sizes(spark, tmp_path, n):
    df = spark.createDataFrame([(k, f"{k}\n", "en", "s", 3) for k in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
    assert run_merkle(df, tmp_path, spark) == brute_manifest([r.asDict() for r in df.collect()])


def test_merkle_many_sources(spark, tmp_path):
    df = spark.createDataFrame([(k, f"{k}\n", "en", f"s{k}", 3) for k in range(100)], "doc_id long, text string, lang string, source string, n_chars long")
    assert run_merkle(df, tmp_path, spark) == brute_manifest([r.asDict() for r in df.collect()])


@pytest.mark.parametrize("name", ["op12_merkle", "op13_phrases"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = catalog.queries()[name](spark, SMALL)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want.project(", ".join(got.columns)).fetchall()))


# op13


def brute_phrases(rows, least, wanted):
    f = collections.defaultdict(collections.Counter)
    n = collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                f[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for q, b in found.items():
            gone.update(p for i in range(len(q)) for j in range(i + 2, len(q) + 1) if (p := q[i:j]) != q and 100 * b >= 100 * found[p])
        rank = []
        for p, a in found.items():
            if p not in gone:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rank.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rank)[:wanted])]
    return sorted(out)


ODD = [("en", "A b c d e f g. a b c d e f\x0bz a  b\tc"), ("en", "a a a a a a a a"), ("en", None), ("en", ""), (None, "x y, x y; X Y? x y\x1cz x y"), ("und", "x y x y"), ("de", "Äß ß\x00 äß ß\x00 Äß ß\x00  x"),
       ("en", "e d c b a . e d c b a " * 3), ("de", "der der der " * 9), ("en", "p q r s t u v w " * 4), ("en", " . \n \t ,")]


@pytest.mark.parametrize(("least", "wanted"), [(2, 1000), (2, 3), (3, 7), (4, 1), (500, 5)])
def test_phrases_awkward_rows(spark, least, wanted):
    rows = ODD + ODD[:3]
    df = spark.createDataFrame([(i, lang, text, "x", 1) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, p string, a long").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(df, least, wanted).collect())
    assert got == brute_phrases(rows, least, wanted)


def test_phrases_settle_early_and_exactly(spark):
    """Low frequencies come first; few are wanted, so later frontiers are never expanded."""
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(df, 4, 25).collect()) == brute_phrases(rows, 4, 25)


def test_phrases_of_no_rows_and_the_lift(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    n = [10**14 + 7, 10**14 + 9, 10**13 + 1, 12345]
    row = spark.createDataFrame([tuple(n)], "a long, n long, l long, r long").select(phrases.lift("a", "n", "l", "r").alias("x")).first()
    assert row.x == 1000 * n[0] * n[1] // (n[2] * n[3])


def test_phrases_filter_holds_all_of_its_phrases(spark):
    df = spark.range(5000).select(F.lit("en").alias("lang"), F.array("id", F.col("id") * 7).alias("p"))
    bits = phrases.np.frombuffer(phrases.filter_of(df).value, phrases.np.uint32)
    words = phrases.np.arange(10000)
    held = phrases.passes(bits, phrases.grown(phrases.grown(phrases.start_of("en"), words), words * 7))
    assert held[:5000].all() and held[5000:].mean() < 0.01


def test_phrases_words_are_named_once_before_any_join(spark, monkeypatch):
    """Many runs name the same words; what joins the frequent words has a row a word."""
    runs = spark.createDataFrame([([1, 2, 3], ["a", "b", "c"])] * 40 + [([4, 1], ["d", "a"])], "named array<long>, words array<string>").repartition(5)
    assert sorted(map(tuple, phrases.names(runs).collect())) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    joins = []
    real = type(runs).join
    monkeypatch.setattr(type(runs), "join", lambda self, other, on=None, how=None: joins.append((on, how)) or real(self, other, on, how))
    df = spark.createDataFrame([("en", "a b c a b d")] * 5, "lang string, text string")
    assert phrases.collocations(df, 3, 5).count() > 0
    assert [how for on, how in joins if on == "hashes"] == [None]  # all runs' rows met the frequent words in a left_semi one
