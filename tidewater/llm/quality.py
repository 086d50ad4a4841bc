"""Quality rules, line first.

Each line is judged on its own, by its characters and words:

* punctuation: more than ``max_symbol_share`` of its visible characters are symbols of ``[#*$%&|<>]`` or braces, or it
  has words and no letter or digit at all;
* navigation: at least ``menu_items`` short items stand between menu separators (``|``, ``»``, ``›``, ``>``, ``·``), or the
  whole line is a menu phrase;
* boilerplate: it has phrases of a fixed list (scripts, cookies, rights, filler) and little else (at most
  ``FEW_WORDS`` words besides for each different phrase), is filler by half of its words, or repeats an earlier line of
  the document. A longer line that mentions a phrase is text.
* repetition: over half of its words stand next to the same word.

Lines that fail are removed; a document is rejected if less than ``min_kept_share`` of its visible characters stay. The
base rules (under 50 words, or over half of the words in repeated windows of three words) reject a document before.
One pass over the rows, no shuffle: the state is one document.

Defined results: a null or empty text has no words, fails the base rules and is not kept; repeated rows are judged one
by one; an empty table gives no row; further columns stay with ``clean`` and are ignored by the digest query.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import map_rows, read_table

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_SYMBOL_SHARE, MENU_ITEMS, MIN_KEPT_SHARE = 0.1, 3, 0.7
SYMBOLS = "#*$%&|<>"
SYMBOL_BYTES = SYMBOLS.encode() + b"{}~^=\\_"
SEPARATORS = re.compile(r"\s*[|»›>·]\s*")
#: Phrases of page furniture, lower case.
BOILERPLATE = ("lorem ipsum", "javascript", "cookie", "all rights reserved", "terms of use", "terms of service", "privacy policy", "sign up for our newsletter", "subscribe to", "click here", "page not found", "read more")
MENU = frozenset(("home", "about", "about us", "contact", "contact us", "login", "log in", "sign in", "sign up", "menu", "search", "next", "previous", "back", "back to top", "share", "print", "skip to content"))
BOILERPLATE_RE = re.compile(f"({'|'.join(map(re.escape, BOILERPLATE))})\\w*")
#: Words that page furniture has besides each phrase.
FEW_WORDS = 8
#: The words of filler text, which is a line's own however long it is.
FILLER = frozenset("lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
WORD_RE = re.compile(r"\w+")
CONTINUATION = bytes(range(0x80, 0xC0))


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three words that the text has at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    n, reach = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 3 - max(i, reach)
            reach = i + 3
    return n


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()  # bytes: ASCII white space, \x09 to \x0D and blank
    chars = sum(map(len, words)) - (len(text) - len(text.translate(None, CONTINUATION)))
    symbols = len(text) - len(text.translate(None, SYMBOLS.encode()))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    return len(words), chars, symbols, dup, repeat_words(words)


def is_furniture(low: str) -> bool:
    """Whether phrases of ``BOILERPLATE`` make up most of a line in lower case."""
    found = set(BOILERPLATE_RE.findall(low))
    if not found:
        return False
    besides = sum(any(map(str.isalnum, w)) for w in BOILERPLATE_RE.sub("", low).split())
    if besides <= FEW_WORDS * len(found):
        return True
    words = WORD_RE.findall(low) if "lorem ipsum" in found else []
    return 2 * sum(w in FILLER for w in words) > len(words)


def line_fails(line: bytes) -> str | None:
    """The rule that a line with a word breaks, None if it passes."""
    text = line.decode("utf-8", "replace")
    low = text.strip().lower()
    if low in MENU:
        return "navigation"
    if b"|" in line or b">" in line or not line.isascii():
        items = SEPARATORS.split(low)
        if len(items) >= MENU_ITEMS and all(len(i.split()) <= 3 for i in items):
            return "navigation"
    visible = len(line.translate(None, b" \t\n\r\x0b\x0c"))
    if len(line) - len(line.translate(None, SYMBOL_BYTES)) > MAX_SYMBOL_SHARE * visible or not any(map(str.isalnum, text)):
        return "punctuation"
    if is_furniture(low):
        return "boilerplate"
    words = line.split()
    if len(words) >= 8 and sum(a == b for a, b in zip(words, words[1:], strict=False)) * 2 > len(words):
        return "repetition"
    return None


def judged(text: bytes) -> Iterator[tuple[bytes, str | None]]:
    """Each line and the rule it breaks; a line without a word breaks none."""
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        if not line or line.isspace():
            yield line, None
        elif line in seen:
            yield line, "boilerplate"
        else:
            seen.add(line)
            yield line, line_fails(line)


def verdict(text: bytes) -> tuple[bool, bool, list[bytes], tuple[int, int, int, int, int]]:
    """base_failed, kept, the lines that pass, the base counts."""
    counts = base(text)
    n_words, n_repeat = counts[0], counts[4]
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    lines = list(judged(text))
    kept = [line for line, rule in lines if rule is None]
    total = len(text.translate(None, b" \t\n\r\x0b\x0c"))
    stays = sum(len(line.translate(None, b" \t\n\r\x0b\x0c")) for line in kept)
    return failed, not failed and stays >= MIN_KEPT_SHARE * total, kept, counts


def as_bytes(value: pa.StringScalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def quality(docs: DataFrame) -> DataFrame:
    """For each row of ``doc_id, text``: the base counts, base_failed, kept, and how many lines each rule removed."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed"]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for value in batch.column("text"):
            text = as_bytes(value)
            failed, kept, lines, counts = verdict(text)
            rows.append((*counts, failed, kept, text.count(b"\n") + 1 - len(lines)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, zip(*rows, strict=True))], names=names)
    return map_rows(docs.select("doc_id", "text"), lambda: step, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, their text without the lines that fail; all columns as they were."""
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, keep = [], []
        at = batch.schema.get_field_index("text")
        for value in batch.column(at):
            _, kept, lines, _ = verdict(as_bytes(value))
            keep.append(kept)
            if kept:
                texts.append(b"\n".join(lines).decode("utf-8", "replace"))
        out = batch.filter(pa.array(keep, pa.bool_()))
        return out.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
    return docs.mapInArrow(lambda batches: map(step, (b for b in batches if b.num_rows)), docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"))
