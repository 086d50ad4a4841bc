"""Main text of web pages by composite text density.

A page becomes a tree of elements. Elements that never hold article text go first: by tag (scripts, styles, menus, forms,
footers, sidebars ...), by role, by hidden state and by the words of their class and id (``NOISE_WORDS``), unless they
hold an article themselves. For every element that is left, with C characters, T tags, LC link characters and LT link
tags below it (1 where a divisor is 0; b: the body), the composite density is

    C/T * log base ln(C/(C-LC) * LC + LC_b/C_b * C + e) of (C/LC * T/LT)

and its density sum is that of its children's densities. The element of the greatest sum holds the article; the least
density on its path up to the body is the threshold, and beside it every element of that density or more gives the
element of the greatest sum under it. Inside an ``article`` or ``main`` element the whole of it is the article, and
nothing outside of it.

The text: character references decoded, white space of a block one space, trimmed, blocks without text left out, blocks
in page order joined by a newline. ``br`` is white space.

Defined results: a null or empty page and one without text give the empty text; markup is read as browsers do where it
is broken (elements without an end, quotes or comments that never end, stray ends); a page of any length is read in one pass and none
of its text is cut; repeated rows are results of their own; url and page_id, null or not, are passed on; an empty
table gives no row; further columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import map_rows, read_table, texts_of

VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table
tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tag -> open elements that it ends, and those beyond which it doesn't look.
IMPLIED = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"), "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th caption colgroup", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"),
    "tbody": ("tbody thead tfoot tr td th caption colgroup", "table"), "thead": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "tfoot": ("tbody thead tfoot tr td th caption colgroup", "table"), "a": ("a", "td th table button"), "button": ("button", "table"),
}
IMPLIED = {tag: (frozenset(ends.split()), frozenset(stop.split())) for tag, (ends, stop) in IMPLIED.items()}
#: An open paragraph ends before these, but not beyond the elements of ``SCOPE``.
ENDS_P = BLOCK - frozenset("body caption dd dt frameset html legend li optgroup option tbody td tfoot th thead tr".split()) | {"dd", "dt", "li"}
SCOPE = frozenset("table td th caption button object html body".split())

NOISE_TAGS = frozenset("""head script style noscript template iframe object embed applet canvas audio video svg math nav menu footer aside form
fieldset button select option optgroup datalist textarea input dialog search title noembed noframes frameset""".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset("""ad ads advert adverts advertisement advertisements adsense banner banners breadcrumb breadcrumbs comment comments commentlist
consent cookie cookies disclaimer disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice
notices overlay pager pagination popup promo promos promotion recommended related reply replies respond share sharing sidebar sidebars
signup skip social sponsor sponsored sponsors subscribe subscription tagcloud teaser teasers toolbar widget widgets""".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>|(!--)|[!?/][^>]*+>)""")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")


class Node:
    __slots__ = ("tag", "parent", "children", "noise", "holds", "titled", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, noise: str = ""):
        """``noise``: '' for no noise, 'tag' for a sure one, 'word' for one by the words of class and id."""
        self.tag, self.parent, self.children, self.noise, self.holds = tag, parent, [], noise, False


def noise_of(tag: str, attributes: str, inside: bool) -> str:
    """Whether an element is no article text. ``inside``: it is in an article or main element."""
    if tag in NOISE_TAGS or tag == "header" and not inside:
        return "tag"
    if not attributes.strip(" /\t\n") or tag in ("html", "body", "main"):
        return ""
    words = set()
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            words.update(w.lower() for w in WORDS.findall(html.unescape(value)))
        elif name == "role" and value.strip().lower() in NOISE_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "tag"
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "tag"
    if not words & NOISE_WORDS or inside and words & NOISE_WORDS == {"header"}:
        return ""
    return "word"


def parse(page: str) -> Node:
    """The tree of a page: nodes and, as strings, the decoded texts between them."""
    root = here = Node("html", None)
    open_tags: Counter[str] = Counter()
    at, end = 0, len(page)

    def pop_to(node: Node) -> Node:
        """Close ``node`` and all in it."""
        nonlocal here
        while True:
            closed, here = here, here.parent
            open_tags[closed.tag] -= 1
            if closed is node:
                return here

    def find(tags: frozenset, stop: frozenset) -> Node | None:
        node = here
        while node.parent is not None:
            if node.tag in tags:
                return node
            if node.tag in stop:
                return None
            node = node.parent
        return None

    while at < end:
        to = page.find("<", at)
        if to < 0:
            to = end
        if to > at:
            here.children.append(html.unescape(page[at:to]))
        if to == end:
            break
        follows = page[to + 1:to + 2]
        if not (follows.isalpha() and follows.isascii() or follows in ("/", "!", "?")) or follows == "/" and not page[to + 2:to + 3]:
            here.children.append("<")  # no tag
            at = to + 1
            continue
        m = TAG.match(page, to)
        if m is None:
            break  # a tag that never ends is dropped with what it holds
        at = m.end()
        if m[4]:
            ended = None if page.startswith((">", "->"), at) else COMMENT_END.search(page, at)
            at = page.index(">", at) + 1 if page.startswith((">", "->"), at) else ended.end() if ended else end
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            if not open_tags[tag] or tag in ("html", "body"):
                if tag == "br":
                    here.children.append(" ")
                continue
            if tag in BLOCK:
                node = find(frozenset([tag]), frozenset() if tag not in ("p", "li") else SCOPE)
            else:
                node = find(frozenset([tag]), BLOCK)  # an inline end doesn't end blocks
            if node is not None:
                pop_to(node)
            continue
        if tag in ("html", "body") or tag == "head" and open_tags["head"]:
            if tag == "body" and open_tags["head"]:
                pop_to(find(frozenset(["head"]), frozenset()))
            continue
        if open_tags["head"] and tag not in RAW and tag not in VOID and tag not in ("noscript", "template"):
            pop_to(find(frozenset(["head"]), frozenset()))
        if tag in ENDS_P and open_tags["p"] and (node := find(frozenset(["p"]), SCOPE)) is not None:
            pop_to(node)
        if tag in HEADINGS and here.tag in HEADINGS:
            pop_to(here)
        if tag in IMPLIED:
            ends, stop = IMPLIED[tag]
            while any(open_tags[t] for t in ends) and (node := find(ends, stop)) is not None:
                pop_to(node)
        if tag == "br":
            here.children.append(" ")
            continue
        node = Node(tag, here, noise_of(tag, m[3], bool(open_tags["article"] or open_tags["main"])))
        here.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "math", "path")):
            here = node
            open_tags[tag] += 1
    return root


def in_order(root: Node) -> list[Node]:
    """The nodes that are no noise, parents before children."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return order


def prune(root: Node) -> list[Node]:
    """Take noise out of the tree; the rest in order."""
    order = in_order(root)
    below = set()
    for node in order:
        if node.parent is not None and (node.parent.noise or id(node.parent) in below):
            below.add(id(node))
    homes = [node for node in order if node.tag in ("article", "main") and node.noise != "tag" and id(node) not in below]
    if all(node.noise for node in homes):  # words of its class don't make the only article noise
        for node in homes:
            node.noise = ""
    for node in reversed(order):
        parts = [c for c in node.children if isinstance(c, Node) and c.noise != "tag"]
        node.chars = sum(len(c) for c in node.children if isinstance(c, str)) + sum(c.chars for c in parts)
        node.titled = node.tag == "h1" or any(c.titled for c in parts)
        node.holds = node.tag in ("article", "main") and not node.noise or any(c.holds for c in parts)
    for node in order:  # nor do those of the element with the title and most of the text
        node.holds |= node.titled and 2 * node.chars > root.chars
    for node in order:
        # a wrapper named after a part that it has beside the article is no noise
        node.children = [c for c in node.children if isinstance(c, str) or not c.noise or c.noise == "word" and c.holds]
    return in_order(root)


def measure(order: list[Node]) -> None:
    """The composite density of each node, and the sum of its children's."""
    for node in reversed(order):
        link = node.tag == "a"
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len("".join(c.split()))
            else:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if link:
            node.link_chars = node.chars
    body = order[0]
    share = body.link_chars / (body.chars or 1)
    for node in order:
        c, t, lc, lt = node.chars, node.tags or 1, node.link_chars or 1, node.link_tags or 1
        if not node.chars:
            node.density = 0.0
            continue
        base = math.log(c / ((c - node.link_chars) or 1) * node.link_chars + share * c + math.e)
        value = c / lc * (t / lt)
        # all text linked and few tags: no density rather than a negative one
        node.density = c / t * (math.log(value) / math.log(base) if base > 1 + 1e-12 else math.log(value + math.e - 1)) if value > 1 else 0.0
    for node in order:
        node.sum = sum(c.density for c in node.children if isinstance(c, Node))


def content(order: list[Node]) -> set[int]:
    """The ids of the nodes whose whole subtrees are the article."""
    best = order[0]
    for node in order:
        if node.sum > best.sum:
            best = node
    threshold, up, home = best.density, best, None
    while up is not None:
        threshold = min(threshold, up.density)
        if home is None and up.tag in ("article", "main"):
            home = up
        up = up.parent
    if home is None:
        homes = [node for node in order if node.tag in ("article", "main") and node.chars]
        home = max(homes, key=lambda node: node.chars, default=None)
    if home is not None:
        return {id(home)}
    # greatest sum under each node; subtrees are runs of the order
    size = {id(node): 1 + node.tags for node in order}
    top = [0.0] * len(order)
    place = {id(node): i for i, node in enumerate(order)}
    most: list[Node] = list(order)
    for i in range(len(order) - 1, -1, -1):
        top[i] = order[i].sum
        for c in order[i].children:
            if isinstance(c, Node) and top[place[id(c)]] > top[i]:
                top[i], most[i] = top[place[id(c)]], most[place[id(c)]]
    chosen, i = {id(best)}, 0
    while i < len(order):
        node = order[i]
        if id(node) in chosen or most[i] is node and node.density >= threshold and node is not order[0]:
            chosen.add(id(node))
            i += size[id(node)]
        elif node.density >= threshold:
            if node is not order[0] and most[i] is not best and best is not node:
                chosen.add(id(most[i]))
            i += 1
        else:
            i += 1 if any(True for _ in node.children) else size[id(node)]
    return chosen


def text_of(root: Node, chosen: set[int]) -> str:
    """The blocks of the chosen subtrees in page order."""
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            words = "".join(parts).split()
            parts.clear()
            if words:
                blocks.append(" ".join(words))

    stack: list = [(root, False, 0)]
    while stack:
        node, on, at = stack.pop()
        if at == 0:
            on = on or id(node) in chosen
            if node.tag in BLOCK:
                flush()
        while at < len(node.children):
            c = node.children[at]
            at += 1
            if isinstance(c, str):
                if on:
                    parts.append(c)
            else:
                stack.append((node, on, at))
                stack.append((c, on, 0))
                break
        else:
            if node.tag in BLOCK or id(node) in chosen:
                flush()
    flush()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    order = prune(root)
    measure(order)
    if not order[0].chars:
        return ""
    return text_of(root, content(order))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of pages."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(page) for page in texts_of(batch, column)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_rows(pages.select("page_id", "url", column), lambda: run, "page_id long, url string, text string, n_chars long")


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
