"""Main text of pages by a site style tree.

The pages of a host are merged into one tree, whose nodes are the paths of block elements (tag and class at each
step). A node's presentation is the sequence of its child elements (repeated items of a list or table count once), its
content the text of its blocks. Over the m pages that have a node:

    presentation importance = - sum_i p_i log_m p_i over its presentations,
    content importance      = 1 - mean_a log_m(c_a) over its distinct texts, c_a the number of pages that have text a
                              (the entropy of a text that is spread evenly over c_a of the m pages),
    composite importance    = (1 - g^l) * presentation + g^l * content, l presentations, g = 0.9; both are 1 for m = 1.

So what the pages of a host share is unimportant; a branch that only one page fills so, or whose make-up changes from
page to page, is important. Pages of a host with the same blocks count once. The tree is never gathered: its counts
come from an aggregation keyed by host, node and value, so a host may hold any share of all pages. Only nodes that
SUPPORT pages and the SHARE of the host's pages have are judged, as what only a few copies of an article have tells
nothing. A node is low if its composite importance is below THRESHOLD. It is high if the presentation's part of it,
(1 - g^l) * presentation, is at least HIGH: an article's paragraphs, quotes and lists follow each other differently on
each page, whereas menus, advertisements and footers are laid out alike however their texts change.

Which blocks of a page stay:

1. The tree finds the main part: the page's blocks in high branches, and its h1. On a host of TRUSTED pages or more it has
   the first word: branches beside the high ones are of low importance there and go, whatever their tags. On smaller
   hosts, and where the tree is silent, as on a host of articles that are all laid out alike, an `article` or `main` is
   the main part: taken whole where it holds, or lies in, a high branch, and also apart from them. found_by tells which
   it was.
2. From it low nodes go, but no unmarked block of an article or main: copies of an article with another title, or
   articles of one title, are still articles. Without any main part all but low nodes stays; where low nodes are all of a
   page's paragraphs (without paragraphs, all but headings), all unmarked blocks stay.
3. Marks break ties inside the main part: elements that are boilerplate by their own mark (navigation, footers, asides,
   forms, advertisements, notices, comments, by tag, role, class or id; see below) go, as the tree can't tell a reader's
   comments from an article: both are new on every page. Headings in an article's header stay.

A class, id or role marks a branch if it is one of WORDS as a whole (`comments`) or a known compound (`comment-list`,
`site-footer`). Other slugs with such a word (`has-comments`, `related-work`) and `header` mark it weakly: also in an
article, a weakly marked block goes if its node is low. A heading's id marks nothing. Forms, dialogs, headers and named
branches that are or hold an article or main (one within another article doesn't count), and forms without such a name
around an h1 (outside of main parts, any heading or paragraph), aren't marked. Where every article of a page lies in
marked branches, only the marks inside them count; where nothing at all is left, what is marked by name alone stays
unless it is low.

Text: character references are decoded, white space within a block becomes one space, blocks are joined by a line
break. `br` is white space. Unclosed elements are closed as browsers do for p, li and table parts.

A host's judged nodes are in one row, at most 1 / SHARE times as many as a page of it has on average.

Defined cases: null html or html without text gives an empty text and n_chars 0; a url without a host is of the host
''; repeated rows get equal answers (and count as one page); an empty table gives an empty result; other columns are
never read. Pages are handled one by one, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.shared import publish, scratch

GAMMA, THRESHOLD, HIGH = 0.9, 0.2, 0.4
SUPPORT, SHARE, TRUSTED = 3, 0.1, 12
PRESENTATION, CONTENT, PAGE = 0, 1, 2

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements without text of their own, by their kind.
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre hr header footer nav aside form fieldset figure figcaption address details summary center hgroup search dialog menu".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object select xmp noembed noframes audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKED = frozenset("head nav footer aside form button menu search dialog".split())
SPARED = frozenset("form dialog".split())
WORDS = frozenset("nav navbar navigation menu header footer sidebar aside notice notices cookie cookies consent banner ad ads advert adverts advertisement advertising promo promotion sponsor sponsored form subscribe newsletter comment comments respond disqus reply replies share sharing social related breadcrumb breadcrumbs pagination pager popup modal widget login signup search masthead contentinfo complementary alert".split())
#: Names that say little, and compounds that say enough.
LOOSE = frozenset("header".split())
KNOWN = re.compile(r"(?:site|main|primary|secondary|global|page|top|bottom|left|right)[-_](?:nav|navbar|navigation|menu|footer|sidebar)|(?:" + "|".join(sorted(WORDS - LOOSE)) + r")[-_](?:area|banner|bar|box|buttons?|consent|container|form|icons|links?|list|menu|nav|notice|posts|slot|thread|unit|widget|wrap|wrapper|[0-9]+)")
WEAK, NAMED, TAGGED = 1, 2, 3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes the open elements on its right, up to those that hold it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLD = frozenset("ul ol dl table".split())
#: Elements whose repeated children are items.
LISTS = HOLD | frozenset("thead tbody tfoot tr menu".split())


class Node:
    __slots__ = ("children", "heading", "holds", "inner", "main", "mark", "marked", "parent", "path", "spared", "tag", "top")

    def __init__(self, tag: str, path: int, parent: Node | None = None, mark: int = 0, spared: bool = True):
        self.tag, self.path, self.parent, self.mark, self.spared, self.children = tag, path, parent, mark, spared, []
        self.heading, self.main, self.holds = bool(parent) and (parent.heading or tag in HEADINGS), bool(parent) and parent.main, False
        self.inner, self.marked, self.top = 0, 0, False

    def settle(self) -> None:
        """Its marks and its ancestors', all and those inside the main part, once it is known what it holds."""
        mark = 0 if self.holds and self.spared else self.mark
        self.marked = max(self.parent.marked, mark)
        self.inner = max(self.parent.inner, mark) if self.parent.main else 0
        self.top = self.parent.top or (self.tag == "header" and not self.holds)


def mark_of(tag: str, marks: dict) -> int:
    """What an element's class, id and role say."""
    names = [n for k, v in marks.items() if k != "id" or tag not in HEADINGS for n in v.split()]
    if any(n in WORDS and n not in LOOSE or KNOWN.fullmatch(n) for n in names):
        return NAMED
    return WEAK if any(not WORDS.isdisjoint(re.split(r"[^a-z0-9]+", n)) for n in names) else 0


def number(text: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def parse(html: str | None) -> tuple[list, list]:
    """Blocks (path, text, marked, in main part) in page order, and nodes (path, presentation); marked: 0, WEAK, NAMED
    or TAGGED."""
    blocks, nodes, _ = read(html)
    return blocks, nodes


def read(html: str | None) -> tuple[list, list, list]:
    """What parse() gives, and the blocks' nodes."""
    html = html or ""
    root = Node("", 0)
    stack, blocks, nodes, made, parts = [root], [], [], [], []

    def flush() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                blocks.append((stack[-1], text))

    def close(to: int) -> None:
        flush()
        for n in stack[to:]:
            children = [c for c, old in zip(n.children, [None, *n.children]) if c != old] if n.tag in LISTS else n.children
            nodes.append((n.path, number(" ".join(children))))
        del stack[to:]

    at, length = 0, len(html)
    while at < length:
        m = TOKEN.search(html, at)
        if not m:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        ended, tag, attributes = m.group(1), m.group(2) or m.group(4), m.group(3) or m.group(5) or ""
        if ended:
            ended = ended.lower()
            if ended in BLOCKS or ended in MARKED:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == ended:
                        close(k)
                        break
                else:
                    flush()
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                at = end.start() if end else length
            stack[-1].children.append(tag)
            parts.append(" ")
            continue
        if tag in VOID and tag != "hr":
            parts.append(" " * (tag == "br"))
            continue
        if tag not in BLOCKS and tag not in MARKED:
            continue
        flush()
        for k in range(len(stack) - 1, 0, -1):  # an open p ends at any block
            if stack[k].tag == "p":
                close(k)
                break
            if stack[k].tag != "head":
                break
        if tag == "body" and len(stack) > 1 and stack[-1].tag == "head":
            close(len(stack) - 1)
        for k in range(len(stack) - 1, 0, -1) if tag in CLOSES else ():
            if stack[k].tag in HOLD:
                break
            if stack[k].tag in CLOSES[tag]:
                close(k)
                break
        if tag == "hr":
            continue
        parent = stack[-1]
        marks = {k.lower(): (a or b or c).lower() for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        label = tag + "." + ".".join(sorted(marks.get("class", "").split()))
        mark = mark_of(tag, marks) if marks and tag not in ("html", "body") else 0
        if (tag in MARKED and (tag not in SPARED or mark < NAMED)) or (tag == "header" and not parent.main):
            mark = TAGGED
        parent.children.append(label)
        stack.append(n := Node(tag, number(f"{parent.path}/{label}"), parent, mark, tag in SPARED or tag not in MARKED))
        made.append(n)
        if tag in ("article", "main") or marks.get("role") == "main":
            n.main = True
            if tag != "article" or not any(x.tag == "article" for x in stack[:-1]):
                for x in reversed(stack):
                    if x.holds:
                        break
                    x.holds = True
        elif tag == "h1" or (not n.main and (tag == "p" or tag in HEADINGS)):
            for x in stack:
                x.holds |= x.tag == "form" and x.mark == TAGGED
    close(1)
    for n in made:
        n.settle()
    return [(n.path, text, TAGGED if n.top and not n.heading else n.marked, n.main) for n, text in blocks], nodes, [n for n, _ in blocks]


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> host, page, found: a digest of the page's blocks, and each value of a node once."""
    kind = pa.list_(pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("value", pa.int64())]))
    for batch in batches:
        for rows in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
            pages, offsets, out = [], [0], []
            for html in rows.column(1):
                blocks, nodes = parse(html.as_py())
                seen = {(path, PRESENTATION, value) for path, value in nodes} | {(path, CONTENT, number(text)) for path, text, _, _ in blocks}
                seen |= {(path, PAGE, 0) for path, _, _ in seen}
                out += seen
                offsets.append(len(out))
                pages.append(xxhash.xxh3_128_digest("\n".join(f"{path} {text}" for path, text, _, _ in blocks).encode("utf-8", "surrogatepass")))
            columns = list(zip(*out, strict=True)) or [()] * 3
            found = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.value_type, strict=True)], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(pages, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)], ["host", "page", "found"])


def importance(pages: DataFrame, once: bool = False) -> DataFrame:
    """The merged trees: host, node, pages, presentation, content, importance, style (the presentation's part of it).
    pages: host, html; once: equal pages of a host count as one."""
    found = pages.mapInArrow(features, "host string, page binary, found array<struct<node: long, kind: int, value: long>>")
    if once:
        found = found.dropDuplicates(["host", "page"])
    counts = found.select("host", F.inline("found")).groupBy("host", "node", "kind", "value").agg(F.count(F.lit(1)).alias("c"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    c = F.col("c")
    per_kind = counts.groupBy("host", "node").agg(
        F.max(F.when(F.col("kind") == PAGE, c)).alias("pages"),
        *[f(kind).alias(f"{name}{kind}") for kind in (PRESENTATION, CONTENT) for name, f in (("n", lambda k: of(k, c)), ("l", lambda k: of(k, F.lit(1))), ("clog", lambda k: of(k, c * F.log(c))), ("log", lambda k: of(k, F.log(c))))],
    )
    log_m = F.log("pages")
    # - sum p log_m p with p = c / n is (log n - sum(c log c) / n) / log m.
    presentation = F.when(F.col("pages") == 1, 1.0).otherwise((F.log("n0") - F.col("clog0") / F.col("n0")) / log_m)
    content = F.when((F.col("pages") == 1) | F.col("l1").isNull(), 1.0).otherwise(1 - F.col("log1") / F.col("l1") / log_m)
    rows = per_kind.select("host", "node", "pages", "l0", F.coalesce(presentation, F.lit(1.0)).alias("presentation"), content.alias("content"))
    weight = F.pow(F.lit(GAMMA), F.coalesce("l0", F.lit(1)))
    # Where the node holds only elements, its parts are judged instead.
    style = F.when(F.col("pages") == 1, 0.0).otherwise((1 - weight) * F.col("presentation"))
    return rows.withColumn("importance", (1 - weight) * F.col("presentation") + weight * F.col("content")).withColumn("style", style).drop("l0")


def main_text(html: str | None, low: frozenset = frozenset(), high: frozenset = frozenset(), marks: bool = True) -> str:
    """found() of a host whose tree isn't trusted: the text alone."""
    return found(html, low, high, marks=marks)[0]


def found(html: str | None, low: frozenset = frozenset(), high: frozenset = frozenset(), trusted: bool = False, marks: bool = True) -> tuple[str, str]:
    """The page's text without the branches that go, and what told it: tree, tags or rest. low, high: nodes of low and of high
    importance; trusted: of a host of enough pages, so that branches that lie apart from the high ones are of low importance
    beside them. marks: False takes the tree's word alone, so tests can tell what it finds by itself."""
    blocks, _, at = read(html)
    if not marks:
        blocks = [(path, text, 0, False) for path, text, _, _ in blocks]
    inside: dict[int, bool] = {}

    def in_high(n: Node) -> bool:
        if id(n) not in inside:
            inside[id(n)] = bool(n.parent) and (n.path in high or in_high(n.parent))
        return inside[id(n)]

    part = [k for k in range(len(blocks)) if high and in_high(at[k])]
    held = [k for k, (_, _, marked, main) in enumerate(blocks) if main and marked < NAMED]
    if trusted and (own := [k for k in part if blocks[k][2] < NAMED]):
        titles = {k for k in held or range(len(blocks)) if at[k].tag == "h1" and blocks[k][2] < NAMED}
        return "\n".join(blocks[k][1] for k in sorted({*own, *titles}) if k in titles or blocks[k][0] not in low or blocks[k][3]), "tree"
    by = "tags" if held else "tree" if part else "rest"
    if held:  # the tree's main part as far as it is an article, and the whole article
        held = [k for k in held if not (blocks[k][2] == WEAK and blocks[k][0] in low)] or held
    else:
        rest = [k for k, (_, _, marked, main) in enumerate(blocks) if marked < NAMED or (main and at[k].inner < NAMED)]
        part = [k for k in rest if k in set(part)]
        if part:
            rest = [k for k in rest if k in set(part) or at[k].tag == "h1"]
        held = [k for k in rest if blocks[k][0] not in low]
        body = [k for k in rest if at[k].tag == "p"] or [k for k in rest if not at[k].heading]
        if not set(body) & set(held):
            held = rest
        if not rest:
            held = [k for k, (path, _, marked, _) in enumerate(blocks) if marked < TAGGED and path not in low]
    return "\n".join(blocks[k][1] for k in held), by


def extract(marks: bool):
    """(page_id, url, html, low, high, trusted) -> page_id, url, text, n_chars, found_by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts, told, sets = [], [], {}
                for html, low, high, trusted in zip(*rows.columns[2:], strict=True):
                    nodes = [sets.setdefault(key, frozenset(key)) for key in (tuple(x.as_py() or ()) for x in (low, high))]
                    text, by = found(html.as_py(), *nodes, bool(trusted.as_py()) and marks, marks)
                    texts.append(text)
                    told.append(by)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(told, pa.string())], ["page_id", "url", "text", "n_chars", "found_by"])

    return run


def judged(trees: DataFrame) -> DataFrame:
    """Per host that has any: its low and its high nodes, and whether its tree is trusted. Nodes are picked before they are gathered, so a row is short."""
    most = trees.groupBy("host").agg(F.max("pages").alias("most"))
    known = trees.join(most, "host").filter((F.col("pages") >= SUPPORT) & (F.col("pages") >= SHARE * F.col("most")))
    known = known.withColumn("low", F.col("importance") < THRESHOLD).withColumn("high", F.col("style") >= HIGH).filter("low or high")
    of = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("node")))).alias(c)
    return known.groupBy("host").agg(of("low"), of("high"), (F.max("most") >= TRUSTED).alias("trusted"))


def main_texts(pages: DataFrame, marks: bool = True) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars, found_by."""
    spark = pages.sparkSession
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    # One row per host, written first so that its size is known when Spark picks the join; a hot host's pages can be
    # split, as the other side has one row for it.
    nodes = publish(judged(importance(rows.select("host", "html"), once=True)), scratch(spark, "style-trees"))
    return rows.join(nodes, "host", "left").select("page_id", "url", "html", "low", "high", "trusted").mapInArrow(extract(marks), "page_id long, url string, text string, n_chars long, found_by string")
