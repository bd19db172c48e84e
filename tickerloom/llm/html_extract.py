"""Main text of web pages by a style tree of each site.

Pages of one host are merged: nodes with the same path of tags and classes from the body down are one node of the
site's tree. A node is important as far as it varies over the pages: its presentation importance is the entropy
of the child layouts under it, its content importance the entropy of the texts in it, both scaled by the log of
the number of pages and averaged over the pages that have the node. Branches below `least_importance` go, inside
an <article> or <main> as well. Few pages tell little: the greater of both is averaged with `PRIOR_PAGES` pages of
importance one, so a branch that never varies goes from five pages on. Pages of a site with equal text (that of
the article, if there is one) count as one page, so copies of an article do not make it boilerplate.

Known roles are a prior: branches that HTML or their class and id name as navigation, header, footer, aside, form,
notice, advert or comments go on every page. Inside an article its own header stays, words that may name a part
of the story do not count, and paragraphs, headings and the like go only as adverts or comments. A page with an <article> or <main> keeps blocks of it only, and keeps
all of them if each would go.

Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty
line. Unclosed, misnested and cut-off markup is read as far as it goes: a quoted value without its end quote ends
with its tag. Pages are read in time proportional to their length. Elements nested deeper than `TREE_DEPTH` belong
to the node above them. Null and empty html give empty text and so do pages whose branches all go. Null urls share one site. Repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.staging import Stages

LEAST_IMPORTANCE = 0.3
#: Weight, in pages, of the assumption that a branch matters.
PRIOR_PAGES = 2
TREE_DEPTH = 64

# Fixed values of HTML: elements without content, elements whose content is no text, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style noscript template textarea title svg math iframe object select canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are no part of the main text on any page, and roles with the same meaning.
CHROME = frozenset("nav header footer aside form button menu dialog head search".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of a class or id that name such a part.
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promos promotion nav navbar navigation "
    "menu menus breadcrumb breadcrumbs pagination pager header masthead topbar footer foot sidebar side sidebars aside widget widgets related "
    "recommended share sharing social cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login search comment comments commentlist disqus respond reply replies copyright legal toolbar skip".split()
)
MAIN = frozenset(["article", "main"])
#: Elements whose class often names the layout around them; only reader comments are told by it.
WHOLE = MAIN | {"body", "html"}
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond".split())

#: Words that name parts of a story as well; inside an article they say nothing.
AMBIGUOUS_WORDS = frozenset("header masthead foot legal side banner".split())
#: Elements that hold text itself, and what names them as no part of the story inside an article.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote figcaption dt dd td th tr tbody thead table caption".split())
ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion newsletter cookie cookies".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*([\"']?))?")
_BARE = re.compile(r"[^\s>]*")
_NAME_PART = re.compile(r"[a-z]+")
# An open element that one of these start tags ends, as HTML has it.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary", "figcaption"}


class _Reader:
    """Reads a page from left to right; no character is looked at more than a few times."""

    def __init__(self, page: str):
        self.page = page
        self.gone: set[str] = set()  # what the rest of the page does not hold any more

    def find(self, what: str, at: int) -> int:
        """Where `what` comes next, or -1; looked for once if it does not come again."""
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def after(self, what: str, at: int) -> int:
        found = self.find(what, at)
        return len(self.page) if found < 0 else found + len(what)

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """Attributes from behind a tag's name on, whether the tag closes itself, and where it ends."""
        page, named = self.page, {}
        while True:
            found = _ATTRIBUTE.match(page, at)
            if found is None:
                end = self.after(">", at)
                return named, page[at:end].rstrip(" \t\n>").endswith("/"), end
            name, quote, at = found[1].lower(), found[2], found.end()
            value = ""
            if quote:
                end = self.find(quote, at)
                if end < 0:
                    end = self.find(">", at)
                    end = len(page) if end < 0 else end
                    value, at = page[at:end], end
                else:
                    value, at = page[at:end], end + 1
            elif quote is not None:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
            named.setdefault(name, html.unescape(value))


def _hidden(named: dict[str, str]) -> bool:
    return "hidden" in named or named.get("aria-hidden", "").lower() == "true" or "display:none" in named.get("style", "").replace(" ", "").lower()


def _chrome(tag: str, named: dict[str, str], in_main: bool) -> bool:
    """Whether an element is no main text by its tag, role, class or id."""
    if _hidden(named) or named.get("role", "").lower() in CHROME_ROLES or (tag in CHROME and not (in_main and tag == "header")):
        return True
    words = set(_NAME_PART.findall(f"{named.get('class', '')} {named.get('id', '')}".lower()))
    if tag in WHOLE:
        return bool(words & COMMENT_WORDS)
    if not in_main:
        return bool(words & CHROME_WORDS)
    return bool(words & (ADVERT_WORDS | COMMENT_WORDS if tag in TEXT else CHROME_WORDS - AMBIGUOUS_WORDS))


def _node_name(tag: str, named: dict[str, str]) -> str:
    """Tag and classes; long ones by their hash."""
    classes = ".".join(sorted(set(named.get("class", "").lower().split())))
    return f"{tag}.{classes if len(classes) <= 40 else _hash(classes)}" if classes else tag


def blocks_of(page: str | None) -> tuple[list[tuple[str, bool, str]], bool]:
    """Blocks (path, in an article, text) in page order, without known chrome; whether the page has an article."""
    blocks: list[tuple[str, bool, str]] = []
    stack: list[tuple[str, str, bool, bool, bool]] = []  # tag, path, chrome, in an article, text unseen
    opened: Counter[str] = Counter()
    parts: list[str] = []
    where = ("", False, False)
    has_main = False
    page = page or ""
    reader = _Reader(page)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text and not where[1]:
                blocks.append((where[0], where[2], text))

    def close(tag: str) -> None:
        while True:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == tag:
                return

    def say(text: str) -> None:
        if text and not (stack and stack[-1][4]):
            parts.append(text)

    at = 0
    while at < len(page):
        begin = reader.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        say(page[at:begin])
        found = _TAG.match(page, begin)
        if found is None:
            mark = page[begin : begin + 9]
            if mark.startswith("<!--"):
                at = reader.after("-->", begin + 4)
            elif mark == "<![CDATA[":
                at = reader.after("]]>", begin)
            elif mark[1:2] in ("!", "?"):
                at = reader.after(">", begin)
            else:
                say("<")
                at = begin + 1
            continue
        named, closes, at = reader.attributes(found.end())
        tag = found[2].lower()
        if tag in BLOCK:
            flush()
        elif tag == "br":
            say(" ")
        if found[1]:
            if opened[tag]:
                close(tag)
        elif tag in OPAQUE:
            if not closes:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag not in VOID:
            if tag in _ENDS_P and opened["p"]:
                close("p")
            elif tag in _ENDS and stack and stack[-1][0] in _ENDS[tag]:
                close(stack[-1][0])
            _, path, chrome, in_main, unseen = stack[-1] if stack else ("", "", False, False, False)
            own = _chrome(tag, named, in_main)
            main = tag in MAIN or named.get("role", "").lower() == "main"
            has_main |= main and not (chrome or own)
            deeper = f"{path}/{_node_name(tag, named)}" if len(stack) < TREE_DEPTH else path
            unseen = unseen or (tag not in BLOCK and (_hidden(named) or tag in CHROME))
            stack.append((tag, deeper, chrome or own, in_main or main, unseen))
            opened[tag] += 1
        if tag in BLOCK:
            where = stack[-1][1:4] if stack else ("", False, False)
    flush()
    return blocks, has_main


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _signed(total: int) -> int:
    return (total + (1 << 63)) % (1 << 64) - (1 << 63)


def branches_of(blocks: list[tuple[str, bool, str]]) -> list[dict]:
    """Each node of a page's tree with a hash of the texts in it and of the paths of its blocks."""
    totals: dict[str, list[int]] = {}
    for path, _, text in blocks:
        content, layout = _hash(text), _hash(path)
        at = path.find("/", 1)
        while True:
            total = totals.setdefault(path if at < 0 else path[:at], [0, 0])
            total[0] += content
            total[1] += layout
            if at < 0:
                break
            at = path.find("/", at + 1)
    return [{"node": node, "content": _signed(c), "layout": _signed(y)} for node, (c, y) in totals.items()]


def _node_rows(pages: DataFrame) -> DataFrame:
    """page, site, its blocks (path, whether in an article, text), its branches, and a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.string()), ("main", pa.bool_()), ("text", pa.string())]))
        tree = pa.list_(pa.struct([("node", pa.string()), ("content", pa.int64()), ("layout", pa.int64())]))
        for batch in batches:
            read = [blocks_of(page) for page in batch.column("html").to_pylist()]
            found = [[{"path": p, "main": m, "text": t} for p, m, t in blocks] for blocks, _ in read]
            own = [_hash("\n".join(t for _, m, t in blocks if m or not has_main)) for blocks, has_main in read]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), batch.column("_site"), pa.array(found, kind), pa.array([m for _, m in read]),
                 pa.array([branches_of(blocks) for blocks, _ in read], tree), pa.array(own, pa.int64())],
                ["page_id", "url", "_site", "blocks", "has_main", "branches", "own"])

    kinds = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url", "_site")]
    return pages.mapInArrow(run, f"{', '.join(kinds)}, blocks array<struct<path:string,main:boolean,text:string>>, has_main boolean, "
                                 "branches array<struct<node:string,content:bigint,layout:bigint>>, own bigint")


def importance(nodes: DataFrame, stages: Stages) -> DataFrame:
    """_site, path, importance of each node of the site trees.

    Texts of a node on a page are one value, so are the paths of its blocks; their entropy over the pages comes
    from counts of values, which are combined before the exchange.
    """
    distinct = nodes.select("_site", "own", "branches").groupBy("_site", "own").agg(F.min("branches").alias("branches"))
    on_page = stages.put(distinct.select("_site", F.explode("branches").alias("b")).select("_site", "b.node", "b.content", "b.layout"))

    def entropy(value: str) -> DataFrame:
        counts = on_page.groupBy("_site", "node", value).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("_site", "node").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("nlogn")).select(
            "_site", "node", "pages", F.when(F.col("pages") > 1, 1 - F.col("nlogn") / (F.col("pages") * F.log(F.col("pages").cast("double")))).otherwise(1.0).alias(f"{value}_importance"))

    greater = F.greatest("content_importance", "layout_importance")
    smoothed = (F.col("pages") * greater + PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)
    return entropy("content").join(entropy("layout").drop("pages"), ["_site", "node"]).select("_site", F.col("node").alias("path"), smoothed.alias("importance"))


def extract(pages: DataFrame, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """page_id, url, text of each page; pages: page_id, url, html."""
    stages = Stages(pages.sparkSession, "html")
    site = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][-+.\w]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    nodes = stages.put(_node_rows(pages.select("page_id", "url", "html", site.alias("_site"))))
    # A row for each site that has low branches: few enough for Spark to send them to the pages, else skew is split.
    low = stages.put(
        importance(nodes, stages).filter(F.col("importance") < least_importance)
        .groupBy("_site").agg(F.collect_set("path").alias("low"))
    )

    def joined(blocks):
        return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")

    own = F.filter("blocks", lambda b: b["main"] | ~F.col("has_main"))
    below = F.coalesce("low", F.array().cast("array<string>"))
    kept = F.filter("own_blocks", lambda b: ~F.exists(below, lambda p: F.startswith(F.concat(b["path"], F.lit("/")), F.concat(p, F.lit("/")))))
    return (
        nodes.select("page_id", "url", "_site", "has_main", own.alias("own_blocks")).join(low, "_site", "left")
        .select("page_id", "url", "has_main", "own_blocks", kept.alias("kept"))
        .select("page_id", "url", joined(F.when(F.col("has_main") & (F.size("kept") == 0), F.col("own_blocks")).otherwise(F.col("kept"))).alias("text"))
    )
