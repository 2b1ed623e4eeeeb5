"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree: a node is the path of block elements with their classes and
ids, as a page's markup is styled by them.  For the nodes that hold text the tree gives an importance:

* content: one minus the mean, over the different blocks of a node, of ``log_m`` of the number of pages with
  that block, where ``m`` pages have the node; blocks that all pages share make it 0, blocks of one page 1;
* presentation: the entropy, in units of ``log_m``, of how many blocks the node has from page to page.

``CONTENT * content + (1 - CONTENT) * presentation`` is averaged with one half, which weighs as much as
``DOUBT`` pages, so it is defined from one page on, and bounded by ``BOUNDS``.  Equal pages count once, so copies
do not make a text look like a template.

What elements say about themselves is the prior of a node's importance, whose odds are multiplied by those of
what the tree has seen; nodes below ``LEAST`` are removed from each page.  Text inside ``article`` or ``main``
has the prior ``INSIDE``, so there a node goes if nearly all of ten pages or more share its text; text of pages
without these has an even one, and the tree decides alone.  Blocks with a class or id of ``MAYBE_NAMES`` have the
prior ``NAMED``: they go unless the tree finds other text on page after page.  Navigation, footers, forms and the
like, elements with a role, class or id of ``NOISE_NAMES``, and what stands outside ``article`` or ``main`` on a page
that has one, are nodes of the tree, too, with the prior ``DECLARED``, which nothing within ``BOUNDS`` lifts above
``LEAST``.  Only text that is never shown (scripts, styles, templates) has no node.

Names count as whole classes or ids.  Of compound ones the parts in ``NOISE_PARTS`` count as much, unless another part
says that they are about the page (``comments-open``); parts in ``MAYBE_NAMES`` lower the prior to ``PART``, so they go
if the tree has seen their text again and again.  Names never count on
``article``, ``main`` or a heading, and not for an ``article`` or ``main`` inside the named element that is the page's
own, not one within another.

Defined results: null or empty html gives an empty text.  Pages without a host are not merged with others.
Unclosed elements, stray end tags and truncated pages are read as far as they go.  Repeated rows are extracted
each; very long pages are read whole; an empty table gives no rows; extra columns are carried along unless they
have the name of an output column, which the output then takes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundalike.llm.common import bounded, need, private, query, stored, table
from soundalike.llm.kernels import text_blocks

LEAST = 0.2
CONTENT = 0.9
#: Prior importance of text inside article or main, of text on pages without these, and of MAYBE_NAMES.
INSIDE, OPEN, NAMED = 0.9, 0.5, 0.1
#: Prior where a part of a compound name is one of these.
PART = 0.3
#: Prior of what an element's tag, role or name says is not the article.
DECLARED = 0.01
BOUNDS = (0.01, 0.95)
DOUBT = 0.5

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""",
    re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
NOISE_TAGS = frozenset("""aside audio button canvas dialog embed fieldset footer form frameset head iframe menu nav
noembed noframes noscript object script search select style svg template textarea title video""".split())
NOISE_ROLES = frozenset("""alert alertdialog banner complementary contentinfo dialog form menu menubar navigation
search toolbar""".split())
#: Classes and ids, without "-" and "_", that say that a part is not the article.
NOISE_NAMES = frozenset("""ad adbanner ads adsense adslot adunit advert advertisement advertising adverts breadcrumb
breadcrumbs comment commentlist comments commentsection consent cookie cookiebanner cookiebar cookieconsent
cookienotice cookies disqus footer gdpr login masthead menu modal nav navbar navigation navmenu newsletter
newslettersignup pager pagination popup promo promotion relatedarticles relatedposts respond sharebuttons sharing
sidebar sidebarad signup sitefooter siteheader sitenav skiplink socialshare sponsor sponsored subscribe toolbar
topbar""".split())
#: Names that may also be part of an article.
MAYBE_NAMES = frozenset("""alert banner copyright header notice notices notification overlay related replies share
skip social widget""".split())
#: Parts of compound names that say it as well, and parts that say that a name is about something else.
NOISE_PARTS = frozenset("""ad ads advert advertisement advertising adverts breadcrumb breadcrumbs comment comments consent
cookie cookies disqus gdpr newsletter sidebar sponsored""".split())
STATES = frozenset("""allowed closed count disabled enabled free has hide link no number off on open post show state type
with without""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are closed by the start of any of these.
CLOSED_BY = {
    "p": BLOCKS - {"option", "optgroup", "legend", "caption", "head", "title"},
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot", "thead"}), "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "option": frozenset({"option", "optgroup"}),
    "head": frozenset({"body"}),
}
#: An implied end does not reach through these.
FENCES = frozenset("table ul ol dl div article main section aside nav form blockquote td th body html".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Element:
    tag: str
    path: int
    noise: float  # 0, 0.5 by a part of a name that may be wrong, 1 by one, 2 by a name or as a form, 3 by tag, role or style
    declared: bool
    block: bool


@dataclass
class Block:
    path: int
    declared: bool
    noise: float
    text: str

    @property
    def prior(self) -> float:
        return {0: INSIDE if self.declared else OPEN, 0.5: PART, 1: NAMED}.get(self.noise, DECLARED)


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    has_main: bool = False

    def text(self, seen: dict[int, float] | None = None) -> str:
        """Text of the blocks that stay, given what the tree has seen of the nodes of this host."""
        return "\n".join(b.text for b in self.blocks if (b.declared or not self.has_main) and importance(
            b.prior, (seen or {}).get(b.path, 0.5)) >= LEAST)


def importance(prior: float, seen: float) -> float:
    """Odds of the prior times odds of what the tree has seen, as a share."""
    seen = min(max(seen, BOUNDS[0]), BOUNDS[1])
    return prior * seen / (prior * seen + (1 - prior) * (1 - seen))


def _names(value: str) -> set[str]:
    return {x.lower() for x in NAME.findall(value)}


def _facts(tag: str, attributes: str, inside: bool) -> tuple[str, float, bool]:
    """Style label of an element, how far it names itself noise, and whether it is main content."""
    noise = 2 if tag == "form" else 3 if tag in NOISE_TAGS or tag == "header" and not inside else 0
    main = tag in ("article", "main")
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag, noise, main
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    said = html.unescape(f"{got.get('class', '')} {got.get('id', '')}")
    role = got.get("role", "").lower()
    main = main or role == "main"
    if role in NOISE_ROLES and tag not in ("html", "body", "main") and not (role == "banner" and inside):
        noise = max(noise, 2 if role == "form" else 3)
    if not main and tag not in HEADINGS and tag not in ("html", "body"):
        whole = {x.replace("-", "").replace("_", "").lower() for x in said.split()}
        # A name that may be wrong is for the tree to confirm, which knows blocks only.
        maybe = MAYBE_NAMES - ({"header"} if inside else set())
        parts = [_names(x) for x in said.split()]
        compound = [x for x in parts if len(x) > 1 and tag in BLOCKS]
        # A box of comments is "post-comments" and a page that may have some "comments-open".
        sure = whole & NOISE_NAMES or any(x & NOISE_PARTS and not x & (STATES - {"post"}) for x in compound)
        part = any(x & (maybe - {"header", "skip"}) and not x & STATES for x in compound)
        noise = max(noise, 2 if sure else 1 if tag in BLOCKS and whole & maybe else 0.5 if part else 0)
    if ("hidden" in got or got.get("aria-hidden", "").lower() == "true"
            or "display:none" in got.get("style", "").replace(" ", "").lower()):
        noise = 3
    return f"{tag}.{' '.join(sorted(_names(said)))}", noise, main


def parse(source: str) -> Page:
    """Blocks of text in page order, each with its place in the style tree and what its elements say about it."""
    page = Page()
    stack = [Element("", 0, 0, False, True)]
    held: list[str] = []

    def flush() -> None:
        if held:
            words = "".join(held).split()
            held.clear()
            if words:
                around = next(e for e in reversed(stack) if e.block)
                page.blocks.append(Block(around.path, around.declared, around.noise, " ".join(words)))

    def counts() -> bool:
        """Whether text at this place belongs to a block; inline noise inside an article's block does not."""
        return stack[-1].noise < 2 or next(e for e in reversed(stack) if e.block).noise >= 2

    def close(tag: str, fences: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                if any(e.block for e in stack[i:]):
                    flush()
                del stack[i:]
                return
            if stack[i].tag in fences:
                return

    at, n = 0, len(source)
    while at < n:
        m = TAG.search(source, at)
        upto = m.start() if m else n
        if upto > at and counts():
            held.append(html.unescape(source[at:upto]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if source.startswith("<![CDATA[", m.start()) and counts():
                held.append(source[m.start() + 9:at].removesuffix("]]>"))
            continue
        block = tag in BLOCKS
        if m[1] or m[4]:
            # The end of an inline element does not close blocks.
            close(tag, frozenset() if block else BLOCKS)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if block:
            flush()
            for open_, closers in CLOSED_BY.items():
                if tag in closers:
                    close(open_, FENCES - {open_})
        if tag in VOID:
            continue
        top = stack[-1]
        attributes = m[3] if m[2] else m[6]
        label, noise, main = _facts(tag, attributes or "", top.declared)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
            at = end.end() if end else n
            continue
        if attributes and attributes.rstrip().endswith("/") and tag in ("svg", "path", "use"):
            continue
        noise = max(noise, 0 if main and top.noise < 3 and not top.declared else top.noise)
        main = main and not noise
        page.has_main |= main
        path = xxhash.xxh64_intdigest(label, seed=top.path) if block else top.path
        stack.append(Element(tag, path, noise, main or top.declared, block))
    flush()
    return page


def host_of(url: str | Column) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(F.lower(c), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def style_tree(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(host, path, pages, noise, seen) of all nodes with text, whatever they say about themselves."""
    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")).where(
        "host is not null and html is not null").withColumn("page", F.xxhash64("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch, "html"):
                out = []
                for host, page, source in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), texts):
                    parsed = parse(source or "")
                    nodes: dict[int, list[str]] = {}
                    for b in parsed.blocks:
                        nodes.setdefault(b.path, []).append(b.text)
                    noise = {b.path: b.noise for b in parsed.blocks}
                    for path, held in nodes.items():
                        for text in set(held):
                            out.append((host, _signed(path), page, len(held),
                                        _signed(xxhash.xxh64_intdigest(text)), noise[path]))
                columns = zip(*out) if out else ((),) * 6
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 names=["host", "path", "page", "n", "block", "noise"])
    found = stored(rows.transform(bounded).mapInArrow(
        run, "host string, path bigint, page bigint, n bigint, block bigint, noise double").distinct(), "style-nodes")
    node = ("host", "path")
    per_page = found.select(*node, "page", "n", "noise").distinct()
    shapes = per_page.groupBy(*node, "n").agg(F.count(F.lit(1)).alias("k"), F.min("noise").alias("noise"))
    shapes = shapes.groupBy(*node).agg(F.sum("k").alias("pages"), F.sum(F.col("k") * F.log("k")).alias("klogk"),
                                       F.min("noise").alias("noise"))
    blocks = found.groupBy(*node, "block").agg(F.count(F.lit(1)).alias("k"))
    blocks = blocks.groupBy(*node).agg(F.avg(F.log("k")).alias("shared"))
    m = F.log("pages")
    # Entropy of counts k that sum to m: log m - sum(k log k) / m.
    presentation = (m - F.col("klogk") / F.col("pages")) / m
    content = F.lit(1.0) - F.col("shared") / m
    more = F.col("pages") - 1
    found = F.when(more > 0, CONTENT * content + (1 - CONTENT) * presentation).otherwise(0.0)
    return shapes.join(blocks, list(node)).select(
        *node, "pages", "noise", ((found * more + 0.5 * DOUBT) / (more + DOUBT)).alias("seen"))


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", text_col: str = "text") -> DataFrame:
    """``pages`` with their main text.

    Low branches and lifted names of a host are few beside its pages.  They are written first; Spark then
    broadcasts them by the size of the files, or else joins by host and splits the large ones.
    """
    need(pages, html_col, url_col)
    tree = style_tree(pages, html_col, url_col)
    # What its elements rule out goes whatever the tree has seen.
    decided = (F.col("noise") < 2) & ((F.col("seen") < LEAST) | (F.col("noise") > 0) & (F.col("seen") != 0.5))
    low = stored(tree.where(decided).groupBy("host").agg(
        F.map_from_entries(F.collect_list(F.struct("path", "seen"))).alias("low")), "style-low")
    host, paths = private("host"), private("low")
    base = pages.drop(text_col) if text_col != html_col else pages
    rows = base.withColumn(host, host_of(url_col)).join(
        low.select(F.col("host").alias(host), F.col("low").alias(paths)), host, "left").drop(host)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != text_col]
    schema = ", ".join([*kinds, f"`{text_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch, html_col):
                names = [x for x in part.schema.names if x not in (paths, text_col)]
                known = part.column(part.schema.get_field_index(paths)).to_pylist()
                out = [parse(source or "").text({p % (1 << 64): x for p, x in seen or ()})
                       for source, seen in zip(texts, known)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(x)) for x in names), pa.array(out, pa.string())],
                    names=[*names, text_col])
    return rows.transform(bounded).mapInArrow(run, schema)


@query("op8_html_extract")
def op8(spark, sf_dir):
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
