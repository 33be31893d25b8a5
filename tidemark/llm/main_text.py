"""Main text of HTML pages by removal of site templates.

A page is parsed once into its blocks of text and its *nodes*: the block elements, each with the node around it,
its number of words and two hashes. The content hash covers tag, class, id, role, text and all nodes inside. The
shape hash covers the same without the text, and takes runs of equal children as one, so a menu of five links has
the shape of one of six. Nodes are counted per host over distinct pages, and two kinds are site templates:

- by content, nodes found in at least ``least_pages`` pages of the host;
- by shape, nodes found in at least ``least_pages`` pages and ``least_share`` of the host's pages that hold less
  than ``most_words`` of all words of the host: menus, footers and adverts whose words change from page to page.

What a page marks as its article (``article``, else ``main``) is content: inside it headings, paragraphs and the
like are never templates, and no node in or around it is one by its shape; containers in it (div, section, lists,
tables) are by content. A template goes with all it contains. Of the rest, the blocks inside the marked article are
the main text, or all blocks of a page without one. Hosts of few pages show no templates; there what is left in
elements that are no main text by their tag (nav, header, footer, aside) or by class, id or role goes. Scripts,
styles, forms and other controls are not read at all.

Scale: a page is parsed once, in time linear in its length: the scan never goes back, and open elements are found
by a stack for each tag. Then only hashes move: counts are pre-aggregated per host, so a host with a third of all
pages is counted map-side. Which nodes go comes back by joins on staged tables.

Defined cases: null html is empty and gives an empty text; null urls share the empty host; broken markup is read
as browsers do for what matters here (unclosed p and li end at the next block, stray end tags are ignored, an
unclosed script or tag ends the page); character references are decoded; pages of equal blocks count once;
repeated rows are extracted each; an empty table gives an empty result; columns named as ours are replaced.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import stage, with_columns_last
from tidemark.llm.url_filter import url_host

#: Fixed values of HTML and of common class names.
UNREAD = frozenset("head form noscript template iframe object svg math button select option dialog menu canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
READ_RAW = frozenset(["xmp"])
NO_MAIN = frozenset("nav footer aside".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CONTAINERS = frozenset("div section ul ol dl table figure details center fieldset nav aside header footer".split())
#: A start tag of the first kind ends an open element of the second.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
STOPS = frozenset("ul ol dl table div section article main body".split())
BARRIERS = ("article", "main", "body")
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|popup|modal|"
    r"comments?|disqus|replies|respond|sidebar|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|share|sharing|social|related|recommended|"
    r"newsletter|subscribe|signup|login|footer|masthead|site-header|page-header|skip-link|pagination|widget)s?(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: In how far a block is part of the marked article.
OUT, IN_MAIN, IN_ARTICLE = 0, 1, 2


class Element:
    """An open element; ``block`` is the block element it is or is in, which gathers what it holds."""

    __slots__ = ("tag", "marks", "unread", "listed", "inside", "node", "own", "block", "holds", "words", "parts", "shapes")

    def __init__(self, tag, marks, unread, listed, inside, node, own, block):
        self.tag, self.marks, self.unread, self.listed, self.inside, self.node, self.own = tag, marks, unread, listed, inside, node, own
        self.block = block or self
        if self.block is self:
            self.holds, self.words = False, 0
            self.parts: list[str] = []
            self.shapes: list[str] = []


def _marks(attributes: str) -> tuple[str, bool]:
    """Class, id and role as one text, and whether they say that the element is no main text."""
    marks, listed = [], False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = next(filter(None, values), ""), name.lower()
        if name in ("class", "id", "role"):
            marks.append(f"{name}={value}")
        listed |= name in ("class", "id") and bool(BOILER.search(value)) or name == "role" and value.lower() in ROLES
        listed |= name == "hidden" or name == "aria-hidden" and value.lower() == "true"
    return " ".join(marks), listed


def _signed(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) - 2**63


class Page:
    """Blocks (text, node, inside, listed) and nodes [parent, content, shape, words].

    Hashes of content are even, those of shape odd, and 0 is never counted.
    """

    def __init__(self, page: str | None):
        self.blocks: list[tuple[str, int, int, bool]] = []
        self.nodes: list[list[int]] = []
        self.stack = [Element("", "", False, False, OUT, -1, False, None)]
        self.open: dict[str, list[int]] = {}
        self.open_blocks: list[int] = []
        self.open_stops: list[int] = []
        self.text: list[str] = []
        self._scan(page or "")
        self._flush()
        self._close_to(0)
        first: dict[int, list[int]] = {}
        for node in self.nodes:  # the first of a shape has the words of all of them
            at = first.setdefault(node[2], node)
            if at is not node:
                at[3], node[3] = at[3] + node[3], 0

    def _flush(self):
        if self.text:
            words = " ".join(entities.unescape("".join(self.text)).split())
            self.text = []
            top = self.stack[-1]
            if words:
                self.blocks.append((words, top.node, top.inside, top.listed))
                top.block.parts.append(words)
                top.block.words += words.count(" ") + 1

    def _add(self, text: str):
        if not self.stack[-1].unread:
            self.text.append(text)

    def _push(self, element: Element):
        at = len(self.stack)
        self.stack.append(element)
        self.open.setdefault(element.tag, []).append(at)
        if element.tag in BLOCKS:
            self.open_blocks.append(at)
        if element.tag in STOPS:
            self.open_stops.append(at)

    def _close_to(self, depth: int):
        """Close the elements above position ``depth`` of the stack and the one there, the root excepted."""
        while len(self.stack) > max(1, depth):
            e = self.stack.pop()
            at = len(self.stack)
            self.open[e.tag].pop()
            for places in (self.open_blocks, self.open_stops):
                if places and places[-1] == at:
                    places.pop()
            if e.block is not e or e.unread:
                continue
            up = self.stack[-1].block
            marked = e.tag in ("article", "main")
            content = _signed(f"{e.tag}[{e.marks}]({'|'.join(e.parts)})", 8) & ~1
            shape = _signed(f"{e.tag}[{e.marks}]({'|'.join(e.shapes)})", 9) | 1
            up.words += e.words
            up.holds |= e.holds or marked
            up.parts.append(f"#{content}")
            if not up.shapes or up.shapes[-1] != str(shape):
                up.shapes.append(str(shape))
            if e.own and e.words and not e.holds:
                fits = e.tag in CONTAINERS
                self.nodes[e.node][1:] = [content if fits or e.inside == OUT else 0, shape if fits and e.inside == OUT else 0, e.words]

    def _above(self, tags, limit: list[int]) -> int:
        """The place of the innermost open element of ``tags`` that is above the last of ``limit``, or 0."""
        at = max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        return at if at and (not limit or at > limit[-1]) else 0

    def _end(self, tag: str):
        if tag in BLOCKS:
            self._flush()
        elif tag == "br":
            self._add(" ")
        at = self.open[tag][-1] if self.open.get(tag) else 0
        if not at:
            return
        if tag not in ("html", *BARRIERS) and any(self.open.get(b) and self.open[b][-1] > at for b in BARRIERS):
            return
        if tag not in BLOCKS and self.open_blocks and self.open_blocks[-1] > at:
            return  # an inline end tag does not close blocks opened inside
        self._close_to(at)

    def _start(self, tag: str, attributes: str):
        if tag == "br":
            return self._add(" ")
        if tag in BLOCKS:
            self._flush()
        if tag in VOID:
            return None
        if tag in BLOCKS and tag not in ("html", "body"):
            # an open p, with the inline elements in it, ends at the next block
            if p := self._above(("p",), self.open_stops):
                self._close_to(p)
        if tag in CLOSES:
            # of the elements to end, those nested in one another go together with the outermost above the stop
            while at := self._above(CLOSES[tag], self.open_stops):
                self._close_to(at)
        up = self.stack[-1]
        marks, listed = _marks(attributes) if attributes and tag not in ("html", "body", "article", "main") else ("", False)
        unread = up.unread or tag in UNREAD or tag in RAW and tag not in READ_RAW
        listed = up.listed or listed or tag in NO_MAIN or tag == "header" and up.inside == OUT
        inside = IN_ARTICLE if tag == "article" else max(up.inside, IN_MAIN) if tag == "main" else up.inside
        own = tag in BLOCKS and not unread and tag not in ("html", "body", "article", "main") and (inside == OUT or tag in CONTAINERS)
        node = len(self.nodes) if own else up.node
        if own:
            self.nodes.append([up.node, 0, 0, 0])
        self._push(Element(tag, marks, unread, listed, inside, node, own, None if tag in BLOCKS else up.block))
        if attributes.endswith("/") and tag not in BLOCKS:
            self._close_to(len(self.stack) - 1)
        return None

    def _scan(self, page: str):
        at, size, quoted = 0, len(page), True
        while at < size:
            less = page.find("<", at)
            if less < 0:
                return self._add(page[at:])
            if less > at:
                self._add(page[at:less])
            at = less + 1
            if page.startswith("!--", at):
                end = page.find("-->", at + 3)
                at = size if end < 0 else end + 3
                continue
            if page[at : at + 1] in ("!", "?"):
                end = page.find(">", at)
                at = size if end < 0 else end + 1
                continue
            ends = page[at : at + 1] == "/"
            name = NAME.match(page, at + ends)
            if not name:
                self._add("<")
                continue
            end = self._tag_end(page, name.end(), quoted)
            if end < 0 and quoted:  # a quote never closed: from here on tags end at the next >
                quoted = False
                end = self._tag_end(page, name.end(), quoted)
            if end < 0:
                return None
            tag, attributes = name[0].lower(), page[name.end() : end]
            at = end + 1
            if ends:
                self._end(tag)
                continue
            self._start(tag, attributes)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                if close is None:
                    return None
                self._add(page[at : close.start()])
                at = close.start()
        return None

    @staticmethod
    def _tag_end(page: str, at: int, quoted: bool) -> int:
        """The place of the > that ends a tag, skipping quoted values."""
        while quoted:
            end = page.find(">", at)
            if end < 0:
                return -1
            one, two = page.find('"', at, end), page.find("'", at, end)
            quote = min((q for q in (one, two) if q >= 0), default=-1)
            if quote < 0:
                return end
            at = page.find(page[quote], quote + 1) + 1
            if not at:
                return -1
        return page.find(">", at)


def main_blocks(page: Page, gone: set[int]) -> list[str]:
    """The texts of the blocks that are main text when the templates ``gone`` go."""
    lost: list[bool] = []
    for parent, content, shape, _ in page.nodes:
        lost.append(parent >= 0 and lost[parent] or content in gone or shape in gone)
    left = [b for b in page.blocks if b[1] < 0 or not lost[b[1]]]
    for wanted in (IN_ARTICLE, IN_MAIN):
        if any(b[2] == wanted and not b[3] for b in left):
            left = [b for b in left if b[2] == wanted]
            break
    return [b[0] for b in left if not b[3]]


BLOCK = T.ArrayType(T.StructType().add("text", "string").add("node", "integer").add("inside", "integer").add("listed", "boolean"))
BLOCK_ARROW = pa.list_(pa.struct([("text", pa.string()), ("node", pa.int32()), ("inside", pa.int32()), ("listed", pa.bool_())]))
NODE = T.ArrayType(T.StructType().add("parent", "integer").add("content", "long").add("shape", "long").add("words", "integer"))
NODE_ARROW = pa.list_(pa.struct([("parent", pa.int32()), ("content", pa.int64()), ("shape", pa.int64()), ("words", pa.int32())]))


class Stored(Page):
    """A page read back from its row."""

    def __init__(self, blocks, nodes):
        self.blocks = [(b["text"], b["node"], b["inside"], b["listed"]) for b in blocks]
        self.nodes = [[n["parent"], n["content"], n["shape"], n["words"]] for n in nodes]


def parsed_pages(pages: DataFrame, rest: list[str]) -> DataFrame:
    """The columns ``rest`` with __tm_uid, __tm_host, __tm_page (a hash of all blocks), __tm_words, __tm_blocks and __tm_nodes."""
    wanted = pages.select(*rest, F.monotonically_increasing_id().alias("__tm_uid"), url_host(F.col("url")).alias("__tm_host"), F.col("html").alias("__tm_html"))
    schema = T.StructType(wanted.schema.fields[:-1]).add("__tm_page", "long").add("__tm_words", "long").add("__tm_blocks", BLOCK).add("__tm_nodes", NODE)

    def run(batches):
        for batch in batches:
            found = [Page(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            names = pa.array([_signed("\n".join(b[0] for b in p.blocks), 7) for p in found], pa.int64())
            words = pa.array([sum(b[0].count(" ") + 1 for b in p.blocks) for p in found], pa.int64())
            blocks = [[dict(zip(("text", "node", "inside", "listed"), b)) for b in p.blocks] for p in found]
            nodes = [[dict(zip(("parent", "content", "shape", "words"), n)) for n in p.nodes] for p in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], names, words, pa.array(blocks, BLOCK_ARROW), pa.array(nodes, NODE_ARROW)], schema.names)

    return wanted.mapInArrow(run, schema)


def node_hashes(parsed: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and (hash, words), a row for each hash of each node."""
    both = lambda n: F.array(F.struct(n["content"].alias("hash"), F.lit(0).alias("words")), F.struct(n["shape"].alias("hash"), n["words"].alias("words")))
    hashes = F.filter(F.flatten(F.transform("__tm_nodes", both)), lambda h: h["hash"] != 0)
    return parsed.select(*columns, F.explode(hashes).alias("h")).select(*columns, "h.hash", "h.words")


def site_templates(parsed: DataFrame, least_pages: int, least_share: float, most_words: float) -> DataFrame:
    """(host, hash) of the subtrees that are templates of their host."""
    pages = parsed.groupBy("__tm_host", "__tm_page").agg(F.max("__tm_words").alias("words"))
    per_host = pages.groupBy(F.col("__tm_host").alias("host")).agg(F.count("*").alias("pages"), F.sum("words").alias("words"))
    in_page = node_hashes(parsed, "__tm_host", "__tm_page").groupBy("__tm_host", "__tm_page", "hash").agg(F.max("words").alias("words"))
    counted = in_page.groupBy(F.col("__tm_host").alias("__host"), "hash").agg(F.count("*").alias("n"), F.sum("words").alias("held"))
    often = counted.where(F.col("n") >= least_pages).join(per_host, F.col("__host") == F.col("host"))
    by_shape = (F.col("n") >= least_share * F.col("pages")) & (F.col("held") < most_words * F.col("words"))
    return often.where((F.col("hash") % 2 == 0) | by_shape).select("host", "hash")


def extract_main_text(pages: DataFrame, least_pages: int = 5, least_share: float = 0.2, most_words: float = 0.1, most_sent: int = 100_000) -> DataFrame:
    """``pages`` (without html) with text and n_chars.

    Up to ``most_sent`` templates travel to the pages; more meet them by joins.
    """
    rest = [c for c in with_columns_last(pages, ["text", "n_chars"]) if c != "html"]
    parsed = stage(parsed_pages(pages, rest), "parsed-pages")
    often = stage(site_templates(parsed, least_pages, least_share, most_words), "templates")
    if often.limit(most_sent + 1).count() <= most_sent:
        per_host = often.groupBy(F.col("host").alias("__host")).agg(F.collect_set("hash").alias("__tm_gone"))
        both = parsed.join(F.broadcast(stage(per_host, "host-templates")), F.col("__tm_host") == F.col("__host"), "left")
    else:
        held = node_hashes(parsed, "__tm_uid", "__tm_host").join(often.select(F.col("host").alias("__tm_host"), "hash"), ["__tm_host", "hash"])
        gone = stage(held.groupBy(F.col("__tm_uid").alias("__uid")).agg(F.collect_set("hash").alias("__tm_gone")), "template-pages")
        both = parsed.join(gone, F.col("__tm_uid") == F.col("__uid"), "left")
    both = both.select(*rest, "__tm_blocks", "__tm_nodes", "__tm_gone")
    schema = T.StructType(both.schema.fields[: len(rest)]).add("text", "string")

    def run(batches):
        for batch in batches:
            blocks, nodes, gone = (batch.column(len(rest) + i) for i in range(3))
            texts = []
            for b, n, g in zip(blocks, nodes, gone):
                n = n.as_py()
                own = np.array([x[k] for x in n for k in ("content", "shape")], np.int64)
                lost = set(own[np.isin(own, np.asarray(g.values))].tolist()) - {0} if g.is_valid and len(n) else set()
                texts.append("\n".join(main_blocks(Stored(b.as_py(), n), lost)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string())], schema.names)

    return both.mapInArrow(run, schema).select(*rest, "text", F.length("text").cast("long").alias("n_chars"))
