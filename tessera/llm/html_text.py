"""HTML extraction (op 6): main text by removal of a site's templates.

Pages are parsed into trees by a tolerant tokenizer (unclosed and stray tags, comments, raw text of scripts and styles,
attributes with any quoting). The subtree of each block element, navigation, footers and adverts included, is hashed (its
source: tags, attributes and text); Spark counts, per host, within how many different surroundings (the hash of the
element around it) a subtree occurs, so that copies of a page count once. Subtrees that recur are the host's template and
are deleted:

- containers (divisions, lists, tables, navigation and so on) outside of articles from ``MIN_PAGES`` surroundings on,
  however many pages the host has;
- paragraphs, headings and other elements of text outside of articles, and containers within them, only if they also
  reach ``MIN_SHARE`` of the host's pages, since an article's text may recur innocently; paragraphs and headings within an
  article never;
- a subtree with half of a page's text or more never: it is content however often it recurs.

A single page can't show its template, so what remains of elements whose very kind is not article text (navigation,
headers outside an article, footers, asides, forms, scripts, styles, and blocks that their class, id or role names as
menu, advertisement, notice, sidebar or reader comments, unless it holds the main text) goes as well. Where there is a
main or article element with text, only such elements are read.

What remains is cut into blocks at block elements. Character references are decoded, white space inside a block becomes
one space, blocks are trimmed and joined by \\n.

Counting: the rows (host, subtree, surroundings, page) are written once, as hashes of 64 bits, and aggregated in two steps
with a partial aggregation before each shuffle, so a host with many pages is spread over all tasks. Templates meet the rows by
(host, subtree); keys that make up over 1 / ``HEAVY`` of all rows, fewer than ``HEAVY`` therefore, are broadcast, so no
task gets more than that share of them. Each page is then joined with its own templates only, by the hash of its source.

Defined results: null and empty html give an empty text; a null or unparsable url counts as one host; repeated rows count
as pages of their own and get a row each; texts of any length are read whole; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import table

#: Different surroundings that make a container a template.
MIN_PAGES = 5
#: What an element of text, or a container within an article, must reach of its host's pages besides.
MIN_SHARE = 0.2
#: Keys of more than one in HEAVY rows are broadcast.
HEAVY = 4096

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/)?(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"'=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"']+)?|[\"'])*)(?:>|\Z)",
    re.S,
)
#: An attribute: its name, its value in either quoting or none.
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"']+))?)?|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
DROP = frozenset(
    "script style noscript template head title meta link nav footer aside form button input select textarea option label fieldset "
    "svg canvas iframe object embed audio video map dialog menu noembed noframes xmp math".split()
)
#: Elements that end a line of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends these elements where they are still open, up to the listed boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_ENDS_P = BLOCK - {"caption", "tbody", "thead", "tfoot", "tr", "td", "th", "html", "body"}
_WORDS = (
    r"(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|popup|modal|newsletter|subscri\w*|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|widget|toolbar|footer|masthead|topbar|pagination|pager|"
    r"comments?|commentlist|respond|disqus\w*|replies|share|sharing|social|related|recommended|login|search)"
)
#: What may follow such a word in a name that is still about the element's place in the page.
_PLACES = (
    r"(?:area|bar|block|body|bottom|box|btn|buttons?|center|col|column|container|content|footer|form|frame|header|holder|icons?|inner|items?|"
    r"left|links?|list|main|module|outer|overlay|panel|posts?|articles?|stories|right|row|section|signup|slot|small|text|title|toggle|top|unit|wide|wrap|wrapper|zone)"
)
#: A name with such a word, alone or before words of place, is noise, unless it only says what the element has or lacks.
_NOISE = re.compile(rf"(?!(?:has|no|with|without)[_\-])(?:.*[_\-])?{_WORDS}(?:[_\-]*\d+)?(?:[_\-]+(?:{_PLACES}|{_WORDS}|\d+))*[_\-]*\Z", re.I)
_NOISE_WHOLE = re.compile(rf"{_WORDS}[\d_\-]*", re.I)
#: Whether an element is noise, and how surely: by a part of a name, by a whole name, or whatever it holds.
PART, WHOLE, SURE = 1, 2, 3
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())


#: What is a template by its count alone outside of articles; within one it must reach the share as well.
CONTAINERS = frozenset("aside center details dialog div dl fieldset figure footer form header menu nav ol section table ul".split())
#: What is hashed: blocks, and what is never article text.
_HASHED = (BLOCK | CONTAINERS) - {"html", "body", "article", "main", "hr"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    """An element: its tag, its children and texts, and where its source lies in the page."""

    __slots__ = ("tag", "parts", "start", "end", "noise", "named")

    def __init__(self, tag: str, start: int):
        self.tag = tag
        self.parts: list[Node | str] = []
        self.start = self.end = start
        self.noise = tag in DROP
        self.named = 0


def _noisy(tag: str, attrs: str) -> int:
    """0, PART, WHOLE or SURE. The id of a heading names its subject, not its place."""
    found = 0
    for name, *values in _ATTR.findall(attrs):
        value = "".join(values)
        name = name.lower()
        if name == "class" or (name == "id" and tag not in _HEADINGS):
            for x in value.split():
                if _NOISE.match(x):
                    found = max(found, WHOLE if _NOISE_WHOLE.fullmatch(x) else PART)
        elif name == "role":
            if value.strip().lower() in _NOISE_ROLES:
                return SURE
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return SURE
    return found


def _clear_wrappers(root: Node) -> None:
    """Elements that are noise by name, but hold the page's main text, are none.

    They hold a main element; or, where no main or article stands outside noise, an article or most of the page's text
    (both, if the whole of a name says that they are noise).
    """
    order: list[Node] = []
    stack = [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [p for p in x.parts if isinstance(p, Node) and not (p.noise and p.named == 0)]
    held: dict[Node, tuple[int, bool, bool]] = {}  # characters, main, article
    for x in reversed(order):
        below = [held[p] for p in x.parts if isinstance(p, Node) and p in held]
        chars = sum(len(p.strip()) for p in x.parts if isinstance(p, str)) + sum(b[0] for b in below)
        held[x] = chars, any(b[1] for b in below) or (x.tag == "main" and chars > 0), any(b[2] for b in below) or (x.tag == "article" and chars > 0)

    def plain(x: Node) -> bool:
        """Whether a main or article with text is found without entering noise."""
        stack = [x]
        while stack:
            y = stack.pop()
            if y.tag in ("main", "article") and held[y][0]:
                return True
            stack += [p for p in y.parts if isinstance(p, Node) and not p.noise]
        return False

    outside = plain(root)
    stack = [root]
    while stack:
        x = stack.pop()
        if x.noise:
            chars, main, article = held[x]
            most = 2 * chars > held[root][0]
            if not main and (outside or not ((article or most) if x.named == PART else (article and most))):
                continue
            x.noise = False
            outside = outside or plain(x)
        stack += [p for p in reversed(x.parts) if isinstance(p, Node) and p in held]


def parse(page: str) -> Node:
    root = Node("", 0)
    stack = [root]
    at, n = 0, len(page)
    named = False

    def close(k: int, end: int) -> None:
        for x in stack[k:]:
            x.end = end
        del stack[k:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k, at)
                    break
                if stack[k].tag in ("article", "main", "table") and tag not in ("body", "html", "main", "article"):
                    break  # a stray end tag doesn't reach out of these
            continue
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k, m.start())
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in CLOSES:
            closed, bound = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closed:
                    close(k, m.start())
                    break
                if stack[k].tag in bound:
                    break
        attrs = m["attrs"].strip()
        node = Node(tag, m.start())
        node.end = at
        stack[-1].parts.append(node)
        if attrs and not node.noise and tag not in ("html", "body", "article", "main") and (noisy := _noisy(tag, attrs)):
            node.noise = True
            node.named = noisy % SURE
            named = named or node.named > 0
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(page, at)
            node.parts.append(page[at : end.start()])
            node.end = at = end.end()
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
    close(0, n)
    if named:
        _clear_wrappers(root)
    return root


def _hash(page: str, x: Node) -> int:
    return xxhash.xxh64_intdigest(page[x.start : x.end]) - (1 << 63)


def _candidates(root: Node) -> Iterator[tuple[Node, Node, bool]]:
    """(element, the one around it, whether its count alone makes it a template) of all that may be templates.

    Sending True for an element keeps what lies in it from being visited.
    """
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        x, inside = stack.pop()
        for p in x.parts:
            if isinstance(p, str) or p.tag in RAW:
                continue
            article = p.tag in ("article", "main")
            gone = None
            if p.tag in (CONTAINERS if inside else _HASHED):
                gone = yield p, x, not inside and p.tag in CONTAINERS
            if not gone:
                stack.append((p, inside or article))


def subtrees(page: str, root: Node) -> set[tuple[int, int, bool]]:
    """(hash, hash of the element around it, whether its count alone makes it a template) of the subtrees of a page."""
    out = set()
    around: tuple[Node | None, int] = (None, 0)
    for p, x, alone in _candidates(root):
        if around[0] is not x:
            around = x, _hash(page, x) if x.tag else xxhash.xxh64_intdigest(page) - (1 << 63)
        if h := _hash(page, p):  # 0 stands for the page itself
            out.add((h, around[1], alone))
    return out


def _chars(x: Node) -> int:
    n, stack = 0, [x]
    while stack:
        y = stack.pop()
        if isinstance(y, str):
            n += len(y)
        elif not y.noise:
            stack += y.parts
    return n


def drop_templates(page: str, root: Node, templates: frozenset[int]) -> None:
    """Marks the recurring subtrees of a page that hold less than half of its text."""
    whole = None
    walk = _candidates(root)
    found = next(walk, None)
    while found is not None:
        p = found[0]
        gone = p.noise
        if not gone and _hash(page, p) in templates:
            whole = _chars(root) if whole is None else whole
            gone = 2 * _chars(p) < whole
        p.noise = gone
        try:
            found = walk.send(gone)
        except StopIteration:
            found = None


def text_of(root: Node) -> str:
    """The text of the blocks that remain."""
    mains: list[Node] = []
    stack: list[Node] = [root]
    while stack:
        x = stack.pop()
        if x.tag in ("article", "main"):
            mains.append(x)
        else:
            stack += [p for p in reversed(x.parts) if isinstance(p, Node) and not p.noise]
    blocks = _blocks(mains)
    return "\n".join(blocks or _blocks([root]))


def _blocks(nodes: list[Node]) -> list[str]:
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            t = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            if t:
                blocks.append(t)
            held.clear()

    for node in nodes:
        stack: list[Node | str | None] = [node]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                held.append(x)
            elif x.tag == "br":
                held.append(" ")
            elif not x.noise and not (x.tag == "header" and node.tag == ""):
                if x.tag in BLOCK or x.tag == "":
                    flush()
                    stack.append(None)
                stack += reversed(x.parts)
        flush()
    return blocks


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"), F.xxhash64(host_of(url)).alias("host"))
    p = p.withColumn("source", F.xxhash64(F.coalesce("html", F.lit(""))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, source, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                page = page.as_py() or ""
                # 0: the page itself
                rows += [(host, source, h, around, alone) for h, around, alone in {(0, source, False), *subtrees(page, parse(page))}]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["host", "source", "h", "around", "alone"])

    found = table(p.select("host", "source", "html").mapInArrow(count, "host long, source long, h long, around long, alone boolean"), "subtrees")
    places = found.groupBy("host", "h", "around").agg(F.count("*").alias("rows"), F.max("alone").alias("alone"))
    counts = places.groupBy("host", "h").agg(F.count("*").alias("n"), F.count_if("alone").alias("alone"), F.sum("rows").alias("rows"))
    heavy = F.lit(-(-found.count() // HEAVY))
    counts = table(counts.filter((F.col("n") >= MIN_PAGES) | (F.col("h") == 0) | (F.col("rows") > heavy)), "counts")
    size = counts.filter("h = 0").select("host", F.col("n").alias("pages"))
    often = (F.col("alone") >= MIN_PAGES) | ((F.col("n") >= MIN_PAGES) & (F.col("n") >= MIN_SHARE * F.col("pages")))
    judged = table(counts.filter("h <> 0").join(size, "host").select("host", "h", often.alias("often"), (F.col("rows") > heavy).alias("heavy")), "templates")
    # fewer than HEAVY keys, whatever the input
    most = F.broadcast(judged.filter("heavy").select("host", "h", F.col("often").alias("known")))
    met = found.filter("h <> 0").join(most, ["host", "h"], "left")
    rest = met.filter("known IS NULL").join(judged.filter("often AND NOT heavy").select("host", "h"), ["host", "h"], "left_semi")
    hits = met.filter("known").unionByName(rest)
    templates = table(hits.groupBy("host", "source").agg(F.collect_set("h").alias("templates")), "hits")  # of one page

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, drop in zip(batch.column(2), batch.column(3), strict=True):
                page, drop = page.as_py() or "", drop.as_py()
                root = parse(page)
                if drop:
                    drop_templates(page, root, frozenset(drop))
                texts.append(text_of(root))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    x = p.join(templates, ["host", "source"], "left").select("page_id", "url", "html", "templates")
    return x.mapInArrow(read, "page_id long, url string, text string, n_chars long")
