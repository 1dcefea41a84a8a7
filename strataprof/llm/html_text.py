"""Main text of web pages by site template removal.

Pages become trees of elements by a tolerant scan.  Element subtrees are hashed in two ways: by content (tags and texts)
and by place in the layout (tags, classes and roles from the root down to them).  Spark counts, for each host, on how
many of its distinct pages a hash stands and how much text stands under it.  What recurs on many pages is the site's
template:

* content that recurs is deleted, wherever it stands; for prose (paragraphs, headings, items) it takes half of the pages;
* a container at a place that recurs and holds little of the host's text is deleted;
* a place that holds most of the host's text is where the articles are: where that is an ``article`` or ``main`` element
  only what is in it counts, and there a container goes only for its content or if its markup names it as no main text.
  Where no such place is an article, articles that hold a fair part of the page are taken.

On a host with few distinct pages a hash must stand on all of them, and then only small containers go for their content.
A page alone on its host, or without a host, is weighed by its own text in the same way.

What markup says is evidence that the text outweighs.  Elements that HTML defines as no main text (nav, footer, aside,
script, style ...) go everywhere.  A form, and a block whose class or id names it as a menu, an advert, a notice or
comments of readers, goes unless it holds the page: half of the page's text and prose, with its h1 if it has one; a named
block also goes if blocks of that name recur and hold less than half of the host's text.  A name with a second part that
says nothing about layout ("ad-hoc", "social-history") counts only for a block whose text is mostly links.

Null html gives an empty text; a null url or one without a host has no template; repeated pages of a host count once for
its template and each come back; a share that is just reached counts as reached; an empty table gives an empty result;
other columns are ignored.  Pages of any length are read whole.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataprof.llm.common import cut, per_text, table

LIGHT, HEAVY = 0.2, 0.5  # shares of the text: a part of the layout holds less, a place of main text at least
MOST_BROADCAST = 200_000  # template subtrees of all hosts, 8 bytes each beside their host
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# Kinds of elements (fixed values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table caption tbody tfoot "
    "thead tr ul".split()
)
SHUTS_P = BLOCK - {"dd", "dt", "li", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "head", "legend", "summary"}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption tr".split())
FORMS = frozenset("form label fieldset".split())
DROPPED = frozenset("nav footer aside head menu dialog button select option input".split()) | FORMS | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
#: Class or id names, or one half of them, that tell what a block is for (fixed values).
NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar ad ads advert adverts advertisement banner sponsor sponsored cookie "
    "cookies consent newsletter subscribe share sharing social comment comments respond disqus footer masthead pagination pager "
    "toolbar popup modal".split()
)
#: What stands beside such a name without changing what it says (fixed values).
LAYOUT_NAMES = frozenset(
    "area bar block body bottom box buttons center col column container content desktop dialog first fixed form global group head header "
    "icon icons inner item items js label last layout left link links list main mobile module outer overlay page panel post primary "
    "message notice notices policy reader readers right row secondary section signup site slot sticky text this thread title top "
    "trail unit user users visitor widget wrap wrapper zone".split()
)


@lru_cache(maxsize=1 << 16)
def _named(names: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The names that say a block is no main text, and those that hint at it: of a class or id of at most two parts, those
    in NAMES, where the other part is a name of layout, or is not."""
    said, hinted = set(), set()
    for n in names:
        parts = [p for p in re.split("[-_]+", n) if p]
        if len(parts) <= 2:
            (said if all(p in NAMES or p in LAYOUT_NAMES for p in parts) else hinted).update(p for p in parts if p in NAMES)
    return tuple(sorted(said)), tuple(sorted(hinted))


@lru_cache(maxsize=1 << 16)
def _hash(*said) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, said)).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


@dataclass(frozen=True)
class Template:
    """Hashes of one host: content and places to delete, and places of main text."""

    content: frozenset = frozenset()
    layout: frozenset = frozenset()
    heavy: frozenset = frozenset()


class Node:
    __slots__ = ("tag", "names", "role", "parts", "key", "place", "size", "links", "prose", "titled")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.names, self.role, self.parts, self.key, self.place = tag, (), "", [], 0, 0
        self.size = self.links = self.prose = 0  # code points under it, those in links, those in prose
        self.titled = tag == "h1"  # whether it is or holds an h1
        if "=" in attributes:
            names = []
            for m in ATTRIBUTE.finditer(attributes):
                name = m[1].lower()
                if name in ("class", "id"):
                    value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[2] or m[3] or m[4] or "")
                    names += re.sub(r"[0-9]+", "", value).lower().split()
                elif name == "role":
                    self.role = (m[2] or m[3] or m[4] or "").strip().lower()
            self.names = tuple(names)

    @property
    def named(self) -> int:
        """A hash of what the markup says a block is for, 0 if it says nothing of the kind."""
        if not self.names:
            return 0
        said, hinted = _named(self.names)
        if hinted and 2 * self.links > self.size:
            said += hinted
        return _hash("named", self.tag, *said) if said else 0


def parse(page: str) -> Node:
    """A tree of elements and texts.  Unclosed paragraphs and list items end where the next begins; closing tags
    without an opening one are skipped; what is open at the end is closed there."""
    root = Node("#root")
    stack, at, end = [root], 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in SHUTS_P:
            _shut(stack, ("p",), ("table", "td", "th", "button", "div", "section", "article", "main", "li"))
        elif tag == "li":
            _shut(stack, ("li",), ("ul", "ol", "menu"))
        elif tag in ("dd", "dt"):
            _shut(stack, ("dd", "dt"), ("dl",))
        elif tag in ("tr", "tbody", "thead", "tfoot"):
            _shut(stack, ("tr",), ("table",))
        elif tag in ("td", "th"):
            _shut(stack, ("td", "th"), ("tr", "table"))
        node = Node(tag, m[3])
        stack[-1].parts.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        stack.append(node)
    return root


def _shut(stack: list[Node], tags: tuple[str, ...], bounds: tuple[str, ...]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in bounds:
            return


#: What stands in a row of counts.
BOX, PROSE_TEXT, PLACE, NAMED = range(4)


def hash_subtrees(root: Node) -> dict[tuple[int, int], int]:
    """Set ``key`` (content), ``place`` and the sizes of every element; the hashes of block elements by kind, with the text
    that stands under each."""
    found: dict[tuple[int, int], int] = {}
    todo, order = [(root, 0)], []
    while todo:
        node, above = todo.pop()
        node.place = _hash(above, node.tag, node.role, *node.names)
        order.append(node)
        todo.extend((x, node.place) for x in node.parts if not isinstance(x, str))
    for node in reversed(order):
        said, size = [node.tag], 0
        for x in node.parts:
            if not isinstance(x, str):
                said.append(str(x.key))
                size += x.size
                node.links += x.links
                node.prose += x.prose
                node.titled |= x.titled
            elif said_here := " ".join(x.split()):
                said.append(said_here)
                size += len(said_here)
        node.size = size
        if node.tag in ("a", "button"):
            node.links = size
        if node.tag in PROSE:
            node.prose = size
        node.key = int.from_bytes(hashlib.blake2b("\x00".join(said).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
        if node.tag in BLOCK and node.tag not in DROPPED:
            prose = node.tag in PROSE
            if len(said) > 1:
                found[PROSE_TEXT if prose else BOX, node.key] = size
            if not prose:
                found[PLACE, node.place] = found.get((PLACE, node.place), 0) + size
            if named := node.named:
                found[NAMED, named] = found.get((NAMED, named), 0) + size
    return found


def _holds_page(node: Node, page: Node) -> bool:
    """Whether most of a page's text stands in the element, its title included: then it is no mere part of the page."""
    return 2 * node.size >= page.size and 2 * node.prose >= page.prose and (node.titled or not page.titled)


def _no_text(node: Node, inside: bool, page: Node) -> bool:
    """Whether HTML itself defines the element as no main text."""
    if node.tag in FORMS or node.role == "form":
        return not _holds_page(node, page)
    if node.tag in DROPPED or node.role in DROPPED_ROLES:
        return True
    return node.tag == "header" and not (inside and any(x.tag in ("h1", "h2") for x in _elements(node)))


def _elements(node: Node):
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(x for x in reversed(n.parts) if not isinstance(x, str))


def _roots(root: Node, template: Template) -> list[Node]:
    """Where the main text stands: the outermost articles at a place of main text; else articles, or else main elements,
    that are no part of the layout and hold a fair part of the page; else the whole page."""
    for tags, fits in (
        (("article", "main"), lambda n: n.place in template.heavy),
        (("article",), lambda n: n.place not in template.layout and not n.named),  # comments may be articles too
        (("main",), lambda n: n.place not in template.layout and not n.named),
    ):
        found, todo = [], [root]
        while todo:
            n = todo.pop()
            if (n.tag in tags or n.role in tags) and fits(n):
                found.append(n)
            elif n is root or not _no_text(n, False, root):
                todo.extend(x for x in reversed(n.parts) if not isinstance(x, str))
        if found and sum(n.size for n in found) >= LIGHT * root.size:
            return found
    return [root]


def alone(found: dict[tuple[int, int], int], total: int) -> Template:
    """What one page shows of a template: where most of its text stands."""
    return Template(heavy=frozenset(key for (kind, key), size in found.items() if kind == PLACE and size >= HEAVY * total))


def main_text(page: str, template: Template | None = None) -> str:
    """Blocks of the main text in page order, one to a line.  ``template``: None for a page weighed by its own text."""
    root = parse(page)
    found = hash_subtrees(root)
    if template is None:
        template = alone(found, root.size)
    roots = _roots(root, template)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            if said := " ".join(entities.unescape("".join(run)).split()):
                blocks.append(said)
            run.clear()

    def gone(x: Node, inside: bool) -> bool:
        if x.tag not in BLOCK:
            return False
        if x.key in template.content:
            return True
        if x.tag not in ("html", "body", "main") and (named := x.named) and (named in template.layout or not _holds_page(x, root)):
            return True
        return not inside and x.tag not in PROSE and x.place in template.layout

    def boxes(x: Node) -> bool:
        return any(c.place in template.heavy for c in x.parts if not isinstance(c, str))

    for top in roots:
        todo: list = [("open", top, top is not root)]
        while todo:
            step, x, inside = todo.pop()
            if step == "flush":
                flush()
                continue
            if isinstance(x, str):
                run.append(x)
                continue
            if x is not top:
                if _no_text(x, inside, root):
                    run.append(" ")
                    continue
                if gone(x, inside):
                    flush()
                    continue
            if not inside and x.tag not in ("html", "body") and x.place in template.heavy and not boxes(x):
                inside = True  # the innermost place that holds most of the text
            if x.tag == "br" or x.tag in ("td", "th"):
                run.append(" ")
            if x.tag in BLOCK:
                flush()
                todo.append(("flush", x, inside))
            todo.extend(("open", c, inside) for c in reversed(x.parts))
        flush()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.length(host) > 0, host)


def subtree_counts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """``host, kind, key, c, chars``: on how many distinct pages of a host a hash stands, and how much text under it;
    and ``host, n, total``: its pages and their text."""

    def fn(texts, rows):
        trees = [parse(t) for t in texts]
        found = [hash_subtrees(p) for p in trees]
        return {
            "page": [p.key for p in trees], "total": [p.size for p in trees], "kinds": [[k for k, _ in f] for f in found],
            "keys": [[k for _, k in f] for f in found], "sizes": [list(f.values()) for f in found],
        }

    src = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("host is not null and html is not null")
    seen = per_text(src, "html", fn, "page bigint, total bigint, kinds array<tinyint>, keys array<bigint>, sizes array<bigint>", ["host"])
    seen = cut(seen.groupBy("host", "page").agg(F.first(F.struct("total", "kinds", "keys", "sizes")).alias("x")).select("host", "x.*"), "page-subtrees")
    counts = (
        seen.select("host", F.explode(F.arrays_zip("kinds", "keys", "sizes")).alias("x"))
        .groupBy("host", F.col("x.kinds").alias("kind"), F.col("x.keys").alias("key"))
        .agg(F.count("*").alias("c"), F.sum("x.sizes").alias("chars"))
    )
    return counts, seen.groupBy("host").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


def templates(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = 8, share: float = 0.2, prose_share: float = 0.5,
    light: float = LIGHT, heavy: float = HEAVY,
) -> DataFrame:
    """``host, content, layout, heavy``: hashes to delete and of places of main text, for hosts of two distinct pages or
    more.  A hash must stand on ``min_pages`` of them, or on all if they are fewer, and on ``share`` (``prose_share``) of
    all, so a host has at most as many as its pages have subtrees on average, over ``share``; names are bounded by their
    list.  What fewer than ``min_pages`` pages share may be one article told twice: of that only light containers go."""
    counts, hosts = subtree_counts(pages, url_col, html_col)
    known = hosts.where("n >= 2")
    often = (F.col("c") >= F.least(F.lit(min_pages), F.col("n"))) & (F.col("c") >= share * F.col("n"))
    sure = F.col("c") >= min_pages
    small = F.col("chars") * F.col("n") < light * F.col("total") * F.col("c")
    role = (
        F.when(often & (F.col("kind") == BOX) & (sure | small), "content")
        .when(often & sure & (F.col("kind") == PROSE_TEXT) & (F.col("c") >= prose_share * F.col("n")), "content")
        .when(often & (F.col("kind") == PLACE) & (F.col("chars") >= heavy * F.col("total")), "heavy")
        .when(often & (F.col("kind") == PLACE) & (F.col("chars") < light * F.col("total")), "layout")
        .when((F.col("kind") == NAMED) & (F.col("c") >= 2) & (F.col("chars") < heavy * F.col("total")), "layout")
    )
    kept = counts.where("c >= 2").join(known, "host").select("host", "key", role.alias("role")).where("role is not null")
    sets = [F.collect_list(F.when(F.col("role") == r, F.col("key"))).alias(r) for r in ("content", "layout", "heavy")]
    return known.select("host").join(kept.groupBy("host").agg(*sets), "host", "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """``id_col, url_col, text, n_chars``."""
    known = cut(templates(pages, url_col, html_col, **options).select(F.col("host").alias("_host"), F.struct("content", "layout", "heavy").alias("_template")), "templates")
    sizes = F.sum(sum(F.coalesce(F.size(f"_template.{k}"), F.lit(0)) for k in ("content", "layout", "heavy")))
    if (known.agg(sizes).first()[0] or 0) <= MOST_BROADCAST:
        known = F.broadcast(known)
    src = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("_h"))
    joined = src.join(known, src["_h"] == F.col("_host"), "left").select("_id", "_url", "_html", "_host", "_template")

    def fn(texts, rows):
        hosts, given = (rows.column(rows.schema.get_field_index(c)) for c in ("_host", "_template"))
        out, last, template = [], None, None
        for i, t in enumerate(texts):
            if not t:
                out.append("")
                continue
            host = hosts[i].as_py()
            if host is None:  # no host, or one distinct page
                template = None
            elif host != last:
                template = Template(**{k: frozenset(v or ()) for k, v in (given[i].as_py() or {}).items()})
            last = host
            out.append(main_text(t, template))
        return {"text": out, "n_chars": list(map(len, out))}

    found = per_text(joined, "_html", fn, "text string, n_chars bigint", ["_id", "_url", "_host", "_template"])
    return found.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
