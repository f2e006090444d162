"""Main text of HTML pages by tree scoring.

A page is read once into a tree of block elements with their text blocks. Regions that are never part of an article (menus,
sidebars, forms, scripts, hidden parts, reader comments ...) are left out by tag, role, class or id; by class or id only if
they don't hold most of the article, so wrappers named after a part of the page stay. Every paragraph gives
points for its length and commas, discounted by its link density, to its parent and in falling shares to the ancestors
above. The container of the highest score, itself discounted by link density, is kept with those of its siblings that have a
fifth of its score or are plain paragraphs; where several have, their parent is kept too, but for its regions of links. Inside
the container only lists and tables of nothing but links go.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lucerna.llm.base import pick, query, ship, table
from lucerna.llm.tokens import slices

ship(__name__)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|math|iframe|object|textarea|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPH = frozenset("p pre td blockquote div section article li dd".split())
LEFT_OUT = frozenset("nav aside footer form head button dialog menu fieldset".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr".split())
CLOSES_SAME = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
LEFT_OUT_ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion sidebar aside comment comments disqus respond replies reply footer header masthead "
    "menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup "
    "login social share sharing related recommended widget toolbar pagination pager skip".split()
)
#: A name of several words is that of a region by its last word, or by its first before one of these; ``has-sidebar`` is a state.
PARTS = frozenset("area bar block body box buttons container content item links list menu panel section slot wrap wrapper".split())
STATES = frozenset("has with without no is layout".split())
KEPT_TAGS = frozenset("html body main article".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LONG_PARAGRAPH = 25
SIBLING_SHARE = 0.2


class Node:
    __slots__ = ("tag", "parent", "depth", "out", "score", "chars", "links", "named")

    def __init__(self, tag: str, parent: "Node | None", out: bool):
        self.tag, self.parent, self.out = tag, parent, out
        self.depth = parent.depth + 1 if parent else 0
        self.score, self.chars, self.links, self.named = 0.0, 0, 0, False


def left_out(tag: str, source: str, inside_main: bool) -> bool:
    """Whether an element and all in it can't be article text, by its tag, role or style."""
    if tag in LEFT_OUT or tag == "header" and not inside_main:
        return True
    if not source or tag in KEPT_TAGS:
        return False
    for name, a, b, c in ATTRIBUTE.findall(source):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role":
            if value in LEFT_OUT_ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return True
    return False


def named_left_out(source: str, inside_main: bool) -> bool:
    """Whether a class or the id names a region that is no article text; in an article a header is part of it."""
    for name, a, b, c in ATTRIBUTE.findall(source):
        if name.lower() in ("class", "id"):
            for token in (a or b or c).lower().split():
                words = [w for w in re.split(r"[^a-z]+", token) if w]
                if not words or words[0] in STATES:
                    continue
                word = words[0] if words[-1] in PARTS and words[-1] not in LEFT_OUT_WORDS else words[-1]
                if word in LEFT_OUT_WORDS and not (word == "header" and inside_main):
                    return True
    return False


def points(text: str, link: int) -> float:
    chars = len(text)
    return (1 + text.count(",") + min(chars / 100, 3.0)) * (1 - link / chars)


def leave_named_out(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Named regions go with all in them, unless they hold most of the points of article and main, or of a page without."""
    weight = {id(x): [0.0, 0.0] for x in nodes}  # of its articles, of all
    for owner, text, link in blocks:
        value = points(text, link) if owner.tag in PARAGRAPH and len(text) >= LONG_PARAGRAPH else 1e-6 * (len(text) - link)
        in_article, up = False, owner
        while up is not None:
            in_article = in_article or up.tag in ("article", "main") and not up.named
            weight[id(up)][0] += value if in_article else 0.0
            weight[id(up)][1] += value
            up = up.parent
    kind = 0 if weight[id(nodes[0])][0] > 0 else 1
    most = weight[id(nodes[0])][kind] / 2
    for x in nodes:  # parents come first
        x.out = x.out or x.parent is not None and x.parent.out or x.named and x.tag not in KEPT_TAGS and weight[id(x)][kind] <= most


def read_tree(source: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """Block elements in page order, and text blocks: owner, text, characters in links."""
    node = Node("body", None, False)
    nodes, blocks = [node], []
    parts: list[str] = []
    in_link = link_chars = 0
    at, n = 0, len(source)

    def flush() -> None:
        nonlocal parts, link_chars
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = entities.unescape(text)
            text = SPACE.sub(" ", text).strip()
            if text:
                blocks.append((node, text, min(link_chars, len(text))))
            parts = []
        link_chars = 0

    def climb(tags: frozenset | tuple | set, stops: frozenset | set) -> None:
        """Close up to the nearest open element of ``tags``, unless one of ``stops`` comes first."""
        nonlocal node
        top = node
        while top.parent is not None:
            if top.tag in tags:
                flush()
                node = top.parent
                return
            if top.tag in stops:
                return
            top = top.parent

    def inside_main() -> bool:
        up = node
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        return up is not None

    scope = frozenset(["td", "th", "table", "button"])
    for m in TOKEN.finditer(source):
        if m.start() > at and not node.out:
            text = source[at : m.start()]
            parts.append(text)
            if in_link:
                link_chars += len(text)
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in BLOCK:
            if tag == "a":
                in_link = 0 if m.group(2) else 1
            elif tag == "br":
                parts.append(" ")
            elif tag == "head" and not m.group(2):
                flush()
                node = Node("head", node, True)
                nodes.append(node)
            elif tag == "head":
                climb(("head",), frozenset())
            elif tag not in EMPTY and not m.group(2) and m.group(4) and ((out := left_out(tag, m.group(4), False)) or named_left_out(m.group(4), inside_main())):
                flush()
                node = Node(tag, node, node.out or out)
                node.named = True
                nodes.append(node)
            elif m.group(2) and node.tag == tag:
                climb((tag,), frozenset())
            continue
        if m.group(2):
            if tag not in ("html", "body"):
                climb((tag,), frozenset() if tag in ("table", "td", "th", "tr") else scope - {tag})
            continue
        if tag in ("html", "body"):
            climb(("head",), frozenset())
            continue
        flush()
        if tag in CLOSES_P:
            climb(("p",), scope)
        if tag in CLOSES_SAME:
            same, stops = CLOSES_SAME[tag]
            climb(set(same.split()), set(stops.split()))
        if tag == "hr":
            continue
        inside = (tag == "header" or bool(m.group(4))) and inside_main()
        named = bool(m.group(4)) and named_left_out(m.group(4), inside)
        node = Node(tag, node, node.out or left_out(tag, m.group(4), inside))
        node.named = named
        nodes.append(node)
        in_link = 0
    if at < n and not node.out:
        parts.append(source[at:])
    flush()
    return nodes, blocks


def main_text(source: str | None) -> str:
    """The article of a page; empty if it has no text outside the regions left out."""
    if not source:
        return ""
    nodes, blocks = read_tree(source)
    if any(x.named for x in nodes):
        leave_named_out(nodes, blocks)
    blocks = [b for b in blocks if not b[0].out]
    if not blocks:
        return ""
    for owner, text, link in blocks:
        chars = len(text)
        up = owner
        while up is not None:
            up.chars += chars
            up.links += link
            up = up.parent
        if owner.tag in PARAGRAPH and chars >= LONG_PARAGRAPH:
            value = points(text, link)
            # an element that holds text itself is the paragraph; the points go to what holds it
            up, share = owner.parent or owner, 1.0
            while up is not None:
                up.score += value * share
                share = 0.5 if share == 1.0 else share / 2
                up = up.parent
    for x in nodes:
        if x.score:
            x.score *= 1 - x.links / x.chars if x.chars else 0.0
            if x.tag in ("article", "main"):
                x.score *= 1.25
    best = max((x for x in nodes if not x.out), key=lambda x: (x.score, x.depth))
    around = None
    if best.score <= 0:  # no paragraph anywhere: all text outside the regions left out
        marked = [x for x in nodes if x.tag in ("article", "main") and x.chars and not x.out]
        kept = {id(max(marked, key=lambda x: x.chars) if marked else nodes[0])}
    else:
        # a section of an article scores alone what the article scores with its other sections
        up = best.parent
        while up is not None and best.tag not in ("article", "main"):
            if up.tag in ("article", "main"):
                best = up
            up = up.parent
        bar = SIBLING_SHARE * best.score
        kept = {id(best)}
        for x in nodes:
            if x.parent is best.parent and x is not best and best.parent is not None and not x.out and x.chars:
                density = x.links / x.chars
                if x.score >= bar or x.tag == "p" and x.chars > 80 and density < 0.25:
                    kept.add(id(x))
        scored = sum(id(x) in kept and x.score > 0 for x in nodes)
        if scored > 1 and best.parent is not nodes[0]:  # what stands between the sections, headings say, is part of the article
            around = best.parent
    state: dict[int, int] = {}  # 2: in the article, 1: around its sections
    for x in nodes:  # parents come first
        whole = id(x) in kept or (x.parent is not None and state[id(x.parent)] == 2)
        inside = whole or x is around or (x.parent is not None and state[id(x.parent)] == 1)
        if id(x) in kept or not inside or not x.chars:
            cut = False
        elif whole:  # in the article only lists and tables of nothing but links
            cut = x.tag in ("ul", "ol", "dl", "table") and x.links >= x.chars
        else:
            cut = x.tag in ("ul", "ol", "dl", "table", "div", "section") and x.links > 0.5 * x.chars
        state[id(x)] = 0 if cut else 2 if whole else int(inside)
    return " ".join(text for owner, text, _ in blocks if state[id(owner)])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = 4_000_000) -> DataFrame:
    """page_id, url, text, n_chars of every page; a narrow pass.

    A null or empty html gives an empty text. Null ids and urls are kept, repeated rows are returned each, other columns
    are ignored. Of containers that tie the deepest, then the first, is taken. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", chunk):
                texts = [main_text(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    return pick(pages, page_id=id_col, url=url_col, html=html_col).mapInArrow(run, "page_id long, url string, text string, n_chars long")


@query("op4_extract")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
