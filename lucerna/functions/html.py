"""HTML to a table of elements.

Spark has no HTML parser, so this is the one place where Python touches each page.
It only builds the tree: one row in, the same row out with a nested ``dom`` column.
Everything that *interprets* the tree is written as Spark expressions elsewhere.

Tree rules kept: void elements, raw-text elements, implied ``html/head/body/tbody``,
implied end tags (``p``, ``li``, ``dt/dd``, table parts, ``option``), and end tags that
never cross a table cell. Formatting elements are not re-opened after a block closes.
"""

from __future__ import annotations

import html as _entities
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# executors need not have this package installed: its functions travel with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title xmp iframe".split())
UNSEEN = frozenset("head title meta link base script style template noscript source track param datalist".split())
HEAD_ONLY = frozenset("title meta link base script style noscript template".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
BLOCK = CLOSES_P | frozenset("br body html tr td th caption thead tbody tfoot option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE_STOP = frozenset("html table td th caption template object marquee applet".split())
# start tag -> (open tags it closes, tags that stop the search)
SIBLING_CLOSE = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
# Containers whose text is rebuilt from their text nodes on demand instead of being stored twice.
WIDE = frozenset("html head body main article section header footer nav aside ul ol dl table thead tbody tr form".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDING_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|opacity\s*:\s*0(?:\.0+)?\s*(?:;|$)", re.I)
DOCTYPE = re.compile(r"<!doctype\s+([^\s>]+)", re.I)
CSS_SAFE = re.compile(r"[^\w\-\u0080-￿]")

DOM_DDL = (
    "elements array<struct<pos:int,parent:int,last:int,depth:int,tag:string,attrs:map<string,string>,nth:int,"
    "n_children:int,text:string,text_len:int,n0:int,n1:int,s0:int,s1:int,selector:string,aria_hidden:boolean,hidden:boolean,"
    # the index: what an element is inside of, what it refers to and what refers to it, its name
    "region:string,link:int,context:int,figcaption:int,dir_at:int,in_lang:boolean,in_head:boolean,isolated:boolean,in_nav:boolean,quiet:boolean,in_heading:boolean,"
    "banner_link:boolean,labels:array<int>,refs:array<struct<attribute:string,id:string,pos:int>>,target:int,described:boolean,fields_before:int,head:string,name:string>>,"
    "nodes array<struct<pos:int,text:string>>,body_text string,doctype string"
)


class _El:
    __slots__ = ("pos", "parent", "last", "depth", "tag", "attrs", "nth", "same", "kids", "n0", "n1", "s0", "s1", "ah", "hid", "seen")


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(source):
        name = m.group(1).lower()
        if name not in out:
            value = m.group(2) or m.group(3) or m.group(4) or ""
            out[name] = _entities.unescape(value) if "&" in value else value
    return out


def parse(source: str) -> tuple[list[_El], list[tuple[int, str]], str, str | None]:
    """Elements in document order, text nodes, visible body text, doctype name."""
    els: list[_El] = []
    stack: list[_El] = []
    nodes: list[tuple[int, str]] = []
    seen_text: list[str] = []
    state = {"head": False, "body": False}

    def push(tag: str, attrs: dict[str, str], at: int) -> _El:
        e = _El()
        top = stack[-1] if stack else None
        e.pos, e.tag, e.attrs, e.kids, e.n0, e.s0 = len(els), tag, attrs, 0, len(nodes), at
        e.last, e.n1, e.s1, e.seen, e.same = e.pos, len(nodes), at, {}, 1
        e.parent = top.pos if top else -1
        e.depth = top.depth + 1 if top else 0
        e.ah = (top.ah if top else False) or attrs.get("aria-hidden") == "true"
        e.hid = (
            (top.hid and top.tag != "head" if top else False)
            or tag in UNSEEN
            or "hidden" in attrs
            or (tag == "input" and attrs.get("type", "").lower() == "hidden")
            or bool(HIDING_STYLE.search(attrs.get("style", "")))
        )
        if top:
            top.kids += 1
            e.nth = top.seen[tag] = top.seen.get(tag, 0) + 1
        else:
            e.nth = 1
        els.append(e)
        stack.append(e)
        return e

    def pop(at: int) -> None:
        e = stack.pop()
        e.last, e.n1, e.s1 = len(els) - 1, len(nodes), at
        if e.tag in BLOCK:
            seen_text.append(" ")

    def close_until(targets, stops, at: int) -> bool:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in targets:
                while len(stack) > i:
                    pop(at)
                return True
            if stack[i].tag in stops:
                return False
        return False

    def ensure_root(at: int) -> None:
        if not stack:
            push("html", {}, at)

    def ensure_body(at: int) -> None:
        ensure_root(at)
        if not state["body"]:
            close_until({"head"}, (), at)
            state["body"] = True
            push("body", {}, at)

    def add_text(raw: str, at: int) -> None:
        if not raw:
            return
        text = _entities.unescape(raw) if "&" in raw else raw
        if not state["body"]:
            if not text.strip():
                return
            if not (stack and stack[-1].tag == "title"):
                ensure_body(at)
        top = stack[-1]
        nodes.append((top.pos, text))
        if state["body"] and not top.hid:
            seen_text.append(text)

    cursor, doctype, n = 0, None, len(source)
    while cursor < n:
        m = TOKEN.search(source, cursor)
        if m is None:
            add_text(source[cursor:], cursor)
            break
        if m.start() > cursor:
            add_text(source[cursor : m.start()], cursor)
        cursor = m.end()
        if m.group(2) is None:
            if doctype is None:
                d = DOCTYPE.match(m.group(0))
                doctype = d.group(1).lower() if d else None
            continue
        tag, at = m.group(2).lower(), m.start()
        if m.group(1):
            if tag in ("html", "body"):
                continue
            stops = () if tag in ("table", "td", "th", "tr", "thead", "tbody", "tfoot", "head") else SCOPE_STOP
            close_until(HEADINGS if tag in HEADINGS else {tag}, stops, cursor)
            continue
        attrs = _attributes(m.group(3)) if m.group(3) else {}
        if tag == "html":
            if els:
                for k, v in attrs.items():
                    els[0].attrs.setdefault(k, v)
            else:
                push("html", attrs, at)
            continue
        ensure_root(at)
        if tag == "head":
            if not state["head"] and not state["body"]:
                state["head"] = True
                push("head", attrs, at)
            continue
        if tag == "body":
            if not state["body"]:
                close_until({"head"}, (), at)
                state["body"] = True
                push("body", attrs, at)
            continue
        if not state["body"]:
            if tag in HEAD_ONLY:
                if not state["head"]:
                    state["head"] = True
                    push("head", {}, at)
            else:
                ensure_body(at)
        if tag in CLOSES_P:
            close_until({"p"}, SCOPE_STOP | {"button"}, at)
        if tag in SIBLING_CLOSE:
            close_until(*SIBLING_CLOSE[tag], at)
        elif tag in ("a", "button"):
            close_until({tag}, SCOPE_STOP, at)
        elif tag in HEADINGS and stack[-1].tag in HEADINGS:
            pop(at)
        if tag == "tr" and stack[-1].tag == "table":
            push("tbody", {}, at)
        if tag in BLOCK:
            seen_text.append(" ")
        push(tag, attrs, at)
        if tag in VOID or (m.group(3).rstrip().endswith("/") and tag in ("svg", "path", "circle", "rect", "use", "g", "line")):
            pop(cursor)
        elif tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, cursor)
            stop = end.start() if end else n
            if tag in ("title", "textarea"):
                add_text(source[cursor:stop], cursor)
            cursor = end.end() if end else n
            pop(cursor)
    while stack:
        pop(n)
    return els, nodes, " ".join("".join(seen_text).split()), doctype


def _selectors(els: list[_El]) -> list[str]:
    """Unique id, else a path of at most six steps up to body or the nearest unique id."""
    count: dict[str, int] = {}
    for e in els:
        i = e.attrs.get("id")
        if i:
            count[i] = count.get(i, 0) + 1
    own: list[str | None] = []
    for e in els:
        i = e.attrs.get("id")
        own.append("#" + CSS_SAFE.sub(lambda m: "\\" + m.group(0), i) if i and count[i] == 1 else None)
    out: list[str] = []
    for e in els:
        if own[e.pos]:
            out.append(own[e.pos])
            continue
        parts: list[str] = []
        node: _El | None = e
        while node is not None and len(parts) < 6:
            if own[node.pos]:
                parts.append(own[node.pos])
                break
            up = els[node.parent] if node.parent >= 0 else None
            if up is None or node.tag in ("html", "body"):
                parts.append(node.tag)
                break
            parts.append(f"{node.tag}:nth-of-type({node.nth})" if up.seen[node.tag] > 1 else node.tag)
            node = up
        out.append(" > ".join(reversed(parts)))
    return out


JAVA_SPACE = re.compile(r"[ \t\n\x0b\f\r\xa0]+")
ASCII_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
NAMED_TAGS = frozenset("button input select textarea a area img video audio object embed iframe".split())
CONTROLS = frozenset("input select textarea".split())
LABELLED_ROLES = frozenset("textbox combobox checkbox radio switch spinbutton slider".split())
CONTEXT_TAGS = frozenset("p li td dd h1 h2 h3 h4 figcaption".split())
REFERENCES = ("aria-labelledby", "aria-describedby", "aria-controls", "aria-owns")
ISOLATING_STYLE = re.compile(r"unicode-bidi\s*:\s*(?:isolate|plaintext|isolate-override)")
HOOK_CLASS, HOOK_ID, HOOK_WORD = re.compile("accessib|a11y|negishut"), re.compile("accessib|a11y"), "נגישות"
HEAD_CHARS = 260  # the start of a wide container's text: enough for every excerpt that is taken of one


def _squash(s: str) -> str:
    return JAVA_SPACE.sub(" ", s).strip(" ")


class Index:
    """Lookups over a parsed page, made in one walk: collectors read an element's columns instead of searching the page."""

    def __init__(self, els: list[_El], nodes: list[tuple[int, str]], texts: list[str | None]):
        self.els, self.nodes, self.texts = els, nodes, texts
        self.by_id: dict[str, int] = {}
        self.by_name: dict[str, int] = {}
        self.label_for: dict[str, list[int]] = {}
        self.described: set[str] = set()
        self.caption: dict[int, int] = {}
        for e in els:
            a = e.attrs
            if a:
                if a.get("id"):
                    self.by_id.setdefault(a["id"], e.pos)
                if a.get("name"):
                    self.by_name.setdefault(a["name"], e.pos)
                if e.tag == "label" and a.get("for"):
                    self.label_for.setdefault(a["for"], []).append(e.pos)
                if "aria-describedby" in a:
                    self.described.update(ASCII_SPACE.split(a["aria-describedby"]))
            if e.tag == "figcaption":
                up = e.parent
                while up >= 0:
                    if els[up].tag == "figure":
                        self.caption.setdefault(up, e.pos)
                    up = els[up].parent

    def text(self, pos: int) -> str:
        own, e = self.texts[pos], self.els[pos]
        return _squash("".join([t for _, t in self.nodes[e.n0 : e.n1]])) if own is None else own

    def head(self, e: _El) -> str:
        """The first characters of a wide container's text; reads no more of it than needed."""
        parts, size = [], 0
        for _, t in self.nodes[e.n0 : e.n1]:
            parts.append(t)
            size += len(t)
            if size > HEAD_CHARS:
                whole = _squash("".join(parts))
                if len(whole) > HEAD_CHARS:
                    return whole[:HEAD_CHARS]
                parts, size = [whole + (" " if JAVA_SPACE.match(t[-1]) else "")], len(whole)
        return _squash("".join(parts))

    def labels(self, e: _El, wrapping: list[int]) -> list[int]:
        own = self.label_for.get(e.attrs.get("id") or "", [])
        return sorted({*own, *wrapping}) if wrapping else own

    def name(self, e: _El, labels: list[int]) -> str:
        """Labelledby, label, alt, <label>, button value, text, title; empty when none."""
        a = e.attrs
        if "aria-labelledby" in a:
            found = _squash(" ".join([self.text(self.by_id[i]) if i in self.by_id else "" for i in re.split("[ ]+", a["aria-labelledby"])]))
            if found:
                return found
        found = _squash(a.get("aria-label", ""))
        if found:
            return found
        kind = a.get("type", "").lower() if e.tag == "input" else ""
        if "alt" in a and (e.tag in ("img", "area") or kind == "image"):
            return _squash(a["alt"])
        if e.tag in CONTROLS:
            if labels:
                return " ".join([self.text(p) for p in labels])
            if a.get("type", "").lower() in ("submit", "button"):
                return _squash(a.get("value", ""))
        return self.text(e.pos) or _squash(a.get("title", ""))

    def rows(self) -> Iterator[tuple]:
        """INDEX_FIELDS of every element, in document order; an element takes over what its parent is inside of."""
        inherited: list[tuple] = []
        wraps: list[list[int]] = []
        fields = 0
        for e in self.els:
            a, tag = e.attrs, e.tag
            up = inherited[e.parent] if e.parent >= 0 else (False, False, False, None, None, None, None, False, False, False, False, False, False)
            footer, header, nav, link, context, figure, dir_at, lang, head, isolated, quiet, heading, banner_link = up
            in_nav, in_quiet = nav, quiet  # strictly inside
            role = a.get("role", "") if a else ""
            footer = footer or tag == "footer" or role == "contentinfo"
            header = header or tag == "header" or role == "banner"
            nav = nav or tag == "nav" or role == "navigation"
            linked = tag == "a" and "href" in a
            if linked or tag == "button":
                link = e.pos
            if tag in CONTEXT_TAGS:
                context = e.pos
            if tag == "figure":
                figure = e.pos
            heading = heading or tag in HEADINGS or role == "heading"
            banner_link = banner_link or (tag == "a" and header)
            head = head or tag in ("head", "noscript")
            quiet = quiet or tag in ("script", "style", "noscript")
            isolated = isolated or tag == "bdi"
            name = labels = refs = target = before = None
            described = False
            wrapping = wraps[e.parent] if e.parent >= 0 else []
            if a:
                if "dir" in a:
                    dir_at = e.pos
                lang = lang or ("lang" in a and e.pos > 0)
                isolated = isolated or ("style" in a and bool(ISOLATING_STYLE.search(a["style"].lower())))
                refs = [(r, i, self.by_id.get(i, -1)) for r in REFERENCES if r in a for i in ASCII_SPACE.split(a[r]) if i] or None
                described = bool(a.get("id")) and a["id"] in self.described
                if linked and a["href"].startswith("#"):
                    fragment = a["href"][1:]
                    target = self.by_id.get(fragment, self.by_name.get(fragment, -1)) if fragment else -1
                    before = fields
                elif tag == "label" and "for" in a:
                    target = self.by_id.get(a["for"], -1)
            if tag in CONTROLS or role in LABELLED_ROLES:
                labels = self.labels(e, wrapping)
            if tag in NAMED_TAGS or (
                a and ("role" in a or "aria-label" in a or HOOK_CLASS.search(a.get("class", "").lower()) or HOOK_ID.search(a.get("id", "").lower()) or HOOK_WORD in a.get("title", ""))
            ):
                name = self.name(e, labels or [])
            if linked or tag == "button" or tag in CONTROLS:
                fields += 1
            inherited.append((footer, header, nav, link, context, figure, dir_at, lang, head, isolated, quiet, heading, banner_link))
            wraps.append([*wrapping, e.pos] if tag == "label" and "for" not in a else wrapping)
            region = "footer" if footer else "header" if header else "nav" if nav else "body"
            yield (
                region, link, context, self.caption.get(figure), dir_at, lang, head, isolated, in_nav, in_quiet, heading, banner_link,
                labels, refs, target, described, before, self.head(e) if self.texts[e.pos] is None else None, name,
            )


INDEX_FIELDS = [
    ("region", pa.string()), ("link", pa.int32()), ("context", pa.int32()), ("figcaption", pa.int32()), ("dir_at", pa.int32()), ("in_lang", pa.bool_()), ("in_head", pa.bool_()),
    ("isolated", pa.bool_()), ("in_nav", pa.bool_()), ("quiet", pa.bool_()), ("in_heading", pa.bool_()), ("banner_link", pa.bool_()), ("labels", pa.list_(pa.int32())),
    ("refs", pa.list_(pa.struct([("attribute", pa.string()), ("id", pa.string()), ("pos", pa.int32())]))), ("target", pa.int32()), ("described", pa.bool_()),
    ("fields_before", pa.int32()), ("head", pa.string()), ("name", pa.string()),
]
_ARROW_EL = pa.struct(
    [
        ("pos", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())), ("nth", pa.int32()), ("n_children", pa.int32()),
        ("text", pa.string()), ("text_len", pa.int32()), ("n0", pa.int32()), ("n1", pa.int32()), ("s0", pa.int32()),
        ("s1", pa.int32()), ("selector", pa.string()), ("aria_hidden", pa.bool_()), ("hidden", pa.bool_()),
        *INDEX_FIELDS,
    ]
)


def _dom_array(sources: list[str | None]) -> pa.StructArray:
    """Column-wise Arrow build, so no per-element Python dict is ever made."""
    cols: dict[str, list] = {f.name: [] for f in _ARROW_EL if f.name != "attrs"}
    index_columns = [cols[name] for name, _ in INDEX_FIELDS]
    akeys, avals, aoff = [], [], [0]
    eoff, noff = [0], [0]
    npos, ntext, bodies, doctypes, valid = [], [], [], [], []
    for src in sources:
        valid.append(src is not None)
        if src is None:
            eoff.append(eoff[-1]); noff.append(noff[-1]); bodies.append(None); doctypes.append(None)
            continue
        els, nodes, body, doctype = parse(src)
        selectors = _selectors(els)
        before = len(cols["text"])
        for e in els:
            if e.tag in WIDE or (e.tag == "div" and e.kids > 0):
                cols["text"].append(None); cols["text_len"].append(None)
            else:
                raw = "".join(t for _, t in nodes[e.n0 : e.n1])
                cols["text"].append(" ".join(raw.split())); cols["text_len"].append(len(raw.strip()))
            for name, value in (
                ("pos", e.pos), ("parent", e.parent), ("last", e.last), ("depth", e.depth), ("tag", e.tag), ("nth", e.nth),
                ("n_children", e.kids), ("n0", e.n0), ("n1", e.n1), ("s0", e.s0), ("s1", e.s1),
                ("selector", selectors[e.pos]), ("aria_hidden", e.ah), ("hidden", e.hid),
            ):
                cols[name].append(value)
            akeys.extend(e.attrs.keys()); avals.extend(e.attrs.values()); aoff.append(len(akeys))
        for column, values in zip(index_columns, zip(*Index(els, nodes, cols["text"][before:]).rows())):
            column.extend(values)
        npos.extend(p for p, _ in nodes); ntext.extend(t for _, t in nodes)
        eoff.append(eoff[-1] + len(els)); noff.append(noff[-1] + len(nodes))
        bodies.append(body); doctypes.append(doctype)
    attrs = pa.MapArray.from_arrays(pa.array(aoff, pa.int32()), pa.array(akeys, pa.string()), pa.array(avals, pa.string()))
    cols["refs"] = [None if r is None else [{"attribute": k, "id": i, "pos": p} for k, i, p in r] for r in cols["refs"]]
    children = [attrs if f.name == "attrs" else pa.array(cols[f.name], f.type) for f in _ARROW_EL]
    elements = pa.ListArray.from_arrays(pa.array(eoff, pa.int32()), pa.StructArray.from_arrays(children, fields=list(_ARROW_EL)))
    nodes_arr = pa.ListArray.from_arrays(
        pa.array(noff, pa.int32()), pa.StructArray.from_arrays([pa.array(npos, pa.int32()), pa.array(ntext, pa.string())], ["pos", "text"])
    )
    return pa.StructArray.from_arrays(
        [elements, nodes_arr, pa.array(bodies, pa.string()), pa.array(doctypes, pa.string())],
        ["elements", "nodes", "body_text", "doctype"],
        mask=pa.array([not v for v in valid]),
    )


def with_dom(pages: DataFrame, html_col: str = "html", flush_chars: int = 500_000) -> DataFrame:
    """Add ``dom`` to every page row. Narrow: no shuffle, one Arrow pass, output flushed by size."""
    schema = T.StructType([*pages.schema.fields, T.StructField("dom", T.StructType.fromDDL(DOM_DDL))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # strings of one part at a time: the batch itself may hold ten thousand pages
            column, sources, start, chars = batch.column(html_col), [], 0, 0
            for i, value in enumerate(column):
                sources.append(value.as_py())
                chars += len(sources[-1] or "")
                if chars >= flush_chars or i == len(column) - 1:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, _dom_array(sources)], [*part.schema.names, "dom"])
                    sources, start, chars = [], i + 1, 0

    return pages.mapInArrow(run, schema)


def elements(pages_with_dom: DataFrame, *keys: str) -> DataFrame:
    """The flat element table: one row per element, page columns ``keys`` kept."""
    return pages_with_dom.selectExpr(*keys, "inline(dom.elements)")
