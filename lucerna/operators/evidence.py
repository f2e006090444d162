"""Page evidence (C1-C44) as expressions over the ``dom`` column.

One row per page stays one row per page: each collector is an array of structs computed
with higher-order functions, so the whole evidence step is narrow (no shuffle) and
unused collectors are pruned by Catalyst. Subtree tests are interval tests on
``pos``/``last``; a subtree is a slice of the element array, never a scan of the page.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions import patterns as P
from lucerna.functions.patterns import lit


# ---- expression helpers (they return SQL text) ---------------------------------------------

def at(e: str, name: str) -> str:
    return f"{e}.attrs['{name}']"


def clip(s: str, n: int) -> str:
    return f"if(char_length({s}) > {n}, concat(left({s}, {n}), '…'), {s})"


def squash(s: str) -> str:
    return rf"trim(regexp_replace({s}, r'[\s\x{{00a0}}]+', ' '))"


def text(e: str) -> str:
    """textContent, whitespace collapsed; wide containers rebuild theirs from the text nodes."""
    joined = f"array_join(transform(slice(TXT, {e}.n0 + 1, {e}.n1 - {e}.n0), q -> q.text), '')"
    return f"coalesce({e}.text, {squash(joined)})"


def under(e: str) -> str:
    """Descendants of an element."""
    return f"slice(ELS, {e}.pos + 2, {e}.last - {e}.pos)"


def kids(e: str) -> str:
    return f"filter({under(e)}, k -> k.parent = {e}.pos)"


def parent(e: str) -> str:
    return f"get(ELS, {e}.parent)"


def next_sibling(e: str) -> str:
    nxt = f"get(ELS, {e}.last + 1)"
    return f"if({nxt}.parent = {e}.pos, null, if({nxt}.parent = {e}.parent, {nxt}, null))"


def element(pos: str) -> str:
    return f"get(ELS, {pos})"


def head(e: str) -> str:
    """The start of the text, for excerpts: a wide container's is at hand and not rebuilt."""
    return f"coalesce({e}.text, {e}.head)"


def words(s: str) -> str:
    return rf"filter(split(coalesce({s}, ''), r'\s+'), w -> w <> '')"


def has_class(e: str, name: str) -> str:
    return f"array_contains({words(at(e, 'class'))}, '{name}')"


def low(e: str, name: str) -> str:
    return f"lower(coalesce({at(e, name)}, ''))"


def tab_index(e: str) -> str:
    return rf"try_cast(regexp_extract({at(e, 'tabindex')}, r'^\s*([+-]?\d+)', 1) as int)"


def focusable(e: str) -> str:
    native = (
        f"({e}.tag in ('button','select','textarea','iframe','summary') or ({e}.tag in ('a','area') and {at(e, 'href')} is not null)"
        f" or ({e}.tag = 'input' and {low(e, 'type')} <> 'hidden') or {low(e, 'contenteditable')} = 'true'"
        f" or ({e}.tag in ('audio','video') and {at(e, 'controls')} is not null))"
    )
    return f"coalesce({tab_index(e)} >= 0, {native})"


def pick(source: str, fields: dict[str, str], var: str = "e") -> str:
    body = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return f"transform({source}, {var} -> named_struct({body}))"


def where(cond: str, source: str = "ELS", var: str = "e") -> str:
    return f"filter({source}, {var} -> {cond})"


HEADING_COND = "(e.tag in ('h1','h2','h3','h4','h5','h6') or coalesce(e.attrs['role'],'') = 'heading')"
WIDGET_HOOK = (
    "(lower(coalesce(e.attrs['class'],'')) rlike 'accessib|a11y|negishut' or lower(coalesce(e.attrs['id'],'')) rlike 'accessib|a11y'"
    " or coalesce(e.attrs['aria-label'],'') like '%נגישות%' or coalesce(e.attrs['title'],'') like '%נגישות%')"
)
LANDMARK_COND = (
    "(e.tag in ('header','nav','main','footer','aside') or (e.tag = 'section' and (e.attrs['aria-label'] is not null or e.attrs['aria-labelledby'] is not null))"
    " or (e.tag = 'form' and e.attrs['aria-label'] is not null)"
    " or coalesce(e.attrs['role'],'') in ('banner','navigation','main','contentinfo','complementary','search','region'))"
)
BAD_CHILD = (
    "size(filter({kids}, c -> if(e.tag = 'dl', c.tag not in ('dt','dd','div'), c.tag not in ('li','template','script'))))"
)


def _count_re(s: str, letters: str) -> str:
    """How many characters of a class ``[...]`` a text has: what is left without the others, not a list of single matches."""
    return f"char_length(regexp_replace({s}, {lit('[^' + letters[1:-1] + ']+')}, ''))"


def _first_kind(options: list[tuple[str, str]], s: str) -> str:
    return "case " + " ".join(f"when {s} rlike {lit(p)} then '{k}'" for k, p in options) + " end"


def _first_match(options: list[tuple[str, str]], s: str) -> str:
    return "case " + " ".join(f"when {s} rlike {lit(p)} then regexp_extract({s}, {lit(p)}, 0)" for k, p in options) + " end"


def stages() -> list[dict[str, str]]:
    """Columns by stage; a stage may use the columns of the stages before it."""
    base = {
        "ELS": "dom.elements",
        "TXT": "dom.nodes",
        "body_text": "coalesce(dom.body_text, '')",
    }
    pools = {
        "HTML_EL": "get(ELS, 0)",
        # without a right-to-left letter there is nothing to count
        "rtl_content": (
            f"body_text rlike r'[\\x{{0590}}-\\x{{06FF}}]' and ({_count_re('body_text', P.HEBREW)} + {_count_re('body_text', P.ARABIC)})"
            f" > {_count_re('body_text', P.LATIN)}"
        ),
        "is_dom": "dom is not null",
    }
    names = {"NAMED": "transform(filter(ELS, e -> e.name is not null), e -> named_struct('e', e, 'name', e.name))"}
    context = element("coalesce(x.e.context, x.e.parent)")
    labels = "transform(coalesce(x.e.labels, array()), p -> get(ELS, p))"
    links = pick(
        "filter(NAMED, x -> (x.e.tag = 'a' and x.e.attrs['href'] is not null) or coalesce(x.e.attrs['role'],'') = 'link')",
        {
            "pos": "x.e.pos",
            "selector": "x.e.selector",
            "text": clip(text("x.e"), 120),
            "name": "x.name",
            "href": "coalesce(x.e.attrs['href'], '')",
            "title": "x.e.attrs['title']",
            "aria_label": "x.e.attrs['aria-label']",
            "new_window": "coalesce(x.e.attrs['target'], '') = '_blank'",
            "warns": f"concat(x.name, ' ', coalesce(x.e.attrs['title'], '')) rlike {lit(P.NEW_WINDOW)}",
            "generic": f"{text('x.e')} rlike {lit(P.GENERIC_LINK)}",
            "is_url": f"{text('x.e')} rlike {lit(P.URL_TEXT)} and char_length({text('x.e')}) > 30",
            "empty": "x.name = ''",
            "image_only": f"{text('x.e')} = '' and exists({under('x.e')}, d -> d.tag in ('img','svg'))",
            "context": clip(head(context), 240),
            "visible": "not x.e.hidden",
            "region": "x.e.region",
        },
        "x",
    )
    controls = pick(
        "filter(NAMED, x -> x.e.tag in ('input','select','textarea') or coalesce(x.e.attrs['role'],'') in ('textbox','combobox','checkbox','radio','switch','spinbutton','slider'))",
        {
            "pos": "x.e.pos",
            "selector": "x.e.selector",
            "tag": "x.e.tag",
            "type": low("x.e", "type"),
            "name": "x.name",
            "labels": f"transform({labels}, l -> {clip(text('l'), 80)})",
            "placeholder": at("x.e", "placeholder"),
            "placeholder_only": f"coalesce({at('x.e', 'placeholder')}, '') <> '' and coalesce(size(x.e.labels), 0) < 1 and coalesce({at('x.e', 'aria-label')}, '') = '' and coalesce({at('x.e', 'aria-labelledby')}, '') = ''",
            "required": f"{at('x.e', 'required')} is not null or coalesce({at('x.e', 'aria-required')}, '') = 'true'",
            "aria_invalid": at("x.e", "aria-invalid"),
            "described_by": f"transform(filter(coalesce(x.e.refs, array()), r -> r.attribute = 'aria-describedby'), r -> coalesce({clip(text(element('r.pos')), 120)}, concat('(missing:', r.id, ')')))",
            "autocomplete": at("x.e", "autocomplete"),
            "pattern": at("x.e", "pattern"),
            "dir": at("x.e", "dir"),
            "visible": "not x.e.hidden",
            "on_change": "coalesce(x.e.attrs['onchange'], '') <> ''",
            "s0": "x.e.s0",
            "s1": "x.e.s1",
        },
        "x",
    )
    size_px = "try_cast(regexp_extract({e}.attrs['{a}'], r'^\\s*(\\d+)', 1) as int)"
    img_w, img_h = size_px.format(e="e", a="width"), size_px.format(e="e", a="height")
    src_of = "coalesce(nullif(e.attrs['src'], ''), nullif(e.attrs['data-src'], ''), nullif(e.attrs['href'], ''), '')"
    link_el = element("e.link")
    images = pick(
        where("e.tag in ('img','svg','area','object','picture') or coalesce(e.attrs['role'],'') = 'img' or (e.tag = 'input' and lower(coalesce(e.attrs['type'],'')) = 'image')"),
        {
            "pos": "e.pos", "selector": "e.selector", "tag": "e.tag", "src": clip(src_of, 160), "alt": at("e", "alt"),
            "has_alt": f"{at('e', 'alt')} is not null", "aria_label": at("e", "aria-label"), "role": at("e", "role"),
            "aria_hidden": "e.aria_hidden", "title": at("e", "title"),
            "in_link": "e.link is not null",
            "link_href": f"coalesce({link_el}.attrs['href'], '')",
            "link_name": f"coalesce({link_el}.name, '')",
            "width": img_w, "height": img_h, "visible": "not e.hidden",
            "likely_decorative": f"coalesce({img_w} <= 24 and {img_h} <= 24, false) or coalesce({at('e', 'alt')} = '', false)",
            "filename_alt": f"coalesce(trim({at('e', 'alt')}) rlike {lit(P.FILENAME_ALT)}, false)",
            "caption": f"coalesce({clip(text(element('e.figcaption')), 200)}, '')",
            "nearby": f"coalesce({clip(head(parent('e')), 150)}, '')",
            "s0": "e.s0", "s1": "e.s1",
        },
    )
    tracks = f"filter({under('x.e')}, k -> k.tag = 'track')"
    media_src = "coalesce(nullif(x.e.attrs['src'], ''), nullif(x.e.attrs['data-src'], ''), '')"
    player = f"(x.e.tag = 'iframe' and {media_src} rlike {lit(P.PLAYER_HOST)})"
    media = pick(
        "filter(NAMED, x -> x.e.tag in ('video','audio','object','embed','iframe'))",
        {
            "pos": "x.e.pos", "selector": "x.e.selector", "tag": "x.e.tag", "src": clip(media_src, 200), "name": "x.name",
            "kind": f"case when x.e.tag in ('audio','video') then x.e.tag when {player} then 'player' else 'embed' end",
            "captions": f"exists({tracks}, k -> coalesce(k.attrs['kind'],'') in ('captions','subtitles'))",
            "descriptions": f"exists({tracks}, k -> coalesce(k.attrs['kind'],'') = 'descriptions')",
            "n_tracks": f"size({tracks})",
            "autoplay": "x.e.attrs['autoplay'] is not null", "muted": "x.e.attrs['muted'] is not null",
            "loop": "x.e.attrs['loop'] is not null", "controls": "x.e.attrs['controls'] is not null",
            "aria_hidden": "x.e.aria_hidden", "nearby": f"coalesce({clip(head(parent('x.e')), 250)}, '')", "s0": "x.e.s0", "s1": "x.e.s1",
        },
        "x",
    )
    headings = pick(
        where(HEADING_COND),
        {
            "pos": "e.pos", "selector": "e.selector",
            "level": "try_cast(coalesce(nullif(e.attrs['aria-level'], ''), regexp_extract(e.tag, '^h([1-6])$', 1)) as int)",
            "text": clip(text("e"), 200),
            "empty": f"{text('e')} = '' and not exists({under('e')}, k -> k.tag = 'img' and coalesce(k.attrs['alt'], '') <> '')",
            "visible": "not e.hidden",
        },
    )
    first_tr = f"get(filter({under('e')}, k -> k.tag = 'tr'), 0)"
    sub = under("e")
    tables = pick(
        where("e.tag = 'table'"),
        {
            "pos": "e.pos", "selector": "e.selector",
            "rows": f"size(filter({sub}, k -> k.tag = 'tr'))",
            "cols": f"coalesce(size(filter({under(first_tr)}, k -> k.tag in ('td','th'))), 0)",
            "th": f"size(filter({sub}, k -> k.tag = 'th'))",
            "th_scope": f"size(filter({sub}, k -> k.tag = 'th' and k.attrs['scope'] is not null))",
            "caption": f"exists({sub}, k -> k.tag = 'caption')",
            "looks_layout": f"size(filter({sub}, k -> k.tag = 'th')) = 0 and not exists({sub}, k -> k.tag = 'caption') and size(filter({sub}, k -> k.tag = 'tr')) > 1",
            "nested": f"size(filter({sub}, k -> k.tag = 'table'))",
            "merged": f"size(filter({sub}, k -> k.tag in ('td','th') and (k.attrs['colspan'] is not null or k.attrs['rowspan'] is not null)))",
            "s0": "e.s0", "s1": "e.s1",
        },
    )
    lists = pick(
        where("e.tag in ('ul','ol','dl')"),
        {"pos": "e.pos", "selector": "e.selector", "tag": "e.tag", "items": "e.n_children", "invalid": BAD_CHILD.format(kids=kids("e"))},
    )
    bullet = lit(P.TYPED_BULLET)
    fake_lists = pick(
        where(f"e.tag in ('p','div') and e.n_children = 0 and coalesce(e.text, '') rlike {bullet} and coalesce({text(next_sibling('e'))}, '') rlike {bullet}"),
        {"pos": "e.pos", "selector": "e.selector", "text": clip("e.text", 120), "s0": "e.s0", "s1": "e.s1"},
    )
    landmarks = pick(
        where(LANDMARK_COND),
        {"pos": "e.pos", "selector": "e.selector", "tag": "e.tag", "role": at("e", "role"), "label": at("e", "aria-label")},
    )
    snippet_only = {"pos": "e.pos", "selector": "e.selector", "tag": "e.tag", "s0": "e.s0", "s1": "e.s1"}
    presentational = pick(
        where("e.tag in ('font','center','marquee','blink','basefont','big','strike','tt') or e.attrs['bgcolor'] is not null or e.attrs['align'] is not null"),
        snippet_only,
    )
    sensory = pick(
        f"filter(transform(TXT, n -> named_struct('pos', n.pos, 'text', n.text, 'kind', {_first_kind(P.SENSORY, 'n.text')})), n -> n.kind is not null and not get(ELS, n.pos).in_head)",
        {
            "pos": "n.pos", "selector": "get(ELS, n.pos).selector", "kind": "n.kind",
            "match": clip(squash(_first_match(P.SENSORY, "n.text")), 120), "context": clip(squash("n.text"), 240),
        },
        "n",
    )
    required_markers = pick(
        where(f"e.tag = 'label' or {has_class('e', 'required')} or coalesce(e.attrs['aria-required'],'') = 'true' or e.attrs['required'] is not null"),
        {
            "pos": "e.pos", "selector": "e.selector", "text": clip(text("e"), 80), "asterisk": f"instr({text('e')}, '*') > 0",
            "says_required": f"{text('e')} rlike {lit(P.SAYS_REQUIRED)}",
            "aria_required": "coalesce(e.attrs['aria-required'],'') = 'true' or e.attrs['required'] is not null",
        },
    )
    hint_src = "lower(concat(coalesce(e.attrs['src'],''), ' ', coalesce(e.attrs['class'],'')))"
    text_images = pick(
        where(
            f"(e.tag = 'img' or coalesce(e.attrs['style'],'') like '%background-image%') and not e.hidden and {img_w} >= 120 and {img_h} >= 40"
            f" and ({hint_src} rlike {lit(P.TEXT_IMAGE_HINT)} or ({img_w} / greatest({img_h}, 1) > 2.5 and {img_w} > 400))"
        ),
        {
            "pos": "e.pos", "selector": "e.selector", "src": clip("coalesce(e.attrs['src'], '')", 160), "alt": "coalesce(e.attrs['alt'], '')",
            "width": img_w, "height": img_h,
            "is_logo": f"lower(concat({hint_src}, ' ', coalesce(e.attrs['alt'],''))) rlike {lit(P.LOGO_HINT)}",
        },
    )
    forms = pick(
        where("e.tag = 'form'"),
        {
            "pos": "e.pos", "selector": "e.selector", "action": clip("coalesce(e.attrs['action'], '')", 160),
            "method": "lower(coalesce(nullif(e.attrs['method'],''), 'get'))",
            "controls": f"size(filter({sub}, k -> k.tag in ('input','select','textarea')))",
            "fieldsets": f"size(filter({sub}, k -> k.tag = 'fieldset'))",
            "legends": f"size(filter({sub}, k -> k.tag = 'legend'))",
            "submit_label": f"coalesce(get(filter({sub}, k -> (k.tag = 'button' and coalesce(k.attrs['type'],'submit') = 'submit') or (k.tag = 'input' and k.attrs['type'] = 'submit')), 0).name, '')",
            "high_stakes": f"lower({text('e')}) rlike {lit(P.HIGH_STAKES)} or exists({sub}, k -> k.tag = 'input' and (coalesce(k.attrs['autocomplete'],'') like '%cc-%'"
            " or coalesce(k.attrs['name'],'') like '%card%' or coalesce(k.attrs['name'],'') like '%credit%' or k.attrs['type'] = 'password'))",
        },
    )
    error_boxes = pick(
        where(
            "coalesce(e.attrs['role'],'') = 'alert' or e.attrs['aria-live'] is not null or coalesce(e.attrs['class'],'') like '%error%' or coalesce(e.attrs['id'],'') like '%error%'"
            f" or {has_class('e', 'invalid')}"
        ),
        {
            "pos": "e.pos", "selector": "e.selector", "role": at("e", "role"), "live": at("e", "aria-live"), "text": clip(text("e"), 160), "visible": "not e.hidden",
            "referenced": "e.described",
        },
    )
    captcha = pick(
        where(
            "lower(coalesce(e.attrs['class'],'')) like '%captcha%' or lower(coalesce(e.attrs['id'],'')) like '%captcha%'"
            " or (e.tag = 'iframe' and (coalesce(e.attrs['src'],'') like '%recaptcha%' or coalesce(e.attrs['src'],'') like '%hcaptcha%')) or e.attrs['data-sitekey'] is not null"
        ),
        snippet_only,
    )
    page_lang = "lower(coalesce(HTML_EL.attrs['lang'], ''))"
    heb, lat = _count_re("coalesce(e.text,'')", P.HEBREW), _count_re("coalesce(e.text,'')", P.LATIN)
    foreign = pick(
        f"filter(transform({where('e.tag in (' + repr('p') + ',' + repr('li') + ',' + repr('td') + ',' + repr('h1') + ',' + repr('h2') + ',' + repr('h3') + ',' + repr('h4') + ',' + repr('blockquote') + ',' + repr('div') + ')')},"
        f" e -> named_struct('e', e, 'heb', {heb}, 'lat', {lat})), f -> f.e.n_children = 0 and not f.e.hidden and coalesce(f.e.text_len, 0) >= 40"
        " and not f.e.in_lang"
        f" and if({page_lang} like 'he%' or rtl_content, f.lat > 30 and f.heb < f.lat * 0.15, f.heb > 30 and f.lat < f.heb * 0.15))",
        {"pos": "f.e.pos", "selector": "f.e.selector", "text": clip("f.e.text", 200), "detected": f"if({page_lang} like 'he%' or rtl_content, 'latin', 'hebrew')", "latin": "f.lat", "hebrew": "f.heb"},
        "f",
    )
    islands = (
        "if(rtl_content, "
        + pick(
            f"filter(transform(TXT, n -> named_struct('pos', n.pos, 'text', n.text, 'kind', {_first_kind(P.ISLANDS, 'n.text')})), n -> n.kind is not null"
            f" and not get(ELS, n.pos).in_head and (n.text rlike {lit(P.HEBREW)} or char_length(trim(n.text)) >= 4)"
            " and coalesce(get(ELS, get(ELS, n.pos).dir_at).attrs['dir'], '') <> 'ltr' and not get(ELS, n.pos).isolated)",
            {
                "pos": "n.pos", "selector": "get(ELS, n.pos).selector", "kind": "n.kind",
                "match": clip(squash(_first_match(P.ISLANDS, "n.text")), 60), "context": clip(squash("n.text"), 160),
            },
            "n",
        )
        + ", array())"
    )
    english = (
        "if(rtl_content, "
        + pick(
            "filter(filter(NAMED, x -> x.e.tag in ('button','input','select','textarea') or (x.e.tag = 'a' and x.e.attrs['href'] is not null) or coalesce(x.e.attrs['role'],'') = 'button' or x.e.attrs['aria-label'] is not null),"
            f" x -> char_length(x.name) >= 3 and not x.name rlike {lit(P.HEBREW)} and x.name rlike {lit(P.LATIN)} and not x.name rlike {lit(P.NOT_PROSE_NAME)}"
            f" and not x.name rlike {lit(P.HOST_LIKE_NAME)} and not (size(split(x.name, ' ')) = 1 and char_length(x.name) < 12))",
            {"pos": "x.e.pos", "selector": "x.e.selector", "name": clip("x.name", 80), "source": "if(coalesce(x.e.attrs['aria-label'],'') <> '', 'aria-label', 'text')"},
            "x",
        )
        + ", array())"
    )
    carousels = pick(
        where("lower(coalesce(e.attrs['class'],'')) rlike 'carousel|slider|swiper|slick|marquee' or coalesce(e.attrs['data-ride'],'') = 'carousel'"),
        {
            "pos": "e.pos", "selector": "e.selector", "class_name": clip("coalesce(e.attrs['class'],'')", 100),
            "has_pause": f"exists({sub}, k -> (k.tag = 'button' or coalesce(k.attrs['role'],'') = 'button') and k.name <> '' and k.name rlike {lit(P.PAUSE_CONTROL)})",
        },
    )
    autoplay = pick(where("e.tag in ('video','audio') and e.attrs['autoplay'] is not null"), {"selector": "e.selector", "tag": "e.tag", "muted": "e.attrs['muted'] is not null", "controls": "e.attrs['controls'] is not null"})
    gifs = pick(where("e.tag = 'img' and lower(coalesce(e.attrs['src'],'')) like '%.gif%'"), {"selector": "e.selector", "src": clip("e.attrs['src']", 120), "alt": at("e", "alt")})
    moving_tags = pick(where("e.tag in ('blink','marquee')"), snippet_only)
    refresh = pick(where("e.tag = 'meta' and lower(coalesce(e.attrs['http-equiv'],'')) = 'refresh'"), {"content": at("e", "content")})
    id_runs = "array_sort(transform(filter(ELS, e -> e.attrs['id'] <> ''), e -> named_struct('id', e.attrs['id'], 'pos', e.pos)))"
    dup_ids = (
        f"array_sort(transform(get(transform(array({id_runs}), r -> filter(r, (y, i) -> i >= 1 and get(r, i - 1).id = y.id and coalesce(get(r, i - 2).id <> y.id, true))), 0),"
        " y -> named_struct('pos', y.pos, 'id', y.id, 'selector', get(ELS, y.pos).selector, 's0', get(ELS, y.pos).s0, 's1', get(ELS, y.pos).s1)))"
    )
    refs = ["aria-labelledby", "aria-describedby", "aria-controls", "aria-owns"]
    broken = "concat(" + ", ".join(
        f"flatten(transform(filter(ELS, e -> e.refs is not null), e -> transform(filter(e.refs, r -> r.attribute = '{a}' and r.pos < 0),"
        f" r -> named_struct('selector', e.selector, 'attribute', r.attribute, 'missing_id', r.id, 's0', e.s0, 's1', e.s1))))"
        for a in refs
    ) + ")"
    orphans = pick(
        "filter(ELS, e -> e.tag = 'label' and e.target < 0)",
        {"pos": "e.pos", "selector": "e.selector", "label_for": at("e", "for"), "text": clip(text("e"), 80)},
    )
    roles = ", ".join(f"'{r}'" for r in P.INTERACTIVE_ROLES)
    widgets = pick(
        f"filter(NAMED, x -> lower(coalesce(x.e.attrs['role'],'')) in ({roles}))",
        {
            "pos": "x.e.pos", "selector": "x.e.selector", "role": "lower(x.e.attrs['role'])", "name": "x.name", "focusable": focusable("x.e"),
            "expanded": at("x.e", "aria-expanded"), "checked": at("x.e", "aria-checked"), "selected": at("x.e", "aria-selected"),
            "controls": at("x.e", "aria-controls"), "visible": "not x.e.hidden", "s0": "x.e.s0", "s1": "x.e.s1",
        },
        "x",
    )
    real_control = "d.tag in ('button','input','select','textarea') or (d.tag = 'a' and d.attrs['href'] is not null) or coalesce(d.attrs['role'],'') in ('button','link')"
    pseudo = pick(
        f"filter(ELS, e -> e.tag in ('div','span','li','td','i') and not e.hidden and coalesce(e.attrs['role'],'') = '' and not {focusable('e')}"
        f" and coalesce(e.attrs['onclick'],'') <> '' and not exists({sub}, d -> {real_control}))",
        {"pos": "e.pos", "selector": "e.selector", "text": clip(text("e"), 80), "inline_handler": "true", "s0": "e.s0", "s1": "e.s1"},
    )
    iframes = pick(where("e.tag in ('iframe','frame')"), {"selector": "e.selector", "title": at("e", "title"), "src": clip("coalesce(e.attrs['src'],'')", 160)})
    icon_buttons = pick(
        "filter(filter(NAMED, x -> x.e.tag = 'button' or (x.e.tag = 'a' and x.e.attrs['href'] is not null) or coalesce(x.e.attrs['role'],'') = 'button'),"
        f" x -> {text('x.e')} = '' and (exists({under('x.e')}, d -> d.tag in ('svg','img','i')) or coalesce(x.e.attrs['class'],'') rlike {lit(P.ICON_CLASS)}))",
        {"pos": "x.e.pos", "selector": "x.e.selector", "name": "x.name", "s0": "x.e.s0", "s1": "x.e.s1"},
        "x",
    )
    target = element("e.target")
    skip_links = pick(
        where("e.tag = 'a' and e.attrs['href'] like '#%'"),
        {
            "pos": "e.pos", "selector": "e.selector", "text": clip(text("e"), 80), "href": at("e", "href"),
            "target_exists": "e.target >= 0",
            "target_focusable": f"coalesce({focusable(target)} or {target}.attrs['tabindex'] is not null, false)",
            "hidden": "e.hidden", "looks_skip": f"{text('e')} rlike {lit(P.SKIP_TEXT)}",
            "dom_position": "e.fields_before",
        },
    )
    navs = pick(
        where("e.tag = 'nav' or coalesce(e.attrs['role'],'') = 'navigation'"),
        {
            "pos": "e.pos", "selector": "e.selector", "label": at("e", "aria-label"),
            "items": f"transform(filter({sub}, k -> k.tag = 'a' and k.attrs['href'] is not null), k -> named_struct('text', {text('k')}, 'href', k.attrs['href']))",
        },
    )
    all_text = f"concat({text('e')}, ' ', coalesce(e.attrs['href'],''), ' ', coalesce(e.attrs['aria-label'],''))"
    statement_links = pick(
        where(f"e.tag = 'a' and e.attrs['href'] is not null and {all_text} rlike {lit(P.STATEMENT_LINK)}"),
        {"pos": "e.pos", "selector": "e.selector", "text": clip(text("e"), 80), "href": clip("e.attrs['href']", 200)},
    )
    candidates = pick(
        f"filter(NAMED, x -> {WIDGET_HOOK.replace('e.attrs', 'x.e.attrs')})",
        {
            "pos": "x.e.pos", "selector": "x.e.selector", "tag": "x.e.tag", "name": "x.name",
            "focusable": f"{focusable('x.e')} or x.e.tag in ('a','button') or exists({under('x.e')}, d -> d.tag = 'button' or (d.tag = 'a' and d.attrs['href'] is not null))",
            "visible": "not x.e.hidden",
        },
        "x",
    )
    vendors = "filter(array(" + ", ".join(f"'{v}'" for v in P.OVERLAY_VENDORS) + "), v -> exists(ELS, e -> e.tag = 'script' and contains(lower(coalesce(e.attrs['src'],'')), v)))"
    focus_pool = (
        "filter(ELS, e -> (e.tag in ('button','select','textarea','details','summary') or (e.tag = 'a' and e.attrs['href'] is not null) or (e.tag = 'input' and coalesce(e.attrs['type'],'') <> 'hidden')"
        " or e.attrs['tabindex'] is not null or coalesce(e.attrs['contenteditable'],'') = 'true' or (e.tag in ('audio','video') and e.attrs['controls'] is not null))"
        f" and not (e.attrs['disabled'] is not null and e.tag in ('button','input','select','textarea')) and {focusable('e')} and not e.hidden)"
    )
    # wide containers that only group: search / sitemap / breadcrumbs
    search = (
        "(e.tag = 'input' and (coalesce(e.attrs['type'],'') = 'search' or lower(coalesce(e.attrs['name'],'')) like '%search%' or lower(coalesce(e.attrs['name'],'')) like '%q%'))"
        " or coalesce(e.attrs['role'],'') = 'search' or (e.tag = 'form' and lower(coalesce(e.attrs['action'],'')) like '%search%')"
    )
    crumbs = (
        f"lower(coalesce(e.attrs['class'],'')) like '%breadcrumb%' or lower(coalesce(e.attrs['aria-label'],'')) like '%breadcrumb%' or (e.tag = 'ol' and e.in_nav)"
    )
    meta_of = "nullif(get(filter(METAS, e -> e.attrs['{k}'] = '{v}'), 0).attrs['content'], '')"
    tail = f"if(size(split(TITLE, {lit(P.TITLE_SEPARATOR)})) > 1, nullif(trim(element_at(split(TITLE, {lit(P.TITLE_SEPARATOR)}), -1)), ''), null)"
    viewport = "get(filter(METAS, e -> e.attrs['name'] = 'viewport'), 0).attrs['content']"
    skeleton_class = (
        rf"array_join(slice(array_sort(filter(split(coalesce(k.attrs['class'],''), r'\s+'), w -> w <> '' and char_length(w) < 25 and not w rlike {lit(P.UNSTABLE_CLASS)})), 1, 3), '.')"
    )
    skeleton_pool = f"filter({under('b')}, k -> k.depth - b.depth - 1 <= 6 and k.tag not in ('script','style','noscript') and not k.quiet)"
    skeleton = (
        "get(transform(filter(ELS, e -> e.tag = 'body'), b -> array_join(transform("
        f"{skeleton_pool}, k -> concat(k.depth - b.depth - 1, k.tag, coalesce(nullif(concat('.', {skeleton_class}), '.'), ''))), '|')), 0)"
    )
    title_el = "get(filter(ELS, e -> e.tag = 'title'), 0)"
    more_pools = {"TITLE": f"get(transform(array({title_el}), e -> coalesce({squash(text('e'))}, '')), 0)", "METAS": where("e.tag = 'meta'"), "LANGS": where("e.attrs['lang'] is not null"), "FOCUS": focus_pool}
    sections = {
        "title": "TITLE",
        "site_name": f"coalesce({meta_of.format(k='property', v='og:site_name')}, {meta_of.format(k='name', v='application-name')}, {tail}, regexp_replace(parse_url(url, 'HOST'), '^www[.]', ''))",
        "lang": "HTML_EL.attrs['lang']",
        "dir": "HTML_EL.attrs['dir']",
        "xml_lang": "HTML_EL.attrs['xml:lang']",
        "viewport": viewport,
        "blocks_zoom": f"coalesce({viewport} rlike {lit(P.BLOCKS_ZOOM)}, false)",
        "description": "get(filter(METAS, e -> e.attrs['name'] = 'description'), 0).attrs['content']",
        "lang_elements": "size(LANGS)",
        "skeleton": skeleton,
        "images": images, "media": media, "headings": headings, "tables": tables, "lists": lists, "fake_lists": fake_lists,
        "landmarks": landmarks, "presentational": presentational,
        "section_count": "size(filter(ELS, e -> e.tag in ('section','article')))",
        "text_length": "char_length(body_text)",
        "sensory": sensory, "required_markers": required_markers, "text_images_static": text_images, "links_raw": links,
        "controls": controls, "forms": forms, "error_boxes": error_boxes, "captcha": captcha,
        "foreign_runs": foreign, "islands": islands, "english_names": english,
        "carousels": carousels, "autoplay": autoplay, "gifs": gifs, "moving_tags": moving_tags, "meta_refresh": refresh,
        "dup_ids": dup_ids, "broken_refs": broken, "orphan_labels": orphans, "doctype": "dom.doctype", "total_elements": "size(ELS)",
        "widgets": widgets, "pseudo_controls": pseudo, "iframes": iframes, "icon_buttons": icon_buttons,
        "skip_links": skip_links, "navs": navs, "statement_links": statement_links,
        "search_mechanisms": f"size({where(search)})",
        "sitemap_links": f"size({where('e.tag = ' + repr('a') + ' and e.attrs[' + repr('href') + '] is not null and concat(' + text('e') + ', ' + repr(' ') + ', e.attrs[' + repr('href') + ']) rlike ' + lit(P.SITEMAP_LINK))})",
        "breadcrumbs": f"size({where(crumbs)})",
        "widget_candidates": candidates, "overlay_vendors": vendors,
        "emails": f"array_distinct(regexp_extract_all(body_text, {lit('(' + P.EMAIL + ')')}, 1))",
        "phones": f"array_distinct(regexp_extract_all(body_text, {lit('(' + P.PHONE + ')')}, 1))",
        "mentions_coordinator": f"body_text rlike {lit(P.COORDINATOR)}",
        "focusable_count": "size(FOCUS)",
        "positive_tabindex": pick(where(f"{tab_index('e')} > 0"), {"pos": "e.pos", "selector": "e.selector", "tabindex": at("e", "tabindex"), "text": clip(text("e"), 60)}),
        "hidden_focusable": pick("filter(FOCUS, e -> e.aria_hidden)", {"pos": "e.pos", "selector": "e.selector", "text": clip(text("e"), 60), "s0": "e.s0", "s1": "e.s1"}),
    }
    derived = {
        "has_h1": "exists(headings, h -> coalesce(h.level, 0) = 1)",
        "has_main": "exists(landmarks, l -> l.tag = 'main' or coalesce(l.role, '') = 'main')",
    }
    fields = (
        "pos selector text name href title aria_label new_window warns generic is_url empty image_only context visible region".split()
    )
    # names with two targets: equal names are neighbours once sorted, so no link is compared with every other
    pairs = "array_sort(transform(links_raw, y -> named_struct('n', y.name, 'h', y.href)))"
    unclear = f"get(transform(array({pairs}), r -> array_distinct(transform(filter(r, (y, i) -> y.n <> '' and get(r, i - 1).n = y.n and get(r, i - 1).h <> y.h), y -> y.n))), 0)"
    derived["links"] = (
        f"get(transform(array({unclear}), u -> transform(links_raw, x -> named_struct(" + ", ".join(f"'{f}', x.{f}" for f in fields)
        + ", 'ambiguous', array_contains(u, x.name)))), 0)"
    )
    return [base, pools, names, more_pools, sections, derived]


RECORDED = {
    # evidence only a browser can give; NULL means it was not recorded
    "keyboard": "struct<stops:array<struct<index:int,selector:string,name:string,tag:string,context_kind:string,context_detail:string>>,"
    "trap:struct<selector:string,name:string,repeats:int>,frame_boundary:struct<selector:string,name:string>,"
    "unreachable:array<struct<selector:string,text:string,reason:string>>,no_indicator:array<struct<selector:string,name:string,tag:string>>,"
    "order_mismatches:array<struct<selector:string,name:string,focus_position:int,visual_position:int>>>",
    "zoom": "struct<clipped:array<struct<selector:string,text:string>>,lost:array<struct<selector:string,text:string>>>",
    "timers": "array<struct<kind:string,delay_ms:double,stack:string>>",
    "animated": "array<struct<selector:string,name:string,duration_sec:double,infinite:boolean,fast:boolean>>",
    "css_reordered": "array<struct<selector:string,css_order:string,flex_direction:string,text:string>>",
    "visual_mismatches": "array<struct<selector:string,text:string,dom_position:int,visual_position:int>>",
    "link_styles": "array<struct<selector:string,text:string,contrast:double,cue:boolean>>",
    "colour_coded": "array<struct<selector:string,text:string,color:string>>",
    "fake_headings": "array<struct<selector:string,text:string,size:double,weight:int,base:double>>",
    "text_images": "array<struct<pos:int,selector:string,src:string,alt:string,width:int,height:int,is_logo:boolean>>",
    "pointer_controls": "array<struct<selector:string,text:string>>",
    "checker": "struct<violations:array<struct<id:string,help:string,nodes:array<struct<target:array<string>,html:string,summary:string>>>>,"
    "incomplete:array<struct<id:string,help:string,nodes:array<struct<target:array<string>,html:string,summary:string>>>>>",
    "load_error": "string",
}


def with_recorded(pages: DataFrame) -> DataFrame:
    """Typed NULLs for every recorded column the input does not carry."""
    have = set(pages.columns)
    return pages.select("*", *[F.lit(None).cast(t).alias(c) for c, t in RECORDED.items() if c not in have])


COUNTS = {
    "images": "size(filter(images, i -> not i.aria_hidden))",
    "linkedImages": "size(filter(images, i -> i.in_link))",
    "decorativeCandidates": "size(filter(images, i -> i.likely_decorative))",
    "complexImages": f"size(filter(images, i -> concat(i.src, ' ', coalesce(i.alt, '')) rlike {lit(P.COMPLEX_IMAGE)}))",
    "embeddedMedia": "size(filter(media, m -> m.kind in ('embed','player')))",
    "audioOnly": "size(filter(media, m -> m.kind = 'audio'))",
    "videoElements": "size(filter(media, m -> m.kind in ('video','player')))",
    "timeBasedMedia": "size(filter(media, m -> m.kind <> 'embed'))",
    "captcha": "size(captcha)",
    "autoplayAudio": "size(filter(autoplay, m -> not m.muted))",
    "headings": "size(headings)",
    "lists": "size(lists)",
    "tables": "size(tables)",
    "forms": "size(forms)",
    "formControls": "size(controls)",
    "highStakesForms": "size(filter(forms, f -> f.high_stakes))",
    "validationSignals": "size(error_boxes) + size(filter(controls, c -> c.required or coalesce(c.pattern, '') <> ''))",
    "focusable": "focusable_count",
    "timeLimits": "size(meta_refresh) + coalesce(size(timers), 0)",
    "movingContent": "coalesce(size(animated), 0) + size(carousels) + size(gifs) + size(moving_tags)",
    "flashCandidates": "coalesce(size(filter(animated, a -> a.fast)), 0) + size(gifs)",
    "links": "size(links)",
    "foreignRuns": "size(foreign_runs)",
    "iframes": "size(iframes)",
    "textLength": "text_length",
    "colourCoded": "coalesce(size(colour_coded), 0) + coalesce(size(link_styles), 0) + size(required_markers)",
    "sensoryInstructions": "size(sensory)",
    "textImages": "size(filter(coalesce(text_images, text_images_static), t -> not t.is_logo))",
    "sections": "section_count + size(headings)",
    "repeatedBlocks": "size(navs)",
}


_WORD = re.compile(r"\w+")


@lru_cache(maxsize=None)
def _plan(need: frozenset[str] | None) -> tuple[tuple[tuple[str, str], ...], ...]:
    """Stages reduced to what the wanted columns refer to, directly or through other columns."""
    todo = [tuple(stage.items()) for stage in _stages()]
    if need is None:
        return tuple(todo)
    wanted = {"is_dom", *need}
    if "counts" in wanted:
        for sql in COUNTS.values():
            wanted.update(_WORD.findall(sql))
    out = []
    for stage in reversed(todo):
        # within a stage columns never refer to each other
        kept = tuple((n, sql) for n, sql in stage if n in wanted)
        for _, sql in kept:
            wanted.update(_WORD.findall(sql))
        out.append(kept)
    return tuple(reversed(out))


@lru_cache(maxsize=1)
def _stages() -> list[dict[str, str]]:
    return stages()


def with_evidence(pages: DataFrame, need: set[str] | None = None) -> DataFrame:
    """Pages with a ``dom`` column -> the same rows plus collectors.

    ``need`` names the wanted columns (with ``counts`` for the counts struct); the rest is not even planned.
    """
    out = with_recorded(pages)
    for stage in _plan(frozenset(need) if need is not None else None):
        if stage:
            out = out.withColumns({name: F.expr(sql) for name, sql in stage})
    if need is not None and "counts" not in need:
        return out
    counts = ", ".join(f"'{k}', {v}" for k, v in COUNTS.items())
    return out.withColumn("counts", F.expr(f"if(is_dom, named_struct({counts}), null)"))


def words_of(*sqls: str) -> set[str]:
    """Column names an expression may refer to; feed it to ``need``."""
    return {w for sql in sqls for w in _WORD.findall(sql)}


def template_hash(skeleton_col: str = "skeleton"):
    """32-bit skeleton hash with the reference arithmetic: signed xor, product in double precision."""
    step = (
        "(h, c) -> cast(cast(if((h ^ ascii(c)) >= 2147483648L, (h ^ ascii(c)) - 4294967296L, h ^ ascii(c)) as double) * 16777619D as bigint) & 4294967295L"
    )
    return F.expr(f"lower(lpad(hex(aggregate(filter(split({skeleton_col}, ''), c -> c <> ''), 2166136261L, {step})), 8, '0'))")
