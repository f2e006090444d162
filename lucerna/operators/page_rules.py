"""Page rules (R0 and the 43 rules): one nullable array of findings per rule.

NULL = no opinion, empty array = checked and clean, otherwise findings (at most 20).
Every rule is a narrow expression over the evidence row; site facts arrive as columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions import patterns as P
from lucerna.functions.patterns import lit
from lucerna.operators.evidence import clip, squash

FINDING = "struct<locator:string,snippet:string,code:string,reason:string>"
NONE = f"cast(array() as array<{FINDING}>)"
NO_OPINION = f"cast(null as array<{FINDING}>)"

SITE_COLUMNS = {
    "page_count": "bigint",
    "title_others": "bigint",
    "title_first_other": "string",
    "site_search": "boolean",
    "site_sitemap": "boolean",
    "site_breadcrumbs": "boolean",
    "nav_seq": "array<string>",
    "nav_conflict": "struct<other_url:string,shared:array<string>,other_shared:array<string>>",
    "components": "map<string,string>",
    "component_conflicts": "array<struct<key:string,name:string,other_name:string,other_url:string>>",
    "statement": "struct<url:string,conformance_level:boolean,features_list:boolean,known_limitations:boolean,coordinator_name:boolean,"
    "phone:boolean,email:boolean,audit_date:boolean,update_date:boolean>",
    "rule_errors": "map<string,string>",
}


def finding(locator: str, snippet: str | None, code: str, detail: str = "''") -> str:
    snip = f"cast({snippet} as string)" if snippet else "cast(null as string)"
    return f"named_struct('locator', {locator}, 'snippet', {snip}, 'code', '{code}', 'reason', concat('{code}: ', coalesce(cast({detail} as string), '')))"


def source(x: str) -> str:
    return clip(squash(f"substring(html, {x}.s0 + 1, least({x}.s1 - {x}.s0, 1200))"), 300)


def each(src: str, locator: str, snippet: str | None, code: str, detail: str = "''", var: str = "x") -> str:
    return f"transform({src}, {var} -> {finding(locator, snippet, code, detail)})"


def when(cond: str, f: str) -> str:
    return f"if({cond}, array({f}), {NONE})"


def together(*parts: str) -> str:
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def only_if(cond: str, body: str) -> str:
    """No opinion unless the condition holds."""
    return f"if({cond}, {body}, {NO_OPINION})"


def _rules() -> dict[str, str]:
    lang, direction = "lower(coalesce(lang, ''))", "lower(coalesce(dir, ''))"
    visible_widget = "exists(widget_candidates, w -> w.visible)"
    r: dict[str, str] = {}
    r["hebrew-lang-dir"] = together(
        when(f"{lang} = ''", finding("'html'", "'<html>'", "lang-missing")),
        when(f"{lang} <> '' and rtl_content and not {lang} rlike '{P.RTL_LANG}'", finding("'html'", f"concat('<html lang=\"', {lang}, '\">')", "lang-not-rtl", lang)),
        when(f"rtl_content and {direction} <> 'rtl'", finding("'html'", None, "dir-not-rtl", direction)),
    )
    r["ltr-island-marked"] = only_if("rtl_content", together(each("islands", "x.selector", "x.context", "ltr-island", "concat(x.kind, ' ', x.match)")))
    r["hebrew-ui-strings"] = only_if("rtl_content", together(each("english_names", "x.selector", "x.name", "english-name", "concat(x.name, ' from ', x.source)")))
    r["hebrew-alt-text"] = together(each("filter(images, i -> not i.aria_hidden and i.filename_alt)", "x.selector", source("x"), "alt-is-filename", "x.alt"))
    missing = ", ".join(f"if(statement.{k}, null, '{k}')" for k, _ in P.STATEMENT_AUDIT)
    missing = f"array_compact(array({missing}))"
    r["accessibility-statement"] = together(
        when("size(statement_links) = 0", finding("'body'", None, "statement-link-missing")),
        when(f"statement is not null and size({missing}) > 0", finding("statement.url", None, "statement-incomplete", f"array_join({missing}, '; ')")),
        when("statement is null and size(statement_links) > 0", finding("get(statement_links, 0).selector", "get(statement_links, 0).href", "statement-not-loaded")),
    )
    ways = "(cast(statement.phone as int) + cast(statement.email as int))"
    r["coordinator-contact"] = only_if(
        "statement is not null",
        together(
            when("not statement.coordinator_name", finding("statement.url", None, "coordinator-missing")),
            when(f"{ways} < 2", finding("statement.url", None, "contact-ways", ways)),
        ),
    )
    r["accessibility-notice-visible"] = when(f"size(statement_links) = 0 and not {visible_widget}", finding("'body'", None, "notice-missing"))
    r["a11y-widget-present"] = when(f"not {visible_widget}", finding("'body'", None, "widget-missing"))
    r["a11y-widget-keyboard"] = only_if(
        visible_widget,
        together(
            each(
                "filter(widget_candidates, w -> w.visible and not w.focusable and not coalesce(array_contains(transform(keyboard.stops, s -> s.selector), w.selector), false))",
                "x.selector", None, "widget-not-operable", "x.name",
            )
        ),
    )
    r["overlay-antipattern"] = when("size(overlay_vendors) > 0", finding("'script[src]'", "array_join(overlay_vendors, ', ')", "overlay", "array_join(overlay_vendors, ', ')"))
    r["fake-heading-detect"] = together(
        each(f"coalesce(fake_headings, cast(array() as array<struct<selector:string,text:string,size:double,weight:int,base:double>>))", "x.selector", "x.text", "fake-heading", "x.text"),
        each("fake_lists", "x.selector", source("x"), "typed-list", "x.text"),
        when("not has_h1", finding("'body'", None, "no-h1")),
    )
    r["landmark-coverage"] = together(
        when("not has_main", finding("'body'", None, "no-main")),
        when("not exists(landmarks, l -> l.tag = 'nav' or coalesce(l.role, '') = 'nav') and size(links) >= 5", finding("'body'", None, "no-nav")),
    )
    r["presentational-markup"] = together(each("presentational", "x.selector", source("x"), "presentational", "x.tag"))
    r["layout-table-detect"] = together(
        f"flatten(transform(tables, x -> case when x.looks_layout then array({finding('x.selector', source('x'), 'layout-table', 'x.rows')})"
        f" when x.th > 0 and not x.caption then array({finding('x.selector', source('x'), 'no-caption')}) else {NONE} end))"
    )
    leveled = "filter(headings, h -> coalesce(h.level, 0) <> 0)"
    jumps = f"get(transform(array({leveled}), hs -> filter(transform(hs, (h, i) -> named_struct('h', h, 'prev', get(hs, i - 1).level)), y -> y.prev is not null and y.h.level > y.prev + 1)), 0)"
    r["section-heading-coverage"] = together(
        each(jumps, "x.h.selector", "x.h.text", "heading-jump", "concat('h', x.h.level, ' after h', x.prev, ' ', x.h.text)"),
        when(f"size({leveled}) = 0 and text_length > 600", finding("'body'", None, "no-headings")),
    )
    reorder = each("css_reordered", "x.selector", "x.text", "css-reordered", "if(coalesce(x.css_order, '') not in ('', '0'), concat('order:', x.css_order), concat('flex-direction:', x.flex_direction))")
    r["dom-visual-order-mismatch"] = (
        f"case when css_reordered is null and visual_mismatches is null then {NO_OPINION}"
        f" when coalesce(size(css_reordered), 0) > 0 then {together(reorder)} when coalesce(size(visual_mismatches), 0) = 0 then {NONE} else {NO_OPINION} end"
    )
    r["generic-link-text"] = together(
        "flatten(transform(filter(links, l -> l.visible), x -> case"
        f" when x.empty then array({finding('x.selector', 'x.href', 'link-empty', 'x.href')})"
        f" when x.ambiguous then array({finding('x.selector', 'x.href', 'link-ambiguous', 'x.text')})"
        f" when x.generic then array({finding('x.selector', 'x.href', 'link-generic', 'concat(x.text, ' + repr(' in ') + ', left(x.context, 120))')})"
        f" when x.is_url then array({finding('x.selector', 'x.text', 'link-url-text')}) else {NONE} end))"
    )
    skips = "filter(skip_links, s -> s.looks_skip)"
    r["skip-link-functional"] = (
        f"if(size({skips}) = 0, {when('not (has_main and size(landmarks) >= 3)', finding(repr('body'), None, 'no-bypass'))}, "
        + together(
            f"flatten(transform({skips}, x -> case when not x.target_exists then array({finding('x.selector', 'x.href', 'skip-target-missing', 'x.href')})"
            f" when x.hidden then array({finding('x.selector', 'x.href', 'skip-hidden')}) when not x.target_focusable then array({finding('x.selector', 'x.href', 'skip-target-not-focusable', 'x.href')})"
            f" when x.dom_position > 3 then array({finding('x.selector', 'x.href', 'skip-late', 'x.dom_position + 1')}) else {NONE} end))"
        )
        + ")"
    )
    r["title-unique-across-site"] = (
        f"if(title = '', array({finding(repr('title'), None, 'title-missing')}), "
        + together(
            when("coalesce(title_others, 0) > 0", finding("'title'", "title", "title-duplicate", "concat(title, ' also on ', title_others, ' pages, first ', title_first_other)")),
            when("title = site_name", finding("'title'", "title", "title-is-site-name")),
        )
        + ")"
    )
    n_ways = (
        "(if(coalesce(site_search, false) or search_mechanisms > 0, 1, 0) + if(coalesce(site_sitemap, false) or sitemap_links > 0, 1, 0)"
        " + if(coalesce(site_breadcrumbs, false) or breadcrumbs > 0, 1, 0) + if(counts.repeatedBlocks > 0, 1, 0))"
    )
    r["multiple-ways-site"] = only_if("page_count > 1", when(f"{n_ways} < 2", finding("'body'", None, "few-ways", n_ways)))
    r["nav-consistency"] = only_if(
        "page_count > 1 and size(nav_seq) > 0",
        when("nav_conflict is not null", finding("'nav'", "array_join(nav_conflict.shared, ' > ')", "nav-order", "concat('differs from ', nav_conflict.other_url, ': ', array_join(nav_conflict.other_shared, ' > '))")),
    )
    r["component-identity"] = only_if(
        "page_count > 1 and components is not null",
        together(each("coalesce(component_conflicts, cast(array() as array<struct<key:string,name:string,other_name:string,other_url:string>>))", "x.key", "x.name", "component-name", "concat(x.other_url, ' calls it ', x.other_name, ', this page ', x.name)")),
    )
    r["placeholder-as-label"] = together(
        each("filter(controls, c -> c.visible and c.placeholder_only)", "x.selector", source("x"), "placeholder-only", "x.placeholder"),
        each("filter(required_markers, m -> m.asterisk and not m.says_required)", "x.selector", "x.text", "asterisk-only", "x.text"),
    )
    live = "exists(error_boxes, b -> coalesce(b.role, '') = 'alert' or coalesce(b.live, 'off') not in ('', 'off'))"
    lost = "filter(c.described_by, d -> startswith(d, '(missing:'))"
    r["error-announcement"] = together(
        when(f"size(error_boxes) > 0 and not {live}", finding("get(error_boxes, 0).selector", "get(error_boxes, 0).text", "errors-silent")),
        each(f"filter(controls, c -> size({lost}) > 0)", "x.selector", source("x"), "describedby-missing", f"array_join({lost.replace('c.', 'x.')}, ', ')"),
        when("size(error_boxes) = 0 and exists(controls, c -> c.required)", finding("'form'", None, "no-error-surface")),
    )
    r["captcha-detect"] = only_if("size(captcha) > 0", together(each("captcha", "x.selector", source("x"), "captcha")))
    r["keyboard-walk"] = only_if("keyboard is not null", together(each("keyboard.unreachable", "x.selector", "x.text", "unreachable", "concat(x.reason, ' ', x.text)")))
    pointer = "cast(array() as array<struct<selector:string,text:string>>)"
    r["click-handler-no-keyboard"] = together(
        each("pseudo_controls", "x.selector", source("x"), "pseudo-control", "x.text"),
        each(f"filter(coalesce(pointer_controls, {pointer}), p -> not exists(pseudo_controls, s -> s.selector = p.selector))", "x.selector", None, "pseudo-control", "x.text"),
    )
    r["keyboard-trap"] = (
        f"case when keyboard is null then {NO_OPINION} when keyboard.trap is not null then array({finding('keyboard.trap.selector', 'keyboard.trap.name', 'focus-trap', 'keyboard.trap.repeats')})"
        f" when keyboard.frame_boundary is not null then {NO_OPINION} else {NONE} end"
    )
    r["focus-order-walk"] = together(
        each("positive_tabindex", "x.selector", "x.text", "positive-tabindex", "x.tabindex"),
        each("hidden_focusable", "x.selector", source("x"), "focusable-but-hidden"),
        f"coalesce({each('keyboard.order_mismatches', 'x.selector', 'x.name', 'focus-order', 'concat(x.focus_position + 1, ' + repr(' seen at ') + ', x.visual_position + 1)')}, {NONE})",
    )
    r["focus-visible-check"] = only_if("keyboard is not null", together(each("keyboard.no_indicator", "x.selector", "x.name", "no-focus-indicator", "concat(x.tag, ' ', x.name)")))
    r["context-change-on-focus"] = only_if(
        "keyboard is not null", together(each("filter(keyboard.stops, s -> s.context_kind is not null)", "x.selector", "x.name", "context-on-focus", "concat_ws(' ', x.context_kind, x.context_detail)"))
    )
    r["context-change-on-input"] = together(each("filter(controls, c -> c.on_change and c.tag = 'select')", "x.selector", source("x"), "select-onchange", "x.name"))
    r["zoom-200-reflow"] = only_if(
        "zoom is not null",
        together(
            when("blocks_zoom", finding("'meta[name=\"viewport\"]'", None, "zoom-blocked")),
            each("zoom.clipped", "x.selector", "x.text", "zoom-clipped"),
            each("zoom.lost", "x.selector", "x.text", "zoom-lost"),
        ),
    )
    origin = "concat(parse_url(url, 'PROTOCOL'), '://', parse_url(url, 'AUTHORITY'))"
    relevant = "filter(coalesce(timers, cast(array() as array<struct<kind:string,delay_ms:double,stack:string>>)), t -> t.delay_ms >= 5000 and t.delay_ms < 72000000)"
    urls = r"regexp_extract_all(coalesce(t.stack, ''), r'(https?://[^\s)]+)', 1)"
    own = f"filter({relevant}, t -> size({urls}) = 0 or exists({urls}, u -> startswith(u, {origin})))"
    r["timeout-detect"] = (
        f"if(size(meta_refresh) = 0 and size({own}) = 0 and size({relevant}) > 0, {NO_OPINION}, "
        + together(
            each("meta_refresh", "'meta[http-equiv=\"refresh\"]'", "x.content", "meta-refresh", "x.content"),
            each(own, "'script'", "concat(x.kind, '(', cast(x.delay_ms as bigint), 'ms)')", "timer", "cast(x.delay_ms as bigint)"),
        )
        + ")"
    )
    no_anim = "cast(array() as array<struct<selector:string,name:string,duration_sec:double,infinite:boolean,fast:boolean>>)"
    r["moving-content-detect"] = together(
        each("moving_tags", "x.selector", source("x"), "moving-tag", "x.tag"),
        each("filter(carousels, c -> not c.has_pause)", "x.selector", "x.class_name", "carousel-no-pause"),
        each(f"filter(coalesce(animated, {no_anim}), a -> a.infinite)", "x.selector", "x.name", "endless-animation"),
    )
    r["flash-candidates"] = together(
        each(f"filter(coalesce(animated, {no_anim}), a -> a.fast)", "x.selector", "x.name", "fast-animation", "x.duration_sec"),
        each("gifs", "x.selector", "x.src", "gif"),
    )
    r["markup-validity"] = together(
        each("dup_ids", "x.selector", source("x"), "duplicate-id", "x.id"),
        each("broken_refs", "x.selector", source("x"), "broken-reference", "concat(x.attribute, ' ', x.missing_id)"),
        each("orphan_labels", "x.selector", "x.text", "orphan-label", "x.label_for"),
    )
    state = [
        ("x.role in ('combobox','menu','menubar') and x.expanded is null", "no-aria-expanded"),
        ("x.role in ('checkbox','radio','switch') and x.checked is null", "no-aria-checked"),
        ("x.role in ('tab','option') and x.selected is null", "no-aria-selected"),
        ("not x.focusable and x.role in ('button','link','checkbox','radio','switch','tab','menuitem','option','slider','spinbutton')", "widget-not-focusable"),
    ]
    r["custom-widget-state"] = together(
        "flatten(transform(filter(widgets, w -> w.visible), x -> array_compact(array("
        + ", ".join(f"if({c}, {finding('x.selector', source('x'), code, 'x.role')}, null)" for c, code in state)
        + "))))",
        each("filter(icon_buttons, b -> b.name = '')", "x.selector", source("x"), "icon-unnamed"),
    )
    r["embedded-media-name"] = together(each(f"filter(media, m -> not m.aria_hidden and (m.name = '' or m.name rlike {lit(P.GENERIC_MEDIA_NAME)}))", "x.selector", source("x"), "media-unnamed", "left(x.src, 80)"))
    r["caption-track-present"] = together(
        each("filter(media, m -> m.kind = 'video' and not m.captions)", "x.selector", source("x"), "no-captions"),
        each("filter(media, m -> m.kind = 'player')", "x.selector", "left(x.src, 120)", "player-captions"),
    )
    r["text-in-image-detect"] = together(
        each("filter(coalesce(text_images, text_images_static), t -> not t.is_logo)", "x.selector", "left(x.src, 100)", "text-image", "concat(x.width, 'x', x.height, ' ', x.alt)")
    )
    r["foreign-language-run"] = together(each("foreign_runs", "x.selector", "x.text", "foreign-run", "x.detected"))
    r["color-only-meaning"] = only_if(
        "link_styles is not null",
        together(each("filter(link_styles, l -> not l.cue and (l.contrast is null or l.contrast < 3))", "x.selector", "x.text", "colour-only-link", "concat(x.text, coalesce(concat(' ', x.contrast), ''))")),
    )
    return r


PAGE_RULES = _rules()
# why a rule declined to judge, when it says so
RULE_NOTES = {
    "keyboard-trap": "if(keyboard.trap is null and keyboard.frame_boundary is not null, concat('walk stopped at frame ', keyboard.frame_boundary.selector), null)",
    "timeout-detect": (
        "if(size(filter(timers, t -> t.delay_ms >= 5000 and t.delay_ms < 72000000)) > 0 and exists(filter(timers, t -> t.delay_ms >= 5000 and t.delay_ms < 72000000),"
        r" t -> size(regexp_extract_all(coalesce(t.stack, ''), r'(https?://[^\s)]+)', 1)) > 0 and not exists(regexp_extract_all(coalesce(t.stack, ''), r'(https?://[^\s)]+)', 1),"
        " u -> startswith(u, concat(parse_url(url, 'PROTOCOL'), '://', parse_url(url, 'AUTHORITY'))))), 'third-party timers seen', null)"
    ),
}


def with_site_defaults(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in SITE_COLUMNS.items() if c not in have])


def rule_sql(rule_id: str) -> str:
    """The expression of one rule; an unknown id raises, a recorded technical failure becomes a finding."""
    if rule_id not in PAGE_RULES:
        raise KeyError(f"unknown page rule {rule_id!r}")
    err = f"rule_errors['{rule_id}']"
    return f"if(is_dom, if({err} is null, {PAGE_RULES[rule_id]}, array({finding(repr('engine'), None, 'rule-failed', err)})), {NO_OPINION})"


def with_rules(evidence: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Add one column per rule, named ``rule:<id>``."""
    df = with_site_defaults(evidence)
    return df.withColumns({f"rule:{r}": F.expr(rule_sql(r)) for r in (rules or PAGE_RULES)})


def rule_results(evidence: DataFrame, rules: list[str] | None = None, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Long form: (page, rule, opined, findings). NULL and empty stay apart in ``opined``."""
    rules = rules or list(PAGE_RULES)
    df = with_rules(evidence, rules)
    items = ", ".join(f"named_struct('rule', '{r}', 'opined', `rule:{r}` is not null, 'findings', `rule:{r}`)" for r in rules)
    return df.selectExpr(*keys, f"inline(array({items}))")
