"""One query per page rule, over pages with defects and over recorded browser evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lucerna.operators import recorded as R
from lucerna.operators.evidence import with_evidence, with_recorded, words_of
from lucerna.operators.page_rules import PAGE_RULES, RULE_NOTES, rule_results, with_site_defaults
from lucerna.plans.corpus import derive, mutated
from lucerna.plans.queries_pages import LINKS, RTL, _n
from lucerna.plans.registry import M, query
from lucerna.plans.review import evidence, parsed

SHAPE = (
    "opined",
    "size(findings) as n",
    "array_join(array_sort(array_distinct(transform(findings, f -> f.code))), ',') as codes",
)


def shaped(results, key="page_id"):
    return results.selectExpr(key, *SHAPE)


def _oracle(parts: list[tuple[str, str]], opined: str = "true", prelude: str = "", source: str = "ok", key: str = "page_id", pages: str | None = None) -> str:
    """(count, code) parts -> the same three columns in plain SQL."""
    counts = ", ".join(f"({c})::INT AS n{i}" for i, (c, _) in enumerate(parts)) or "0 AS n0"
    total = " + ".join(f"n{i}" for i in range(len(parts))) or "0"
    codes = "list_sort(list_filter([" + (", ".join(f"CASE WHEN n{i} > 0 THEN '{code}' END" for i, (_, code) in enumerate(parts)) or "NULL") + "], lambda x: x IS NOT NULL))"
    head = pages if pages is not None else M
    return (
        f"WITH {head}{prelude}, parts AS (SELECT {key}, ({opined}) AS opined, {counts} FROM {source}) SELECT {key}, opined, CASE WHEN opined THEN ({total})::INT END AS n,"
        f" CASE WHEN opined THEN array_to_string({codes}, ',') END AS codes FROM parts"
    )


def has(text: str) -> str:
    return f"strpos(html, '{text}') > 0"


FORM, WIDGETS = has('placeholder="Your name"'), has('role="checkbox"')
MEDIA = has("<video ")
LINK_COUNTS = (
    f", {LINKS}, lc AS (SELECT page_id, text = '' AS empty, text <> '' AND min(href) OVER (PARTITION BY page_id, text) <> max(href) OVER (PARTITION BY page_id, text) AS ambiguous,"
    " regexp_matches(lower(text), '^(click here|read more|more|here|link|details)$') AS generic FROM links),"
    " lg AS (SELECT o.page_id, count(*) FILTER (empty) AS e, count(*) FILTER (NOT empty AND ambiguous) AS a, count(*) FILTER (NOT empty AND NOT ambiguous AND generic) AS g FROM ok o LEFT JOIN lc USING (page_id) GROUP BY 1)"
)

STATIC: dict[str, str] = {
    "hebrew-lang-dir": _oracle([("strpos(html, '<html lang') = 0", "lang-missing"), (f"{RTL} AND {has('<html lang=')}", "lang-not-rtl"), (RTL, "dir-not-rtl")]),
    "ltr-island-marked": _oracle([(has("03-1234567"), "ltr-island")], RTL),
    "hebrew-ui-strings": _oracle([(has("Open the main menu"), "english-name")], RTL),
    "hebrew-alt-text": _oracle([(has("banner.png"), "alt-is-filename")]),
    "accessibility-notice-visible": _oracle([("strpos(html, '/statement') = 0", "notice-missing")]),
    "a11y-widget-present": _oracle([("1", "widget-missing")]),
    "a11y-widget-keyboard": _oracle([], "false"),
    "overlay-antipattern": _oracle([(has("userway"), "overlay")]),
    "fake-heading-detect": _oracle([(has("<p>- one</p>"), "typed-list")]),
    "landmark-coverage": _oracle([("NOT regexp_matches(html, '<main[ >]')", "no-main")]),
    "presentational-markup": _oracle([(_n("<(?:font|marquee)[ >]"), "presentational")]),
    "layout-table-detect": _oracle([(has("<table><tr><td>"), "layout-table"), (has("<table><tr><th>"), "no-caption")]),
    "section-heading-coverage": _oracle([("regexp_matches(html, '</h1><h[34]>')", "heading-jump")]),
    "generic-link-text": _oracle([("e", "link-empty"), ("a", "link-ambiguous"), ("g", "link-generic")], prelude=LINK_COUNTS, source="lg"),
    "skip-link-functional": _oracle(
        [
            (f"{has('<a href=' + chr(34) + '#m' + chr(34) + '>')} AND NOT {has(' id=' + chr(34) + 'm' + chr(34))}", "skip-target-missing"),
            (f"NOT {has('<a href=' + chr(34) + '#m' + chr(34) + '>')} AND NOT regexp_matches(html, '<main[ >]')", "no-bypass"),
        ]
    ),
    "placeholder-as-label": _oracle([(FORM, "placeholder-only"), (FORM, "asterisk-only")]),
    "error-announcement": _oracle([(FORM, "describedby-missing"), (f"{FORM} AND NOT {has('role=' + chr(34) + 'alert')}", "no-error-surface")]),
    "captcha-detect": _oracle([("1", "captcha")], has("g-captcha")),
    "click-handler-no-keyboard": _oracle([(has("<div onclick"), "pseudo-control")]),
    "focus-order-walk": _oracle([(_n('tabindex="[1-9]'), "positive-tabindex"), (has('<a href="/h">hidden'), "focusable-but-hidden")]),
    "context-change-on-input": _oracle([(FORM, "select-onchange")]),
    "timeout-detect": _oracle([(_n('http-equiv="refresh"'), "meta-refresh")]),
    "moving-content-detect": _oracle([(_n("<marquee>"), "moving-tag"), (_n('class="carousel"'), "carousel-no-pause")]),
    "flash-candidates": _oracle([(_n('[.]gif"'), "gif")]),
    "markup-validity": _oracle([(has('<div id="d"></div><div id="d">'), "duplicate-id"), (FORM, "broken-reference")]),
    "custom-widget-state": _oracle([(WIDGETS, "no-aria-checked"), (WIDGETS, "widget-not-focusable"), (WIDGETS, "no-aria-selected"), (WIDGETS, "icon-unnamed")]),
    "embedded-media-name": _oracle([(f"2 * ({MEDIA})::INT", "media-unnamed")]),
    "caption-track-present": _oracle([(MEDIA, "no-captions"), (MEDIA, "player-captions")]),
    "text-in-image-detect": _oracle([(has("promo.png"), "text-image")]),
    "foreign-language-run": _oracle([(has("This paragraph is written in English only"), "foreign-run")]),
}


def _register(rule: str, sql: str) -> None:
    @query("rule_" + rule.replace("-", "_"), sql)
    def run(spark, d):
        needed = words_of(PAGE_RULES[rule], RULE_NOTES.get(rule, ""))
        return shaped(rule_results(with_site_defaults(evidence(mutated(spark, d), needed)).where("is_dom"), [rule]))


for _rule, _sql in STATIC.items():
    _register(_rule, _sql)


# ---- recorded evidence, read from the events table -------------------------------------------

STOPS = (
    "SELECT user_id AS page_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, concat('#k', cast(cast(floor(value) AS int) % 6 AS string)) AS selector,"
    " event_type AS name, 'a' AS tag, event_type = 'error' AS contains_frame, event_type <> 'view' AS visible, event_type <> 'click' AS indicator_changed,"
    " cast(floor(value * 10) AS int) AS top_px, cast(floor(value * 7) AS int) % 100 AS left_px, event_type = 'signup' AND value > 40 AS changes FROM {ev}"
)
EV = "lucerna_src_events"


def stops(spark, d):
    df = derive(spark, d, STOPS.format(ev=EV), e="events")
    return df.selectExpr(
        "page_id", "idx as index", "selector", "name", "tag", "contains_frame", "visible", "indicator_changed", "top_px as top", "left_px as left", "left_px + 10 as right",
        "page_id % 2 = 0 as rtl", "if(changes, 'navigation', null) as context_kind", "cast(null as string) as context_detail",
    )


def candidates(spark, d):
    sql = f"SELECT page_id, selector, min(idx) AS pos, 'x' AS text, 'inline handler' AS reason FROM (SELECT user_id AS page_id, event_id AS idx, concat('#k', cast(cast(floor(value) AS int) % 9 AS string)) AS selector FROM {EV}) c GROUP BY page_id, selector"
    return derive(spark, d, sql, e="events")


STOPS_DB = STOPS.format(ev="events")
WALK_DB = (
    f"s AS ({STOPS_DB}), l AS (SELECT *, lag(selector, 1) OVER w AS p1, lag(selector, 2) OVER w AS p2, first_value(selector) OVER w AS f, count(*) OVER (PARTITION BY page_id, selector ORDER BY idx) AS rep FROM s WINDOW w AS (PARTITION BY page_id ORDER BY idx)),"
    " e AS (SELECT *, CASE WHEN selector = p1 AND selector = p2 THEN CASE WHEN contains_frame THEN 'frame' ELSE 'trap' END WHEN idx > 4 AND selector = f THEN 'cycle' END AS fin FROM l),"
    " walk AS (SELECT page_id, arg_min(fin, idx) FILTER (fin IS NOT NULL) AS outcome, arg_min(selector, idx) FILTER (fin IS NOT NULL) AS end_selector, min(idx) FILTER (fin IS NOT NULL) AS end_at,"
    " arg_min(rep, idx) FILTER (fin IS NOT NULL) AS repeats, count(*) AS presses FROM e GROUP BY page_id),"
    " kept AS (SELECT s.*, s.idx - 1 AS position FROM s JOIN walk USING (page_id) WHERE end_at IS NULL OR idx < end_at)"
)
CAND_DB = "cand AS (SELECT DISTINCT user_id AS page_id, concat('#k', cast(cast(floor(value) AS int) % 9 AS string)) AS selector FROM events)"


@query("c46_keyboard_walk", f"WITH {WALK_DB} SELECT page_id, outcome, end_selector, end_at, repeats, presses FROM walk")
def c46(spark, d):
    return R.walk(stops(spark, d)).select("page_id", "outcome", "end_selector", "end_at", "repeats", "presses")


@query("c47_no_indicator", f"WITH {WALK_DB} SELECT page_id, selector, position FROM kept WHERE visible AND NOT indicator_changed AND NOT contains_frame")
def c47(spark, d):
    s = stops(spark, d)
    return R.without_indicator(R.kept_stops(s, R.walk(s))).select("page_id", "selector", "position")


def _bands(source: str, order: str) -> str:
    return (
        f"b1 AS (SELECT *, CASE WHEN top_px - lag(top_px) OVER (PARTITION BY page_id ORDER BY top_px, {order}) > 12 THEN 1 ELSE 0 END AS gap FROM {source}),"
        f" b2 AS (SELECT *, sum(gap) OVER (PARTITION BY page_id ORDER BY top_px, {order}) AS band FROM b1),"
        f" b3 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY band, CASE WHEN page_id % 2 = 0 THEN -(left_px + 10) ELSE left_px END, {order}) - 1 AS visual_position FROM b2)"
    )


@query(
    "c47_focus_order",
    f"WITH {WALK_DB}, v AS (SELECT * FROM kept WHERE visible), {_bands('v', 'position')}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY visual_position) AS r FROM b3 WHERE abs(position - visual_position) > 3)"
    " SELECT page_id, selector, position, visual_position FROM r",
)
def c47b(spark, d):
    s = stops(spark, d)
    return R.focus_order_mismatches(R.kept_stops(s, R.walk(s))).select("page_id", "selector", "position", "visual_position")


@query("c48_unreachable", f"WITH {WALK_DB}, {CAND_DB} SELECT page_id, selector FROM cand c WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.page_id = c.page_id AND k.selector = c.selector)")
def c48(spark, d):
    s = stops(spark, d)
    return R.unreachable(candidates(spark, d), R.kept_stops(s, R.walk(s))).select("page_id", "selector")


BLOCKS = (
    "SELECT user_id AS page_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position, concat('p', cast(event_id AS string)) AS selector, cast(floor(value * 3) AS int) AS top_px,"
    " cast(floor(value * 13) AS int) % 200 AS left_px FROM {ev}"
)


@query(
    "c16_reading_order",
    f"WITH bl AS ({BLOCKS.format(ev='events')}), {_bands('bl', 'position')}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY visual_position) AS r FROM b3 WHERE abs(position - visual_position) > 2)"
    " SELECT page_id, selector, position, visual_position FROM r",
)
def c16(spark, d):
    b = derive(spark, d, BLOCKS.format(ev=EV), e="events").selectExpr("page_id", "position", "selector", "top_px as top", "left_px as left", "left_px + 10 as right", "page_id % 2 = 0 as rtl")
    return R.reading_order_mismatches(b).select("page_id", "selector", "position", "visual_position")


COLOURS = (
    "SELECT event_id, user_id AS page_id, concat('rgb(', cast(event_id * 37 % 256 AS string), ', ', cast(event_id * 91 % 256 AS string), ', ', cast(event_id * 13 % 256 AS string), ')') AS color,"
    " concat('rgba(', cast(user_id * 53 % 256 AS string), ', ', cast(user_id * 29 % 256 AS string), ', ', cast(user_id * 7 % 256 AS string), ', 1)') AS surrounding,"
    " event_type = 'click' AS underlined, event_type = 'view' AS bolder, event_type = 'error' AS has_image, event_type AS text FROM {ev}"
)


def _lum(r: str, g: str, b: str) -> str:
    def ch(v):
        return f"CASE WHEN ({v})/255.0::DOUBLE <= 0.03928 THEN ({v})/255.0::DOUBLE/12.92 ELSE pow((({v})/255.0::DOUBLE + 0.055)/1.055, 2.4) END"

    return f"(0.2126*({ch(r)}) + 0.7152*({ch(g)}) + 0.0722*({ch(b)}))"


LUM_DB = f"lum AS (SELECT *, {_lum('event_id*37%256', 'event_id*91%256', 'event_id*13%256')} AS l1, {_lum('page_id*53%256', 'page_id*29%256', 'page_id*7%256')} AS l2 FROM co)"


@query(
    "c5_c18_contrast",
    f"WITH co AS ({COLOURS.format(ev='events')}), {LUM_DB} SELECT event_id, floor((greatest(l1, l2) + 0.05)/(least(l1, l2) + 0.05)*100 + 0.5)/100 AS contrast, underlined OR bolder OR has_image AS cue FROM lum",
)
def c18(spark, d):
    return R.link_cues(derive(spark, d, COLOURS.format(ev=EV), e="events")).select("event_id", "contrast", "cue")


@query(
    "c19_colour_coded",
    "SELECT event_id, event_type AS text FROM events WHERE greatest(event_id*37%256, event_id*91%256, event_id*13%256) - least(event_id*37%256, event_id*91%256, event_id*13%256) >= 60",
)
def c19(spark, d):
    return R.colour_coded(derive(spark, d, COLOURS.format(ev=EV), e="events")).select("event_id", "text")


MEASURES = (
    "SELECT user_id AS page_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 100 ELSE 200 END AS scale, concat('#t', cast(cast(floor(value * 3) AS int) % 40 AS string)) AS selector,"
    " min(event_id) AS pos, max(event_type) AS text, bool_or(event_type = 'error' AND value > 30) AS clipped FROM {ev} GROUP BY 1, 2, 3"
)


@query(
    "c45_zoom_loss",
    f"""WITH ms AS ({MEASURES.format(ev='events')}), b AS (SELECT page_id, selector, 'lost' AS loss, pos FROM ms a WHERE scale = 100 AND NOT EXISTS (SELECT 1 FROM ms z WHERE z.scale = 200 AND z.page_id = a.page_id AND z.selector = a.selector)
    UNION ALL SELECT page_id, selector, 'clipped', pos FROM ms WHERE scale = 200 AND clipped), r AS (SELECT *, row_number() OVER (PARTITION BY page_id, loss ORDER BY pos) AS r FROM b) SELECT page_id, selector, loss FROM r""",
)
def c45(spark, d):
    m = derive(spark, d, MEASURES.format(ev=EV), e="events")
    return R.zoom_loss(m).select("page_id", "selector", "loss")


# rules over the recorded evidence
KB_RULES = {
    "keyboard-walk": _oracle([("(SELECT count(*) FROM cand c WHERE c.page_id = w.page_id AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.page_id = c.page_id AND k.selector = c.selector))", "unreachable")], pages=f"{WALK_DB}, {CAND_DB}", source="walk w"),
    "keyboard-trap": _oracle([("coalesce(outcome, '') = 'trap'", "focus-trap")], "coalesce(outcome, '') <> 'frame'", pages=WALK_DB, source="walk w"),
    "focus-visible-check": _oracle(
        [("(SELECT count(*) FROM kept k WHERE k.page_id = w.page_id AND visible AND NOT indicator_changed AND NOT contains_frame)", "no-focus-indicator")], pages=WALK_DB, source="walk w"
    ),
    "context-change-on-focus": _oracle([("(SELECT count(*) FROM kept k WHERE k.page_id = w.page_id AND changes)", "context-on-focus")], pages=WALK_DB, source="walk w"),
}


def _register_recorded(rule: str, sql: str) -> None:
    @query("rule_" + rule.replace("-", "_"), sql)
    def run(spark, d):
        kb = R.keyboard_struct(stops(spark, d), candidates(spark, d))
        pages = with_site_defaults(with_recorded(kb.withColumn("is_dom", F.lit(True)).withColumn("url", F.lit("https://a.example/"))))
        return shaped(rule_results(pages, [rule]))


for _rule, _sql in KB_RULES.items():
    _register_recorded(_rule, _sql)


def _recorded_rule(rule: str, arrays, sql: str, blanks: str = "") -> None:
    """A rule over arrays grouped per page from the events table."""

    @query("rule_" + rule.replace("-", "_"), sql)
    def run(spark, d):
        df = derive(spark, d, arrays, e="events")
        df = with_site_defaults(with_recorded(df.withColumn("is_dom", F.lit(True)).withColumn("url", F.lit("https://a.example/x"))))
        if blanks:
            df = df.withColumns({name: F.expr(expr) for name, expr in (b.split("=", 1) for b in blanks.split(";"))})
        return shaped(rule_results(df, [rule]))


_recorded_rule(
    "zoom-200-reflow",
    f"SELECT user_id AS page_id, named_struct('clipped', collect_list(if(event_type = 'click', named_struct('selector', cast(event_id as string), 'text', event_type), null)), 'lost', collect_list(if(event_type = 'error', named_struct('selector', cast(event_id as string), 'text', event_type), null))) AS zoom FROM {EV} GROUP BY user_id",
    _oracle(
        [("page_id % 5 = 0", "zoom-blocked"), ("c", "zoom-clipped"), ("l", "zoom-lost")],
        pages="g AS (SELECT user_id AS page_id, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'error') AS l FROM events GROUP BY 1)",
        source="g",
    ),
    "blocks_zoom=page_id % 5 = 0",
)
_recorded_rule(
    "color-only-meaning",
    f"SELECT user_id AS page_id, collect_list(named_struct('selector', cast(event_id as string), 'text', event_type, 'contrast', if(event_type = 'view', null, value / 10D), 'cue', event_type = 'click')) AS link_styles FROM {EV} GROUP BY user_id",
    _oracle(
        [("n", "colour-only-link")],
        pages="g AS (SELECT user_id AS page_id, count(*) FILTER (event_type <> 'click' AND (event_type = 'view' OR value / 10 < 3)) AS n FROM events GROUP BY 1)",
        source="g",
    ),
)
_recorded_rule(
    "dom-visual-order-mismatch",
    f"SELECT user_id AS page_id, filter(collect_list(if(event_type = 'error' and value > 60, named_struct('selector', cast(event_id as string), 'css_order', '2', 'flex_direction', '', 'text', ''), null)), x -> x is not null) AS css_reordered,"
    f" filter(collect_list(if(event_type = 'view' and value > 60, named_struct('selector', cast(event_id as string), 'text', '', 'dom_position', 1, 'visual_position', 9), null)), x -> x is not null) AS visual_mismatches FROM {EV} GROUP BY user_id",
    _oracle(
        [("c", "css-reordered")],
        "c > 0 OR v = 0",
        pages="g AS (SELECT user_id AS page_id, count(*) FILTER (event_type = 'error' AND value > 60) AS c, count(*) FILTER (event_type = 'view' AND value > 60) AS v FROM events GROUP BY 1)",
        source="g",
    ),
)


@query(
    "rule_timers_first_party",
    _oracle(
        [("own", "timer")],
        "own > 0 OR other = 0",
        pages="g AS (SELECT user_id AS page_id, count(*) FILTER (value * 1000 >= 5000 AND event_type IN ('view', 'click')) AS own, count(*) FILTER (value * 1000 >= 5000 AND event_type NOT IN ('view', 'click')) AS other FROM events WHERE event_id % 9 = 0 GROUP BY 1)",
        source="g",
    ),
)
def timers(spark, d):
    sql = (
        "SELECT user_id AS page_id, collect_list(named_struct('kind', 'setTimeout', 'delay_ms', value * 1000D, 'stack', case event_type when 'view' then '' when 'click' then 'at https://a.example/app.js:1' else 'at https://cdn.other/lib.js:2' end)) AS timers"
        f" FROM {EV} WHERE event_id % 9 = 0 GROUP BY user_id"
    )
    df = derive(spark, d, sql, e="events")
    df = with_site_defaults(with_recorded(df.withColumn("is_dom", F.lit(True)).withColumn("url", F.lit("https://a.example/x")).withColumn("meta_refresh", F.expr("cast(array() as array<struct<content:string>>)"))))
    return shaped(rule_results(df, ["timeout-detect"]))


# ---- C10: styled text that is no heading; styles are recorded on the elements of the derived pages -------------------

_F = "data-f"
_NEXT = f'<p {_F}="16 400 16 block 1 30 50">We open at nine</p>'
# page_id % 20 -> (markup, text when it is a fake heading): each but the first three and the last is excluded for one reason
HEADING_CASES = [
    (f'<div><p {_F}="24 400 16 block 1 0 20">Opening hours</p>{_NEXT}</div>', "Opening hours"),
    (f'<div><strong {_F}="16 700 16 block 1 0 20">Getting here</strong>{_NEXT}</div>', "Getting here"),
    (f'<div><p {_F}="20 400 16 block 1 0 20">Tickets, prices <i>now</i></p>{_NEXT}</div>', "Tickets, prices now"),
    (f'<div><span {_F}="24 700 16 inline-block 1 0 20">Inline</span>{_NEXT}</div>', None),
    (f'<div><p {_F}="24 700 16 block 1 0 20">This is a lead paragraph that is set larger than all the rest.</p>{_NEXT}</div>', None),
    (f'<div><p {_F}="24 700 16 block 1 0 20">Bread, milk, eggs</p>{_NEXT}</div>', None),
    (f'<ul><li {_F}="24 700 16 list-item 1 0 20">First item</li><li {_F}="24 700 16 list-item 1 30 50">Second item</li></ul>', None),
    (f'<div><div {_F}="24 700 16 block 1 0 20">Chip one</div><div {_F}="16 400 16 block 1 0 20">Chip two</div></div>', None),
    (f'<header><a href="/"><span {_F}="24 700 16 block 1 0 20">Wordmark</span></a>{_NEXT}</header>', None),
    (f'<div><p aria-hidden="true" {_F}="24 700 16 block 1 0 20">Hidden one</p>{_NEXT}</div>', None),
    (f'<div><p {_F}="24 700 16 block 1 0 20">12 +</p>{_NEXT}</div>', None),
    (f'<div><p {_F}="24 700 16 block 1 0 20">Last of all</p></div>', None),
    (f'<div><p {_F}="24 700 16 block 1 0 20">Over nothing</p><p {_F}="16 400 16 block 1 30 50"> </p></div>', None),
    (f'<div><p {_F}="24 700 16 block 1 0 20">{"long words " * 12}</p>{_NEXT}</div>', None),
    (f'<h2><span {_F}="24 700 16 block 1 0 20">Real heading</span>{_NEXT.replace("<p ", "<span ").replace("</p>", "</span>")}</h2>', None),
    (f'<div><p {_F}="24 700 16 block 0 0 20">Not visible</p>{_NEXT}</div>', None),
    (f'<div><p {_F}="19 500 16 block 1 0 20">Neither big nor bold</p>{_NEXT}</div>', None),
    (f'<div><p {_F}="24 700 16 block 1 0 20"><i>Two</i> <i>children</i></p>{_NEXT}</div>', None),
    (f'<div><p>No style recorded</p>{_NEXT}</div>', None),
    (f'<div><li {_F}="24 700 16 list-item 1 0 20">Item of no list</li>{_NEXT}</div>', "Item of no list"),
]
HEADING_PAGES = (
    "SELECT page_id, url, replace(html, '</article>', concat(CASE page_id % 20 " + " ".join(f"WHEN {i} THEN '{h}'" for i, (h, _) in enumerate(HEADING_CASES)) + " END, '</article>')) AS html FROM {t}"
)
_TEXTS = "CASE page_id % 20 " + " ".join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(HEADING_CASES) if t) + " END"
_SIZES = "CASE page_id % 20 WHEN 1 THEN 16 WHEN 2 THEN 20 ELSE 24 END"


def heading_pages(spark, d):
    return parsed(derive(spark, d, HEADING_PAGES.format(t="lucerna_src_pages"), p="pages"))


def recorded_styles(pages):
    """What a browser would have recorded of each styled element, read from the element itself."""
    facts = pages.selectExpr("page_id", "inline(transform(filter(dom.elements, e -> e.attrs['data-f'] is not null), e -> named_struct('selector', e.selector, 'f', split(e.attrs['data-f'], ' '))))")
    return facts.selectExpr(
        "page_id", "selector", "cast(f[0] as double) as size", "cast(f[1] as int) as weight", "cast(f[2] as double) as base", "f[3] as display", "f[4] = '1' as visible", "cast(f[5] as int) as top", "cast(f[6] as int) as bottom"
    )


@query("c10_fake_headings", f"SELECT page_id, {_TEXTS} AS text, ({_SIZES})::DOUBLE AS size, CASE page_id % 20 WHEN 0 THEN 400 WHEN 2 THEN 400 ELSE 700 END AS weight FROM pages WHERE strpos(html, '</article>') > 0 AND {_TEXTS} IS NOT NULL")
def c10(spark, d):
    pages = heading_pages(spark, d)
    return R.fake_headings(pages, recorded_styles(pages)).select("page_id", "text", "size", "weight")


@query(
    "c10_fake_heading_rule",
    f"SELECT page_id, true AS opined, (strpos(html, '</article>') > 0 AND {_TEXTS} IS NOT NULL)::INT AS n, CASE WHEN strpos(html, '</article>') > 0 AND {_TEXTS} IS NOT NULL THEN 'fake-heading' ELSE '' END AS codes FROM pages",
)
def c10_rule(spark, d):
    pages = heading_pages(spark, d)
    needed = words_of(PAGE_RULES["fake-heading-detect"], RULE_NOTES.get("fake-heading-detect", ""))
    return shaped(rule_results(with_site_defaults(with_evidence(R.with_fake_headings(pages, recorded_styles(pages)), needed)), ["fake-heading-detect"]))
