"""Derivations over recorded browser evidence.

Inputs are flat tables keyed by page; each derivation windows within one page, whose rows are bounded
by the recorder's own caps, never across pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lucerna.functions import color as C


def walk(stops: DataFrame, key: str = "page_id") -> DataFrame:
    """Per page, how the keyboard walk ended.

    ``stops`` has key, index, selector, name, contains_frame (every press, repeats included). The walk ends
    at the first press that repeats the two before it (a trap, or a frame boundary when a frame is involved)
    or that returns to the first stop after more than three.
    """
    w = W.partitionBy(key).orderBy("index")
    lagged = stops.withColumns(
        {
            "_p1": F.lag("selector", 1).over(w), "_p2": F.lag("selector", 2).over(w),
            "_first": F.first("selector").over(w), "_n": F.row_number().over(w),
            "_repeats": F.count(F.lit(1)).over(W.partitionBy(key, "selector").orderBy("index")),
        }
    )
    ended = lagged.withColumn(
        "_end",
        F.expr("case when selector = _p1 and selector = _p2 then if(contains_frame, 'frame', 'trap') when _n > 4 and selector = _first then 'cycle' end"),
    )
    return (
        ended.groupBy(key)
        .agg(
            F.expr("min_by(_end, if(_end is null, null, _n))").alias("outcome"),
            F.expr("min_by(selector, if(_end is null, null, _n))").alias("end_selector"),
            F.expr("min(if(_end is null, null, _n))").alias("end_at"),
            F.expr("min_by(_repeats, if(_end is null, null, _n))").alias("repeats"),
            F.count(F.lit(1)).alias("presses"),
        )
    )


def kept_stops(stops: DataFrame, ends: DataFrame, key: str = "page_id") -> DataFrame:
    """The stops before the walk ended, numbered from 0."""
    n = F.row_number().over(W.partitionBy(key).orderBy("index"))
    return stops.withColumn("_n", n).join(ends.select(key, "end_at"), key).where("end_at is null or _n < end_at").withColumn("position", F.col("_n") - 1).drop("_n", "end_at")


def without_indicator(stops: DataFrame) -> DataFrame:
    """Visible stops with no visible change on focus; frames are outside what can be seen."""
    return stops.where("visible and not indicator_changed and not contains_frame")


def _visual_rank(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """Rank by 12 px bands from the top, then along the reading direction."""
    w = W.partitionBy(key).orderBy("top", order_col)
    step = df.withColumn("_gap", F.expr("if(top - lag(top) over (partition by {0} order by top, {1}) > 12, 1, 0)".format(key, order_col)))
    band = step.withColumn("_band", F.sum("_gap").over(w.rowsBetween(W.unboundedPreceding, 0)))
    across = F.expr("if(rtl, -right, left)")
    return band.withColumn("visual_position", F.row_number().over(W.partitionBy(key).orderBy("_band", across, order_col)) - 1).drop("_gap", "_band")


def focus_order_mismatches(stops: DataFrame, key: str = "page_id") -> DataFrame:
    """Visible stops more than three places from where they are seen, in visual order."""
    return _visual_rank(stops.where("visible"), key, "position").where("abs(position - visual_position) > 3")


def reading_order_mismatches(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Blocks whose document rank is more than two away from their visual rank."""
    return _visual_rank(blocks, key, "position").where("abs(position - visual_position) > 2")


def unreachable(candidates: DataFrame, stops: DataFrame, key: str = "page_id") -> DataFrame:
    """Things that look operable and were never reached."""
    return candidates.join(stops.select(key, "selector").distinct(), [key, "selector"], "left_anti")


def zoom_loss(measures: DataFrame, key: str = "page_id") -> DataFrame:
    """Text seen at 100 % and gone at 200 %, and text clipped at 200 %."""
    before, after = measures.where("scale = 100"), measures.where("scale = 200")
    lost = before.join(after.select(key, "selector").distinct(), [key, "selector"], "left_anti").withColumn("loss", F.lit("lost"))
    clipped = after.where("clipped").withColumn("loss", F.lit("clipped"))
    return lost.select(key, "selector", "text", "loss").unionByName(clipped.select(key, "selector", "text", "loss"))


def link_cues(styles: DataFrame) -> DataFrame:
    """Contrast of a link against its surroundings and whether anything but colour marks it."""
    return styles.withColumn("contrast", F.expr(C.contrast("color", "surrounding"))).withColumn("cue", F.expr("underlined or bolder or has_image"))


def colour_coded(texts: DataFrame) -> DataFrame:
    """Short leaf texts in a saturated colour."""
    return texts.where(F.expr(f"text <> '' and char_length(text) <= 60 and {C.spread('color')} >= 60"))


def keyboard_struct(stops: DataFrame, candidates: DataFrame, key: str = "page_id") -> DataFrame:
    """One ``keyboard`` struct per page, in the shape the page rules read. A page holds at most the recorder's cap of stops."""
    ends = walk(stops, key)
    kept = kept_stops(stops, ends, key)
    listed = kept.groupBy(key).agg(
        F.expr("transform(array_sort(collect_list(struct(position, selector, name, tag, context_kind, context_detail, visible, indicator_changed, contains_frame))), s -> s)").alias("_s")
    )
    reach = unreachable(candidates, kept, key).groupBy(key).agg(F.expr("transform(array_sort(collect_list(struct(pos, selector, text, reason))), u -> named_struct('selector', u.selector, 'text', u.text, 'reason', u.reason))").alias("_u"))
    order = focus_order_mismatches(kept, key).groupBy(key).agg(
        F.expr("transform(array_sort(collect_list(struct(visual_position, selector, name, position))), m -> named_struct('selector', m.selector, 'name', m.name, 'position', cast(m.position as int), 'visual_position', cast(m.visual_position as int)))").alias("_o")
    )
    joined = ends.join(listed, key, "left").join(reach, key, "left").join(order, key, "left")
    return joined.select(
        key,
        F.expr(
            "named_struct('stops', transform(coalesce(_s, array()), s -> named_struct('index', cast(s.position as int), 'selector', s.selector, 'name', s.name, 'tag', s.tag, 'context_kind', s.context_kind, 'context_detail', s.context_detail)),"
            " 'trap', if(outcome = 'trap', named_struct('selector', end_selector, 'name', end_selector, 'repeats', cast(repeats as int)), null),"
            " 'frame_boundary', if(outcome = 'frame', named_struct('selector', end_selector, 'name', end_selector), null),"
            " 'unreachable', transform(coalesce(_u, array()), u -> named_struct('selector', u.selector, 'text', u.text, 'reason', u.reason)),"
            " 'no_indicator', transform(filter(coalesce(_s, array()), s -> s.visible and not s.indicator_changed and not s.contains_frame), s -> named_struct('selector', s.selector, 'name', s.name, 'tag', s.tag)),"
            " 'order_mismatches', transform(coalesce(_o, array()), m -> named_struct('selector', m.selector, 'name', m.name, 'focus_position', m.position, 'visual_position', m.visual_position)))"
        ).alias("keyboard"),
    )


# What may look like a heading without being one, and how much it must stand out.
FAKE_HEADING_TAGS = ["p", "div", "span", "strong", "b", "td", "li"]
BIGGER, BOLDER, LONGEST, SENTENCE, SAME_LINE = 1.2, 600, 120, 45, 2


def heading_like(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Elements whose text and place allow an unmarked heading, each with its next sibling's selector. ``pages`` has ``dom``.

    Left out: what is inside a heading or a banner's link, hidden from assistive technology, an item of a list, longer than
    120 characters, a sentence, several clauses, fewer than two letters, more than one child, and whatever introduces nothing.
    """
    tags = ", ".join(f"'{t}'" for t in FAKE_HEADING_TAGS)
    leaf = (
        f"filter(dom.elements, e -> e.tag in ({tags}) and not e.in_heading and not e.banner_link and not e.aria_hidden and e.n_children <= 1"
        " and not (e.tag = 'li' and get(dom.elements, e.parent).tag in ('ul','ol','menu')))"
    )
    # the next sibling comes right after the subtree
    nxt = "get(dom.elements, e.last + 1)"
    listed = (
        f"transform({leaf}, e -> named_struct('pos', e.pos, 'selector', e.selector, 'text', coalesce(e.text, e.head), 'next_selector', if({nxt}.parent = e.parent, {nxt}.selector, null),"
        f" 'next_text', if({nxt}.parent = e.parent, coalesce({nxt}.text, {nxt}.head), null)))"
    )
    worded = (
        rf"x -> x.text <> '' and char_length(x.text) <= {LONGEST} and coalesce(x.next_text, '') <> '' and not (x.text rlike r'[.!?。]$' and char_length(x.text) > {SENTENCE})"
        r" and regexp_count(x.text, r'[,;:،]') < 2 and regexp_count(x.text, r'\p{L}') >= 2"
    )
    return pages.selectExpr(f"`{key}`", f"inline(filter({listed}, {worded}))").drop("next_text")


def fake_headings(pages: DataFrame, styles: DataFrame, key: str = "page_id") -> DataFrame:
    """Text styled as a heading above what it introduces, and not marked up as one.

    ``styles`` has a recorded row per element: key, selector, size, weight, base (the body's size), display, visible, top and
    bottom. An element without a row is not judged. Both joins are by page and selector, so neither a page nor a site is one task.
    """
    own = styles.select(key, "selector", "size", "weight", "base", "bottom", F.expr(f"visible and display not like 'inline%' and (size >= base * {BIGGER} or weight >= {BOLDER})").alias("_stands_out"))
    below = styles.select(key, F.col("selector").alias("next_selector"), F.col("top").alias("_next_top"))
    styled = heading_like(pages, key).join(own.where("_stands_out"), [key, "selector"]).join(below, [key, "next_selector"])
    return styled.where(f"_next_top >= bottom - {SAME_LINE}").select(key, "pos", "selector", "text", "size", "weight", "base")


def with_fake_headings(pages: DataFrame, styles: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages with the recorded column ``fake_headings``, in document order; empty where a page has none."""
    found = fake_headings(pages, styles, key).groupBy(key).agg(F.expr("array_sort(collect_list(struct(pos, selector, text, cast(size as double) as size, cast(weight as int) as weight, cast(base as double) as base)))").alias("_f"))
    shaped = "transform(coalesce(_f, array()), f -> named_struct('selector', f.selector, 'text', f.text, 'size', f.size, 'weight', f.weight, 'base', f.base))"
    return pages.join(found, key, "left").withColumn("fake_headings", F.expr(shaped)).drop("_f")
