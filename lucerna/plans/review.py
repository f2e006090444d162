"""The review: pages -> elements -> evidence -> rules -> site context -> verdicts -> rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions import urls as U
from lucerna.functions.html import with_dom
from lucerna.operators import site as S
from lucerna.operators.catalogue import CATALOGUE_VERSION, Row, rows_for
from lucerna.operators.evidence import RECORDED, template_hash, with_evidence, words_of
from lucerna.operators.page_rules import PAGE_RULES, rule_sql, with_site_defaults
from lucerna.operators.skew import ensure_parallelism
from lucerna.operators.verdict import evaluate_pages
from lucerna.plans.materialize import materialize

# rules that read facts of other pages; the rest are finished in the parsing stage
SITE_RULES = ["accessibility-statement", "coordinator-contact", "title-unique-across-site", "multiple-ways-site", "nav-consistency", "component-identity"]
SITE_BY_DOMAIN = U.registrable_domain(U.host("url"))
SITE_BY_HOST = U.host("url")
# what one page tells the site step; everything else of a page stays where it was computed
SITE_INPUTS = (
    "page_id url site crawl_order load_error is_dom title lang site_name counts nav_seq components statement_flags statement_ref statement_links "
    "search_mechanisms sitemap_links breadcrumbs"
).split()
COMPACT = [*SITE_INPUTS, "checker", "keyboard", "timers", "template_hash"]
PROFILE = ["public_authority", "turnover", "edits_video", "before_2017"]
CONTENT = "content"  # digest of what a page's facts follow from
_COLLECTED = set(SITE_INPUTS + ["skeleton", "links", "widgets", "icon_buttons", "navs"])


def prepare(pages: DataFrame) -> DataFrame:
    """Fill the optional columns of a page table: crawl order and load error."""
    have = set(pages.columns)
    if "crawl_order" not in have:
        pages = pages.withColumn("crawl_order", F.col("page_id"))
    if "load_error" not in have:
        pages = pages.withColumn("load_error", F.expr("if(html is null, 'no content', null)"))
    return pages


def parsed(pages: DataFrame) -> DataFrame:
    return with_dom(ensure_parallelism(prepare(pages), "page_id"))


def evidence(pages: DataFrame, need: set[str] | None = None) -> DataFrame:
    """Evidence of every page, or only the wanted collectors: one narrow pass."""
    return with_evidence(parsed(pages), need)


def rules_of(items: list[str] | None, level: str) -> list[str]:
    rows = [r for r in rows_for("page", level) if items is None or r.item_id in items]
    return [r for r in PAGE_RULES if any(r in row.own_rules for row in rows)]


def needs_site(row: Row) -> bool:
    return row.probe == "isMultiPageSite" or any(r in SITE_RULES for r in row.own_rules)


def page_facts(pages: DataFrame, rules: list[str] | None = None, site_sql: str = SITE_BY_DOMAIN) -> DataFrame:
    """Everything one page can tell on its own, HTML dropped: the compact table between the two stages."""
    rules = list(PAGE_RULES) if rules is None else rules
    own = [r for r in rules if r not in SITE_RULES]
    need = _COLLECTED | words_of(*(PAGE_RULES[r] for r in own))
    ev = S.page_inputs(with_site_defaults(evidence(pages, need)).drop("components", "nav_seq"), site_sql)
    ev = ev.withColumns({"template_hash": template_hash(), **{f"rule:{r}": F.expr(rule_sql(r)) for r in own}})
    extra = [c for c in [*PROFILE, CONTENT] if c in ev.columns]
    return ev.select(*COMPACT, *extra, *[f"`rule:{r}`" for r in own])


def _narrow(facts: DataFrame, rows: list[Row]) -> DataFrame:
    """The columns the site rows read; checker results cut down to the rules of those rows."""
    wanted = ", ".join(f"'{c}'" for r in rows for c in r.checker_rules) or "''"
    checker = (
        f"if(checker is null, null, named_struct('violations', filter(checker.violations, v -> v.id in ({wanted})), 'incomplete', filter(checker.incomplete, v -> v.id in ({wanted})))) as checker"
    )
    return facts.selectExpr(*SITE_INPUTS, checker, *[c for c in PROFILE if c in facts.columns])


def review(
    pages: DataFrame,
    level: str = "AA",
    use_ai: bool = False,
    items: list[str] | None = None,
    site_sql: str = SITE_BY_DOMAIN,
    rows_per_slice: int = 500_000,
) -> DataFrame:
    """One row per page and catalogue row. HTML is read and parsed exactly once.

    Rows decided by the page alone are evaluated without any shuffle. Only the rows that compare pages go
    through the site step, and they take a narrow projection of the page facts with them.
    """
    facts = materialize(page_facts(pages, rules_of(items, level), site_sql), "page-facts")
    return verdicts(facts, level, use_ai, items, rows_per_slice)


def verdicts(facts: DataFrame, level: str = "AA", use_ai: bool = False, items: list[str] | None = None, rows_per_slice: int = 500_000) -> DataFrame:
    """The review of written page facts."""
    rows = [r for r in rows_for("page", level) if items is None or r.item_id in items]
    alone, across = [r for r in rows if not needs_site(r)], [r for r in rows if needs_site(r)]
    parts = []
    if alone:
        parts.append(evaluate_pages(facts, level, use_ai, [r.item_id for r in alone]))
    if across:
        context = with_site_defaults(S.with_site_context(_narrow(facts, across), rows_per_slice))
        used = [x for r in across for x in r.own_rules]
        context = context.withColumns({f"rule:{x}": F.expr(rule_sql(x)) for x in used}).withColumns(
            {n: F.lit(None).cast(RECORDED[n]) for n in ("keyboard", "timers") if n not in context.columns}
        )
        parts.append(evaluate_pages(context, level, use_ai, [r.item_id for r in across]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def with_content(pages: DataFrame) -> DataFrame:
    """Adds the digest of all columns of a page but its id and its place in the crawl; HTML and every recorded fact count."""
    rest = [c for c in pages.columns if c not in ("page_id", "crawl_order", "html", CONTENT)]
    return pages.withColumn(CONTENT, F.sha2(F.concat_ws("\x00", F.lit(CATALOGUE_VERSION), F.coalesce(F.concat(F.lit("h"), F.col("html")), F.lit("n")), F.to_json(F.struct(*rest))), 256))


def kept_facts(pages: DataFrame, level: str = "AA", items: list[str] | None = None, site_sql: str = SITE_BY_DOMAIN) -> DataFrame:
    """Written page facts with the digest of each page: what a later review takes over where nothing changed."""
    return materialize(page_facts(with_content(prepare(pages)), rules_of(items, level), site_sql), "page-facts")


def facts_after(pages: DataFrame, kept: DataFrame, level: str = "AA", items: list[str] | None = None, site_sql: str = SITE_BY_DOMAIN) -> DataFrame:
    """Facts of ``pages`` where only pages whose digest is not in ``kept`` are parsed and evaluated.

    ``kept`` must come from ``kept_facts`` with the same level, items and site rule. The digest holds the URL, the catalogue
    version and all evidence, so a fact that could differ is never taken over; a page's id and crawl order are its own.
    Only digests are joined with the facts; HTML goes no further than the evaluation of what changed.
    """
    marked = with_content(prepare(pages))
    ids = materialize(marked.select("page_id", "crawl_order", CONTENT), "digests")
    old = kept.dropDuplicates([CONTENT]).drop("page_id", "crawl_order")
    same = ids.join(old, CONTENT)
    changed = ids.join(old.select(CONTENT), CONTENT, "left_anti").select("page_id")
    fresh = page_facts(marked.join(materialize(changed, "changed"), "page_id", "left_semi"), rules_of(items, level), site_sql)
    return materialize(fresh.unionByName(same.select(*fresh.columns)), "page-facts")


def review_changes(pages: DataFrame, kept: DataFrame, level: str = "AA", use_ai: bool = False, items: list[str] | None = None, site_sql: str = SITE_BY_DOMAIN, rows_per_slice: int = 500_000) -> DataFrame:
    """The review of ``pages``, equal to ``review``, at the cost of the pages that changed since ``kept``."""
    return verdicts(facts_after(pages, kept, level, items, site_sql), level, use_ai, items, rows_per_slice)
