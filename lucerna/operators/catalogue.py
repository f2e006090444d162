"""The catalogue of check rows and the operators on it (K1-K8)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Row ids, criteria, levels, methods, checker rule ids, rule ids, probes,
# evidence slices and effort classes. One row per line, in form order.
# id|criterion|level|method|checker rules|own rules|probe|slice|effort|name
ROWS = """
R04|1.1.1|A|hybrid|image-alt input-image-alt area-alt role-img-alt svg-img-alt object-alt server-side-image-map|hebrew-alt-text|hasImages|images|low|Text alternative for images
R05|1.1.1|A|hybrid|object-alt frame-title|embedded-media-name|hasEmbeddedMedia|media|low|Name for embedded media
R06|1.1.1|A|llm|||hasTimeBasedMedia|media|medium|Description of time-based media
R07|1.1.1|A|llm||captcha-detect|hasCaptcha|forms|high|Alternatives for captcha
R08|1.2.1|AA|llm|||hasAudioOnly|media|medium|Alternative for audio only
R09|1.2.1|AA|llm|||hasVideoOnly|media|medium|Alternative for video only
R10|1.2.2|AA|hybrid|video-caption|caption-track-present|hasVideoWithAudio|media|medium|Captions
R11|1.2.3|AA|llm|||hasVideoWithAudio|media|high|Audio description or text alternative
R12|1.2.5|AA|llm|||hasVideoWithAudio|media|high|Audio description
R13|1.3.1|A|hybrid|list listitem definition-list dlitem td-headers-attr th-has-data-cells scope-attr-valid td-has-header label form-field-multiple-labels select-name aria-required-children aria-required-parent empty-heading heading-order p-as-heading table-fake-caption landmark-one-main|fake-heading-detect landmark-coverage|hasTextContent|structure|medium|Structure and relationships
R14|1.3.1|A|hybrid||presentational-markup layout-table-detect|hasTextContent|structure|medium|Content apart from presentation
R15|1.3.2|A|hybrid||dom-visual-order-mismatch|hasTextContent|readingOrder|medium|Meaningful sequence
R16|1.3.3|A|llm|||hasSensoryInstructions|sensoryText|low|Sensory characteristics
R17|1.4.1|A|hybrid|link-in-text-block|color-only-meaning|hasColorCodedContent|colorUsage|low|Use of colour
R18|1.4.2|A|hybrid|no-autoplay-audio||hasAutoplayAudio|media|low|Audio control
R19|1.4.3|AA|auto|color-contrast||hasTextContent|contrast|low|Contrast
R20|1.4.4|AA|hybrid|meta-viewport|zoom-200-reflow|hasTextContent|contrast|medium|Text resize
R21|1.4.5|AA|llm||text-in-image-detect|hasTextImages|textImages|medium|Images of text
R22|2.1.1|A|hybrid|nested-interactive scrollable-region-focusable|keyboard-walk click-handler-no-keyboard|hasFocusableElements|keyboard|high|Keyboard operation
R23|2.1.2|A|auto||keyboard-trap|hasFocusableElements|keyboard|medium|No keyboard trap
R24|2.2.1|A|hybrid|meta-refresh|timeout-detect|hasTimeLimit|timing|medium|Adjustable timing
R25|2.2.2|A|hybrid|blink marquee|moving-content-detect|hasMovingContent|motion|medium|Pause, stop, hide
R26|2.3.1|A|hybrid|blink marquee|flash-candidates|hasFlashingCandidates|motion|low|Flashes
R27|2.4.1|A|hybrid|bypass region landmark-one-main|skip-link-functional|hasRepeatedBlocks|navigation|low|Bypass blocks
R28|2.4.2|A|hybrid|document-title|title-unique-across-site|always|navigation|low|Page titled
R29|2.4.3|A|hybrid|tabindex|focus-order-walk|hasFocusableElements|keyboard|medium|Focus order
R30|2.4.4|A|hybrid|link-name|generic-link-text|hasLinks|links|low|Link purpose
R31|2.4.5|AA|hybrid||multiple-ways-site|isMultiPageSite|siteConsistency|medium|Multiple ways
R32|2.4.6|AA|llm|empty-heading||hasHeadingsOrLabels|headingsLabels|low|Headings and labels
R33|2.4.7|AA|hybrid||focus-visible-check|hasFocusableElements|focusVisible|low|Focus visible
R34|2.4.10|AA|hybrid|heading-order empty-heading|section-heading-coverage|hasSections|structure|low|Section headings
R35|3.1.1|A|auto|html-has-lang html-lang-valid html-xml-lang-mismatch|hebrew-lang-dir|always|language|low|Language of page
R36|3.1.2|A|hybrid|valid-lang|foreign-language-run|hasForeignLanguageParts|language|low|Language of parts
R37|3.2.1|A|hybrid||context-change-on-focus|hasFocusableElements|keyboard|medium|On focus
R38|3.2.2|A|hybrid||context-change-on-input|hasForms|forms|medium|On input
R39|3.2.3|AA|hybrid||nav-consistency|isMultiPageSite|siteConsistency|low|Consistent navigation
R40|3.2.4|AA|hybrid||component-identity|isMultiPageSite|siteConsistency|low|Consistent identification
R41|3.3.1 / 3.3.3|A|hybrid|aria-valid-attr-value|error-announcement|hasFormsWithValidation|formErrors|medium|Error identification and suggestion
R42|3.3.2|A|hybrid|label form-field-multiple-labels select-name input-button-name aria-input-field-name aria-toggle-field-name label-title-only|placeholder-as-label|hasForms|forms|low|Labels or instructions
R43|3.3.4|AA|llm|||hasHighStakesForm|forms|high|Error prevention
R44|4.1.1|A|auto|duplicate-id duplicate-id-active duplicate-id-aria|markup-validity|always|markupValidity|low|Parsing
R45|4.1.2|A|hybrid|button-name link-name frame-title frame-title-unique aria-allowed-attr aria-allowed-role aria-command-name aria-hidden-body aria-hidden-focus aria-input-field-name aria-meter-name aria-progressbar-name aria-required-attr aria-roles aria-toggle-field-name aria-tooltip-name aria-valid-attr aria-valid-attr-value presentation-role-conflict|custom-widget-state|hasFocusableElements|ariaWidgets|medium|Name, role, value
D01|1.1.1|A|hybrid||doc-image-alt|hasImages|documentStructure|low|Text alternative for document images
D02|1.3.1|A|hybrid||doc-heading-structure|hasHeadingsOrLists|documentStructure|low|Document headings
D03|1.3.1|A|hybrid||doc-list-structure|hasHeadingsOrLists|documentStructure|low|Document lists
D04|1.3.2|A|hybrid||doc-reading-order|hasTextContent|documentStructure|medium|Document reading order
D05|1.3.3|A|llm|||hasSensoryInstructions|documentText|low|Document sensory wording
D06|1.4.1|A|llm||doc-color-only|hasColorCodedContent|documentText|low|Document use of colour
D07|1.4.3|AA|auto||doc-contrast|hasTextContent|documentText|low|Document contrast
D08|1.4.5|AA|hybrid||doc-scanned-detect doc-text-image|hasTextImages|documentText|high|Document images of text
D09|2.4.2|A|hybrid||doc-title|always|documentStructure|low|Document title
D10|2.4.4|A|llm|||hasLinks|documentText|low|Document link purpose
D11|2.4.6|AA|llm|||hasHeadingsOrLists|documentStructure|low|Document headings and labels
D12|5568-2/6|AA|llm||doc-complex-info|hasComplexImages|documentComplexInfo|high|Document complex information
IL01|IL-1|A|hybrid||accessibility-statement|always|siteConsistency|medium|Accessibility statement
IL02|IL-2|A|hybrid||coordinator-contact|always|siteConsistency|low|Coordinator contact
IL03|IL-3|A|hybrid||hebrew-lang-dir ltr-island-marked|hasTextContent|language|low|Direction and language
IL04|IL-4|A|hybrid||hebrew-ui-strings|hasTextContent|language|low|Interface strings in the page language
IL05|IL-5|A|hybrid||a11y-widget-present a11y-widget-keyboard overlay-antipattern|always|siteConsistency|high|Preferences widget
IL06|IL-6|A|hybrid||accessibility-notice-visible|always|siteConsistency|low|Visible accessibility notice
"""

CATALOGUE_VERSION = "2026.08.1"
EFFECTIVE_FROM = "2026-08-28"
PAGE = ("page",)
DOCUMENT_KINDS = ("pdf", "docx", "pptx", "xlsx", "txt")
OVERRIDE_LEVEL = {"R12": "AAA"}
CANCELLED = {"R36": "The standard cancels this criterion; it is listed but never assessed."}
# Provenance of the catalogue: id, authority tier, publication date, rows fed.
SOURCES = [
    ("commissioner-check-sheet", "binding", "2025-07-08", "R04-R45"),
    ("si-5568-1-2023", "binding", "2023-09", "R12, R36"),
    ("si-5568-2", "binding", "2020-06", "D01-D12"),
    ("service-accessibility-regulations", "binding", "2017-10-26", "IL01-IL06"),
]


@dataclass(frozen=True)
class Row:
    item_id: str
    criterion: str
    level: str
    method: str
    checker_rules: tuple[str, ...]
    own_rules: tuple[str, ...]
    probe: str
    slice: str
    effort: str
    name: str
    ordinal: int

    @property
    def part(self) -> str:
        return {"R": "1", "D": "2", "I": "IL"}[self.item_id[0]]

    @property
    def applies_to(self) -> tuple[str, ...]:
        return DOCUMENT_KINDS if self.part == "2" else PAGE

    @property
    def effective_level(self) -> str:
        return OVERRIDE_LEVEL.get(self.item_id, self.level)

    @property
    def cancelled(self) -> str | None:
        return CANCELLED.get(self.item_id)

    @property
    def needs_judgement(self) -> bool:
        return self.method in ("llm", "hybrid")


def _load() -> list[Row]:
    out = []
    for i, line in enumerate(ROWS.strip().splitlines()):
        a, b, c, d, e, f, g, h, j, k = line.split("|")
        out.append(Row(a, b, c, d, tuple(e.split()), tuple(f.split()), g, h, j, k, i))
    return out


CATALOGUE: list[Row] = _load()

SCHEMA = (
    "item_id string, criterion string, level string, effective_level string, method string, checker_rules array<string>, "
    "own_rules array<string>, probe string, slice string, effort string, name string, part string, applies_to array<string>, "
    "cancelled_reason string, ordinal int"
)


def rows_for(kind: str, level: str = "AA") -> list[Row]:
    """K1-K2 on the driver side: the fixed rows that apply to a target kind at a level."""
    wanted = {"A": ("A",), "AA": ("A", "AA")}[level]
    return [r for r in CATALOGUE if kind in r.applies_to and r.effective_level in wanted]


def catalogue_df(spark: SparkSession) -> DataFrame:
    """Sixty fixed rows; their size bound makes broadcasting them safe."""
    data = [
        (r.item_id, r.criterion, r.level, r.effective_level, r.method, list(r.checker_rules), list(r.own_rules), r.probe, r.slice,
         r.effort, r.name, r.part, list(r.applies_to), r.cancelled, r.ordinal)
        for r in CATALOGUE
    ]
    return spark.createDataFrame(data, SCHEMA)


def sources_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "source_id string, authority string, published string, feeds string")


def expand(targets: DataFrame, kind_col: str = "kind", level: str = "AA") -> DataFrame:
    """K1: every target times the rows for its kind. The catalogue is the fixed, broadcast side."""
    cat = level_filter(catalogue_df(targets.sparkSession), level).withColumn(kind_col, F.explode("applies_to"))
    return targets.join(F.broadcast(cat), kind_col)


def level_filter(catalogue: DataFrame, level: str) -> DataFrame:
    """K2: AAA is never reported; AA takes A and AA; A takes A."""
    return catalogue.where(F.col("effective_level").isin(["A", "AA"] if level == "AA" else ["A"]))


def checker_map(spark: SparkSession) -> DataFrame:
    """K5: checker rule -> rows it decides, with the position of the row."""
    return catalogue_df(spark).select(F.explode("checker_rules").alias("rule_id"), "item_id", "ordinal")


def unknown_checker_rules(spark: SparkSession, known: DataFrame) -> DataFrame:
    """Rules the catalogue names and the installed checker lacks (``known`` has ``rule_id``)."""
    return checker_map(spark).join(known, "rule_id", "left_anti").select("rule_id").distinct()


def assert_known_rules(mapping: DataFrame, known: DataFrame) -> DataFrame:
    """K5 strict: pass the mapping through, raise on a rule the checker does not have."""
    hit = known.select("rule_id", F.lit(True).alias("known"))
    return (
        mapping.join(F.broadcast(hit), "rule_id", "left")
        .withColumn("rule_id", F.expr("if(known, rule_id, raise_error(concat('unknown checker rule ', rule_id)))"))
        .drop("known")
    )


def lint(form_rows: DataFrame, engine_rows: DataFrame) -> DataFrame:
    """K6: rows on one side only; both inputs carry ``item_id``."""
    a = form_rows.join(engine_rows, "item_id", "left_anti").select("item_id", F.lit("no engine mapping").alias("problem"))
    b = engine_rows.join(form_rows, "item_id", "left_anti").select("item_id", F.lit("no form row").alias("problem"))
    return a.unionByName(b)


def normalise_criterion(raw: Column) -> Column:
    """K7: keep every dotted number of a form cell, joined by `` / ``."""
    nums = F.regexp_extract_all(raw, F.lit(r"(\d+(?:\.\d+)+)"), 1)
    return F.when(F.size(nums) > 0, F.array_join(nums, " / ")).otherwise(F.trim(raw))


def guideline_short(raw: Column) -> Column:
    return F.trim(F.split_part(raw, F.lit(":"), F.lit(1)))


def parse_level(raw: Column) -> Column:
    v = F.upper(F.trim(raw))
    return F.when(v.isin("A", "AA"), v).otherwise(F.raise_error(F.concat(F.lit("unexpected level "), F.coalesce(raw, F.lit("NULL")))))


def lookup(catalogue: DataFrame, text: str) -> DataFrame:
    """K8: rows whose criterion contains the text."""
    return catalogue.where(F.col("criterion").contains(text))
