"""Applicability probes (A0-A3): counts in, (applicable, reason) out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.operators.evidence import COUNTS

# probe -> (condition over the counts struct ``c``, reason when it does not hold)
PAGE_PROBES = {
    "always": ("true", ""),
    "hasImages": ("c.images > 0", "no images"),
    "hasLinkedImages": ("c.linkedImages > 0", "no images inside links"),
    "hasDecorativeCandidates": ("c.decorativeCandidates > 0", "no decorative images"),
    "hasComplexImages": ("c.complexImages > 0", "no complex images"),
    "hasEmbeddedMedia": ("c.embeddedMedia > 0", "no embedded media"),
    "hasAudioOnly": ("c.audioOnly > 0", "no audio"),
    "hasVideoOnly": ("c.videoElements > 0", "no video"),
    "hasVideoWithAudio": ("c.videoElements > 0", "no video"),
    "hasTimeBasedMedia": ("c.timeBasedMedia > 0", "no time-based media"),
    "hasCaptcha": ("c.captcha > 0", "no captcha"),
    "hasAutoplayAudio": ("c.autoplayAudio > 0", "no audio that starts by itself"),
    "hasHeadingsOrLists": ("c.headings > 0 or c.lists > 0", "no headings or lists"),
    "hasHeadingsOrLabels": ("c.headings > 0 or c.formControls > 0", "no headings or labels"),
    "hasTables": ("c.tables > 0", "no tables"),
    "hasSections": ("c.sections > 0 or c.textLength > 400", "no sections"),
    "hasForms": ("c.formControls > 0", "no form controls"),
    "hasFormsWithValidation": ("c.formControls > 0", "no form controls"),
    "hasHighStakesForm": ("c.highStakesForms > 0", "no legal or financial form"),
    "hasFocusableElements": ("c.focusable > 0", "nothing focusable"),
    "hasCustomWidgets": ("c.focusable > 0", "nothing focusable"),
    "hasLinks": ("c.links > 0", "no links"),
    "hasTimeLimit": ("c.timeLimits > 0", "no time limits"),
    "hasMovingContent": ("c.movingContent > 0", "no moving content"),
    "hasFlashingCandidates": ("c.flashCandidates > 0", "nothing that may flash"),
    "hasRepeatedBlocks": ("c.repeatedBlocks > 0 or c.links >= 5", "no repeated blocks"),
    "hasForeignLanguageParts": ("c.foreignRuns > 0", "no passages in another language"),
    "hasIframes": ("c.iframes > 0", "no frames"),
    "hasTextContent": ("c.textLength > 50", "no text"),
    "hasColorCodedContent": ("c.colourCoded > 0", "nothing distinguished by colour"),
    "hasSensoryInstructions": ("c.sensoryInstructions > 0", "no sensory instructions"),
    "hasTextImages": ("c.textImages > 0", "no images of text"),
    "isMultiPageSite": ("c.sitePageCount > 1", "one page only"),
}
DOCUMENT_PROBES = {
    "always": ("true", ""),
    "hasImages": ("c.images > 0", "no images"),
    "hasComplexImages": ("c.complexInfo > 0", "no complex information"),
    "hasHeadingsOrLists": ("c.headings > 0 or c.lists > 0 or c.paragraphs > 3", "no structure"),
    "hasTables": ("c.tables > 0", "no tables"),
    "hasLinks": ("c.links > 0", "no links"),
    "hasTextContent": ("c.textLength > 50", "no extractable text"),
    "hasColorCodedContent": ("c.colouredRuns > 0", "nothing distinguished by colour"),
    "hasSensoryInstructions": ("c.sensoryPhrases > 0", "no sensory instructions"),
    "hasTextImages": ("c.textImages > 0 or c.scannedPages > 0 or c.textLength < 50", "no images of text"),
}
PAGE_COUNT_KEYS = [*COUNTS, "sitePageCount"]
DOCUMENT_COUNT_KEYS = (
    "images headings lists tables links paragraphs textLength sensoryPhrases complexInfo scannedPages textImages colouredRuns contrastFailures"
).split()


def condition(probe: str, var: str = "counts", probes: dict = PAGE_PROBES) -> str:
    """A0: the boolean of one probe. An unknown probe raises instead of passing silently."""
    if probe not in probes:
        if probes is DOCUMENT_PROBES and probe in PAGE_PROBES:
            return "false"
        raise KeyError(f"unknown applicability probe {probe!r}")
    return probes[probe][0].replace("c.", f"{var}.")


def reason(probe: str, probes: dict = PAGE_PROBES) -> str:
    return probes.get(probe, ("", "does not apply to this kind of target"))[1]


def checked(var: str, keys: list[str] | None = None) -> str:
    """A1/A3 as an expression: the counts struct, or an error naming what is missing or not finite."""
    names = keys or PAGE_COUNT_KEYS
    bad = ", ".join(f"if({var}.{k} is null or isnan(cast({var}.{k} as double)), '{k}', null)" for k in names)
    listed = f"array_join(array_compact(array({bad})), ', ')"
    return f"if({var} is null or {listed} = '', {var}, raise_error(concat('evidence did not report these counts: ', {listed})))"


def checked_counts(df: DataFrame, var: str = "counts", keys: list[str] | None = None) -> DataFrame:
    """Every contract count must be a finite number; a missing one raises, it is never zero."""
    keys = keys or PAGE_COUNT_KEYS
    have = set(df.schema[var].dataType.fieldNames())
    absent = [k for k in keys if k not in have]
    if absent:
        raise ValueError(f"evidence did not report these counts: {', '.join(absent)}")
    return df.withColumn(var, F.expr(f"get(transform(array({var}), c -> {checked('c', keys)}), 0)"))


def count_violations(df: DataFrame, var: str = "counts", keys: list[str] | None = None) -> DataFrame:
    """The same contract as an audit: rows per key that break it."""
    keys = keys or PAGE_COUNT_KEYS
    stacked = ", ".join(f"'{k}', count_if({var}.{k} is null or isnan(cast({var}.{k} as double)))" for k in keys)
    return df.selectExpr(f"map({stacked}) as m").selectExpr("explode(m) as (key, violations)")


def probe_results(df: DataFrame, key: str, var: str = "counts", probes: dict = PAGE_PROBES) -> DataFrame:
    """One row per target and probe, produced in place from the counts row."""
    items = ", ".join(
        f"named_struct('probe', '{p}', 'applicable', {condition(p, var, probes)}, 'reason', if({condition(p, var, probes)}, null, '{reason(p, probes)}'))"
        for p in probes
    )
    return df.selectExpr(key, f"inline(array({items}))")
