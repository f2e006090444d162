"""Quality rules at the level of hosts.

Each document is measured once and tested against rules. Failures are counted per host (the ``source`` column), and a
host's failure rate of each rule is shrunk towards the rate of all hosts by a beta prior fitted to the spread of the
hosts' rates (method of moments): a host of few documents is judged mostly by the others, one of many by its own.

Verdicts go back to the documents. A host most of whose documents fail some rule loses all of them. Elsewhere a document
that fails a rule is rejected, unless such failures are so rare on its host that they are more likely false alarms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucerna.llm.base import join_sources, pick, process_cache, query, ship, staged, table

ship(__name__)

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
BAD_HOST = 0.5
TRUSTED = 0.01
NO_SPREAD = 1e6
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters"]

# rule -> condition on the measures; the same text runs in any SQL engine
RULES = {
    "base_failed": "n_words < 10 OR 100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "capitals": "2 * n_upper > n_letters",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more in the list, first bearers included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    word = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    suspects = np.union1d(order[1:][same], order[:-1][same]).tolist()
    count = Counter(tuple(words[i : i + window]) for i in suspects)  # the words themselves decide
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for i in suspects:
        if count[tuple(words[i : i + window])] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


def _measure(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    octet = np.frombuffer(raw, dtype=np.uint8)
    letter = np.count_nonzero((octet | 32) - np.uint8(97) < 26)
    upper = np.count_nonzero(octet - np.uint8(65) < 26)
    chars = sum(map(len, words)) - (0 if raw.isascii() else int(np.count_nonzero((octet & 0xC0) == 0x80)))
    return len(words), chars, sum(raw.count(s) for s in SYMBOLS), len(lines), len(lines) - len(set(lines)), repeated_words(words), int(upper), int(letter)


def measured(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (without the text unless ``keep_text``) and MEASURES. Narrow."""
    kept = [f for f in docs.schema.fields if (keep_text or f.name != text_col) and f.name not in MEASURES]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_cache("rules")
        for batch in batches:
            rows = [_measure(t.as_py()) for t in batch.column(text_col)]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], [*names, *MEASURES])

    return docs.mapInArrow(run, T.StructType([*kept, *(T.StructField(m, T.LongType()) for m in MEASURES)]))


def fails() -> dict[str, Column]:
    return {name: F.expr(condition) for name, condition in RULES.items()}


def host_rates(rows: DataFrame, host_col: str = "source") -> DataFrame:
    """Per host: documents, failures and shrunk rate ``rate_<rule>`` of each rule and of ``any``."""
    rules = fails()
    rules["any"] = F.expr(" OR ".join(f"({c})" for c in RULES.values()))
    hosts = staged(rows.groupBy(host_col).agg(F.count(F.lit(1)).alias("docs"), *[F.count_if(c).alias(f"fail_{r}") for r, c in rules.items()]), "hosts")
    raw = {r: F.col(f"fail_{r}") / F.col("docs") for r in rules}
    sums = hosts.agg(
        F.sum("docs").alias("docs"), F.avg(1 / F.col("docs")).alias("inverse"),
        *[f(c).alias(f"{n}_{r}") for r in rules for n, f, c in (("fail", F.sum, F.col(f"fail_{r}")), ("mean", F.avg, raw[r]), ("square", F.avg, raw[r] * raw[r]))],
    ).first()
    for r in rules:
        if not sums["docs"]:
            hosts = hosts.withColumn(f"rate_{r}", F.lit(0.0))
            continue
        mu = sums[f"fail_{r}"] / sums["docs"]
        between = sums[f"square_{r}"] - 2 * mu * sums[f"mean_{r}"] + mu * mu - mu * (1 - mu) * sums["inverse"]
        strength = max(mu * (1 - mu) / between - 1, 0.0) if between > 1e-12 else NO_SPREAD
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"fail_{r}") + F.lit(strength * mu)) / (F.col("docs") + F.lit(strength)))
    return hosts


def judged(rows: DataFrame, host_col: str = "source", bad_host: float = BAD_HOST, trusted: float = TRUSTED) -> DataFrame:
    """Adds ``base_failed``, ``host_failed`` and ``kept`` to measured rows."""
    hosts = host_rates(rows, host_col)
    verdicts = hosts.select(host_col, (F.col("rate_any") > bad_host).alias("host_failed"), *[(F.col(f"rate_{r}") >= trusted).alias(f"_strict_{r}") for r in RULES])
    joined = join_sources(rows, verdicts, [host_col], F.xxhash64("n_words", "word_chars"))
    rejected = F.col("base_failed") | F.col("host_failed")
    for r, failed in fails().items():
        rejected = rejected | (failed & F.col(f"_strict_{r}"))
    return joined.withColumn("base_failed", F.expr(RULES["base_failed"])).withColumn("kept", ~rejected).drop(*[f"_strict_{r}" for r in RULES])


def document_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, MEASURES, base_failed, host_failed, kept of every row.

    A null text has no words and so fails. Null is a host of its own. Rows that repeat are counted and returned each; a
    null id is kept as it is; other columns are ignored. An empty table gives no rows.
    """
    return judged(staged(measured(pick(docs, doc_id=id_col, source=host_col, text=text_col)), "measures"), "source")


def filter_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns. Texts are not shuffled unless hosts are very many."""
    table_ = staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"), F.col(host_col).alias("source")).transform(lambda d: measured(d)), "measures")
    return judged(table_, "source").where("kept").select("row.*")


def _sql() -> str:
    rates, priors = [], []
    rules = {**RULES, "any": " OR ".join(f"({c})" for c in RULES.values())}
    counts = ", ".join(f"count(*) FILTER (WHERE {c}) AS fail_{r}" for r, c in rules.items())
    for r in rules:
        p = f"(fail_{r} / docs)"
        priors.append(f"sum(fail_{r}) / sum(docs) AS mu_{r}, avg({p} * {p}) - 2 * (sum(fail_{r}) / sum(docs)) * avg({p}) AS part_{r}")
        between = f"(part_{r} + mu_{r} * mu_{r} - mu_{r} * (1 - mu_{r}) * inverse)"
        strength = f"(CASE WHEN {between} > 1e-12 THEN greatest(mu_{r} * (1 - mu_{r}) / {between} - 1, 0) ELSE {NO_SPREAD} END)"
        rates.append(f"(fail_{r} + {strength} * mu_{r}) / (docs + {strength}) AS rate_{r}")
    strict = " OR ".join(f"(({c}) AND rate_{r} >= {TRUSTED})" for r, c in RULES.items())
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d)),
g AS (SELECT doc_id, p, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS gram, lead(w, 4) OVER o AS fifth FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
again AS (SELECT doc_id, p FROM g WHERE fifth IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM again, unnest([0, 1, 2, 3, 4]) AS u(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS n_letters
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
),
h AS (SELECT source, count(*) AS docs, {counts} FROM m GROUP BY source),
prior AS (SELECT avg(1 / docs) AS inverse, {', '.join(priors)} FROM h),
v AS (SELECT source, {', '.join(rates)} FROM h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({RULES['base_failed']}) AS base_failed,
  NOT (({RULES['base_failed']}) OR rate_any > {BAD_HOST} OR {strict}) AS kept
FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source"""


@query("op2_host_quality", _sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_verdicts(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
