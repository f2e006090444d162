"""Token counts of fields or sections by offset mapping.

A whole document is encoded once. Every token has a span of characters; spans are joined to the sections' intervals by
their ends (both are sorted, so this is a binary search), and counted. A token that crosses a boundary goes, by rule,
to the section that holds most of its characters (``largest``, ties to the earlier), the ``first`` or the ``last``. Counts
of a document's sections, with the row for what lies in no section, add up to its token count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lucerna.llm import tokens
from lucerna.llm.base import pick, query, ship, table

ship(__name__)

RULES = ("largest", "first", "last")
COUNTS = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def line_sections(text: str) -> list[tuple[int, int]]:
    """Each line with its line end is a section."""
    out, at = [], 0
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        if end > at:
            out.append((at, end))
        at = end
    return out


def apart(spans: list[tuple[int | None, int | None]], length: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Spans in order and free of overlaps, with their numbers: a character that several cover is the earliest one's.

    Spans are cut to the text; a span without a start or an end covers nothing.
    """
    order = sorted((k for k, (a, b) in enumerate(spans) if a is not None and b is not None), key=lambda k: (spans[k][0], k))
    out, at = [], 0
    for k in order:
        a = min(max(spans[k][0], at), length)
        b = max(a, min(spans[k][1], length))
        out.append((a, b))
        at = max(at, b)
    return order, out


def char_spans(text: str, byte_length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and character after the last of every token; a token of part of a character's bytes covers it."""
    end = np.cumsum(byte_length)
    start = end - byte_length
    if text.isascii():
        return start, end
    octets = np.frombuffer(text.encode(), dtype=np.uint8)
    char = np.cumsum((octets & 0xC0) != 0x80) - 1
    return char[start], char[end - 1] + 1


def attribute(start: np.ndarray, end: np.ndarray, sections: list[tuple[int, int]], rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross its boundary; the last entry is for tokens in no section.

    Sections are sorted and do not overlap; they may leave gaps and be empty.
    """
    k = len(sections)
    n = np.zeros(k + 1, dtype=np.int64)
    crossing = np.zeros(k + 1, dtype=np.int64)
    if not k:
        n[k] = len(start)
        return n, crossing
    left = np.array([a for a, _ in sections])
    right = np.array([b for _, b in sections])
    first = np.searchsorted(right, start, side="right")  # the first section that ends after the token starts
    last = np.searchsorted(left, end, side="left") - 1  # the last one that starts before it ends
    inside = (first == last) & (left[np.minimum(first, k - 1)] <= start) & (end <= right[np.minimum(first, k - 1)])
    n[:k] += np.bincount(first[inside], minlength=k)[:k]
    for t in np.flatnonzero(~inside):
        met = [(min(end[t], right[s]) - max(start[t], left[s]), s) for s in range(first[t], last[t] + 1)]
        met = [(share, s) for share, s in met if share > 0]
        if not met:
            n[k] += 1
            continue
        s = met[0][1] if rule == "first" else met[-1][1] if rule == "last" else max(met, key=lambda x: (x[0], -x[1]))[1]
        n[s] += 1
        crossing[s] += 1
    return n, crossing


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None, rule: str = "largest", tokenizer: str = tokens.TOKENIZER, chunk: int = 4_000_000) -> DataFrame:
    """Rows (doc_id, section, start, end, n_tokens, n_crossing) of all sections of all documents; a narrow pass.

    ``spans_col`` names an array of structs (start, end) of character offsets; without it the lines are the sections. Section
    numbers follow the array, in any order. Where spans overlap, the earliest keeps the characters; null spans, and those
    without a start or an end, hold no tokens. Section -1 holds tokens outside all sections, where there
    are any, and stands for the whole of a null or empty text or one without sections (with 0 tokens where it has none),
    so every document has a row. Null ids are kept, repeated rows counted each, other columns ignored. An empty table
    gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    columns = {"doc_id": id_col, "text": text_col} | ({"spans": spans_col} if spans_col else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            for part in tokens.slices(batch, "text", chunk):
                flat, at = encoder.ids_of(part.column("text"))
                length = encoder.byte_length[flat]
                out: list[list] = [[], [], [], [], [], []]
                spans = part.column("spans").to_pylist() if spans_col else [None] * part.num_rows
                for i, (doc_id, text) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text"))):
                    text = text.as_py() or ""
                    sections = [(s["start"], s["end"]) if s else (None, None) for s in spans[i] or []] if spans_col else line_sections(text)
                    start, end = char_spans(text, length[at[i] : at[i + 1]])
                    n, crossing = np.zeros((2, len(sections) + 1), dtype=np.int64)
                    order, clear = apart(sections, len(text))
                    counted = attribute(start, end, clear, rule)
                    n[[*order, -1]], crossing[[*order, -1]] = counted
                    keep = len(sections) + (1 if n[-1] or not sections else 0)
                    out[0] += [doc_id] * keep
                    out[1] += [*range(len(sections)), -1][:keep]
                    out[2] += [*(a for a, _ in sections), 0][:keep]
                    out[3] += [*(b for _, b in sections), len(text)][:keep]
                    out[4] += n.tolist()[:keep]
                    out[5] += crossing.tolist()[:keep]
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], [c.split()[0] for c in COUNTS.split(", ")])

    return pick(docs, **columns).mapInArrow(run, COUNTS)


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
