"""Removal of later repeats of runs of words: winnowed fingerprints, joined positions, matches extended both ways.

A run is a sequence of at least ``min_words`` consecutive words, wherever in its lines it starts and ends; white space counts
for nothing. Of every window of ``min_words`` words the smallest hash of the word groups of half its length is its
fingerprint. The windows that chose one place follow each other; the words they cover are the stretch of that place, up to
a group to its left and to its right, and the stretches of a text hold each of its windows once. Places meet on their
fingerprint. Equal stretches match as a whole, and all bearers but the first lose theirs. Where a fingerprint stands in
unequal stretches, as at the ends of a repeated passage, the first bearer of each is extended to both sides window by window.
A window and its repeats have the same fingerprint, so no repeat is missed whichever document bears it first, and a word
goes if a window that holds it came earlier: a longer repeat goes in full, except in the document of the smallest id. A line
that loses all its words goes with its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucerna.llm.base import Stage, pick, process_cache, query, ship, staged, table
from lucerna.operators.skew import join_on_hot_key

ship(__name__)

MIN_WORDS = 50
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept by the worker."""
    kept = process_cache("lines")
    if len(kept.get("power", ())) < n:
        power, back = np.ones((2, max(n, 1 << 17)), dtype=np.uint64)
        power[1:], back[1:] = _BASE, _BACK
        kept["power"], kept["back"] = np.cumprod(power), np.cumprod(back)
    return kept["power"][:n], kept["back"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of values times powers; the hash of ``values[i:j]`` follows from them and the inverse powers."""
    power, back = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[:-1], out=total[1:])
    return total, back


def slabs(texts: pa.Array, at_once: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Neighbouring texts of a batch as one array of about so many bytes, or one text that is longer: the place of the first,
    the bytes, and where each text begins in them (and the last ends). A null text has no bytes."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    k = 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + at_once, "right")) - 1)
        yield k, data[offsets[k] : offsets[end]], offsets[k : end + 1].astype(np.int64) - offsets[k]
        k = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts that follow each other start and end, in bytes."""
    word = (data != 32) & (data - np.uint8(9) > 4)
    begin, finish = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    finish[:-1] &= ~word[1:]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    begin[borders], finish[borders - 1] = word[borders], word[borders - 1]
    return np.flatnonzero(begin), np.flatnonzero(finish) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at_once: int = 1 << 15) -> np.ndarray:
    """The hash of every word; so many words at once."""
    found = np.zeros(len(starts), dtype=np.uint64)
    for k in range(0, len(starts), at_once):
        first, last = starts[k : k + at_once], ends[k : k + at_once]
        base = first[0]
        total, back = sums(data[base : last[-1]].astype(np.uint64) + np.uint64(1))
        found[k : k + at_once] = mixed(mixed((total[last - base] - total[first - base]) * back[first - base]))
    return found


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of texts that follow each other, and the number of words before each text (and after the last)."""
    starts, ends = word_spans(data, offsets)
    return word_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def group_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every group of so many consecutive words."""
    total, back = sums(words)
    return mixed((total[size:] - total[:-size]) * back[: len(words) - size + 1])


def smallest(groups: np.ndarray, width: int) -> np.ndarray:
    """The place of the last smallest of every ``width`` consecutive group hashes, by doubling."""
    value, place, size = groups, np.arange(len(groups), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        later = value[step:] <= value[:-step]
        value = np.minimum(value[step:], value[:-step])
        place = np.where(later, place[step:], place[:-step])
        size += step
    return place


def repeats(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For every value whether its owner had it before."""
    again = np.ones(len(values), dtype=bool)
    again[np.unique(values + mixed(owner.astype(np.uint64) * _MIX), return_index=True)[1]] = False
    return again


def batch_of(batch: pa.RecordBatch, owner: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """Rows of the texts at ``owner``, with their document's id and mark; hashes become signed."""
    at = pa.array(owner)
    own = {"doc_id": batch.column("doc_id").cast(pa.int64()).take(at), "mark": batch.column("mark").take(at)}
    new = {name: pa.array(x.view(np.int64) if x.dtype == np.uint64 else x if x.dtype == bool else x.astype(np.int32)) for name, x in columns.items()}
    return pa.RecordBatch.from_pydict(own | new)


def stretches(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Of (doc_id, mark, text): the places of fingerprints. ``low``: the fingerprint; ``whole``: the hash of its stretch;
    ``first``, ``n``: the windows of the stretch; ``again``: the stretch came earlier in this text."""
    half = (min_words + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data, offsets in slabs(batch.column("text")):
                words, before = words_of(data, offsets)
                if len(words) < min_words:
                    continue
                owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
                windows = np.flatnonzero(owner[: len(words) - min_words + 1] == owner[min_words - 1 :])
                if not len(windows):
                    continue
                groups = group_hashes(words, half)
                chosen = smallest(groups, min_words - half + 1)[windows]
                at = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])  # texts have places of their own
                n, first = np.diff(np.append(at, len(chosen))), windows[at]
                total, back = sums(words)
                whole = mixed((total[first + n + min_words - 1] - total[first]) * back[first] + n.astype(np.uint64) * _MIX)
                text = owner[first]
                yield batch_of(batch, text + k, low=groups[chosen[at]], whole=whole, first=first - before[text], n=n, again=repeats(text, whole))

    return docs.mapInArrow(run, "doc_id long, mark long, low long, whole long, first int, n int, again boolean")


def extended(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Of (doc_id, mark, text, ends): the windows of the stretches ``ends``; ``again``: it came earlier in this text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ends")
            for k, data, offsets in slabs(batch.column("text")):
                words, before = words_of(data, offsets)
                ends = lists.slice(k, len(before) - 1)
                base = np.repeat(before[:-1], pc.list_value_length(ends).to_numpy(zero_copy_only=False))
                first, n = (ends.flatten().field(name).to_numpy(zero_copy_only=False) for name in ("first", "n"))
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, base + first, 1)
                np.add.at(change, base + first + n, -1)
                places = np.flatnonzero(np.cumsum(change) > 0)
                win = group_hashes(words, min_words)[places]
                text = np.searchsorted(before, places, "right") - 1
                yield batch_of(batch, text + k, win=win, first=places - before[text], again=repeats(text, win))

    return docs.mapInArrow(run, "doc_id long, mark long, win long, first int, again boolean")


def repeated_stretches(texts: DataFrame, min_words: int, rows_per_slice: int) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, mark, text): the (doc_id, mark, first, n) whose stretch came earlier as a whole, and those that came first
    but share their fingerprint with unequal ones."""
    kept = Stage(stretches(texts, min_words), "stretches")
    twice = kept.df.groupBy("low").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    met = staged(join_on_hot_key(kept.df, staged(twice, "twice"), ["low"], "rows", "doc_id", how="inner", rows_per_slice=rows_per_slice), "met")
    kept.drop()
    fresh = met.where("not again")
    bearers = staged(fresh.groupBy("low", "whole").agg(F.min("doc_id").alias("bearer"), F.count(F.lit(1)).alias("rows")), "bearers")
    unequal = bearers.groupBy("low").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    several = join_on_hot_key(bearers, unequal.withColumn("unequal", F.lit(True)), ["low"], "kinds", "whole", how="left", rows_per_slice=rows_per_slice)
    of_place = several.where("rows > 1 or unequal").withColumnRenamed("rows", "weight")
    judged = staged(join_on_hot_key(fresh, of_place, ["low", "whole"], "weight", "doc_id", how="inner", rows_per_slice=rows_per_slice), "judged")
    place = ["doc_id", "mark", "first", "n"]
    gone = judged.where("doc_id > bearer").select(*place).union(met.where("again").select(*place))
    return gone, judged.where("doc_id = bearer and unequal").select(*place)


def repeated_windows(marks: DataFrame, rows_per_slice: int = 500_000) -> DataFrame:
    """(doc_id, mark, first) of windows that an earlier document, or this one earlier, bears too."""
    fresh = marks.where("not again")
    bearers = fresh.groupBy("win").agg(F.min("doc_id").alias("bearer"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = join_on_hot_key(fresh, staged(bearers, "bearers"), ["win"], "n", "doc_id", how="inner", rows_per_slice=rows_per_slice).where("doc_id > bearer")
    return met.select("doc_id", "mark", "first").union(marks.where("again").select("doc_id", "mark", "first"))


def cut_words(text: str, first: np.ndarray, n: np.ndarray, min_words: int) -> tuple[str, int, int]:
    """The text without the ``n`` windows from each of ``first`` on, and how many lines went whole and how many words went."""
    data = text.encode()
    values = np.frombuffer(data, dtype=np.uint8)
    starts, ends = word_spans(values, np.array([0, len(data)]))
    change = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + n + min_words - 1, -1)
    lost = np.cumsum(change)[:-1] > 0
    before = np.concatenate([[0], np.cumsum(lost)])
    line_ends = np.append(np.flatnonzero(values == 10), len(data))
    last_words = np.searchsorted(starts, line_ends)
    kept, lines, at, begin = [], 0, 0, 0
    for end, word in zip(line_ends.tolist(), last_words.tolist(), strict=True):
        n_lost = int(before[word] - before[begin])
        if begin == word:
            if not (0 < word < len(lost) and lost[word - 1] and lost[word]):  # blank lines inside a run go with it
                kept.append(data[at:end])
        elif n_lost == word - begin:
            lines += 1
        elif n_lost == 0:
            kept.append(data[at:end])
        else:
            own, here, parts = lost[begin:word], at, []
            own_starts, own_ends, last = starts[begin:word].tolist(), ends[begin:word].tolist(), int(np.flatnonzero(~own)[-1])
            for k in np.flatnonzero(own[:last]).tolist():  # with the white space after it
                parts.append(data[here : own_starts[k]])
                here = own_starts[k + 1]
            parts += [data[here : own_ends[last]], data[own_ends[-1] : end]]
            kept.append(b"".join(parts))
        at, begin = end + 1, word
    return b"\n".join(kept).decode(), lines, int(before[-1])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, rows_per_slice: int = 500_000) -> DataFrame:
    """All columns of ``docs`` with later repeated runs cut from the text, and ``removed_lines``
    (those gone whole) and ``removed_words`` (long).

    Between documents the smallest id keeps a run, within one its first place does (repeats may overlap, as in a line that
    follows itself). A null text stays null, a text without repeats stays byte for byte. A text that is all repeats becomes
    empty. A row without an id takes no part and stays as it is. Rows that share an id count as one bearer, and
    spans are joined back by id and hash of the text: neither loses what only the other has. A column named like one of the
    two new ones is replaced. An empty table gives no rows.
    """
    docs = docs.drop("removed_lines", "removed_words")
    texts = pick(docs, doc_id=id_col, text=text_col).where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("mark"), "text")
    gone, ends = repeated_stretches(texts, min_words, rows_per_slice)
    ends = ends.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "n")).alias("ends"))
    marks = staged(extended(texts.join(ends, ["doc_id", "mark"]), min_words), "windows")
    found = gone.union(repeated_windows(marks, rows_per_slice).withColumn("n", F.lit(1)))
    spans = found.groupBy(F.col("doc_id").alias("_dedup_id"), F.col("mark").alias("_dedup_mark")).agg(F.collect_list(F.struct("first", "n")).alias("_dedup_spans"))
    joined = docs.join(spans, (docs[id_col] == spans["_dedup_id"]) & (F.xxhash64(docs[text_col]) == spans["_dedup_mark"]), "left").drop("_dedup_id", "_dedup_mark")
    schema = T.StructType([*docs.schema.fields, T.StructField("removed_lines", T.LongType()), T.StructField("removed_words", T.LongType())])
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, spans = batch.columns
            n_spans = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero((n_spans > 0) & ~columns[place].is_null().to_numpy(zero_copy_only=False))
            lines, words = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            if len(hit):
                new = []
                for k in hit.tolist():
                    first, n = (spans[k].values.field(name).to_numpy(zero_copy_only=False) for name in ("first", "n"))
                    text, lines[k], words[k] = cut_words(columns[place][k].as_py(), first, n, min_words)
                    new.append(text)
                mask = np.zeros(batch.num_rows, dtype=bool)
                mask[hit] = True
                columns[place] = pc.replace_with_mask(columns[place], pa.array(mask), pa.array(new, columns[place].type))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines), pa.array(words)], [*batch.schema.names[:-1], "removed_lines", "removed_words"])

    return joined.mapInArrow(run, schema)


@query("op10_line_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines", "removed_words")
