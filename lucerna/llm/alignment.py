"""Alignment of the tokens of two vocabularies on the same text, by sparse incidence matrices.

Tokens of A and of B are rows of 0/1 matrices over the bytes of the text, kept in compressed sparse rows (CSR) built here.
The row product A B' (for every byte of an A token, the row of B' at that byte) gives overlap links with the number of
shared bytes. Offsets at which tokens of both end cut the text into groups; with incidence of ids over groups the
same product gives all links inside groups.

Both vocabularies always start a token at a space between two other characters, so a text may be cut there: groups never
cross such a cut. Pieces repeat, so a worker keeps the alignment of a piece and a document is mostly lookups.

Corpus counts: a block of documents lists its distinct id pairs once, with the number of its documents that hold each.
Lists are summed over all blocks, and each block gets the totals of its own pairs back, so neither texts nor the pairs of
single documents are shuffled, and nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm import tokens
from lucerna.llm.base import Stage, pick, process_cache, query, ship, table
from lucerna.operators.skew import join_on_hot_key

ship(__name__)

A, B = tokens.TOKENIZER, "piece_bpe_32k"
BLOCK_CHARS = 1_000_000
BLOCKS_PER_FILE = 16  # a block's lists are some megabytes
CELLS = 4_000_000  # entries of a product made at once
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
ODD = r"\A |" + tokens.ODD_SPACE
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
BLOCK = "doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in COUNTS) + ", groups_sha256 array<string>, ends array<long>, entry array<int>, times array<long>, pair array<long>, holders array<long>"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long"
ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, overlaps array<struct<a:int,b:int,bytes:int>>, groups array<struct<a_end:int,b_end:int>>"


class Csr(NamedTuple):
    """Row i holds ``column[start[i]:start[i + 1]]`` with ``value`` at the same places."""

    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    width: int


def csr(row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]) -> Csr:
    """From coordinates in any order; repeated ones are summed."""
    key, at = np.unique(row.astype(np.int64) * shape[1] + column, return_inverse=True)
    total = np.bincount(at, weights=value, minlength=len(key)).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(np.bincount(key // max(1, shape[1]), minlength=shape[0]))])
    return Csr(start, key % max(1, shape[1]), total, shape[1])


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.column, kind="stable")
    row = np.repeat(np.arange(len(m.start) - 1), np.diff(m.start))
    start = np.concatenate([[0], np.cumsum(np.bincount(m.column, minlength=m.width))])
    return Csr(start, row[order], m.value[order], len(m.start) - 1)


def row_products(a: Csr, b: Csr, cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of the product a b, some rows of a at a time, about ``cells`` entries before they are summed.

    Each entry (i, k) of a calls row k of b, scaled by its value; what falls on the same place of row i is added up.
    """
    called = np.diff(b.start)[a.column]
    reach = np.concatenate([[0], np.cumsum(called)])[a.start]  # entries before each row
    row_of = np.repeat(np.arange(len(a.start) - 1), np.diff(a.start))
    first = 0
    while first < len(a.start) - 1:
        last = max(first + 1, int(np.searchsorted(reach, reach[first] + cells, side="right")) - 1)
        own = slice(a.start[first], a.start[last])
        n = called[own]
        end = np.cumsum(n)
        if len(end) and end[-1]:
            place = np.repeat(b.start[a.column[own]] - (end - n), n) + np.arange(end[-1])
            key = np.repeat(row_of[own], n) * b.width + b.column[place]
            value = np.repeat(a.value[own], n) * b.value[place]
            key, at = np.unique(key, return_inverse=True)
            yield key // b.width, key % b.width, np.bincount(at, weights=value, minlength=len(key)).astype(np.int64)
        first = last


def byte_incidence(ends: np.ndarray, total: int) -> Csr:
    """Tokens over the bytes they cover; tokens follow each other without gaps."""
    return Csr(np.concatenate([[0], ends]), np.arange(total), np.ones(total, dtype=np.int64), total)


class Pieces(NamedTuple):
    """Aligned pieces by column: counts, groups as text, and each one's distinct id pairs (a * 65536 + b) with the number of links.

    ``n_pairs`` of a piece lie one after another in ``pair`` and ``times``. ``sound`` is False where B's bytes are not those of the piece.
    """

    counts: np.ndarray
    groups: list[str]
    n_pairs: np.ndarray
    pair: np.ndarray
    times: np.ndarray
    sound: np.ndarray

    @classmethod
    def of(cls, parts: list["Pieces"]) -> "Pieces":
        if not parts:
            return cls(np.zeros((0, len(COUNTS)), np.int64), [], *(np.zeros(0, t) for t in (np.int64, np.uint32, np.int64, bool)))
        return cls(*([x for p in parts for x in p.groups] if f == "groups" else np.concatenate([getattr(p, f) for p in parts]) for f in cls._fields))


class Joined(NamedTuple):
    """Tokens of many pieces, one piece after another: byte ends of the tokens, of the groups and of the pieces."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    cut: np.ndarray
    piece_end: np.ndarray


class Aligner:
    """Alignments of pieces, which all start with a space; the first ``limit`` of ordinary length are kept."""

    def __init__(self, a: str = A, b: str = B, limit: int = 100_000, chunk: int = 200_000):
        import public_tokenizers as public
        import sentencepiece

        self.a, self.limit, self.chunk = tokens.encoder(a), limit, chunk
        self.kept, self.number = Pieces.of([]), {}
        self.b = sentencepiece.SentencePieceProcessor(model_file=public.path(f"{b}.model"))
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.b_length = np.array([len(x) for x in self.b_bytes])

    def encode(self, text: str, run: bool = False) -> tuple[list[int], list[int], bool]:
        """Ids of both vocabularies, and whether the bytes of B's tokens are those of the text; a run has no long piece."""
        b = self.b.encode(text[1:], num_threads=1)
        return self.a._fast.encode_ordinary(text) if run else self.a._encode(text), b, b"".join(map(self.b_bytes.__getitem__, b)) == text.encode()

    def joined(self, pieces: list[str]) -> tuple[Joined, np.ndarray]:
        """All sound pieces, and which are.

        Pieces that neither start with white space after their space nor end with any are encoded in one run, since both
        vocabularies cut between them; the rest, the very long ones, and runs with an unsound piece go one by one.
        """
        plain = [not (p[1:2].isspace() or p[-1].isspace()) and len(p) < self.chunk // 4 for p in pieces]
        runs: list[tuple[list[int], str]] = [([i], pieces[i]) for i, ok in enumerate(plain) if not ok]
        if any(plain):
            own = [i for i, ok in enumerate(plain) if ok]
            runs.append((own, "".join([pieces[i] for i in own])))
        sound, order, a_ids, b_ids = np.ones(len(pieces), dtype=bool), [], [], []
        while runs:
            own, text = runs.pop()
            a, b, same = self.encode(text, len(own) > 1)
            if same:
                order += own
                a_ids.append(a)
                b_ids.append(b)
            elif len(own) == 1:
                sound[own] = False
            else:
                runs += [([i], pieces[i]) for i in own]
        a, b = (np.array([i for ids in x for i in ids], dtype=np.int64) for x in (a_ids, b_ids))
        a_end, b_end = np.cumsum(self.a.byte_length[a]), np.cumsum(self.b_length[b])
        piece_end = np.cumsum([len(pieces[i].encode()) for i in order])
        self.order = np.array(order, dtype=np.int64)
        return Joined(a, b, a_end, b_end, np.intersect1d(a_end, b_end, assume_unique=True), piece_end), sound

    def align(self, pieces: list[str]) -> Pieces:
        """All at once, as one matrix."""
        m, sound = self.joined(pieces)
        n, order = len(pieces), self.order
        counts = np.zeros((n, len(COUNTS)), dtype=np.int64)
        groups, n_pairs = [""] * n, np.zeros(n, dtype=np.int64)
        if not len(order):
            return Pieces(counts, groups, n_pairs, np.zeros(0, np.uint32), np.zeros(0, np.int64), sound)
        total = int(m.piece_end[-1])
        a_group, b_group = np.searchsorted(m.cut, m.a_end), np.searchsorted(m.cut, m.b_end)
        piece_of_group = np.searchsorted(m.piece_end, m.cut)
        a_piece, b_piece = piece_of_group[a_group], piece_of_group[b_group]
        overlaps = np.zeros(len(order), dtype=np.int64)
        for row, _, _ in row_products(byte_incidence(m.a_end, total), transposed(byte_incidence(m.b_end, total))):
            overlaps += np.bincount(a_piece[row], minlength=len(order))
        ids_a, at_a = np.unique(a_group << 16 | m.a, return_inverse=True)
        ids_b, at_b = np.unique(b_group << 16 | m.b, return_inverse=True)
        one = csr(np.arange(len(ids_a)), ids_a >> 16, np.bincount(at_a), (len(ids_a), len(m.cut)))
        other = csr(np.arange(len(ids_b)), ids_b >> 16, np.bincount(at_b), (len(ids_b), len(m.cut)))
        found = [
            (order[piece_of_group[ids_a[row] >> 16]] << 32 | (ids_a[row] & 65535) << 16 | (ids_b[column] & 65535), value)
            for row, column, value in row_products(one, transposed(other))
        ]
        # the same pair of ids may be in several groups of a piece
        key, times = _summed(*(np.concatenate(c) for c in zip(*found)))
        piece = key >> 32
        for c, values in enumerate((a_piece, b_piece, piece_of_group)):
            counts[order, c] = np.bincount(values, minlength=len(order))
        counts[:, 3] = np.bincount(piece, weights=times, minlength=n).astype(np.int64)
        counts[order, 4] = overlaps
        listed = [f"{x}|{y}" for x, y in zip(_listed(m.a, a_group, len(m.cut)), _listed(m.b, b_group, len(m.cut)))]
        edge = np.searchsorted(piece_of_group, np.arange(len(order) + 1)).tolist()
        for i, g, h in zip(order.tolist(), edge, edge[1:]):
            groups[i] = listed[g] if h == g + 1 else ";".join(listed[g:h])
        return Pieces(counts, groups, np.bincount(piece, minlength=n), (key & 0xFFFFFFFF).astype(np.uint32), times, sound)

    def lookup(self, pieces: list[str]) -> tuple[np.ndarray, Pieces]:
        """Where each piece is in the columns returned: those kept, then those aligned just now."""
        missing = [p for p in pieces if p not in self.number]
        fresh, start = [self.kept], 0
        size = np.cumsum([len(p) for p in missing])
        while start < len(missing):
            stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + self.chunk, side="right")))
            fresh.append(self.align(missing[start:stop]))
            start = stop
        whole = Pieces.of(fresh)
        number = {p: len(self.number) + i for i, p in enumerate(missing)}
        at = np.array([number[p] if p in number else self.number[p] for p in pieces], dtype=np.int64)
        if len(self.number) < self.limit:
            keep = [i for i, p in enumerate(missing) if len(p) < 40][: self.limit - len(self.number)]
            rows = np.concatenate([np.arange(len(self.number)), len(self.number) + np.array(keep, dtype=np.int64)])
            place, _ = _gathered(np.cumsum(whole.n_pairs) - whole.n_pairs, whole.n_pairs, rows)
            self.number |= {missing[i]: len(self.number) + k for k, i in enumerate(keep)}
            self.kept = Pieces(whole.counts[rows], [whole.groups[i] for i in rows], whole.n_pairs[rows], whole.pair[place], whole.times[place], whole.sound[rows])
        return at, whole


def _listed(ids: np.ndarray, group: np.ndarray, n: int) -> list[str]:
    """Decimal ids of each group with commas between."""
    words = list(map(str, ids.tolist()))
    edge = np.searchsorted(group, np.arange(n + 1)).tolist()
    return [words[i] if j == i + 1 else ",".join(words[i:j]) for i, j in zip(edge, edge[1:])]


def aligner(a: str = A, b: str = B) -> Aligner:
    """One for each Python worker."""
    kept = process_cache("tokens")
    if ("align", a, b) not in kept:
        kept["align", a, b] = Aligner(a, b)
    return kept["align", a, b]


def pieces_of(text: str) -> list[str]:
    """A non-empty text with a space before it, cut where both vocabularies start a token."""
    spaced = " " + text
    at = [0, *(m.start() for m in CUT.finditer(spaced)), len(spaced)]
    return [spaced[i:j] for i, j in zip(at, at[1:])]


def coded_pieces(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces of many texts, the piece numbers of all texts one after another, and where each text's start.

    Most texts are cut column-wise at their spaces; those with a space at either end or before white space one by one.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
    at = split.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    coded = split.flatten().dictionary_encode()
    code, known = coded.indices.to_numpy().astype(np.int64), [" " + p for p in coded.dictionary.to_pylist()]
    if not (odd | empty).any():
        return known, code, at
    number = {p: i for i, p in enumerate(known)}
    parts, size = [], np.diff(at)
    for i in np.flatnonzero(odd | empty):
        own = pieces_of(texts[int(i)].as_py()) if odd[i] else []
        parts.append((i, [number.setdefault(p, len(number)) for p in own]))
    rows = [code[at[i] : at[i + 1]] for i in range(len(size))]
    for i, own in parts:
        rows[i] = np.array(own, dtype=np.int64)
    return list(number), np.concatenate(rows) if rows else code, np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def _gathered(start: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places start[c] .. start[c] + size[c] for each code c, one after another, and how many each has."""
    n = size[code]
    end = np.cumsum(n)
    return np.repeat(start[code] - (end - n), n) + np.arange(end[-1] if len(end) else 0), n


def _summed(key: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    if weight is None:
        return key[at], np.diff(np.r_[at, len(key)])
    return key[at], np.add.reduceat(weight[order], at) if len(at) else weight[:0]


def block_row(part: pa.RecordBatch, own: Aligner) -> list:
    """The values of BLOCK for some documents (doc_id, text)."""
    pieces, code, at = coded_pieces(part.column("text"))
    place, known = own.lookup(pieces)
    code = place[code]
    n = part.num_rows
    doc = np.repeat(np.arange(n), np.diff(at))
    wrong = np.zeros(n, dtype=bool)
    wrong[doc[~known.sound[code]]] = True
    before = np.concatenate([np.zeros((1, len(COUNTS)), dtype=np.int64), known.counts[code].cumsum(axis=0)])
    totals = np.where(wrong[:, None], 0, before[at[1:]] - before[at[:-1]])
    texts = known.groups
    digest = []
    for i, j, bad in zip(at[:-1].tolist(), at[1:].tolist(), wrong.tolist()):
        digest.append("" if bad or i == j else hashlib.sha256(";".join([texts[c] for c in code[i:j].tolist()]).encode()).hexdigest())
    # first the pieces of a document, then their pairs: both with the number of times
    seen, times = _summed((doc << 32 | code)[~wrong[doc]], None)
    place, each = _gathered(np.cumsum(known.n_pairs) - known.n_pairs, known.n_pairs, seen & 0xFFFFFFFF)
    key, times = _summed(np.repeat(seen >> 32, each) << 32 | known.pair[place], np.repeat(times, each) * known.times[place])
    distinct, entry, holders = np.unique(key & 0xFFFFFFFF, return_inverse=True, return_counts=True)
    ends = np.searchsorted(key >> 32, np.arange(n), side="right")
    return [part.column("doc_id").to_pylist(), *totals.T, digest, ends, entry.astype(np.int32), times, distinct, holders]


def aligned_blocks(docs: DataFrame, a: str = A, b: str = B, chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each block of documents: their counts, their id pairs as places in the block's list, and that list."""
    names = [c.split()[0] for c in BLOCK.split(", ")]
    kinds = [pa.string() if "string" in c else pa.int32() if "<int>" in c else pa.int64() for c in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        for batch in batches:
            for part in tokens.slices(batch, "text", chars):
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(t)) for v, t in zip(block_row(part, own), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK)


def pair_counts(listed: DataFrame) -> DataFrame:
    """(pair, n, best, blocks): documents that hold the pair, whether no pair of its A id has more, and the lists it is in."""
    total = Stage(listed.groupBy("pair").agg(F.sum("holders").alias("n"), F.count(F.lit(1)).alias("blocks")), "pairs").df.withColumn("a", F.shiftrightunsigned("pair", 16))
    return total.join(total.groupBy("a").agg(F.max("n").alias("most")), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"), "blocks")


def alignment_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A, b: str = B, chars: int = BLOCK_CHARS, rows_per_slice: int = 500_000) -> DataFrame:
    """Per document DIGEST: tokens, groups, links, links of the A id's commonest pair, summed counts of the links, digest of the groups.

    The count of a pair of ids is the number of documents in which a token of the one shares a group with a token of the
    other. Null and empty texts, and those which B does not give back byte for byte, have no tokens: zeros and an empty
    digest. Null ids are kept, rows that share an id count as a document each, other columns are ignored. Ties for the
    highest count all count as best. An empty table gives no rows. Whole texts at any length; a block holds one text at least.
    """
    blocks = Stage(aligned_blocks(pick(docs, doc_id=id_col, text=text_col), a, b, chars).withColumn("block", F.monotonically_increasing_id()), "aligned", BLOCKS_PER_FILE).df
    listed = blocks.select("block", F.posexplode(F.arrays_zip("pair", "holders")).alias("at", "e")).select("block", "at", "e.pair", "e.holders")
    counted = Stage(pair_counts(listed), "pair-counts").df
    found = join_on_hot_key(listed.drop("holders"), counted, ["pair"], "blocks", "block", how="inner", rows_per_slice=rows_per_slice)
    lists = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "n", "best"))).alias("found"))  # as long as the block's list
    whole = blocks.drop("pair", "holders").join(lists, "block", "left").drop("block").withColumns({"n": F.col("found.n"), "best": F.col("found.best")}).drop("found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_cache("alignment counts")  # the worker's aligner is not needed any more
        for batch in batches:
            for r in range(batch.num_rows):
                v = {c: batch.column(c)[r].values for c in batch.schema.names}
                entry, times, ends = (v[c].to_numpy() for c in ("entry", "times", "ends"))
                n = v["n"].to_numpy() if v["n"] is not None else np.zeros(0, dtype=np.int64)
                best = v["best"].to_numpy(zero_copy_only=False) if v["best"] is not None else np.zeros(0, dtype=bool)
                summed = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (times * best[entry], times * n[entry])]
                starts = np.concatenate([[0], ends[:-1]])
                n_best, count_sum = (pa.array(s[ends] - s[starts]) for s in summed)
                yield pa.RecordBatch.from_arrays([v["doc_id"], *(v[c] for c in COUNTS[:4]), n_best, count_sum, v["groups_sha256"], v["n_overlaps"]], [c.split()[0] for c in DIGEST.split(", ")])

    return whole.mapInArrow(run, DIGEST)


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A, b: str = B) -> DataFrame:
    """Per document ALIGNED: both lists of ids, overlap links (token places and shared bytes), and the last tokens of each group.

    A text without tokens (see ``alignment_digest``) has empty lists. A narrow pass over whole texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        link = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())])
        end = pa.struct([("a_end", pa.int32()), ("b_end", pa.int32())])
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                row: list = [[], [], [], []]
                m, sound = own.joined([" " + text.as_py()]) if text.as_py() else (None, np.zeros(0))
                if sound.all() and len(sound):
                    total = int(m.piece_end[-1])
                    parts = list(row_products(byte_incidence(m.a_end, total), transposed(byte_incidence(m.b_end, total))))
                    at, to, shared = (np.concatenate(c).tolist() for c in zip(*parts))
                    last = (np.searchsorted(e, m.cut).tolist() for e in (m.a_end, m.b_end))
                    row = [m.a, m.b, [{"a": i, "b": j, "bytes": k} for i, j, k in zip(at, to, shared)], [{"a_end": i, "b_end": j} for i, j in zip(*last)]]
                kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(link), pa.list_(end)]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), *(pa.array([x], t) for x, t in zip(row, kinds))], [c.split()[0] for c in ("doc_id", "a_ids", "b_ids", "overlaps", "groups")])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, ALIGNED)


@query("op13_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digest(table(spark, sf_dir, "documents"))
