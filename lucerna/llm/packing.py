"""Packing along a space-filling curve: similar documents share training sequences.

1. One pass over the texts: token ids, a hashed token-count vector projected to a few dimensions, and checksums at fixed
   steps, from which the checksum of any later cut follows. The ids themselves are not kept, so no text or id is shuffled.
2. The projections become coordinates on a grid and a Hilbert key; rows are range-sorted by the key. The ranges are
   stretches of the curve of equal tokens, read off the summed tokens of its cells, so reruns give the same pieces.
3. Each range is packed in curve order. Whole sequences of a long document stand alone; its remainder joins its
   neighbours on the curve and is cut where a sequence is full. A cut falls on a multiple of ``step`` tokens of the
   remainder, so a sequence lacks fewer than ``step`` tokens, except for the last of each range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucerna.llm import tokens
from lucerna.llm.base import Stage, pick, process_cache, query, ship, table

ship(__name__)

LENGTH = 2048
END_ID = 1
STEP = 16
BUCKETS = 256
DIMS, BITS = 3, 10
CELL_BITS = 18
TOKENS_PER_PARTITION = 8_000_000

MEASURED = "doc_id long, doc_tokens long, p0 float, p1 float, p2 float, blocks array<long>, tail array<long>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
POLYNOMIAL = 0xEDB88320  # of CRC-32, lowest power in the highest bit


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the checksum's polynomial."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (POLYNOMIAL if b & 1 else 0)
    return out


@lru_cache(maxsize=4096)
def _shift(n_bytes: int) -> int:
    """x to the power of 8 n, by squaring."""
    out, square = 0x80000000, 0x00800000
    while n_bytes:
        if n_bytes & 1:
            out = _times(square, out)
        square, n_bytes = _times(square, square), n_bytes >> 1
    return out


def crc_of_rest(whole: int, head: int, rest_bytes: int) -> int:
    """CRC-32 of b, given those of ab and a and the length of b."""
    return whole ^ _times(_shift(rest_bytes), head)


def projection() -> np.ndarray:
    """Fixed random directions; the same on every executor and in every run."""
    return np.random.Generator(np.random.PCG64(20)).standard_normal((BUCKETS, DIMS))


def _checksums(ids: np.ndarray, length: int, step: int) -> tuple[list[int], list[int]]:
    """Of each whole block, and of the remainder's prefixes at every multiple of ``step`` and at its end."""
    raw = memoryview(ids.astype("<u4").tobytes())
    cut = len(ids) // length * length * 4
    blocks = [zlib.crc32(raw[i : i + 4 * length]) for i in range(0, cut, 4 * length)]
    tail, crc = [], 0
    for i in range(cut, len(raw), 4 * step):
        crc = zlib.crc32(raw[i : i + 4 * step], crc)
        tail.append(crc)
    return blocks, tail


def measure(docs: DataFrame, length: int = LENGTH, step: int = STEP, tokenizer: str = tokens.TOKENIZER, chunk: int = 4_000_000) -> DataFrame:
    """Per document (doc_id, text): token count with the end id, projected vector, checksums. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, directions = tokens.encoder(tokenizer), projection()
        # the bucket of a token id: a multiplicative hash, so neighbouring ids part
        bucket = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64) % BUCKETS
        for batch in batches:
            for part in tokens.slices(batch, "text", chunk):
                flat, at = encoder.ids_of(part.column("text"))
                hashed = bucket[flat]
                n, p, blocks, tails = [], np.zeros((part.num_rows, DIMS)), [], []
                for i in range(part.num_rows):
                    a, b = at[i], at[i + 1]
                    ids = np.append(flat[a:b], np.uint16(END_ID))
                    count = np.bincount(hashed[a:b], minlength=BUCKETS)
                    p[i] = np.sqrt(count / max(1, b - a)) @ directions
                    block, tail = _checksums(ids, length, step)
                    n.append(len(ids)), blocks.append(block), tails.append(tail)
                ints = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), *(pa.array(p[:, k].astype(np.float32)) for k in range(DIMS)), pa.array(blocks, ints), pa.array(tails, ints)],
                    ["doc_id", "doc_tokens", "p0", "p1", "p2", "blocks", "tail"],
                )

    return docs.mapInArrow(run, MEASURED)


def hilbert_keys(coordinates: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of rows of grid coordinates, each below ``2 ** bits``.

    Works from the highest bit down: the cell's Gray-code corner gives the next ``dims`` bits of the key, then the
    frame is reflected and swapped so that the curve inside the cell joins its neighbours'.
    """
    x = coordinates.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for k in range(dims):
            flipped = (x[:, k] & bit) != 0
            swap = np.where(flipped, 0, (x[:, 0] ^ x[:, k]) & low)
            x[:, 0] ^= np.where(flipped, low, swap)
            x[:, k] ^= swap
    for k in range(1, dims):
        x[:, k] ^= x[:, k - 1]
    turn = np.zeros(len(x), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, dims - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for k in range(dims):
            key = (key << 1) | ((x[:, k] >> level) & 1)
    return key


def with_key(measured: DataFrame, bits: int = BITS) -> DataFrame:
    """Adds ``curve``: coordinates are standardised over all documents and spread evenly over the grid."""
    names = [f"p{k}" for k in range(DIMS)]
    stats = measured.agg(*[f(n).alias(f"{n}_{f.__name__}") for n in names for f in (F.avg, F.stddev_pop)]).first()
    # rounded, so that the order of summation does not move a document to another cell
    centre = [round(stats[f"{n}_avg"] or 0.0, 6) for n in names]
    spread = [round(stats[f"{n}_stddev_pop"] or 0.0, 6) or 1.0 for n in names]

    @F.pandas_udf("long")
    def key(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        process_cache("packing")
        z = (np.stack([a, b, c], axis=1).astype(np.float64) - centre) / spread
        grid = np.floor((1 << bits) / (1 + np.exp(-1.702 * z)))  # the logistic curve stands for the normal one
        return pd.Series(hilbert_keys(np.clip(grid, 0, (1 << bits) - 1), bits))

    return measured.withColumn("curve", key(*names))


def pack_rows(rows: Iterator[tuple], length: int, step: int, first_sequence: int) -> Iterator[tuple]:
    """Pieces of documents in order. ``rows``: doc_id, doc_tokens, block checksums, checksums of the remainder's prefixes."""
    free = first_sequence  # the next unused sequence
    current, fill = None, 0
    for doc_id, n, blocks, tail in rows:
        for i, crc in enumerate(blocks):
            yield doc_id, i * length, length, crc, n, free, 0
            free += 1
        at, rest = len(blocks) * length, n - len(blocks) * length
        if not rest:
            continue
        head = 0
        if current is not None and fill + rest > length:
            cut = (length - fill) // step * step
            if cut:
                head = tail[cut // step - 1]
                yield doc_id, at, cut, head, n, current, fill
                at, rest = at + cut, rest - cut
            current = None
        if current is None:
            current, fill, free = free, 0, free + 1
        yield doc_id, at, rest, crc_of_rest(tail[-1], head, 4 * rest) if head or at % length else tail[-1], n, current, fill
        fill += rest
        if fill == length:
            current = None


def with_part(keyed: DataFrame, per_partition: int, bits: int = BITS) -> DataFrame:
    """Adds ``part``, the stretch of about ``per_partition`` tokens of the curve, and ``tie``, a hash of the row.

    The curve has at most ``2 ** CELL_BITS`` cells, so the running total and the broadcast are bounded. Inside a cell
    documents are spread by ``tie``: copies share a key, not a task. The part depends on the rows alone.
    """
    cell = F.shiftright("curve", max(0, DIMS * bits - CELL_BITS))
    rows = keyed.withColumn("cell", cell).withColumn("tie", F.xxhash64("doc_id", "doc_tokens", "blocks", "tail"))
    cells = rows.groupBy("cell").agg(F.sum("doc_tokens").alias("cell_tokens"))
    before = F.coalesce(F.sum("cell_tokens").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.floor(F.pmod("tie", F.lit(1 << 20)) / (1 << 20) * F.col("cell_tokens"))
    # every row has its cell; an inner join would test the cell for null first and run the curve's Python twice, in two workers a task
    placed = rows.join(F.broadcast(cells.withColumn("before", before)), "cell", "left")
    return placed.withColumn("part", F.floor((F.col("before") + inside) / per_partition).cast("int"))


def pack(measured: DataFrame, length: int = LENGTH, step: int = STEP, per_partition: int = TOKENS_PER_PARTITION) -> DataFrame:
    """Pieces of all measured documents, in sequences of neighbours on the curve."""
    total = measured.agg(F.sum("doc_tokens")).first()[0] or 0
    parts = max(1, -(-total // per_partition))
    ordered = with_part(with_key(measured), per_partition).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "curve", "doc_id", "doc_tokens", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_cache("packing")
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        out: list[tuple] = []
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
        for part, own in groupby(rows, key=lambda row: row[4]):
            for piece in pack_rows((row[:4] for row in own), length, step, part << 40):
                out.append(piece)
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return ordered.select("doc_id", "doc_tokens", "blocks", "tail", "part").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, step: int = STEP, tokenizer: str = tokens.TOKENIZER, per_partition: int = TOKENS_PER_PARTITION) -> DataFrame:
    """Pack whole documents into sequences of ``length`` tokens.

    A document is its text's ids and the end id; null and empty texts are the end id alone. A null id is kept as null,
    rows that share an id are packed one by one. Other columns are ignored. An empty table gives no rows.
    ``length`` must be a multiple of ``step``. Sequence ids are unique, not gapless; offsets within one are gapless.
    The same rows give the same pieces, however they are partitioned.
    """
    if length % step:
        raise ValueError("length must be a multiple of step")
    measured = Stage(measure(pick(docs, doc_id=id_col, text=text_col), length, step, tokenizer), "packing").df
    return pack(measured, length, step, per_partition)


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
