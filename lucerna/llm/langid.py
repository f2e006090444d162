"""Language identification by interpolated Kneser-Ney character models.

One model per language over character n-grams of letters and single spaces. N-grams are 64-bit polynomial hashes in sorted
arrays; a row holds the n-gram's probability under every language, back-off included, so one binary search per character
serves all languages. What no model has seen backs off at lookup through the context weights of the lower orders.
A text gets the language of the lowest cross-entropy per character. Two things are calibrated on training documents that
the models have not seen: the temperature that turns cross-entropies into a confidence, and per language the cross-entropy
above which a text is marked ``rejected`` (like no learned language).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm.base import pick, process_cache, query, ship, staged, table
from lucerna.llm.tokens import slices

ship(__name__)

ORDER = 4
SAMPLE = 2000  # documents per language that a model is fitted on, about
CALIBRATION = 500  # further documents per language, about
MAX_CELLS = 24_000_000  # n-grams times languages in the broadcast model
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPACE = 32
TEMPERATURES = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)
KEPT_QUANTILE = 0.999


def _letters() -> np.ndarray:
    """Whether a code point is a letter; computed once per worker."""
    kept = process_cache("langid")
    if "letters" not in kept:
        kept["letters"] = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)
    return kept["letters"]


def characters(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, lower case, letters and single spaces, ``order - 1`` spaces before each; whose they are; which to score."""
    pad = "\x01" * (order - 1)
    lowered = [t.lower() for t in texts]
    raw = np.frombuffer((pad + pad.join(lowered)).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered)) + len(pad)
    begin = np.cumsum(size) - size
    padding = np.zeros(len(raw), dtype=bool)
    for k in range(order - 1):
        padding[begin + k] = True
    letter = _letters()[raw]
    before = np.concatenate([[False], letter[:-1]])
    keep = letter | before | padding
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)[keep]
    return np.where(letter, raw, SPACE)[keep].astype(np.uint64), owner, ~padding[keep]


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    out = columns[0].astype(np.uint64)
    for c in columns[1:]:
        out = out * MULTIPLIER + c
    return out


def grams(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """The n-gram that ends at each position, as columns; positions before the first whole one hold spaces."""
    padded = np.concatenate([np.full(order - 1, SPACE, dtype=np.uint64), codes])
    return [padded[k : k + len(codes)] for k in range(order)]


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, c0.., n): n-grams of (lang, text), counted in each task and then over all."""
    names = [f"c{k}" for k in range(order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                texts = [t.as_py() for t, name in zip(batch.column("text"), langs) if name == lang]
                codes, _, scored = characters(texts, order)
                columns = [c[scored] for c in grams(codes, order)]
                _, at, n = np.unique(hashed(columns), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *(pa.array(c[at].astype(np.int32)) for c in columns), pa.array(n.astype(np.int64))], ["lang", *names, "n"])

    return docs.mapInArrow(run, f"lang string, {', '.join(f'{c} int' for c in names)}, n long").groupBy("lang", *names).agg(F.sum("n").alias("n"))


class _Language:
    """Sorted hash arrays of one language: discounted n-gram parts and context weights of every order."""

    def __init__(self, columns: list[np.ndarray], counts: np.ndarray, vocabulary: int):
        order = len(columns)
        self.part, self.weight, self.uniform = {}, {}, 1.0 / vocabulary
        for k in range(order, 0, -1):
            if k < order:  # lower orders count the distinct characters before an n-gram
                key = hashed(columns[-k:])
                _, at, counts = np.unique(key, return_index=True, return_counts=True)
                columns = [c[at] for c in columns[-k:]]
            once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context = hashed(columns[:-1]) if k > 1 else np.zeros(len(counts), dtype=np.uint64)
            seen, inverse, kinds = np.unique(context, return_inverse=True, return_counts=True)
            total = np.bincount(inverse, weights=counts)
            key = hashed(columns)
            order_ = np.argsort(key)
            self.part[k] = key[order_], (np.maximum(counts - discount, 0) / total[inverse])[order_]
            self.weight[k] = seen, discount * kinds / total

    def probability(self, columns: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(columns[0]), self.uniform)
        for k in range(1, len(columns) + 1):
            own = columns[-k:]
            part = lookup(self.part[k], hashed(own), 0.0)
            p = part + p * lookup(self.weight[k], hashed(own[:-1]) if k > 1 else np.zeros(len(p), dtype=np.uint64), 1.0)
        return p


def lookup(pairs: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
    sorted_keys, values = pairs
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, values[at], missing)


class Model:
    """Probabilities of all n-grams under all languages. ``counts``: lang -> (columns, counts)."""

    def __init__(self, counts: dict[str, tuple[list[np.ndarray], np.ndarray]], order: int = ORDER):
        self.order, self.langs = order, sorted(counts)
        vocabulary = len(np.unique(np.concatenate([c[0][-1] for c in counts.values()]))) + 1
        models = [_Language(*counts[lang], vocabulary) for lang in self.langs]
        union = [np.concatenate([counts[lang][0][k] for lang in self.langs]) for k in range(order)]
        self.keys, self.p, self.contexts, self.weights = {}, {}, {}, {}
        for k in range(order, 0, -1):
            key, at = np.unique(hashed(union[-k:]), return_index=True)
            own = [c[at] for c in union[-k:]]
            self.keys[k] = key
            self.p[k] = np.stack([m.probability(own) for m in models], axis=1).astype(np.float32)
            self.contexts[k] = np.unique(np.concatenate([m.weight[k][0] for m in models]))
            self.weights[k] = np.stack([lookup(m.weight[k], self.contexts[k], 1.0) for m in models], axis=1).astype(np.float32)
        self.log = np.log(self.p[order])
        self.unseen = np.full((1, len(models)), 1.0 / vocabulary, dtype=np.float32)
        self.temperature, self.limit = 10.0, np.full(len(models), np.inf)

    def _backed_off(self, columns: list[np.ndarray], k: int) -> np.ndarray:
        """Probabilities of n-grams of order ``k``."""
        if k == 0:
            return np.repeat(self.unseen, len(columns[0]), axis=0)
        key = hashed(columns[-k:])
        at = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
        out = self.p[k][at]
        miss = np.flatnonzero(self.keys[k][at] != key)
        if len(miss):
            rest = [c[miss] for c in columns]
            context = hashed(rest[-k:-1]) if k > 1 else np.zeros(len(miss), dtype=np.uint64)
            where = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            known = self.contexts[k][where] == context
            out[miss] = np.where(known[:, None], self.weights[k][where], 1.0) * self._backed_off(rest, k - 1)
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language, in nats per character; and the number of letters of each text."""
        codes, owner, scored = characters(texts, self.order)
        columns = grams(codes, self.order)
        columns, owner = [c[scored] for c in columns], owner[scored]
        key = hashed(columns)
        at = np.minimum(np.searchsorted(self.keys[self.order], key), len(self.log) - 1)
        miss = np.flatnonzero(self.keys[self.order][at] != key)
        fixed = np.log(self._backed_off([c[miss] for c in columns], self.order)) if len(miss) else None
        n = np.bincount(owner, minlength=len(texts))
        letters = np.bincount(owner, weights=columns[-1] != SPACE, minlength=len(texts))
        out = np.zeros((len(texts), len(self.langs)))
        for j in range(len(self.langs)):
            log = self.log[:, j][at]
            if fixed is not None:
                log[miss] = fixed[:, j]
            out[:, j] = -np.bincount(owner, weights=log, minlength=len(texts)) / np.maximum(n, 1)
        return out, letters

    def confidence(self, entropy: np.ndarray) -> np.ndarray:
        z = -self.temperature * (entropy - entropy.min(axis=1, keepdims=True))
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


def _sampled(rows: DataFrame, counts: dict[str, int], size: int) -> DataFrame:
    """About ``size`` rows of each language, by a hash of the row."""
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, size / n))])
    return rows.where(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)


def fit(labelled: DataFrame, order: int = ORDER, sample: int = SAMPLE, calibration: int = CALIBRATION, max_cells: int = MAX_CELLS) -> Model | None:
    """Fit on (doc_id, lang, text, fold). Fold 1 calibrates, the others train; None without training rows.

    The sample bounds the model. Where n-grams times languages would still pass ``max_cells``, the sample is halved.
    """
    rows = labelled.where("lang is not null and text is not null")
    counts = {lang: n for lang, n in rows.where("fold <> 1").groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    while True:
        counted = staged(count_grams(_sampled(rows.where("fold <> 1"), counts, sample).select("lang", "text"), order), "grams")
        if counted.count() * len(counts) <= max_cells or sample <= 1:
            break
        sample //= 2
    arrow = counted.toArrow()
    names, found = np.array(arrow.column("lang").to_pylist(), dtype=object), {}
    for lang in counts:
        own = np.flatnonzero(names == lang)
        if len(own):
            found[lang] = [arrow.column(f"c{k}").to_numpy()[own].astype(np.uint64) for k in range(order)], arrow.column("n").to_numpy()[own]
    if not found:
        return None
    model = Model(found, order)
    held = _sampled(rows.where("fold = 1"), {lang: n for lang, n in rows.where("fold = 1").groupBy("lang").count().collect()} or {"": 1}, calibration)
    scored = cross_entropies(held.select("doc_id", "lang", "text"), model).where("letters > 0").toArrow()
    if scored.num_rows:
        entropy = np.array(scored.column("entropy").to_pylist())
        place = {lang: j for j, lang in enumerate(model.langs)}
        truth = np.array([place.get(x, -1) for x in scored.column("lang").to_pylist()])
        entropy, truth = entropy[truth >= 0], truth[truth >= 0]
        loss = []
        for t in TEMPERATURES:
            model.temperature = t
            loss.append(-np.log(model.confidence(entropy)[np.arange(len(truth)), truth] + 1e-12).mean() if len(truth) else 0.0)
        model.temperature = TEMPERATURES[int(np.argmin(loss))]
        for j in range(len(model.langs)):
            own = entropy[truth == j, j]
            model.limit[j] = np.quantile(own, KEPT_QUANTILE) if len(own) else np.inf
    return model


def cross_entropies(docs: DataFrame, model: Model, chunk: int = 2_000_000) -> DataFrame:
    """doc_id, lang, entropy (one per learned language), letters. Narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", chunk):
                entropy, letters = shared.value.cross_entropy([t.as_py() or "" for t in part.column("text")])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, entropy.size + 1, entropy.shape[1]), pa.int32()), pa.array(entropy.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("lang").cast(pa.string()), flat, pa.array(letters.astype(np.int64))], ["doc_id", "lang", "entropy", "letters"])

    return docs.mapInArrow(run, "doc_id long, lang string, entropy array<double>, letters long")


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected of every row.

    ``und`` with score 0 for a null text or one without a letter, and for all where no model was fitted. Whole texts are
    scored. A null id is kept; rows that repeat are scored each; other columns are ignored. An empty table gives no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    scored = cross_entropies(rows.select("doc_id", F.lit(None).cast("string").alias("lang"), "text"), model)
    best = F.array_min("entropy")
    index = F.array_position("entropy", best).cast("int")
    total = F.aggregate(F.transform("entropy", lambda e: F.exp(-F.lit(float(model.temperature)) * (e - best))), F.lit(0.0), lambda a, b: a + b)
    named = F.element_at(F.array(*[F.lit(x) for x in model.langs]), index)
    limit = F.element_at(F.array(*[F.lit(float(x)) for x in model.limit]), index)
    lettered = F.col("letters") > 0
    return scored.select(
        "doc_id", F.when(lettered, named).otherwise("und").alias("lang_pred"), F.when(lettered, 1.0 / total).otherwise(0.0).alias("score"),
        F.when(lettered, best).alias("cross_entropy"), (~lettered | (best > limit)).alias("rejected"),
    )


@query("op3_langid")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "lang", "text", fold.alias("fold")).where("fold <> 0"))
    found = identify(docs, model)
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
