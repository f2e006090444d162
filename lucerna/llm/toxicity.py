"""Toxicity by a counterfactually regularised classifier.

A logistic model over the words of a whole text. Where a labelled text names a group (an identity term), its sentences are
copied with the term swapped for another of the same kind; the loss adds the squared change of the score between the two.
Weight on a group's name itself is so driven out, and neutral mentions do not raise the score.

Labels are learned from a bounded sample (``sample`` texts, by a hash). Vocabulary statistics come from Spark aggregates over
it: a word enters if its toxic share differs from the sample's by ``min_z`` standard errors, or if it is an identity term.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm.base import pick, query, ship, staged, table

ship(__name__)

SAMPLE = 20_000
MAX_WORDS = 50_000
MIN_DOCS, MIN_Z = 5, 4.0
SWAP_WEIGHT, RIDGE = 5.0, 1e-5
THRESHOLD = 0.7
TOKEN = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?\n])\s+")

# terms that may stand for each other in a sentence without changing whether it is toxic
IDENTITY_TERMS = [
    ["men", "women", "boys", "girls", "males", "females"],
    ["man", "woman", "boy", "girl", "male", "female"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"],
    ["black", "white", "asian", "latino", "african", "european", "arab"],
    ["gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual", "homosexual"],
    ["american", "mexican", "chinese", "indian", "german", "french", "russian", "turkish", "polish", "spanish"],
    ["americans", "mexicans", "indians", "germans", "russians", "turks", "poles", "spaniards"],
    ["immigrants", "refugees", "foreigners", "natives", "locals"],
    ["old", "young", "elderly"],
    ["deaf", "blind", "disabled", "autistic"],
]
KIND = {term: (g, i) for g, terms in enumerate(IDENTITY_TERMS) for i, term in enumerate(terms)}


def words(text: str | None) -> set[str]:
    return set(TOKEN.findall(text.lower())) if text else set()


def swapped(text: str) -> set[str]:
    """Words of the text with the identity terms of each sentence moved on to the next of their kind."""
    out: set[str] = set()
    for k, sentence in enumerate(SENTENCE.split(text.lower())):
        for w in TOKEN.findall(sentence):
            if w in KIND:
                g, i = KIND[w]
                w = IDENTITY_TERMS[g][(i + 1 + k) % len(IDENTITY_TERMS[g])]
                w = w if (g, i) != KIND[w] else IDENTITY_TERMS[g][(i + 1) % len(IDENTITY_TERMS[g])]
            out.add(w)
    return out


def labelled_words(rows: DataFrame) -> DataFrame:
    """toxic, words and swapped words (null where the text names no group) of (text, toxic). Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                w = words(text)
                own.append(sorted(w))
                other.append(sorted(swapped(text)) if not w.isdisjoint(KIND) else None)
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(own, strings), pa.array(other, strings)], ["toxic", "words", "swapped"])

    return rows.mapInArrow(run, "toxic int, words array<string>, swapped array<string>")


class Classifier:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        w = self.weights
        z = self.bias + sum(w[x] for x in words(text) & w.keys())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _rows(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), list(map(len, lists))), np.fromiter((x for xs in lists for x in xs), dtype=np.int64)


def train(features: list[list[int]], labels: np.ndarray, weights: np.ndarray, pairs: list[tuple[int, list[int]]], n_words: int, swap_weight: float = SWAP_WEIGHT, ridge: float = RIDGE, steps: int = 800, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Word weights and bias by gradient descent with moments. ``weights``: how many texts a row stands for. ``pairs``: row
    number and the features of its swapped copy."""
    theta, moment, square = np.zeros(n_words + 1), np.zeros(n_words + 1), np.zeros(n_words + 1)
    row, col = _rows(features)
    swap_row, swap_col = _rows([f for _, f in pairs])
    origin = np.array([i for i, _ in pairs], dtype=np.int64)
    n, n_pairs = max(1.0, weights.sum()), max(1.0, weights[origin].sum())
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, theta[col], len(features)) + theta[-1], -30, 30)))
        pull = weights * (p - labels) / n
        grad = ridge * theta
        grad[-1] = 0.0
        if pairs:
            q = 1 / (1 + np.exp(-np.clip(np.bincount(swap_row, theta[swap_col], len(pairs)) + theta[-1], -30, 30)))
            change = 2 * swap_weight * weights[origin] * (p[origin] - q) / n_pairs
            pull = pull + np.bincount(origin, change * p[origin] * (1 - p[origin]), len(features))
            back = -change * q * (1 - q)
            grad = grad + np.bincount(swap_col, back[swap_row], n_words + 1)
            grad[-1] += back.sum()
        grad = grad + np.bincount(col, pull[row], n_words + 1)
        grad[-1] += pull.sum()
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        theta = theta - rate * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def threshold_shift(z: np.ndarray, labels: np.ndarray, weights: np.ndarray, threshold: float = THRESHOLD) -> float:
    """What to add to the logits so that ``threshold`` cuts where F1 is best, midway between the neighbouring texts."""
    order = np.argsort(-z, kind="stable")
    z, w = z[order], weights[order]
    y = labels[order] * w
    hits, n = np.cumsum(y), y.sum()
    if not 0 < n < w.sum():
        return 0.0
    f1 = 2 * hits / (np.cumsum(w) + n)
    f1[:-1][z[:-1] == z[1:]] = -1.0  # a cut can't part equal scores
    k = int(np.argmax(f1))
    cut = (z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1.0
    return math.log(threshold / (1 - threshold)) - cut


def numbered(rows: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """toxic, words and swapped as numbers in the vocabulary (at most ``MAX_WORDS`` and the identity terms). Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[None if ws is None else sorted(vocabulary[w] for w in ws if w in vocabulary) for ws in batch.column(c).to_pylist()] for c in ("words", "swapped")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(x, pa.list_(pa.int32())) for x in lists)], ["toxic", "words", "swapped"])

    return rows.mapInArrow(run, "toxic int, words array<int>, swapped array<int>")


def fit(labelled: DataFrame, sample: int = SAMPLE, max_words: int = MAX_WORDS, swap_weight: float = SWAP_WEIGHT) -> Classifier:
    """Fit on (doc_id, text, toxic). Rows without a label or text take no part; without rows all scores are 0.5 at most."""
    rows = labelled.where("toxic is not null and text is not null")
    total = rows.count()
    if not total:
        return Classifier({}, 0.0)
    share = min(1.0, sample / total)
    taken = staged(labelled_words(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).select("text", "toxic")), "labelled")
    n, toxic = taken.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n:
        return Classifier({}, 0.0)
    base = toxic / n
    counted = taken.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"), F.sum("toxic").alias("bad"))
    z = (F.col("bad") / F.col("docs") - base) / F.sqrt(F.lit(max(base * (1 - base), 1e-9)) / F.col("docs"))
    kept = counted.where(((F.col("docs") >= MIN_DOCS) & (F.abs(z) >= MIN_Z)) | F.col("word").isin(list(KIND))).orderBy(F.abs(z).desc(), "word").limit(max_words)
    vocabulary = {w: i for i, w in enumerate(sorted({r["word"] for r in kept.select("word").collect()} | set(KIND)))}
    # at most ``sample`` rows of word numbers, equal ones once
    rows = numbered(taken, vocabulary).groupBy("toxic", "words", "swapped").agg(F.count(F.lit(1)).alias("n")).orderBy("toxic", "words", "swapped").toArrow()
    features, swaps = rows["words"].to_pylist(), rows["swapped"].to_pylist()
    truth, weights = rows["toxic"].to_numpy().astype(np.float64), rows["n"].to_numpy().astype(np.float64)
    pairs = [(i, s) for i, s in enumerate(swaps) if s is not None]
    theta, bias = train(features, truth, weights, pairs, len(vocabulary), swap_weight)
    row, col = _rows(features)
    bias += threshold_shift(np.bincount(row, theta[col], len(features)) + bias, truth, weights)
    return Classifier({w: float(theta[i]) for w, i in vocabulary.items()}, bias)


def toxicity(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row; a narrow pass over whole texts.

    A null or empty text gets the model's bias. Null ids are kept, repeated rows are scored each, other columns are
    ignored. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([model.score(t.as_py()) for t in batch.column("text")], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, score double, predicted int")


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_doc_id"), "toxic").where(F.crc32(F.col("l_doc_id").cast("string")) % 3 != 1)
    # the sample is drawn on the narrow side first, so only its texts are joined
    n = labels.where("toxic is not null").count()
    share = min(1.0, SAMPLE / n) if n else 1.0
    drawn = labels.where(F.pmod(F.xxhash64("l_doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    rows = docs.select("doc_id", "text").join(drawn, docs["doc_id"] == F.col("l_doc_id")).select("doc_id", "text", "toxic")
    model = fit(staged(rows, "toxic-sample"))
    return toxicity(docs, model).select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", "predicted")
