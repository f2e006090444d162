"""Alignment of two vocabularies against a plain walk over both token lists, and the matrices against dense products."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers as public

from pyspark.sql import functions as F

from lucerna.llm import alignment

SCHEMA = "doc_id long, text string, pair int, n int, block string, found string"
TEXTS = [
    None, "", " ", "  ", " a", "a  b", "a ", "\n x\t y\n\n z", "a▁b c", "日本語 テキスト", "a\x00b c", "<|endoftext|> <s> </s> <0x0A>", "😀😀 x", "é é", "x" * 5000, "a b" * 3000,
    " \n ", "\ufeffx", "\xa0x　y z", "-----------   ======  ", "1234567890123 " * 30, "\x1c x \x85 y", "e" + " " * 50 + "f", "same words here", "same words here", "the quick brown fox, jumped! over the lazy dog's back.\n" * 40,
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


def byte_letters():
    """The letters that stand for bytes in the byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def slow(texts, a_side, b_side):
    letters = byte_letters()
    docs, count, best = [], Counter(), {}
    for t in texts:
        docs.append(None)
        if not t:
            continue
        a, b = a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)
        a_bytes = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode():
            continue
        i = j = a_at = b_at = 0
        one, other, groups = [], [], []
        while i < len(a) or j < len(b):
            if a_at <= b_at and i < len(a):
                one.append(a[i])
                a_at, i = a_at + len(a_bytes[i]), i + 1
            else:
                other.append(b[j])
                b_at, j = b_at + len(b_bytes[j]), j + 1
            if a_at == b_at:
                groups.append((one, other))
                one, other = [], []
        links = Counter((p, q) for x, y in groups for p in x for q in y)
        count.update(links.keys())
        docs[-1] = (a, b, groups, links)
    for (p, _), c in count.items():
        best[p] = max(best.get(p, 0), c)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = d
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best = sum(c for k, c in links.items() if count[k] == best[k[0]])
        out.append((len(a), len(b), len(groups), sum(links.values()), n_best, sum(c * count[k] for k, c in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("chars", [50, 2_000_000])
def test_digest_equals_a_plain_walk(spark, libraries, chars):
    df = spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.alignment_digest(df, chars=chars, rows_per_slice=4).collect()}
    assert [got[i] for i in range(len(TEXTS))] == slow(TEXTS, *libraries)


def test_digest_on_the_given_documents(spark, sf, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.alignment_digest(docs).collect()}
    assert [got[r["doc_id"]] for r in rows] == slow([r["text"] for r in rows], *libraries)


def test_repeated_and_null_ids_and_no_rows(spark):
    same = [(None, "one two", 0, 0, "", ""), (4, "one two", 0, 0, "", ""), (4, "one two", 0, 0, "", ""), (4, None, 0, 0, "", "")]
    rows = alignment.alignment_digest(spark.createDataFrame(same, SCHEMA)).collect()
    assert sorted((r["doc_id"] is None, r["n_a"], r["count_sum"]) for r in rows) == [(False, 0, 0), (False, 2, 6), (False, 2, 6), (True, 2, 6)]
    none = spark.createDataFrame([], SCHEMA)
    assert alignment.alignment_digest(none).collect() == [] and alignment.align_tokens(none).collect() == []


def test_overlaps_are_shared_bytes(spark, libraries):
    df = spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in enumerate(TEXTS)], SCHEMA)
    for r in alignment.align_tokens(df).collect():
        text = TEXTS[r["doc_id"]]
        if not r["a_ids"]:
            assert not r["b_ids"] and not r["overlaps"]
            continue
        assert r["a_ids"] == libraries[0].encode(" " + text, add_special_tokens=False).ids and r["b_ids"] == libraries[1].encode(text)
        assert sum(x["bytes"] for x in r["overlaps"]) == len((" " + text).encode())
        assert r["groups"][-1] == (len(r["a_ids"]) - 1, len(r["b_ids"]) - 1)
        ends = {(x["a"], x["b"]) for x in r["overlaps"]}
        assert all((g["a_end"], g["b_end"]) in ends for g in r["groups"])


def test_row_products_equal_dense_ones():
    rng = np.random.default_rng(2)
    for cells in (3, 1000):
        a, b = rng.integers(0, 3, (9, 14)) * rng.integers(0, 2, (9, 14)), rng.integers(0, 3, (6, 14)) * rng.integers(0, 2, (6, 14))
        sparse = [alignment.csr(*np.nonzero(m), m[np.nonzero(m)], m.shape) for m in (a, b)]
        out = np.zeros((9, 6), dtype=np.int64)
        for row, column, value in alignment.row_products(sparse[0], alignment.transposed(sparse[1]), cells):
            out[row, column] += value
        assert (out == a @ b.T).all()


def test_no_piece_joins_a_space_to_what_is_before_it(libraries):
    """Why texts may be cut: in the second vocabulary a space stands only at the start of a piece."""
    model = libraries[1]
    assert not [p for p in map(model.id_to_piece, range(model.vocab_size())) if "\u2581" in p.lstrip("\u2581")]


def test_a_file_holds_few_blocks(spark, monkeypatch):
    """A reader decodes the rows of a file together, and a block's lists are megabytes."""
    staged, stage = [], alignment.Stage
    monkeypatch.setattr(alignment, "Stage", lambda df, name, *rest: staged.append((name, stage(df, name, *rest))) or staged[-1][1])
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(50)], "doc_id long, text string").coalesce(1)
    assert alignment.alignment_digest(docs, chars=1).count() == 50
    blocks = dict(staged)["aligned"].df
    sizes = [r["count"] for r in blocks.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 50 and max(sizes) <= 16
