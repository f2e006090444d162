"""Token ids of whole texts, with a cache of the ids of space-separated pieces.

The byte-level pattern of the vocabulary always starts a token at a space that a non-space character follows, so a
text may be cut there and its pieces encoded apart. Pieces repeat, hence most of a text is a dictionary lookup.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lucerna.llm.base import process_cache, ship

ship(__name__)

TOKENIZER = "byte_bpe_50k"
ODD_SPACE = r" (?:[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"  # the same for the columnar engine
SPACE_BEFORE_SPACE = re.compile(r" (?:\s|\Z)")


def encoder(name: str = TOKENIZER) -> "PieceEncoder":
    """One encoder for each Python worker."""
    kept = process_cache("tokens")
    if name not in kept:
        kept[name] = PieceEncoder(name)
    return kept[name]


class _Cache(dict):
    """Piece -> ids as little-endian 16-bit bytes. Once full it takes no more, so memory is bounded; frequent pieces come early."""

    def __init__(self, encode, word, prefix: str, limit: int):
        super().__init__()
        self.encode, self.word, self.prefix, self.limit, self.marks = encode, word, prefix, limit, {}

    def mark(self, marks: str) -> bytes:
        if marks not in self.marks:
            self.marks[marks] = array("H", self.word(marks)).tobytes()
        return self.marks[marks]

    def __missing__(self, piece: str) -> bytes:
        core = piece.rstrip(".,")
        if core.isalpha() and len(core) < 100:  # a run of letters, then a run of marks: two tokens of the pattern
            if len(core) < len(piece):
                out = self[core] + self.mark(piece[len(core) :])
            else:
                out = array("H", self.word(self.prefix + piece)).tobytes()
        else:
            out = array("H", self.encode(self.prefix + piece)).tobytes()
        if len(self) < self.limit and len(piece) < 100:
            self[piece] = out
        return out


class PieceEncoder:
    """Ids of a vocabulary of at most 65536 tokens. Special-token strings in a text are ordinary text."""

    def __init__(self, name: str, cache: int = 400_000, long_piece: int = 50_000):
        import public_tokenizers as public
        import tiktoken

        with open(public.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._json, self._slow, self.long_piece = public.path(f"{name}.json"), None, long_piece
        self.byte_length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.byte_length[i] = len(token)
        self._first = _Cache(self._encode, self._word, "", cache // 8)
        self._rest = _Cache(self._encode, self._word, " ", cache)

    def _word(self, text: str) -> list[int]:
        return self._fast._encode_single_piece(text)

    def _encode(self, text: str) -> list[int]:
        if len(text) < self.long_piece:
            return self._fast.encode_ordinary(text)
        if self._slow is None:  # one unbroken piece of this length would run the fast one's pattern out of stack
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._json)
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text, unsigned 16-bit."""
        if not text:
            return np.zeros(0, dtype="<u2")
        first, *rest = text.split(" ")
        if SPACE_BEFORE_SPACE.search(text):
            # a space before white space belongs to what stands before it
            merged = [first]
            for p in rest:
                if p == "" or p[0].isspace():
                    merged[-1] += " " + p
                else:
                    merged.append(p)
            first, *rest = merged
        return np.frombuffer(self._first[first] + b"".join(map(self._rest.__getitem__, rest)), dtype="<u2")

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many whole texts, one after another, and where each text's ids start (one entry more than texts).

        Distinct pieces are found column-wise; only those reach Python. Null counts as empty.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
        huge = pc.greater(pc.utf8_length(texts), self.long_piece * 8).to_numpy(zero_copy_only=False)
        plain = ~(odd | huge)
        pieces = pc.split_pattern(pc.if_else(pa.array(plain), texts, ""), " ")
        at = pieces.offsets.to_numpy().astype(np.int64) - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        first = pieces.flatten().take(pa.array(at[:-1])).to_pylist()
        known = [self._rest[p] for p in coded.dictionary.to_pylist()] + [self._first[p] if p else b"" for p in first]
        for i in np.flatnonzero(~plain):
            known[len(coded.dictionary) + i] = self.ids(texts[int(i)].as_py()).tobytes()
        code[at[:-1]] = len(coded.dictionary) + np.arange(len(first))
        size = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 2
        start = np.cumsum(size) - size
        vocabulary = np.frombuffer(b"".join(known), dtype="<u2")
        length = size[code]
        end = np.cumsum(length)
        flat = vocabulary[np.repeat(start[code] - (end - length), length) + np.arange(end[-1] if len(end) else 0)]
        return flat, np.concatenate([[0], end])[at]


def slices(batch: pa.RecordBatch, column: str, chars: int):
    """Parts of a batch whose texts hold about ``chars`` characters, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + chars, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
