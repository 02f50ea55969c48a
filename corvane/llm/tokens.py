"""Encoding of texts with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern; each distinct word of a worker's batches is
folded once: of all neighbouring byte pieces the pair whose union has the lowest rank merges, until
no union has a rank. Words repeat, so nearly every occurrence is one lookup in a bounded table, and
the encoding needs no shuffle. Decoding concatenates the byte pieces of the ids.

Defined results
    null and empty texts: an empty list of ids; an empty or null list of ids: an empty text.
    strings that look like special tokens are ordinary text. Ids without a piece decode to nothing;
    bytes that aren't UTF-8 decode to U+FFFD. Repeated rows: one row each. Texts of any length whole.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts a text into words, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their ids by a worker; beyond, the table starts anew.
KNOWN_WORDS = 400_000
#: Longer words are neither kept nor folded by plain scans.
LONG_WORD = 64


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Bpe:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(k): int(v) for k, v in (line.split() for line in f if line.strip())}
        self.pieces = {v: k for k, v in self.ranks.items()}
        self.words = regex.compile(PATTERN).findall
        self.known = _Known(self)

    def fold(self, word: bytes) -> list[int]:
        """Ranked merges over the bytes of a word."""
        ranks = self.ranks
        if (r := ranks.get(word)) is not None:
            return [r]
        if len(word) > LONG_WORD:
            return self._fold_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        pair = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
        while pair and (least := min(pair)) != _NONE:
            i = pair.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        return [ranks[p] for p in parts]

    def _fold_long(self, word: bytes) -> list[int]:
        """The same merges by a heap of pairs over linked pieces, for words of any length."""
        n, ranks = len(word), self.ranks
        end = list(range(1, n + 1))  # the piece that starts at i ends before end[i]; 0: merged away
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := prev[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        return np.fromiter(chain.from_iterable(map(self.known.__getitem__, self.words(text))), np.int32)

    def decode(self, ids: list[int] | None) -> str:
        return b"".join(self.pieces.get(i, b"") for i in (ids if ids is not None else ())).decode("utf-8", "replace")


_NONE = 1 << 60


class _Known(dict):
    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> list[int]:
        ids = self.bpe.fold(word.encode("utf-8", "replace"))
        if len(word) <= LONG_WORD:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row. ``path``: the vocabulary file, which every executor must have."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe(path)
        for batch in batches:
            found = [enc.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>")


def count(docs: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """The ``keep`` columns of each row and n_tokens of its text."""
    path = path or vocabulary()
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe(path)
        for batch in batches:
            n = pa.array([len(enc.encode(t)) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    rows = docs.select(*[F.col(k) for k in keep], F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", n_tokens long")


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Adds ``text`` of the list of ids to each row."""
    path = path or vocabulary()

    @F.pandas_udf("string")
    def run(ids):
        enc = bpe(path)
        return ids.map(enc.decode)

    return encoded.withColumn("text", run(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))))
