"""Repetition inside a single document.

Method: repetition coverage. Words, word runs and lines get 64-bit rolling hashes from prefix sums
over the code points in numpy; a run that occurred earlier in its document covers its words, and the
covered words, characters and lines are measured against all of them. Documents are taken together
in chunks of about ``CHUNK_CHARS`` characters; each is whole, whatever its length.

Defined results
    words: runs of letters in lower case; each Han, Hiragana or Katakana character is a word.
    null, empty and wordless texts: 0 words, every share 0. Repeated rows: one row each.
    texts shorter than the run: share 0. Lines: without outer blanks; blank lines don't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters handled at once (8-byte arrays of that length are held about ten times).
CHUNK_CHARS = 1_000_000
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_C = np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 a character that is a word by itself; by code point."""
    table = np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((1, r"\p{L}+"), (2, r"[\p{Han}\p{Hiragana}\p{Katakana}&&\p{L}]+")):
        for m in regex.finditer(pattern, points, regex.V1):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = 0
    return table


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _earlier(keys: np.ndarray) -> np.ndarray:
    """For each key whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    return out


def measure(texts: list[str | None], runs: tuple[int, ...] = (6,), lines: bool = False) -> dict[str, np.ndarray]:
    """n_words, n_chars (of words), and per run length n words_n and chars_n covered; with lines also line_chars and line_rep."""
    low = [(t or "").lower() for t in texts]
    n_docs = len(low)
    code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in low])
    last = ends - 1  # the line ends that were put between the documents
    hashed = _mix(code.astype(np.uint64) + np.uint64(1)) * _powers(_B, len(code))[:-1]
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed, dtype=np.uint64)])
    inverse = _powers(_B_INV, len(code))

    def span(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((prefix[b] - prefix[a]) * inverse[a] + (b - a).astype(np.uint64))

    kind = _classes()[code]
    kind[last] = 0
    before, after = np.concatenate([[0], kind[:-1]]), np.concatenate([kind[1:], [0]])
    a = np.flatnonzero((kind == 2) | ((kind == 1) & (before != 1)))
    b = np.flatnonzero((kind == 2) | ((kind == 1) & (after != 1))) + 1
    doc = np.searchsorted(ends, a, "right")
    words, chars = span(a, b), (b - a).astype(np.float64)
    out = {"n_words": np.bincount(doc, minlength=n_docs), "n_chars": np.bincount(doc, chars, n_docs).astype(np.int64)}
    salt = _mix(np.arange(n_docs, dtype=np.uint64) * _B + _C)
    for n in runs:
        m = max(0, len(words) - n + 1)
        covered = np.zeros(len(words), bool)
        if m:
            key = np.zeros(m, np.uint64)
            for j in range(n):
                key = key * _C + words[j : j + m]
            at = np.flatnonzero(doc[:m] == doc[n - 1 :])
            hit = at[_earlier(_mix(key[at]) ^ salt[doc[at]])]
            step = np.bincount(hit, minlength=len(words) + 1).astype(np.int64) - np.bincount(hit + n, minlength=len(words) + 1)[: len(words) + 1]
            covered = np.cumsum(step)[:-1] > 0
        out[f"words_{n}"] = np.bincount(doc, covered, n_docs).astype(np.int64)
        out[f"chars_{n}"] = np.bincount(doc, chars * covered, n_docs).astype(np.int64)
    if lines:
        stop = np.flatnonzero(code == 10)
        start = np.concatenate([[0], stop[:-1] + 1])
        blank = np.isin(code, np.array([9, 10, 11, 12, 13, 32, 160, 0x3000], np.uint32))
        filled = np.flatnonzero(~blank)
        first, end = np.searchsorted(filled, start), np.searchsorted(filled, stop)
        some = first < end
        la, lb = filled[first[some]], filled[end[some] - 1] + 1
        ldoc = np.searchsorted(ends, la, "right")
        again = _earlier(span(la, lb) ^ salt[ldoc])
        size = (lb - la).astype(np.float64)
        out["line_chars"] = np.bincount(ldoc, size, n_docs).astype(np.int64)
        out["line_rep"] = np.bincount(ldoc, size * again, n_docs).astype(np.int64)
    return out


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: tuple[int, ...] = (3, 6, 12), lines: bool = True) -> DataFrame:
    """(doc_id, n_words, n_chars, words_n and chars_n per run length, line_chars, line_rep) of each row."""
    names = ["n_words", "n_chars", *[f"{x}_{n}" for n in runs for x in ("words", "chars")], *(["line_chars", "line_rep"] if lines else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["t"].tolist()
            i = 0
            while i < len(texts):
                j, total = i, 0
                while j < len(texts) and (j == i or total + len(texts[j] or "") <= CHUNK_CHARS):
                    total += len(texts[j] or "")
                    j += 1
                out = pd.DataFrame(measure(texts[i:j], runs, lines))
                out.insert(0, "id", batch["id"].iloc[i:j].to_numpy())
                yield out
                i = j

    kind = dict(docs.dtypes)[id_col]
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names))
    return found.withColumnRenamed("id", id_col)


def share(part: str, whole: str) -> F.Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
