"""Splitting oversized items at natural boundaries.

Method: dynamic programming over boundary positions. A cut before a commit costs nothing, before a
file, a line, a word or inside a word ever more; the square of a piece's distance from the even size
is added, and the cheapest cuts are taken such that no piece, its overlap with the one before
included, exceeds the limit. Only items above the limit leave the JVM.

Sizes are estimated tokens of four characters (code points): ceil(characters / 4).

Defined results
    null and empty contents and contents within the limit: one piece (``split``), or none where only
    oversized items are asked for. Rows repeated with the same content: once, with the sorted union
    of their hash lists. Pieces cover the content; each starts ``overlap`` before the end of the last.
    ``commit_hashes``: hashes of the headers whose lines the piece holds, as listed by the item, else
    the seven digits of the header; text before the first header belongs to the listed hashes without a
    header, or to the first header if there are none; items without headers name all hashes in each piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
#: Characters of pieces that go back to the JVM at once.
FRAME_CHARS = 4_000_000
_HEADER = regex.compile(r"\[([0-9a-f]{7})\] \d{4}-\d{2}-\d{2} ")
_LINE = regex.compile(r"(?:\r\n|\n|\r)+")
_FILE = regex.compile(r"(?:  |--- )\S.* \+\d+-\d+[ \t]*(?=[\r\n]|$)")
_WORD = regex.compile(r"\s+")
#: Cost of a cut before a commit, a file, a line, a word, and inside a word.
COMMIT, FILE, LINE, WORD, INSIDE = 0.0, 0.5, 1.0, 2.5, 6.0


def boundaries(text: str, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the text may be cut, ascending, and the cost of each."""
    cost: dict[int, float] = {}
    for m in _LINE.finditer(text):
        cost[m.end()] = FILE if _FILE.match(text, m.end()) else LINE
    for m in _HEADER.finditer(text):
        cost[m.start()] = COMMIT
    # Where lines are so long that sizes would suffer, words are boundaries too, and where those are, characters.
    for finder, price in ((_WORD, WORD), (None, INSIDE)):
        known = sorted({0, len(text), *cost})
        far = max(1, room // 8)
        for a, b in zip(known, known[1:]):
            if b - a > far:
                places = (m.end() for m in finder.finditer(text, a, b)) if finder else range(a + far, b, far)
                for p in places:
                    if price == INSIDE:
                        planned = p
                        while p < b and (regex.match(r"\p{M}", text[p]) or text[p - 1 : p + 1] == "\r\n"):
                            p += 1
                        if p - planned > far or p >= b:  # nothing but marks: cut anyway
                            p = planned
                    cost.setdefault(p, price)
    at = np.array(sorted(p for p in cost if 0 < p < len(text)), np.int64)
    return at, np.array([cost[p] for p in at.tolist()])


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces; piece i starts ``overlap`` before the end of piece i - 1."""
    n = len(text)
    if n <= limit:
        return [n]
    room = limit - overlap
    at, cost = boundaries(text, room)
    keep = at >= overlap
    at, cost = np.concatenate([at[keep], [n]]), np.concatenate([cost[keep], [0.0]])
    pieces = 1 + -(-(n - limit) // room)
    even = n / pieces
    best, back = np.full(len(at), np.inf), np.full(len(at), -1)
    low = np.searchsorted(at, at - room)
    for j in range(len(at)):
        if at[j] <= limit:
            best[j] = cost[j] + 1 + ((at[j] - even) / even) ** 2
        i = low[j]
        if i < j:
            tried = best[i:j] + ((at[j] - at[i:j] - even) / even) ** 2
            k = int(np.argmin(tried))
            if tried[k] + cost[j] + 1 < best[j]:
                best[j], back[j] = tried[k] + cost[j] + 1, i + k
    ends, j = [], len(at) - 1
    while j >= 0:
        ends.append(int(at[j]))
        j = back[j]
    return ends[::-1]


def pieces(text: str, hashes: list[str], limit: int, overlap: int) -> list[dict]:
    full = {}
    for h in sorted({h for h in hashes if h}):
        full.setdefault(h[:7].lower(), h)
    heads = [(m.start(), full.get(m[1], m[1])) for m in _HEADER.finditer(text)]
    stops = [p for p, _ in heads[1:]] + [len(text)]
    if heads and heads[0][0] > 0 and text[: heads[0][0]].strip():
        headed = {h for _, h in heads}
        before = [h for h in dict.fromkeys(hashes) if h and h not in headed] or [heads[0][1]]
        heads, stops = [(0, h) for h in before] + heads, [heads[0][0]] * len(before) + stops
    out, ends = [], cuts(text, limit, overlap)
    for i, end in enumerate(ends):
        start = 0 if i == 0 else max(0, ends[i - 1] - overlap)
        named = [h for (p, h), stop in zip(heads, stops) if p < end and stop > start] if heads else list(hashes)
        out.append({"piece": i, "n_pieces": len(ends), "start": start, "stop": end, "content": text[start:end], "commit_hashes": list(dict.fromkeys(named))})
    return out


def split(
    units: DataFrame,
    max_tokens: int = 1200,
    overlap_tokens: int = 100,
    id_col: str = "id",
    text_col: str = "content",
    hashes_col: str = "commit_hashes",
    oversized_only: bool = False,
) -> DataFrame:
    """(id, item, piece, n_pieces, start, stop, content, commit_hashes) in code points of the content; ``item`` is a hash of the whole content."""
    if not 0 <= overlap_tokens < max_tokens:
        raise ValueError("the overlap must be smaller than the limit")
    limit, overlap = max_tokens * CHARS_PER_TOKEN, overlap_tokens * CHARS_PER_TOKEN
    rows = units.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("content"), F.coalesce(F.col(hashes_col), F.array().cast("array<string>")).alias("commit_hashes")
    )
    large = F.coalesce(F.length("content") > limit, F.lit(False))
    schema = "id string, item long, piece int, n_pieces int, start long, stop long, content string, commit_hashes array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, chars = [], 0
            for r in batch.itertuples(index=False):
                held += [{"id": r.id, "item": r.item, **p} for p in pieces(r.content, list(r.commit_hashes), limit, overlap)]
                chars += len(r.content)
                if chars > FRAME_CHARS:
                    yield pd.DataFrame(held)
                    held, chars = [], 0
            if held:
                yield pd.DataFrame(held)

    union = F.array_sort(F.array_distinct(F.flatten(F.collect_set("commit_hashes")))).alias("commit_hashes")
    item = F.xxhash64("content").alias("item")
    once = rows.where(large).groupBy("id", "content").agg(union).select("id", item, "content", "commit_hashes")
    out = once.mapInPandas(run, schema)
    if oversized_only:
        return out
    whole = rows.where(~large).groupBy("id", "content").agg(union)
    return out.unionByName(
        whole.select(
            "id", item, F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.lit(0).cast("long").alias("start"), F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("stop"), "content", "commit_hashes"
        )
    )
