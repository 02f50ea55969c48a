import random
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import splitting as S

UNIT = "id string, content string, commit_hashes array<string>, piece int, start string"


def check(text, limit, overlap):
    out = S.pieces(text, [], limit, overlap)
    assert out[0]["start"] == 0 and out[-1]["stop"] == len(text)
    for a, b in zip(out, out[1:]):
        assert b["start"] == a["stop"] - overlap and b["stop"] > a["stop"]
    assert all(len(p["content"]) <= limit and p["content"] == text[p["start"] : p["stop"]] for p in out)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "字", " ", "\n", "\r\n", "́", "[0123abc] 2024-01-01 x\n", "  src/a.ts +1-2\n", "word ", "é" * 30]), max_size=300), st.sampled_from([(40, 8), (60, 0), (100, 30)]))
def test_pieces_cover_within_the_limit_and_overlap(parts, size):
    check("".join(parts), *size)


def test_cuts_are_natural():
    commit = lambda h, n: f"[{h}] 2024-01-0{n} Ann\nmessage {n}\n" + "".join(f"  src/f{k}.ts +1-2\n" for k in range(12)) + "\n"
    text = commit("aaaaaaa", 1) + commit("bbbbbbb", 2) + commit("ccccccc", 3)
    out = S.pieces(text, ["bbbbbbb" + "0" * 33, None, "aaaaaaa" + "1" * 33], 300, 40)
    assert [text[p["stop"] :][:9] for p in out[:-1]] == ["[bbbbbbb]", "[ccccccc]"]
    assert [p["commit_hashes"] for p in out] == [["aaaaaaa" + "1" * 33], ["aaaaaaa" + "1" * 33, "bbbbbbb" + "0" * 33], ["bbbbbbb" + "0" * 33, "ccccccc"]]


def least_cost(text, limit, overlap):
    """Least cost over all sequences of cuts, by plain recursion over the boundaries."""
    at, cost = S.boundaries(text, limit - overlap)
    price = {p: c for p, c in zip(at.tolist(), cost.tolist()) if p >= overlap} | {len(text): 0.0}
    even = len(text) / (1 + -(-(len(text) - limit) // (limit - overlap)))

    @lru_cache(None)
    def rest(last):
        if last == len(text):
            return 0.0
        room = limit if last == 0 else limit - overlap
        return min((c + 1 + ((p - last - even) / even) ** 2 + rest(p) for p, c in price.items() if last < p <= last + room), default=float("inf"))

    def of(ends):
        return sum(price[e] + 1 + ((e - s - even) / even) ** 2 for s, e in zip([0, *ends], ends))

    return rest(0), of


def test_the_dynamic_program_finds_the_least_cost():
    rng = random.Random(5)
    for _ in range(40):
        text = "".join(rng.choice(["ab ", "abc\n", "x" * 7, "  p/q +1-1\n"]) for _ in range(20))
        least, of = least_cost(text, 24, 4)
        if len(text) > 24:
            assert of(S.cuts(text, 24, 4)) == pytest.approx(least)


def test_rows(spark):
    data = [
        ("null", None, ["h"]), ("empty", "", None), ("fits", "x" * 4800, ["h"]), ("over", "x" * 4801, ["h"]), ("over", "x" * 4801, None), ("over", "x" * 4801, ["h", "i"]),
        (None, "y" * 5000, None), ("long", "word " * 200_000, []),
    ]
    df = spark.createDataFrame([(*d, 1, "s") for d in data], UNIT)
    out = S.split(df).collect()
    by = {}
    for r in out:
        by.setdefault(r.id, []).append(r)
    assert [(r.n_pieces, r.content) for r in by["null"] + by["empty"]] == [(1, None), (1, "")]
    assert len(by["fits"]) == 1 and len(by["over"]) == 2 and by["over"][0].commit_hashes == ["h", "i"] and len(by[None]) == 2
    longs = sorted(by["long"], key=lambda r: r.piece)
    assert "".join(r.content[400 if r.piece else 0 :] for r in longs) == "word " * 200_000 and max(len(r.content) for r in longs) <= 4800
    assert S.split(df, oversized_only=True).select("id").distinct().count() == 3
    assert S.split(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.split(df, 10, 10)


def test_text_before_the_first_header_has_its_hashes():
    text = "lead " * 20 + "\n[aaaaaaa] 2024-01-01 Ann\n" + "x y " * 40
    full = ["aaaaaaa" + "1" * 33, "ccccccc" + "2" * 33]
    assert [p["commit_hashes"] for p in S.pieces(text, full, 120, 10)][0] == [full[1]]
    assert S.pieces(text, full[:1], 120, 10)[0]["commit_hashes"] == [full[0]]
    assert S.pieces(text, [], 120, 10)[0]["commit_hashes"] == ["aaaaaaa"]
