import random

import regex

from corvane.llm import repetition as R

WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}&&\p{L}]|[\p{L}--[\p{Han}\p{Hiragana}\p{Katakana}]]+", regex.V1)


def brute(text, n):
    w = WORD.findall((text or "").lower())
    seen, hit = set(), set()
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            hit |= set(range(i, i + n))
        seen.add(g)
    return len(w), len(hit), sum(len(x) for x in w), sum(len(w[i]) for i in hit)


TEXTS = [
    None, "", "   \n", "one two three", "a b c d e f " * 3, "a b c d e f a b c d e f", "Ä ö Ü é ß a " * 4, "漢字かなカナ漢字かなカナ漢字かなカナ", "mixed漢字word mixed漢字word mixed漢字word", "x1y2z_q " * 9, "same line here\n" * 5,
    "İstanbul É " * 10, "word\r\n\r\nword\r\n", "́á b c d e f g " * 2, "no repetition in this sentence at all today", "a " * 7, "a " * 6,
]


def test_words_equal_brute_force():
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(150)]
    got = R.measure(texts, (3, 6, 12), True)
    for i, t in enumerate(texts):
        for n in (3, 6, 12):
            assert (got["n_words"][i], got[f"words_{n}"][i], got["n_chars"][i], got[f"chars_{n}"][i]) == brute(t, n), (t, n)


def test_lines():
    got = R.measure(["ab\n ab \ncd\n\n\nab", "x", None, "x\ny"], (6,), True)
    assert got["line_chars"].tolist() == [8, 1, 0, 2] and got["line_rep"].tolist() == [4, 0, 0, 0]


def test_chunks_do_not_matter(spark, monkeypatch):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "a b c d e f " * 3, 1), (4, TEXTS[4], 1), (77, "spam and eggs on toast again " * 40_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    want = sorted(map(repr, R.repetition(df).collect()))
    monkeypatch.setattr(R, "CHUNK_CHARS", 20)
    assert sorted(map(repr, R.repetition(df).collect())) == want
    assert R.repetition(df.limit(0)).count() == 0
    shares = {r.doc_id: r.s for r in R.repetition(df).withColumn("s", R.share("words_6", "n_words")).collect()}
    assert shares[0] == 0.0 and shares[77] > 0.99
