import pytest

from corvane.llm import tokens as T

TEXTS = [
    None, "", " ", "hello world", "Hello  World\n\n\tfoo", "<|endoftext|> is text", "don't they'll we've I'M", "naïve café — “quotes” …", "日本語のテキストと漢字", "Привет, мир!", "😀👩‍👩‍👧‍👦 emoji", " 　spaces x ",
    "a" * 5000, "ab" * 3000, "字" * 2000, "x" * 63 + " " + "y" * 65, "1234567890" * 20, "tab\tand\r\nline", "\x00\x01\x7f", "é́̂combining", " " * 500 + "end", "def f(x):\n    return x+1\n" * 30, "ﬁ ligature Ⅷ ½ ²",
]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_reference_and_decode_back(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "hello world", "y")], "doc_id long, text string, ids string")
    enc = T.encode(df)
    got = {}
    for r in enc.collect():
        got.setdefault(r.doc_id, r.ids)
    for i, t in enumerate(TEXTS):
        assert got[i] == (reference(t) if t else []), repr(t)
    back = {r.doc_id: r.text for r in T.decode(enc).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    counts = {r.doc_id: r.n_tokens for r in T.count(df, ["doc_id"]).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


def test_long_words_fold_like_short_ones(monkeypatch):
    b = T.bpe(T.vocabulary())
    for w in ("abcabcabd" * 6, "the" * 20, "zzzzzzzzz" * 7, "internationalisation" * 3):
        w = w.encode()[:64]
        assert b._fold_long(w) == b.fold(w)


def test_empty_table_unknown_ids_and_bounded_words(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert T.encode(empty).count() == 0
    df = spark.createDataFrame([([10_000_000, 31373],), (None,)], "ids array<int>")
    assert sorted(r.text for r in T.decode(df).collect()) == ["", "hello"]
    monkeypatch.setattr(T, "KNOWN_WORDS", 3)
    b = T.Bpe(T.vocabulary())
    assert b.encode("one two three four five six one two").tolist() == T.bpe(T.vocabulary()).encode("one two three four five six one two").tolist()
    assert len(b.known) <= 3
