"""Variant spellings of names typed by people.

Method
    1. Every entity has views: its name, its aliases and, where they resemble the name, the local
       parts of its e-mail addresses (its own, and those that commits carry beside the name). A view is
       a bag of folded tokens; a user name without separators is also read as surname plus initial.
    2. MinHash banding over padded q-grams of the telling tokens of all views. ``tune`` takes rows and
       bands from the collision curve: one edit in a token must share a band with the asked-for recall.
       The sketch is of distinct tokens, so a group of equal names is one item of it.
    3. Views whose telling tokens collide and are within one edit are verified by Monge-Elkan similarity:
       the mean, over the tokens of the shorter view, of the best token similarity in the other, where
       initials, short forms and single typos count and a token without any partner rejects.
    4. Star clustering: full spellings with most links become centres, others join their best centre.

Views of a token that more than ``HOT`` entities share (given names, or a surname of a third of all rows)
are compared as distinct bags of tokens, and only where a further token of both can match by its
``match_keys``, which leave out no match; matches are links to one entity of a bag, so a name that many
share costs one link a row for each spelling of it.

Defined results
    null or blank names: no views; such an entity is alone. Repeated rows of an id: all their names
    are views. Ids are compared as they are. Very long names: whole. Empty tables: no pairs.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Entities that may share a token which is compared on its own.
HOT = 200
#: Names of one bucket that a task compares at once; larger buckets are cut and their parts compared crosswise.
BUCKET = 400
#: Shortest token that is telling. Shorter ones, down to two letters, are compared like common ones.
TELLING = 5
#: Jaccard of a swap in a whole name of 14 letters.
WHOLE = 0.6
Q = 3
#: Letters that a short form may leave out after a beginning, and before an ending.
BEGINNING, ENDING = 9, 5

#: Widely used short forms of given names that no rule gives (beginnings, ends and forms like Danny or Debbie follow by rule).
SHORT_FORMS = {
    "abigail": "gail",
    "albert": "bertie",
    "alexander": "alec alek sandy sasha sascha",
    "alexandra": "sandra sasha",
    "andrew": "andy drew",
    "anthony": "tony",
    "barbara": "babs",
    "benjamin": "benji",
    "catherine": "kate katie kathy kitty kit",
    "charles": "chuck",
    "christina": "tina",
    "christopher": "kit topher",
    "david": "dave",
    "dmitri": "dima mitya",
    "dorothy": "dot dolly dottie",
    "edward": "ted teddy ned",
    "ekaterina": "katya katia kate",
    "eleanor": "nell nelly",
    "elizabeth": "betsy betty bess liz lizzie liza lisa",
    "florence": "flossie",
    "frances": "frankie",
    "francis": "frank frankie",
    "francisco": "paco pancho",
    "gabriela": "gabby",
    "gerald": "jerry",
    "giuseppe": "beppe",
    "harold": "hal harry",
    "helen": "nell",
    "henry": "hank harry hal",
    "jacob": "jake",
    "james": "jim jimmy",
    "joao": "joca",
    "john": "jack",
    "jonathan": "john johnny jonny",
    "jose": "pepe",
    "joseph": "joe",
    "katherine": "kate katie kathy kitty kit",
    "lawrence": "larry",
    "margaret": "peggy peg meg maggie greta",
    "martha": "patty",
    "mary": "molly polly",
    "matilda": "tilly",
    "michael": "mike mikey mick mickey micky",
    "mikhail": "misha",
    "mohamed": "mohammed muhammad mohammad",
    "nicholas": "nick nicky nico klaus",
    "patricia": "trish",
    "patrick": "paddy",
    "rebecca": "becky becca",
    "richard": "dick rick ricky",
    "robert": "bob bobby",
    "sarah": "sally sadie",
    "stephen": "steve",
    "susan": "suzy",
    "tatiana": "tanya tania",
    "theodore": "ted teddy",
    "thomas": "tom tommy",
    "victoria": "vicky vicki tori",
    "virginia": "ginny",
    "vladimir": "vova volodya",
    "william": "bill billy",
    "yevgeny": "zhenya",
    "zachary": "zack zak",
}
#: Words of team names that tell nothing.
GENERIC = ["the", "team", "group", "squad", "crew", "lists", "list"]

_ROOTS: dict[str, set[str]] = {}
for _full, _forms in SHORT_FORMS.items():
    for _f in (_full, *_forms.split()):
        _ROOTS.setdefault(_f, set()).add(_full)


def _fold_table() -> tuple[str, str]:
    """Letters with marks and their base letters, from the Unicode decompositions."""
    a, b = "łŁøØđĐħŧı", "lLoOdDhti"
    for p in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(p))[0]
        if base != chr(p) and base.isascii() and base.isalpha():
            a, b = a + chr(p), b + base
    return a, b


_FOLD = _fold_table()


def name_tokens(c: Column) -> Column:
    """Folded tokens of a name, without bracketed notes; two capitals side by side are initials."""
    x = F.translate(c, *_FOLD)
    x = F.regexp_replace(x, r"[̀-ͯ]", "")
    x = F.regexp_replace(x, r"[(\[{][^)\]}]*[)\]}]", " ")
    x = F.regexp_replace(x, r"(?<!\p{L})(\p{Lu})(\p{Lu})(?!\p{L})", "$1 $2")
    generic = F.array(*map(F.lit, GENERIC))
    return F.filter(F.split(F.lower(x), r"[^\p{L}]+"), lambda t: (t != "") & ~F.array_contains(generic, t))


def views(people: DataFrame, authors: DataFrame | None) -> DataFrame:
    """(id, tokens, kind): kind 0 name, 1 alias, 2 e-mail, 3 a reading of a user name."""
    rows = people.select("id", "name", "aliases", F.element_at("metadata", "email").alias("email")).where("id is not null")
    named = rows.select("id", F.col("name").alias("said"), F.lit(0).alias("kind")).unionByName(
        rows.select("id", F.explode("aliases").alias("said"), F.lit(1).alias("kind"))
    )
    named = named.select("id", name_tokens(F.col("said")).alias("tokens"), "kind").where(F.size("tokens") > 0).groupBy("id", "tokens").agg(F.min("kind").alias("kind"))
    mail = rows.select("id", "name", "email")
    if authors is not None:
        plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
        said = authors.select(plain(F.col("author_name")).alias("key"), F.lower(F.trim("author_email")).alias("email")).where("key <> '' and email like '%@%'").distinct()
        mail = mail.unionByName(rows.select("id", "name", plain(F.col("name")).alias("key")).distinct().join(said, "key").select("id", "name", "email"))
    local = F.substring_index(F.lower(F.translate(F.col("email"), *_FOLD)), "@", 1)
    # An address that doesn't resemble the name (shared boxes, build machines) says nothing about it.
    like = F.exists(
        name_tokens(F.col("name")),
        lambda t: (F.length(t) >= 4)
        & (F.contains(local, t) | ((F.length(t) >= 6) & (F.contains(local, F.substr(t, F.lit(2))) | F.contains(local, F.substr(t, F.lit(1), F.length(t) - 1))))),
    )
    mail = mail.where(F.col("email").isNotNull() & like).select("id", F.filter(F.split(local, r"[^\p{L}]+"), lambda t: t != "").alias("tokens"), F.lit(2).alias("kind"))
    # Addresses of more parts repeat a display name, often with letters missing.
    both = named.unionByName(mail.where(F.size("tokens").between(1, 2)).distinct()).groupBy("id", "tokens").agg(F.min("kind").alias("kind"))
    t, n = F.col("tokens")[0], F.length(F.col("tokens")[0])
    readings = F.array(
        F.array(F.substr(t, F.lit(1), n - 1), F.substr(t, n)),
        F.array(F.substr(t, F.lit(2)), F.substr(t, F.lit(1), F.lit(1))),
        F.array(F.substr(t, F.lit(1), n - 2), F.substr(t, n - 1)),
    )
    fused = both.where((F.size("tokens") == 1) & (n >= TELLING + 2)).select("id", F.explode(readings).alias("tokens"), F.lit(3).alias("kind"))
    return both.unionByName(fused)


# ---- tokens that resemble each other ----


def tune(similarity: float, recall: float, max_bands: int) -> tuple[int, int]:
    """(rows, bands): the most rows a band whose collision curve 1 - (1 - s^r)^b still gives the recall at the similarity."""
    best = (1, 1)
    for r in range(1, 16):
        b = math.ceil(math.log(1 - recall) / math.log(1 - similarity**r))
        if b <= max_bands:
            best = (r, b)
    return best


def one_edit(a: str, b: str) -> bool:
    """Equal, or one letter inserted, deleted or replaced, or two neighbours swapped."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    m = min(la, lb)
    i = 0
    while i < m and a[i] == b[i]:
        i += 1
    j = 0
    while j < m - i and a[la - 1 - j] == b[lb - 1 - j]:
        j += 1
    x, y = a[i : la - j], b[i : lb - j]
    return (len(x) <= 1 and len(y) <= 1) or (len(x) == len(y) == 2 and x == y[::-1])


def _bands(tokens: list[str], rows: int, bands: int) -> np.ndarray:
    rng = np.random.default_rng(20_240_601)
    mul = rng.integers(1, 1 << 63, rows * bands, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64)
    out = np.empty((len(tokens), bands), np.int64)
    for i, t in enumerate(tokens):
        padded = "#" * (Q - 1) + t + "#" * (Q - 1)
        grams = np.array([xxhash.xxh64_intdigest(g) for g in {padded[k : k + Q] for k in range(len(padded) - Q + 1)}], np.uint64)
        h = grams[:, None] * mul[None, :] + add[None, :]
        h ^= h >> np.uint64(29)
        low = h.min(axis=0).reshape(bands, rows)
        key = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1469598103934665603)
        for k in range(rows):
            key = (key ^ low[:, k]) * np.uint64(1099511628211)
            key ^= key >> np.uint64(32)
        out[i] = key.astype(np.int64)
    return out


def _deletions(t: str) -> list[int]:
    """Keys of a token and of it without one letter: tokens within one edit share one, a swap included."""
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in {t, *(t[:k] + t[k + 1 :] for k in range(len(t)))}]


def similar_tokens(tokens: DataFrame, similarity: float = 0.43, recall: float = 0.99, max_bands: int = 160, exact: int = 8) -> DataFrame:
    """(a, b), a < b: distinct tokens within one edit that share a band. ``similarity``: Jaccard of a swap in ``exact`` letters.

    A swap in fewer letters has a lower Jaccard, so tokens up to that length meet by their deletions, which miss none.
    """
    rows, bands = tune(similarity, recall, max_bands)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = batch["token"].tolist()
            for i in range(0, len(words), 2000):
                part = words[i : i + 2000]
                short = [(key, w) for w in part if len(w) <= exact for key in _deletions(w)]
                if short:
                    yield pd.DataFrame(short, columns=["key", "token"])
                if long := [w for w in part if len(w) >= exact]:
                    keys = _bands(long, rows, bands)
                    yield pd.DataFrame({"key": keys.ravel(), "token": np.repeat(np.array(long, object), bands)})

    # Few bytes become many rows here, so the tokens are spread by number, by an expression that no earlier
    # shuffle has, or Spark would leave the shuffle out. The band is part of the key.
    spread = tokens.repartition(tokens.sparkSession.sparkContext.defaultParallelism * 2, F.xxhash64("token"))
    keyed = spread.mapInPandas(sketch, "key long, token string")
    # Most keys are of one token; what is left is small. One token more than fits in a bucket makes a further
    # part of it; parts are compared crosswise.
    hits = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    hits = cut(hits.select("key", "token", F.ceil(F.col("n") / BUCKET).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("token"), F.col("parts")).cast("int").alias("part")
    lists = lambda df: df.groupBy("key", "parts", part).agg(F.collect_list("token").alias("l"))
    both = lists(hits).select("l", F.lit(None).cast("array<string>").alias("r"))
    if not hits.where("parts > 1").isEmpty():
        big = lists(hits.where("parts > 1"))
        cross = big.alias("x").join(big.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.part") < F.col("y.part")))
        both = both.unionByName(cross.select(F.col("x.l").alias("l"), F.col("y.l").alias("r")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = set()
            for l, r in zip(batch["l"], batch["r"]):
                pairs = ((a, b) for i, a in enumerate(l) for b in l[i + 1 :]) if r is None else ((a, b) for a in l for b in r)
                for a, b in pairs:
                    if a > b:
                        a, b = b, a
                    if (a, b) not in seen and one_edit(a, b):
                        seen.add((a, b))
            if seen:
                yield pd.DataFrame(list(seen), columns=["a", "b"])

    return both.mapInPandas(compare, "a string, b string").distinct()


# ---- views that resemble each other ----


def _diminutive(a: str, b: str) -> bool:
    """Whether ``a`` is a beginning of ``b`` with its last letter doubled and -y, -ie or -i (Danny, Jenni, Debbie)."""
    for end in ("ie", "y", "i"):
        stem = a[: -len(end)]
        if a.endswith(end) and len(stem) >= 4 and stem[-1] == stem[-2]:
            return len(b) >= len(stem) and b.startswith(stem[:-1]) and len(b) <= len(stem) + BEGINNING
    return False


def token_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return 0.85 if b[0] == a or any(r[0] == a for r in _ROOTS.get(b, ())) else 0.0
    if _ROOTS.get(a, set()) & _ROOTS.get(b, set()):
        return 0.97
    if len(a) >= 3 and one_edit(a, b):
        return 0.93
    if len(a) == 2:
        return 0.88 if b.startswith(a) else 0.0
    if len(b) >= 4 and ((b.startswith(a) and len(b) <= len(a) + BEGINNING) or (b.endswith(a) and len(b) <= len(a) + ENDING)):
        return 0.95
    if _diminutive(a, b) or _diminutive(b, a):
        return 0.95
    # A short form with a typo in it.
    if len(a) >= 4 and any(one_edit(a, f) for r in _ROOTS.get(b, ()) for f in SHORT_FORMS[r].split() if len(f) >= 4):
        return 0.9
    return 0.0


def _without_short_typos(a: str, b: str) -> float:
    """In short tokens one letter may be the whole difference (Wei, Mei), unless it is a further one at an end."""
    return 0.0 if a != b and max(len(a), len(b)) < TELLING and token_similarity(a, b) == 0.93 and not (len(a) != len(b) and (a.startswith(b) or b.startswith(a))) else token_similarity(a, b)


def monge_elkan(x: list[str], y: list[str], xi: int, yi: int) -> float:
    """Mean of the best similarities of the shorter view's tokens, each partner used once; x[xi] and y[yi] are partners already."""
    similarity = _without_short_typos if len(x[xi]) < TELLING and x[xi] == y[yi] else token_similarity
    if len(x) > len(y):
        x, y, xi, yi = y, x, yi, xi
    total = token_similarity(x[xi], y[yi])
    free = [t for k, t in enumerate(y) if k != yi]
    initial = False
    for t in sorted((t for k, t in enumerate(x) if k != xi), key=len, reverse=True):
        best, at = max(((similarity(t, u), k) for k, u in enumerate(free)), default=(0.0, -1))
        if best == 0.0:
            return 0.0
        total += best
        initial |= len(free[at]) == 1 < len(t)
        del free[at]
    # An initial of the longer view stood for a full token while a long token of its own found no partner:
    # it is another name that begins like this one.
    if initial and any(len(u) >= TELLING + 2 for u in free):
        return 0.0
    return total / len(x)


def _compare_views(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        best: dict[tuple[str, str], float] = {}
        for a, b, left, right in zip(batch["a"], batch["b"], batch["l"], batch["r"]):
            for i, u in enumerate(left):
                x = u["tokens"]
                for v in left[i + 1 :] if right is None else right:
                    if u["id"] == v["id"]:
                        continue
                    y = v["tokens"]
                    if len(x) == 1 or len(y) == 1:
                        score = 0.9 if len(x) == len(y) and x[0] == y[0] else 0.0
                    elif u["kind"] == 3 and v["kind"] == 3:
                        score = 0.0
                    else:
                        score = monge_elkan(list(x), list(y), u["at"], v["at"])
                    if score > 0:
                        # A reading of a user name is a guess, an alias or address that fits is not.
                        score -= 0.05 * (u["kind"] == 3 or v["kind"] == 3)
                        key = (u["id"], v["id"]) if u["id"] < v["id"] else (v["id"], u["id"])
                        best[key] = max(best.get(key, 0.0), score)
        if best:
            yield pd.DataFrame([(*k, s) for k, s in best.items()], columns=["x", "y", "score"])


def _letters(t: str) -> list[str]:
    """Keys that two tokens of three letters or more share where one is the beginning or end of the other, or within one edit of it."""
    out = [f"^{t[:3]}", f"${t[-3:]}"]
    # An edit among the first three letters leaves the last three alone only in tokens of seven.
    return out + [f"-{t[:k]}{t[k + 1 :]}" for k in range(len(t))] + [f"-{t}"] if len(t) <= 7 else out


def match_keys(t: str) -> list[tuple[str, bool]]:
    """(key, short): tokens with a positive ``token_similarity`` share a key; keys that begin with a digit compare only with short tokens (two letters or fewer)."""
    roots = _ROOTS.get(t, ())
    if len(t) <= 2:
        out = {(f"{len(t)}{t}", True), (f"1{t[0]}", True)}
    else:
        out = {(f"1{t[0]}", False), (f"2{t[:2]}", False)} | {(k, False) for k in _letters(t)}
    out |= {(f"1{r[0]}", len(t) <= 2) for r in roots} | {(f"={r}", False) for r in roots}
    # A short form with a typo meets the forms of this token's roots.
    out |= {(k, False) for r in roots for f in SHORT_FORMS[r].split() if len(f) >= 4 for k in _letters(f)}
    return sorted(out)


def _common_links(keyed: DataFrame, counts: DataFrame, similar: DataFrame) -> DataFrame:
    """(x, y, score) of views with a token, equal or within one edit, that more than ``HOT`` entities share, or an equal short one."""
    hot = counts.where(F.col("n") > HOT).select("token")
    # A reading of a user name has a telling token that must match as well.
    short = keyed.where("kind < 3").select("id", F.explode("tokens").alias("token")).where(F.length("token").between(2, TELLING - 1)).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Tokens within one edit of a common one are compared under it; of two common ones, under the smaller.
    pairs = similar.unionByName(similar.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = pairs.join(hot.select(F.col("token").alias("a")), "a").join(hot.select(F.col("token").alias("b"), F.lit(True).alias("also")), "b", "left")
    pairs = pairs.where(F.col("also").isNull() | (F.col("a") < F.col("b"))).select(F.col("b").alias("token"), F.col("a").alias("anchor"), F.lit(1).alias("side"))
    anchors = cut(pairs.unionByName(hot.unionByName(short.select("token")).select("token", F.col("token").alias("anchor"), F.lit(0).alias("side"))))
    if anchors.isEmpty():
        return keyed.select(F.col("id").alias("x"), F.col("id").alias("y"), F.lit(0.0).alias("score")).limit(0)
    fused = (F.col("kind") == 3).alias("fused")
    rows = keyed.select("id", "kind", F.array_sort("tokens").alias("tokens"), fused).withColumn("bag", F.xxhash64("tokens", "fused"))
    bags = rows.groupBy("bag", "tokens", "fused").agg(F.min(F.struct("kind", "id")).alias("first"))
    placed = bags.select("bag", "tokens", "fused", F.posexplode("tokens").alias("at", "token")).where((F.length("token") >= TELLING) | ~F.col("fused")).join(anchors, "token").select("bag", "tokens", "fused", "at", "anchor", "side")

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for bag, tokens, fused, at, anchor, side in b.itertuples(index=False):
                best = {}
                for k, t in enumerate(tokens):
                    if k != at:
                        for key, short in match_keys(t):
                            best[key] = best.get(key, False) or short
                out += [(xxhash.xxh64_intdigest(f"{anchor} {key}") - (1 << 63), key[0] in "12", short, bag, " ".join(tokens), bool(fused), at, side) for key, short in best.items()]
            yield pd.DataFrame(out, columns=["key", "asks", "short", "bag", "tokens", "fused", "at", "side"])

    found = placed.repartition(keyed.sparkSession.sparkContext.defaultParallelism * 2, "bag").mapInPandas(keys, "key long, asks boolean, short boolean, bag long, tokens string, fused boolean, at int, side int")
    # A key matters where two bags have it that are to be compared under it.
    w = Window.partitionBy("key")
    told = found.withColumns({"n": F.count(F.lit(1)).over(w), "own": F.count_if(F.col("side") == 0).over(w), "shorts": F.count_if("short").over(w)})
    told = told.where("n > 1 and own > 0 and (shorts > 0 or not asks)").withColumn("parts", F.ceil(F.col("n") / BUCKET).cast("int"))
    told = cut(told.withColumn("part", F.pmod(F.xxhash64("bag"), F.col("parts")).cast("int")))
    item = F.struct("bag", "tokens", "fused", "at", "side", "short")
    lists = lambda df: df.groupBy("key", "asks", "parts", "part").agg(F.collect_list(item).alias("l"))
    parts = lists(told)
    both = parts.select("asks", "l", F.lit(None).cast(parts.schema["l"].dataType).alias("r"))
    if not told.where("parts > 1").isEmpty():
        big = lists(told.where("parts > 1"))
        cross = big.alias("x").join(big.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.part") < F.col("y.part")))
        both = both.unionByName(cross.select("x.asks", F.col("x.l").alias("l"), F.col("y.l").alias("r")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, int], float] = {}
        seen: set[tuple] = set()
        for batch in batches:
            for asks, left, right in zip(batch["asks"], batch["l"], batch["r"]):
                left = [(u["bag"], u["tokens"].split(" "), u["fused"], u["at"], u["side"], u["short"]) for u in left]
                right = None if right is None else [(u["bag"], u["tokens"].split(" "), u["fused"], u["at"], u["side"], u["short"]) for u in right]
                for i, (a, x, xf, xi, xs, xshort) in enumerate(left):
                    for b, y, yf, yi, ys, yshort in left[i + 1 :] if right is None else right:
                        if a == b or (xs and ys) or (xf and yf) or (asks and not (xshort or yshort)) or (a, xi, b, yi) in seen:
                            continue
                        seen.add((a, xi, b, yi))
                        score = monge_elkan(x, y, xi, yi) - 0.05 * (xf or yf)
                        if score > 0:
                            key = (a, b) if a < b else (b, a)
                            best[key] = max(best.get(key, 0.0), score)
            if best:
                yield pd.DataFrame([(*k, v) for k, v in best.items()], columns=["a", "b", "score"])
                best = {}
            if len(seen) > 500_000:
                seen = set()

    near = cut(both.mapInPandas(compare, "a long, b long, score double").groupBy("a", "b").agg(F.max("score").alias("score")))
    equal = placed.where((F.col("side") == 0) & ~F.col("fused") & ((F.size("tokens") > 1) | (F.length("anchor") >= TELLING))).select(F.col("bag").alias("a"), F.col("bag").alias("b"), F.when(F.size("tokens") == 1, 0.9).otherwise(1.0).alias("score")).distinct()
    met = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).unionByName(equal)
    met = met.join(bags.select(F.col("bag").alias("b"), F.col("first.id").alias("other")), "b")
    ids = rows.select(F.col("bag").alias("a"), "id").distinct()
    return _ordered(met.join(ids, "a").where("id <> other").select("id", "other", "score"))


def links(seen: DataFrame) -> DataFrame:
    """(x, y, score), x < y: ids with views that name the same person or team."""
    tokens = seen.select("id", F.explode("tokens").alias("token")).where(F.length("token") >= TELLING).distinct()
    counts = cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    telling = counts.where(F.col("n") <= HOT).select("token")
    keyed = seen.withColumn("view", F.xxhash64("id", "tokens", "kind"))
    placed = keyed.select("id", "tokens", "kind", "view", F.posexplode("tokens").alias("at", "token")).join(telling, "token")
    placed = cut(placed.groupBy("token", "id", "tokens", "kind", "at", "view").agg(F.lit(1).alias("one")).drop("one"))
    lists = placed.groupBy("token").agg(F.collect_list(F.struct("id", "tokens", "kind", "at")).alias("v"))
    every = cut(similar_tokens(counts.select("token")))
    similar = every.join(telling.select(F.col("token").alias("a")), "a", "left_semi").join(telling.select(F.col("token").alias("b")), "b", "left_semi")
    own = lists.select(F.col("token").alias("a"), F.col("token").alias("b"), F.col("v").alias("l"), F.lit(None).cast(lists.schema["v"].dataType).alias("r"))
    near = similar.join(lists.select(F.col("token").alias("a"), F.col("v").alias("l")), "a").join(lists.select(F.col("token").alias("b"), F.col("v").alias("r")), "b").select("a", "b", "l", "r")
    found = own.where(F.size("l") > 1).unionByName(near).mapInPandas(_compare_views, "x string, y string, score double")
    return found.unionByName(_whole_links(keyed, placed)).unionByName(_common_links(keyed, counts, every)).groupBy("x", "y").agg(F.max("score").alias("score"))


def _whole_links(keyed: DataFrame, placed: DataFrame) -> DataFrame:
    """(x, y, score) of views of common tokens only, compared as wholes whatever the order of their tokens.

    Equal wholes, and wholes within one edit of them, are linked to the first id of the larger group, so a
    name that a third of all rows share costs one link a row.
    """
    whole = F.array_join(F.array_sort("tokens"), " ")
    names = keyed.where("kind < 2").select("id", "view", whole.alias("whole"))
    common = names.join(placed.select("view").distinct(), "view", "left_anti")
    groups = cut(names.groupBy("whole").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    wanted = cut(common.select("whole").distinct())
    equal = common.select("id", "whole").join(groups, "whole").where("id <> first").select("id", F.col("first").alias("other"), F.lit(0.9).alias("score"))
    if wanted.isEmpty():
        return _ordered(equal)
    # In short names one letter may be the whole difference. A typo that makes a common token telling is
    # found under the common one, so only wholes of common tokens meet here.
    near = similar_tokens(wanted.where(F.length("whole") >= 2 * TELLING).select(F.col("whole").alias("token")), WHOLE, exact=14)
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = lambda s: groups.select(F.col("whole").alias(s), F.col("first").alias(f"{s}_first"), F.col("n").alias(f"{s}_n"))
    kept = near.join(side("a"), "a").join(side("b"), "b").where(F.struct("a_n", "a") > F.struct("b_n", "b"))
    typos = kept.select("a_first", F.col("b").alias("whole")).join(names.select("id", "whole").distinct(), "whole")
    return _ordered(equal.unionByName(typos.where("id <> a_first").select("id", F.col("a_first").alias("other"), F.lit(0.88).alias("score"))))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id", "other").alias("x"), F.greatest("id", "other").alias("y"), "score")


def stars(edges: DataFrame, rank: DataFrame) -> DataFrame:
    """(id, centre) of the linked ids. ``rank``: (id, full, weight); a centre is a free id that no free neighbour outranks.

    Each round settles the first of the free ids at least, and rounds go on until none is free.
    """
    both = edges.select(F.col("x").alias("id"), F.col("y").alias("other"), "score").unionByName(edges.select(F.col("y").alias("id"), F.col("x").alias("other"), "score"))
    degree = both.groupBy("id").agg(F.sum("score").alias("degree"))
    order = degree.join(rank, "id", "left").select("id", F.struct(F.coalesce("full", F.lit(0)).alias("full"), F.round("degree", 6).alias("degree"), F.coalesce("weight", F.lit(0)).alias("weight"), "id").alias("o"))
    open_edges = cut(both.join(order, "id").join(order.select(F.col("id").alias("other"), F.col("o").alias("p")), "other"))
    nodes = cut(order.select("id"))
    done: list[DataFrame] = []
    while True:
        # Free ids without a free neighbour above them, or without any.
        above = open_edges.where("p > o").select("id").distinct()
        centres = nodes.join(above, "id", "left_anti")
        members = open_edges.join(centres.select(F.col("id").alias("other")), "other", "left_semi").groupBy("id").agg(F.max_by("other", F.struct("score", "p")).alias("centre"))
        settled = cut(centres.withColumn("centre", F.col("id")).unionByName(members.join(centres, "id", "left_anti")))
        done.append(settled)
        ids = settled.select("id")
        nodes = cut(nodes.join(ids, "id", "left_anti"))
        if nodes.isEmpty():
            break
        open_edges = cut(open_edges.join(ids, "id", "left_anti").join(ids.select(F.col("id").alias("other")), "other", "left_anti"))
        if len(done) == 16:
            done = [cut(reduce(DataFrame.unionByName, done))]
    return reduce(DataFrame.unionByName, done)


def variants(people: DataFrame, authors: DataFrame | None = None) -> DataFrame:
    """(id, centre) of the ids that have variants. ``people``: id, name, aliases, metadata, frequency; ``authors``: author_name, author_email."""
    seen = cut(views(people, authors))
    edges = cut(links(seen))
    full = F.max(((F.col("kind") == 0) & (F.size(F.filter("tokens", lambda t: F.length(t) >= 3)) >= 2)).cast("int"))
    weight = people.groupBy("id").agg(F.max("frequency").alias("weight"))
    rank = seen.groupBy("id").agg(full.alias("full")).join(weight, "id", "left")
    return stars(edges, rank)


def variant_pairs(members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, within each star."""
    a, b = members.select("centre", F.col("id").alias("id_a")), members.select("centre", F.col("id").alias("id_b"))
    return a.join(b, "centre").where("id_a < id_b").select("id_a", "id_b")
