"""Full-text and vector search, and the two retrieval composites.

A query has a handful of terms, so a scan counts them per document inside the JVM and only two numbers
per term and one row of statistics leave it: no postings are shuffled. ``postings`` builds the stored
form for repeated use. Vector search takes a stated set of queries against all rows in matrix blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.query_text import terms, words
from ..functions.text import instant

K1, B = 1.2, 0.75
#: Bytes of query vectors that are broadcast; beyond, blocks of both sides are shuffled.
BROADCAST_BYTES = 32_000_000
ENTITY_WEIGHTS = {"name": 10.0, "aliases": 5.0, "description": 1.0}
# Fixed values of the ranking.
TEXT_ONLY = {"fts": 0.5, "recency": 0.3, "degree": 0.2}
HYBRID = {"fts": 0.25, "recency": 0.1, "degree": 0.05}
SEMANTIC, GLOBAL_SEMANTIC, GLOBAL_FTS, GLOBAL_CANDIDATES = 0.6, 0.6, 0.4, 5
SEED_SHARE, HOP1, HOP1_WEIGHT, PER_SEED, HOP2, HOP2_FROM, HOP2_EACH, HOP2_WEIGHT = 0.6, 15, 1.0, 15, 5, 3, 3, 1.5
DECAY = {1: 0.5, 2: 0.25}


def postings(docs: DataFrame, id_col: str, columns: dict[str, float]) -> DataFrame:
    """(token, id, f, n): weighted and plain occurrences of each token; store it partitioned or bucketed by token."""
    parts = None
    for c, w in columns.items():
        p = docs.select(F.col(id_col).alias("id"), F.explode(words(F.coalesce(F.col(c), F.lit("")))).alias("token"), F.lit(w).alias("w"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy("token", "id").agg(F.sum("w").alias("f"), F.count(F.lit(1)).alias("n"))


def document_lengths(docs: DataFrame, id_col: str, stored: DataFrame) -> DataFrame:
    """(id, dl) of every document, stored beside its postings; those without a word have length 0."""
    n = stored.groupBy("id").agg(F.sum("n").alias("dl"))
    return docs.select(F.col(id_col).alias("id")).distinct().join(n, "id", "left").select("id", F.coalesce("dl", F.lit(0)).alias("dl"))


def bm25_of_postings(stored: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """(id, score) as ``bm25`` gives it, from stored postings: only the rows of the query's tokens are read."""
    found = terms(query)
    if not found:
        return lengths.select("id", F.lit(0.0).alias("score")).limit(0)
    same = [F.col("token").startswith(t) if p else F.col("token") == t for t, p in found]
    hits = stored.where(reduce(lambda a, b: a | b, same))
    f = [F.coalesce(F.sum(F.when(s, F.col("f"))), F.lit(0.0)).alias(f"f{k}") for k, s in enumerate(same)]
    per = hits.groupBy("id").agg(*f)
    df = per.agg(*[F.count_if(F.col(f"f{k}") > 0).alias(f"d{k}") for k in range(len(found))])
    size = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    rows = per.join(lengths, "id").join(F.broadcast(df), F.lit(True)).join(F.broadcast(size), F.lit(True))
    return rows.select("id", sum((_bm25_term(k) for k in range(len(found))), F.lit(0.0)).alias("score"))


def _bm25_term(k: int) -> Column:
    f, df = F.col(f"f{k}"), F.col(f"d{k}")
    idf = F.greatest(F.ln((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def bm25(docs: DataFrame, id_col: str, columns: dict[str, float], query: str) -> DataFrame:
    """(id, score) of matching documents; higher is better. A term that most documents hold keeps a tiny positive weight."""
    found = terms(query)
    if not found:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    lists = {c: words(F.coalesce(F.col(c), F.lit(""))) for c in columns}
    toks = docs.select(F.col(id_col).alias("id"), *[t.alias(f"t{i}") for i, t in enumerate(lists.values())])

    def hits(c: str, term: str, prefix: bool) -> Column:
        return F.size(F.filter(c, (lambda x: x.startswith(term)) if prefix else (lambda x: x == term)))

    length = sum((F.size(f"t{i}") for i in range(len(columns))), F.lit(0))
    tf = [sum((hits(f"t{i}", t, p) * w for i, w in enumerate(columns.values())), F.lit(0.0)).alias(f"f{k}") for k, (t, p) in enumerate(found)]
    base = toks.select("id", length.alias("dl"), *tf)
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"f{k}") > 0).alias(f"d{k}") for k in range(len(found))])
    any_hit = F.lit(False)
    score = F.lit(0.0)
    for k in range(len(found)):
        score = score + _bm25_term(k)
        any_hit = any_hit | (F.col(f"f{k}") > 0)
    return base.where(any_hit).join(F.broadcast(stats), F.lit(True)).select("id", score.alias("score"))


def entity_texts(entities: DataFrame) -> DataFrame:
    return entities.withColumn("aliases", F.array_join("aliases", " "))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 for a zero vector, null vectors or other lengths."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def dot(x: Column, y: Column) -> Column:
        return total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def rank_by_vector(rows: DataFrame, id_col: str, vec_col: str, query: list[float], top: int | None = None) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    out = rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), cosine(F.col(vec_col), q).alias("similarity"))
    return out if top is None else out.orderBy(F.desc("similarity"), "id").limit(top)


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, vec_col: str, top: int, block: int = 4096) -> DataFrame:
    """(query_id, id, similarity, place): the ``top`` other rows of each query, by matrix products of blocks.

    Each pair of blocks returns at most ``top`` rows a query, so what is shuffled is blocks x queries x top.
    """
    kind = dict(rows.dtypes)[id_col]
    spark = rows.sparkSession

    def blocked(df: DataFrame, prefix: str) -> DataFrame:
        part = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(vec_col).cast("array<float>").alias("v"))
        n = max(1, -(-part.count() // block))
        return part.groupBy(F.pmod(F.xxhash64("i"), F.lit(n)).alias(f"{prefix}b")).agg(F.collect_list(F.struct("i", "v")).alias(prefix))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for left, right in zip(batch["q"], batch["r"]):
                dims: dict[int, tuple[list, list]] = {}
                for side, part in ((0, left), (1, right)):
                    for x in part:
                        dims.setdefault(len(x["v"]), ([], []))[side].append(x)
                for a, b in dims.values():
                    if not a or not b:
                        continue
                    u, v = np.array([x["v"] for x in a], np.float64), np.array([x["v"] for x in b], np.float64)
                    nu, nv = np.linalg.norm(u, axis=1), np.linalg.norm(v, axis=1)
                    s = np.round((u @ v.T) / np.where(nu > 0, nu, 1)[:, None] / np.where(nv > 0, nv, 1)[None, :], 6) + 0.0
                    ids, qids = np.array([x["i"] for x in b]), np.array([x["i"] for x in a])
                    order = np.argsort(ids, kind="stable")
                    s, ids = s[:, order], ids[order]
                    s[qids[:, None] == ids[None, :]] = -np.inf
                    best = np.argsort(-s, axis=1, kind="stable")[:, :top]
                    sim = np.take_along_axis(s, best, axis=1)
                    keep = np.isfinite(sim)
                    yield pd.DataFrame({"query_id": np.repeat(qids, keep.sum(axis=1)), "id": ids[best][keep], "similarity": sim[keep]})

    q, r = blocked(queries, "q"), blocked(rows, "r")
    size = queries.agg(F.coalesce(F.sum(F.size(vec_col)), F.lit(0)), F.count(F.lit(1))).first()
    if 4 * size[0] + 40 * size[1] <= BROADCAST_BYTES:
        # The blocks of rows stay where they are.
        pairs = r.join(F.broadcast(q), F.lit(True))
    else:
        pairs = q.join(r, F.lit(True)).repartition(spark.sparkContext.defaultParallelism)
    found = pairs.select("q", "r").mapInPandas(products, f"query_id {kind}, id {kind}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def recency(as_of: str, c: Column) -> Column:
    days = (F.unix_micros(instant(F.lit(as_of))) - F.unix_micros(instant(c))) / F.lit(86_400_000_000.0)
    return F.coalesce(F.exp(-F.greatest(days, F.lit(0.0)) / 260), F.lit(0.0))


def scored(rows: DataFrame, as_of: str, hybrid: bool) -> DataFrame:
    """Adds ``score`` to (id, fts, last_seen, degree, semantic): text, recency, degree and meaning, weighed."""
    w = HYBRID if hybrid else TEXT_ONLY
    # The two largest values travel as one row, so the rows themselves stay where they are.
    most = rows.agg(F.greatest(F.max(F.abs("fts")), F.lit(1.0)).alias("_fts"), F.greatest(F.max("degree"), F.lit(1)).alias("_degree"))
    fts = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fts") / F.col("_fts")))
    degree = F.when(F.col("_degree") > 1, F.ln(F.col("degree") + 1) / F.ln(F.col("_degree") + 1)).otherwise((F.col("degree") > 0).cast("double"))
    score = fts * w["fts"] + recency(as_of, F.col("last_seen")) * w["recency"] + degree * w["degree"]
    score = score + F.coalesce(F.greatest("semantic", F.lit(0.0)) * SEMANTIC, F.lit(0.0))
    return rows.join(F.broadcast(most), F.lit(True)).withColumn("score", score).drop("_fts", "_degree")


def _heaviest(relations: DataFrame, ids: list[str], least: float, each: int) -> dict[str, list]:
    """The heaviest relations at each id (at most ``each``), in order."""
    ends = relations.where(F.col("weight") >= least)
    at = None
    for side in ("source_id", "target_id"):
        p = ends.where(F.col(side).isin(ids)).select(F.col(side).alias("at"), "id", "source_id", "target_id", "type", "weight")
        at = p if at is None else at.unionByName(p)
    w = Window.partitionBy("at").orderBy(F.desc("weight"), "id")
    out: dict[str, list] = {}
    for r in at.withColumn("k", F.row_number().over(w)).where(F.col("k") <= each).orderBy("at", "k").collect():
        out.setdefault(r["at"], []).append(r)
    return out


def local_search(
    entities: DataFrame, relations: DataFrame, units: DataFrame, communities: DataFrame, query: str, as_of: str,
    max_entities: int = 10, max_relations: int = 20, max_units: int = 20, max_tokens: int = 8000, types: list[str] | None = None, vector: list[float] | None = None,
) -> dict:
    """Seeds by text and meaning, their neighbourhood within budgets, and the evidence behind them.

    The budgets are sequential but bound all that is collected: at most a few hundred rows.
    """
    spark = entities.sparkSession
    empty = {"entities": [], "relations": [], "units": [], "communities": [], "total_matches": 0, "total_relations": 0}
    fts = bm25(entity_texts(entities), "id", ENTITY_WEIGHTS, query).orderBy(F.desc("score"), "id").limit(max_entities * 3)
    seeds = [(r["id"], r["score"]) for r in fts.collect()]
    meaning: dict[str, float] = {}
    if vector is not None:
        first = entities.where("embedding is not null").select(F.size("embedding")).head()
        if first and first[0] == len(vector):
            meaning = {r["id"]: r["similarity"] for r in rank_by_vector(entities, "id", "embedding", vector, max_entities * 3).collect()}
    ids = list(dict.fromkeys([i for i, _ in seeds] + list(meaning)))
    if not ids:
        return empty
    known = {r["id"]: r for r in entities.where(F.col("id").isin(ids)).select("id", "name", "type", "last_seen").collect()}
    seeds = [(i, f) for i, f in seeds if not types or known[i]["type"] in types]
    there = {i for i, _ in seeds}
    seeds += [(i, 0.0) for i in meaning if i not in there and (not types or known[i]["type"] in types)]
    total_matches = len(seeds)
    seeds = seeds[: -int(-max_entities * SEED_SHARE // 1)]
    if not seeds:
        return empty
    seed_ids = [i for i, _ in seeds]
    ends = relations.select(F.explode(F.array("source_id", "target_id")).alias("id")).where(F.col("id").isin(seed_ids))
    degree = {r["id"]: r["count"] for r in ends.groupBy("id").count().collect()}
    frame = spark.createDataFrame([(i, float(f), known[i]["last_seen"], degree.get(i, 0), meaning.get(i)) for i, f in seeds], "id string, fts double, last_seen string, degree long, semantic double")
    ranked = scored(frame, as_of, bool(meaning)).orderBy(F.desc("score"), "id").collect()
    out = [{"id": r["id"], "score": r["score"], "hop": 0} for r in ranked]
    order, seen, taken, rels, near = [r["id"] for r in ranked], set(seed_ids), set(), [], []
    heavy = _heaviest(relations, order, HOP1_WEIGHT, PER_SEED)
    budget = min(HOP1, max_relations)
    for i in order:
        for r in heavy.get(i, []):
            if budget > 0 and r["id"] not in taken:
                taken.add(r["id"])
                rels.append(r)
                budget -= 1
                other = r["target_id"] if r["source_id"] == i else r["source_id"]
                if other not in seen:
                    seen.add(other)
                    near.append((other, r["weight"], 1))
    exists = lambda xs: {r["id"]: r["name"] for r in entities.where(F.col("id").isin([x[0] for x in xs])).select("id", "name").collect()} if xs else {}
    names = {i: known[i]["name"] for i in seed_ids} | exists(near)
    near = [x for x in near if x[0] in names]
    start = [x[0] for x in sorted(near, key=lambda x: -x[1])[:HOP2_FROM]]
    budget = min(HOP2, max_relations - len(rels))
    heavy = _heaviest(relations, start, HOP2_WEIGHT, HOP2_EACH) if start and budget > 0 else {}
    far = []
    for i in start:
        for r in heavy.get(i, []):
            if budget > 0 and r["id"] not in taken:
                taken.add(r["id"])
                rels.append(r)
                budget -= 1
                other = r["target_id"] if r["source_id"] == i else r["source_id"]
                if other not in seen:
                    seen.add(other)
                    far.append((other, r["weight"], 2))
    names |= exists(far)
    near += [x for x in far if x[0] in names]
    most = max([x[1] for x in near] + [1.0])
    out += [{"id": i, "score": w / most * DECAY[h], "hop": h} for i, w, h in near]
    names |= exists([(x,) for r in rels for x in (r["source_id"], r["target_id"]) if x not in names])
    chosen = _evidence(units, order, max_units, max_tokens)
    member = communities.where(F.arrays_overlap("entity_ids", F.array(*map(F.lit, order)))).select("id").distinct().orderBy("id").collect()
    return {
        "entities": out[:max_entities],
        "relations": [{"id": r["id"], "type": r["type"], "source": names.get(r["source_id"], r["source_id"]), "target": names.get(r["target_id"], r["target_id"]), "weight": r["weight"]} for r in rels],
        "units": chosen,
        "communities": [r["id"] for r in member],
        "total_matches": total_matches,
        "total_relations": sum(degree.values()),
    }


def _evidence(units: DataFrame, order: list[str], max_units: int, max_tokens: int) -> list[str]:
    """Units of the seeds in turn, latest first, while they fit the budget. Every round takes one or ends, so max_units + 1 each are enough."""
    pairs = units.select("id", "date_end", F.ceil(F.length("content") / 4).alias("tokens"), F.explode(F.array_intersect("entity_ids", F.array(*map(F.lit, order)))).alias("seed"))
    w = Window.partitionBy("seed").orderBy(F.desc("date_end"), "id")
    lists: dict[str, list] = {}
    for r in pairs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= max_units + 1).orderBy("seed", "k").collect():
        lists.setdefault(r["seed"], []).append(r)
    out: list[str] = []
    for k in range(max_units + 1):
        before = len(out)
        for s in order:
            mine = lists.get(s, [])
            if k < len(mine) and len(out) < max_units and max_tokens > 0 and mine[k]["id"] not in out and (mine[k]["tokens"] or 0) <= max_tokens:
                out.append(mine[k]["id"])
                max_tokens -= mine[k]["tokens"] or 0
        if len(out) == before:
            break
    return out


def global_search(communities: DataFrame, query: str, level: int | None = None, top: int = 5, vector: list[float] | None = None) -> DataFrame:
    """(id, score, place) of the communities that answer best, by text rank and, with a vector, meaning."""
    w = Window.orderBy(F.desc("score"), "id")
    text = bm25(communities, "id", {"title": 1.0, "summary": 1.0}, query)
    inside = communities if level is None else communities.where(F.col("level") == level)
    stored = communities.where("embedding is not null").select(F.size("embedding")).head() if vector is not None else None
    if not stored or stored[0] != len(vector):
        limit = top if level is None else 2 * top
        # The level filter comes after the limit, so fewer than ``top`` may be left.
        best = text.orderBy(F.desc("score"), "id").limit(limit).join(inside.select("id"), "id", "left_semi")
        return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    limit = top * GLOBAL_CANDIDATES if level is None else max(top * GLOBAL_CANDIDATES, inside.count())
    best = text.orderBy(F.desc("score"), "id").limit(limit).withColumn("k", F.row_number().over(w))
    n = F.greatest(F.max("k").over(Window.partitionBy(F.lit(1))), F.lit(1))
    best = best.select("id", (1 - (F.col("k") - 1) / n).alias("text"))
    meaning = rank_by_vector(communities, "id", "embedding", vector)
    both = meaning.join(best, "id", "full_outer")
    if level is not None:
        both = inside.select("id").join(both, "id", "left")
    score = F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(0.0)) * GLOBAL_SEMANTIC + F.coalesce("text", F.lit(0.0)) * GLOBAL_FTS
    return both.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(top).withColumn("place", F.row_number().over(w))


def lookup(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, entity_id): by id, else by name in any case; ties by id."""
    q = wanted.select("query").where("query is not null").distinct()
    hits = q.join(entities.select(F.col("id").alias("query"), F.col("id").alias("e")), "query").select("query", F.struct(F.lit(0).alias("p"), "e").alias("h"))
    by_name = q.withColumn("k", F.lower("query")).join(entities.select(F.lower("name").alias("k"), F.col("id").alias("e")), "k").select("query", F.struct(F.lit(1).alias("p"), "e").alias("h"))
    return hits.unionByName(by_name).groupBy("query").agg(F.min("h").alias("h")).select("query", F.col("h.e").alias("entity_id"))
