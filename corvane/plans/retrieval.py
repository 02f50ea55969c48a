"""Search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import query_text
from ..operators import search as S
from ..session import table
from .build import CLEAN, clean_commits
from .questions import AS_OF, DAYS, GRAPH, W, communities, entities, relations

QUESTION = "who maintains the decoder tooling and the cached snapshots of the platform"


#: The vector that stands for the question.
VECTOR = [1.0, 0.5, -0.5, 0.25, -1.0, 0.75, 0.1, -0.2]


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"))


def search_entities(s, d):
    return _ranked(S.bm25(S.entity_texts(entities(s, d)), "id", S.ENTITY_WEIGHTS, QUESTION))


def search_text_units(s, d):
    u = table(s, d, "text_units").groupBy("id").agg(F.max("content").alias("content"))
    return _ranked(S.bm25(u, "id", {"content": 1.0}, QUESTION))


def search_communities(s, d):
    return _ranked(S.bm25(communities(s, d), "id", {"title": 1.0, "summary": 1.0}, QUESTION))


def _community_postings(s, d):
    return S.postings(communities(s, d), "id", {"title": 1.0, "summary": 1.0})


def community_postings(s, d):
    """Documents and occurrences of each token in the communities' titles and summaries."""
    return _community_postings(s, d).groupBy("token").agg(F.count(F.lit(1)).alias("documents"), F.sum("f").alias("occurrences"))


def search_postings(s, d):
    """The ranking of ``search_communities`` from postings and lengths as they are stored."""
    p = _community_postings(s, d)
    return _ranked(S.bm25_of_postings(p, S.document_lengths(communities(s, d), "id", p), QUESTION))


def vector_neighbours(s, d):
    """The three nearest rows of every row whose id is divisible by 20."""
    e = table(s, d, "embeddings")
    return S.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 3).select("query_id", "id", "similarity", "place")


def entity_similarity(s, d):
    """Cosine of every entity's embedding to one fixed vector."""
    return S.rank_by_vector(entities(s, d), "id", "embedding", VECTOR).select("id", F.round("similarity", 6).alias("similarity"))


def entity_scores(s, d):
    """The text-only ranking of all matching entities."""
    hits = S.bm25(S.entity_texts(entities(s, d)), "id", S.ENTITY_WEIGHTS, QUESTION).withColumnRenamed("score", "fts")
    ends = relations(s, d).select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    rows = hits.join(entities(s, d).select("id", "last_seen"), "id").join(ends, "id", "left")
    rows = rows.select("id", "fts", "last_seen", F.coalesce("degree", F.lit(0)).alias("degree"), F.lit(None).cast("double").alias("semantic"))
    return S.scored(rows, AS_OF, False).select("id", F.round("score", 5).alias("score"))


def local_search(s, d):
    u = table(s, d, "text_units").groupBy("id").agg(F.max("content").alias("content"), F.max("date_end").alias("date_end"), F.max("entity_ids").alias("entity_ids"))
    found = S.local_search(entities(s, d), relations(s, d), u, communities(s, d), QUESTION, AS_OF)
    rows = [(k, e["id"], float(e["score"]), e["hop"]) for k, e in enumerate(found["entities"])]
    return s.createDataFrame(rows, "place int, id string, score double, hop int")


def global_search(s, d):
    c = communities(s, d).withColumn("embedding", F.lit(None).cast("array<float>"))
    return S.global_search(c, QUESTION).select("place", "id", F.round("score", 6).alias("score"))


def global_hybrid(s, d):
    """Communities by text and meaning; a community's vector is the mean of its members'."""
    e = entities(s, d).where(F.size("embedding") == 8).select(F.col("id").alias("eid"), "embedding")
    c = communities(s, d)
    pairs = c.select("id", F.explode("entity_ids").alias("eid")).distinct().join(e, "eid")
    mean = pairs.groupBy("id").agg(F.array(*[F.round(F.avg(F.get("embedding", F.lit(k)).cast("double")), 4).cast("float") for k in range(8)]).alias("embedding"))
    return S.global_search(c.join(mean, "id", "left"), QUESTION, vector=VECTOR).select("place", "id", F.round("score", 5).alias("score"))


def question_kind(s, d):
    return table(s, d, "documents").select("doc_id", query_text.classify_column(F.coalesce("text", F.lit(""))).alias("kind"))


def author_entities(s, d):
    names = clean_commits(s, d).select(F.col("author_name").alias("query"))
    return S.lookup(entities(s, d), names)


def label_matches(s, d):
    """Per type: how many names contain a string, and the most frequent of them."""
    hit = entities(s, d).where(F.contains(F.lower("name"), F.lit("ar")))
    return hit.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max_by("name", F.struct("frequency", "id")).alias("largest"))


QUERIES = {
    f.__name__: f
    for f in (
        search_entities, search_text_units, search_communities, community_postings, search_postings, vector_neighbours, entity_similarity, entity_scores,
        local_search, global_search, global_hybrid, question_kind, author_entities, label_matches,
    )
}

_LIST = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"


def _bm25_sql(source: str, columns: dict[str, float], prefix: str = "") -> str:
    found = query_text.terms(QUESTION)
    lists = ", ".join(f"{_LIST.format(c)} t{i}" for i, c in enumerate(columns))
    dl = " + ".join(f"len(t{i})" for i in range(len(columns)))

    def hit(i: int, t: str, p: bool) -> str:
        return f"len(list_filter(t{i}, lambda x: {f'starts_with(x, {chr(39)}{t}{chr(39)})' if p else f'x = {chr(39)}{t}{chr(39)}'}))"

    tf = ", ".join(" + ".join(f"{w} * {hit(i, t, p)}" for i, w in enumerate(columns.values())) + f" f{k}" for k, (t, p) in enumerate(found))
    df = ", ".join(f"count(*) filter (f{k} > 0) d{k}" for k in range(len(found)))
    score = " + ".join(f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in range(len(found)))
    hits = " or ".join(f"f{k} > 0" for k in range(len(found)))
    return f"{prefix} q0 as (select id, {lists} from {source}), q1 as (select id, {dl} dl, {tf} from q0), q2 as (select count(*) n, avg(dl) avgdl, {df} from q1), q as (select id, {score} score from q1, q2 where {hits})"


_ENT = W + ", et as (select id, name, array_to_string(aliases, ' ') aliases, description from e)" + _bm25_sql("et", S.ENTITY_WEIGHTS, ",")


def _rx(p: str) -> str:
    return "regexp_matches(coalesce(text, ''), '(?i)" + p.replace("'", "''") + "')"


ORACLE = {
    "search_entities": _ENT + " select id, round(score, 6) score from q",
    "search_text_units": _bm25_sql("(select id, max(content) content from text_units group by id)", {"content": 1.0}, "with") + " select id, round(score, 6) score from q",
    "search_communities": W + _bm25_sql("cm", {"title": 1.0, "summary": 1.0}, ",") + " select id, round(score, 6) score from q",
    "community_postings": W + ", w as (select id, unnest(" + _LIST.format("title") + " || " + _LIST.format("summary") + ") token from cm), p as (select token, id, count(*)::double f from w group by all) select token, count(*) documents, sum(f) occurrences from p group by 1",
    "vector_neighbours": """with p as (select q.vec_id query_id, r.vec_id id, round(list_cosine_similarity(q.embedding::double[], r.embedding::double[]), 6) + 0.0 s from embeddings q join embeddings r on q.vec_id % 20 = 0 and q.vec_id <> r.vec_id),
 k as (select *, row_number() over (partition by query_id order by s desc, id) place from p) select query_id, id, s similarity, place from k where place <= 3""",
    "entity_similarity": W + "select id, round(case when len(embedding) = 8 then coalesce(list_cosine_similarity(embedding::double[], [1.0, 0.5, -0.5, 0.25, -1.0, 0.75, 0.1, -0.2]::double[]), 0) else 0 end, 6) similarity from e where embedding is not null",
    "entity_scores": _ENT + f""", g as (select x id, count(*) degree from (select source_id x from r union all select target_id from r) group by 1),
 z as (select q.id, q.score fts, e.last_seen, coalesce(g.degree, 0) degree from q join e on e.id = q.id left join g on g.id = q.id),
 y as (select *, greatest(max(abs(fts)) over (), 1) mf, greatest(max(degree) over (), 1) md from z)
 select id, round(0.5 * greatest(0, least(1, fts / mf)) + 0.3 * coalesce(exp(-greatest(0, {DAYS('last_seen')}) / 260), 0) + 0.2 * (case when md > 1 then ln(1 + degree) / ln(1 + md) when degree > 0 then 1 else 0 end), 5) score from y""",
    "search_postings": W + _bm25_sql("cm", {"title": 1.0, "summary": 1.0}, ",") + " select id, round(score, 6) score from q",
    "global_hybrid": W + _bm25_sql("cm", {"title": 1.0, "summary": 1.0}, ",") + """, mv as (select distinct c.id, e.id eid, e.embedding v from (select id, unnest(entity_ids) eid from cm) c join e on e.id = c.eid where len(e.embedding) = 8),
 cv as (select id, [""" + ", ".join(f"round(avg(v[{k + 1}]::double), 4)" for k in range(8)) + f"""] v from mv group by 1), sim as (select id, round(coalesce(list_cosine_similarity(v, {VECTOR}::double[]), 0), 9) s from cv),
 tk as (select id, row_number() over (order by score desc, id) k from q), tb as (select id, k from tk where k <= 25), tn as (select greatest(max(k), 1) n from tb), tx as (select id, 1 - (k - 1) / n t from tb, tn),
 al as (select coalesce(sim.id, tx.id) id, 0.6 * greatest(coalesce(s, 0), 0) + 0.4 * coalesce(t, 0) score from sim full join tx on tx.id = sim.id), k as (select id, score, row_number() over (order by score desc, id) place from al)
 select place, id, round(score, 5) score from k where place <= 5""",
    "global_search": W + _bm25_sql("cm", {"title": 1.0, "summary": 1.0}, ",") + ", k as (select id, score, row_number() over (order by score desc, id) place from q) select place, id, round(score, 6) score from k where place <= 5",
    "question_kind": "select doc_id, case " + " ".join(f"when {_rx(p)} then '{k}'" for k, ps in (("local", query_text.LOCAL_PATTERNS), ("global", query_text.GLOBAL_PATTERNS)) for p in ps) + " else 'local' end kind from documents",
    "label_matches": W + "select type, count(*) n, arg_max(name, lpad(frequency::varchar, 20, '0') || id) largest from e where contains(lower(name), 'ar') group by 1",
}
ORACLE["author_entities"] = (
    CLEAN
    + ","
    + GRAPH
    + ", a as (select distinct author_name q from c where author_name is not null), h as (select q, 0 p, e.id from a join e on e.id = q union all select q, 1, e.id from a join e on lower(e.name) = lower(q)) select q query, arg_min(id, p || id) entity_id from h group by 1"
)
