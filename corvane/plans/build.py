"""Queries that build the graph: modules, people, ownership, co-change, merge rules, junctions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_noise, module_path, norm_path, renamed_to
from ..functions.text import instant
from ..operators import graph_build as G
from ..session import table


def _clean(s: SparkSession, d: str) -> DataFrame:
    return G.clean_commits(table(s, d, "commits"))


def _changes(s: SparkSession, d: str, depth: int | None = None) -> DataFrame:
    return G.file_changes(_clean(s, d), depth)


def clean_commits(s: SparkSession, d: str) -> DataFrame:
    return _clean(s, d).select("hash", "author_name", "author_email", "date", "n_parents", F.size("files").alias("n_files"))


def module_paths(s: SparkSession, d: str) -> DataFrame:
    paths = table(s, d, "commits").select(F.explode("files_changed.path").alias("p")).select(norm_path(F.col("p")).alias("path")).where("path is not null").distinct()
    return paths.select("path", module_path(F.col("path")).alias("module"), module_path(F.col("path"), 2).alias("module2"), is_noise(F.col("path")).alias("noise"))


def renames(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "commits").select("hash", F.explode("files_changed").alias("f")).where("f.old_path is not null")
    both = F.concat(F.col("f.old_path"), F.lit(" => "), F.col("f.path"))
    return f.select("hash", both.alias("spelling"), renamed_to(both).alias("path")).distinct()


def ownership_people(s: SparkSession, d: str) -> DataFrame:
    return G.people(_clean(s, d))


def ownership_edges(s: SparkSession, d: str) -> DataFrame:
    return G.ownership(_changes(s, d))


def ownership_relations(s: SparkSession, d: str) -> DataFrame:
    return G.ownership_relations(G.ownership(_changes(s, d, 2)))


def co_change_edges(s: SparkSession, d: str) -> DataFrame:
    return G.co_changes(_changes(s, d))


def entity_mentions(s: SparkSession, d: str) -> DataFrame:
    return G.mentions(table(s, d, "text_units"))


def edge_density(s: SparkSession, d: str) -> DataFrame:
    x = G.edge_density(table(s, d, "entities"), table(s, d, "relations"))
    return x.withColumn("density", F.round("density", 9))


def upsert_entities(s: SparkSession, d: str) -> DataFrame:
    x = G.upsert_entities(table(s, d, "entities")).withColumn("aliases", F.array_join("aliases", "|"))
    pairs = F.transform(F.array_sort(F.map_keys("metadata")), lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at("metadata", k), F.lit(""))))
    return x.withColumns({"metadata": F.coalesce(F.array_join(pairs, "|"), F.lit("")), "embedding": F.array_join(F.transform("embedding", lambda v: F.round(v.cast("double") * 1e4).cast("long").cast("string")), "|")})


def upsert_relations(s: SparkSession, d: str) -> DataFrame:
    x = G.upsert_relations(table(s, d, "relations"))
    return x.select("id", "type", "source_id", "target_id", F.round("weight", 6).alias("weight"), "description", F.coalesce(F.array_join("evidence", "|"), F.lit("")).alias("evidence"), "first_seen", "last_seen")


def insert_commits(s: SparkSession, d: str) -> DataFrame:
    """Whole rows: insert-or-ignore of the newest rows of 2025 and later into the newest of those that came before."""
    cols = ["author_name", "author_email", "date", "message", "parent_hashes", "text_unit_id", "indexed_at", "files_changed"]
    c = table(s, d, "commits").withColumn("_at", instant("indexed_at"))
    early = F.coalesce(F.col("_at") < F.lit("2025-01-01").cast("timestamp"), F.lit(True))
    order = F.struct(F.coalesce("_at", F.timestamp_micros(F.lit(0))), F.coalesce("indexed_at", F.lit("")), F.coalesce("message", F.lit("")))
    stored, late = G.newest(c.where(early), "hash", order, cols), G.newest(c.where(~early), "hash", order, cols)
    x = G.insert_or_ignore(stored, late, "hash")
    return x.select("hash", "author_name", "author_email", "date", "message", "text_unit_id", F.size("parent_hashes").alias("n_parents"), F.size("files_changed").alias("n_files"))


def text_unit_entities(s: SparkSession, d: str) -> DataFrame:
    return G.junction(table(s, d, "text_units"), "entity_ids", table(s, d, "entities"), "text_unit_id")


def community_entities(s: SparkSession, d: str) -> DataFrame:
    return G.junction(table(s, d, "communities"), "entity_ids", table(s, d, "entities"), "community_id")


QUERIES = {
    f.__name__: f
    for f in (
        clean_commits, module_paths, renames, ownership_people, ownership_edges, ownership_relations, co_change_edges, entity_mentions,
        edge_density, upsert_entities, upsert_relations, insert_commits, text_unit_entities, community_entities,
    )
}

AT_SQL = "coalesce(epoch_us(try_cast(case when regexp_matches(upper(trim(indexed_at)), '(Z|[+-][0-9]{2}:?[0-9]{2})$') then upper(trim(indexed_at)) else upper(trim(indexed_at)) || 'Z' end as timestamptz)), -1)"
PATH_SQL = r"regexp_replace(replace({}, '\', '/'), '^(\./)+', '')"


def module_sql(path: str, depth: int | None = None) -> str:
    p = rf"regexp_replace({path}, '/index\.[^/]+$', '')"
    parts = rf"case when regexp_matches({p}, '(?i)\.[a-z]+$') and len(string_split({p}, '/')) >= 3 then string_split({p}, '/')[:-2] else string_split({p}, '/') end"
    return f"array_to_string(({parts}){f'[1:{depth}]' if depth else ''}, '/')"


CLEAN = rf"""
with c0 as (select hash, trim(regexp_replace(author_name, '\s+', ' ', 'g')) author_name, lower(trim(author_email)) author_email, date, len(parent_hashes) n_parents, files_changed,
   row_number() over (partition by hash order by {AT_SQL} desc) rn from commits where hash is not null),
 c as (select * from c0 where rn = 1),
 f0 as (select hash, author_email, date, unnest(files_changed) f from c where n_parents <= 1),
 f1 as (select hash, author_email, date, {PATH_SQL.format('f.path')} path, f.status status, coalesce(f.additions, 0) + coalesce(f.deletions, 0) lines from f0),
 f as (select *, {module_sql('path')} as module, {module_sql('path', 2)} as module2 from f1 where trim(path) <> '')
"""


def _own(module: str) -> str:
    return f""", o0 as (select author_email, {module} as module, hash, max(case when status = 'added' then 1 else 0 end) added, min(date) date from f where author_email <> '' group by all),
 o as (select author_email, module, case when max(added) = 1 then 'AUTHORED' else 'MODIFIED' end as type, count(*) weight, min(date) first_seen, max(date) last_seen from o0 group by author_email, module)"""


def _slug(kind: str, name: str) -> str:
    return f"'{kind}:' || regexp_replace(regexp_replace(regexp_replace(lower({name}), '[^a-z0-9/_.-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


_NOISE = r"(regexp_extract(path, '(\.[^.]*)$', 1) <> '' and lower(regexp_extract(path, '(\.[^.]*)$', 1)) in ('.lock','.sum','.min.js','.min.css','.map','.snap','.png','.jpg','.jpeg','.gif','.svg','.ico','.woff','.woff2','.ttf','.eot','.pb','.pyc','.pyo','.class','.o','.so','.dylib')) or regexp_matches(path, '(^|/)(node_modules|vendor|dist|build|\.next|__pycache__|\.git)/')"

ORACLE = {
    "clean_commits": CLEAN + "select hash, author_name, author_email, date, n_parents, len(files_changed) n_files from c",
    "module_paths": rf"with p as (select distinct {PATH_SQL.format('p')} path from (select unnest(files_changed).path p from commits)) select path, {module_sql('path')} as module, {module_sql('path', 2)} as module2, {_NOISE} noise from p where trim(path) <> ''",
    "renames": "select distinct hash, f.old_path || ' => ' || f.path spelling, f.path path from (select hash, unnest(files_changed) f from commits) where f.old_path is not null",
    "ownership_people": CLEAN + "select author_email, arg_max(author_name, date || hash) as name, count(*) frequency, min(date) first_seen, max(date) last_seen from c where n_parents <= 1 and author_email <> '' group by 1",
    "ownership_edges": CLEAN + _own("module") + " select * from o",
    "ownership_relations": CLEAN + _own("module2")
    + f", r as (select *, {_slug('person', 'author_email')} s, {_slug('module', 'module')} t from o) select 'rel:' || substr(sha256(type || ',' || least(s, t) || ',' || greatest(s, t)), 1, 12) id, type, s source_id, t target_id, weight, first_seen, last_seen from r",
    "co_change_edges": CLEAN + ", m as (select hash, module, sum(lines) lines from f group by all) select a.module module_a, b.module module_b, sum(least(a.lines, b.lines))::bigint weight, count(*) commits from m a join m b on a.hash = b.hash and a.module < b.module group by all",
    "entity_mentions": "select entity_id, count(distinct id) frequency, min(date_start) first_seen, max(date_end) last_seen from (select id, date_start, date_end, unnest(entity_ids) entity_id from text_units) where entity_id is not null group by 1",
    "edge_density": "select v n_entities, e n_relations, round(e::double / (v * (v - 1)), 9) density from (select count(distinct id) v from entities), (select count(distinct id) e from relations)",
    "upsert_entities": """select id, arg_max(type, k) as type, arg_max(name, k) as name, arg_max(array_to_string(aliases, '|'), k) aliases, arg_max(description, d) description,
   min(first_seen) first_seen, max(last_seen) last_seen, sum(frequency)::bigint frequency, coalesce(arg_max(meta, k), '') metadata, arg_max(vec, k) filter (vec is not null) embedding
  from (select *, strftime(loaded_at, '%Y%m%d%H%M%S%f') k, (case when trim(coalesce(description, '')) <> '' then '1' else '0' end) || strftime(loaded_at, '%Y%m%d%H%M%S%f') || coalesce(description, '') d,
   array_to_string(list_transform(list_sort(map_keys(metadata)), lambda x: x || '=' || coalesce(metadata[x], '')), '|') meta, array_to_string(list_transform(embedding, lambda v: round(v::double * 1e4)::bigint::varchar), '|') vec from entities) group by id""",
    "upsert_relations": """select id, arg_min(type, loaded_at) as type, arg_min(source_id, loaded_at) source_id, arg_min(target_id, loaded_at) target_id, round(sum(weight), 6) weight,
   arg_max(description, loaded_at) description, coalesce(array_to_string(list_filter(arg_max(coalesce(evidence, []), loaded_at), lambda x: x is not null), '|'), '') evidence, coalesce(min(nullif(first_seen, '')), '') first_seen, coalesce(max(nullif(last_seen, '')), '') last_seen from relations where id is not null group by id""",
    "insert_commits": f"""with c as (select *, {AT_SQL} tm, coalesce({AT_SQL} < epoch_us(timestamptz '2025-01-01 00:00:00+00'), true) early from commits where hash is not null),
 k as (select *, row_number() over (partition by hash order by early desc, greatest(tm, 0) desc, coalesce(indexed_at, '') desc, coalesce(message, '') desc) rn from c)
 select hash, author_name, author_email, date, message, text_unit_id, len(parent_hashes) n_parents, len(files_changed) n_files from k where rn = 1""",
    "text_unit_entities": "select distinct id text_unit_id, e entity_id from (select id, unnest(entity_ids) e from text_units) where e in (select id from entities)",
    "community_entities": "select distinct id community_id, e entity_id from (select id, unnest(entity_ids) e from communities) where e in (select id from entities)",
}
