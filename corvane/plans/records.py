"""Queries of the general record problems: references, incremental runs, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, incremental
from ..operators.references import Parent, ReferenceCheck, Referrer
from ..session import table


def reference_check(s: SparkSession, d: str) -> ReferenceCheck:
    units, entities = table(s, d, "text_units"), table(s, d, "entities")
    return ReferenceCheck(
        [
            Referrer("relations", table(s, d, "relations"), {"source_id": "entities", "target_id": "entities", "evidence": "text_units"}),
            Referrer("text_units", units, {"entity_ids": "entities"}),
        ],
        [Parent("entities", entities), Parent("text_units", units)],
        table(s, d, "tombstones"),
    )


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return reference_check(s, d).orphans().select("table_name", "field_name", "record_id", "ref_key")


def p1_report(s: SparkSession, d: str) -> DataFrame:
    return reference_check(s, d).report()


def _handled(s: SparkSession, d: str) -> DataFrame:
    """What each run took, in the order of the runs, and whether it succeeded."""
    runs = table(s, d, "index_runs").groupBy("run_id").agg(F.max(F.col("run_status") == "ok").alias("ok"))
    return table(s, d, "run_commits").join(runs, "run_id", "left").select(F.col("commit_hash").alias("hash"), "indexed_at", "run_id", "ok")


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return incremental.pending(table(s, d, "commits"), _handled(s, d), run="run_id", ok="ok").select(F.col("key").alias("hash")).distinct()


def p3_next(s: SparkSession, d: str) -> DataFrame:
    """(hash, indexed_at, date) of the commits that the next run must process."""
    commits = table(s, d, "commits")
    todo = p3_found(s, d)
    rows = commits.select("hash", "indexed_at", "date", incremental.instant("indexed_at").alias("at")).join(todo, "hash", "left_semi")
    newest = F.struct(F.col("at").isNotNull(), "at", F.coalesce("indexed_at", F.lit("")), F.coalesce("date", F.lit("")))
    return rows.groupBy("hash").agg(F.max_by(F.struct("indexed_at", "date"), newest).alias("r")).select("hash", "r.indexed_at", "r.date")


def p6_found(s: SparkSession, d: str) -> DataFrame:
    p = hierarchy.cut(hierarchy.parents(table(s, d, "communities"))).where("parent is not null")
    return hierarchy.roots(p).select("id", "root_id", "depth")


def p6_paths(s: SparkSession, d: str) -> DataFrame:
    h = hierarchy.hierarchy(table(s, d, "communities"))
    return h.select("id", "root_id", "depth", F.array_join("path", "/").alias("path"))


def p6_descendants(s: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(table(s, d, "communities"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p3_found, p3_next, p6_found, p6_paths, p6_descendants)}

# The blanks that norm_key strips, spelled for SQL.
_B = "concat(' ', chr(9), chr(10), chr(13), chr(11), chr(12), chr(160), chr(12288))"


def _key(c: str) -> str:
    return f"nullif(lower(trim({c}, {_B})), '')"


_REFS = f"""
with rel as (select {_key('id')} rid, *, min(loaded_at) over (partition by {_key('id')}) first from relations),
 tu as (select {_key('id')} rid, *, min(loaded_at) over (partition by {_key('id')}) first from text_units),
 refs as (
  select 'relations' table_name, 'source_id' field_name, 'entities' target, rid, {_key('source_id')} k, case when rid is null then loaded_at else first end tm from rel
  union all select 'relations', 'target_id', 'entities', rid, {_key('target_id')}, case when rid is null then loaded_at else first end from rel
  union all select 'relations', 'evidence', 'text_units', rid, {_key('e')}, tm from (select rid, unnest(evidence) e, case when rid is null then loaded_at else first end tm from rel)
  union all select 'text_units', 'entity_ids', 'entities', rid, {_key('e')}, tm from (select rid, unnest(entity_ids) e, case when rid is null then loaded_at else first end tm from tu)),
 parent as (select 'entities' target, {_key('id')} k, min(loaded_at) f, max(loaded_at) l from entities group by all
  union all select 'text_units', {_key('id')}, min(loaded_at), max(loaded_at) from text_units group by all),
 dead as (select {_key('table_name')} target, {_key('record_key')} k, max(deleted_at) x from tombstones group by all),
 live as (select p.target, p.k, p.f from parent p left join dead d on p.target = d.target and p.k = d.k where d.k is null or p.l > d.x),
 found as (select r.table_name, r.field_name, r.rid record_id, r.k ref_key, min(r.tm) tm,
   max(case when l.k is null then 'missing' else 'late' end) reason
  from refs r left join live l on r.target = l.target and r.k = l.k
  where r.k is not null and (l.k is null or coalesce(l.f > r.tm + interval 1 day, false))
  group by all)
"""

_AT = "try_cast(case when regexp_matches(upper(trim(indexed_at)), '(Z|[+-][0-9]{2}:?[0-9]{2})$') then upper(trim(indexed_at)) else upper(trim(indexed_at)) || 'Z' end as timestamptz)"
_PENDING = f"""
with c as (select hash, coalesce(epoch_us({_AT}), -1) tm, date, indexed_at,
   to_json(struct_pack(author_name, author_email, date, message, parent_hashes, text_unit_id, files_changed))::varchar body
  from commits where hash is not null),
 h as (select distinct commit_hash hash, coalesce(epoch_us({_AT}), -1) tm
  from run_commits where run_id in (select run_id from index_runs where run_status = 'ok')),
 v as (select c.hash, c.body, max(c.tm) tm, max(case when h.hash is null then 0 else 1 end) done
  from c left join h on c.hash = h.hash and c.tm = h.tm group by all),
 todo as (select distinct hash from (select *, max(tm) over (partition by hash) last from v) where tm = last and done = 0)
"""

_TREE = f"""
with recursive own as (select {_key('id')} id, min({_key('parent_id')}) parent from communities where {_key('id')} is not null group by all),
 listed as (select {_key('c')} id, min(lister) lister from (select {_key('id')} lister, unnest(child_ids) c from communities) where lister is not null group by all),
 pick as (select own.id, coalesce(own.parent, listed.lister) parent from own left join listed on own.id = listed.id),
 link as (select id, case when parent in (select id from own) then parent end parent from pick),
 walk(id, tm, path, ring) as (
  select id, id, [id], false from link
  union all
  select w.id, l.parent, list_append(w.path, l.parent), list_contains(w.path, l.parent)
  from walk w join link l on w.tm = l.id where l.parent is not null and not w.ring),
 ends as (select id, arg_max(path, len(path)) path, bool_or(ring) ring from walk group by id),
 tree as (select e.id, case when ring then (select min(x) from (select unnest(e.path[list_position(e.path, e.path[-1]):]) x)) else e.path[-1] end root_id,
   case when ring then -1 else len(e.path) - 1 end::bigint depth, case when not ring then list_reverse(e.path) end path from ends e)
"""

ORACLE = {
    "p1_found": _REFS + "select table_name, field_name, record_id, ref_key from found",
    "p1_report": _REFS
    + "select table_name, field_name, strftime(tm, '%Y-%m') period, count(*) n_references, count(*) filter (reason = 'missing') n_missing, count(*) filter (reason = 'late') n_late from found group by all",
    "p3_found": _PENDING + "select hash from todo",
    "p3_next": _PENDING + "select hash, indexed_at, date from (select *, row_number() over (partition by hash order by tm desc, coalesce(indexed_at, '') desc, coalesce(date, '') desc) rn from c where hash in (select hash from todo)) where rn = 1",
    "p6_found": _TREE + "select t.id, t.root_id, t.depth from tree t join link l on t.id = l.id where l.parent is not null",
    "p6_paths": _TREE + "select id, root_id, depth, array_to_string(path, '/') path from tree",
    "p6_descendants": _TREE + "select path[i] id, id descendant_id, len(path) - i distance from (select id, path, unnest(range(1, len(path))) i from tree where depth > 0)",
}
