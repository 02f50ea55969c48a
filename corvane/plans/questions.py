"""Queries that ask the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_key
from ..operators import analytics as A
from ..operators.graph_build import newest
from ..session import table
from .build import CLEAN, clean_commits

#: The time that the registered queries take as now.
AS_OF = "2025-12-01T00:00:00Z"


def entities(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "entities")
    cols = ["type", "name", "aliases", "description", "first_seen", "last_seen", "frequency", "embedding"]
    return newest(e.select(norm_key("id").alias("id"), *cols, "loaded_at"), "id", F.col("loaded_at"), cols)


def relations(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "relations")
    cols = ["type", "source_id", "target_id", "weight", "first_seen", "last_seen"]
    rows = r.select(norm_key("id").alias("id"), "type", norm_key("source_id").alias("source_id"), norm_key("target_id").alias("target_id"), "weight", "first_seen", "last_seen", "loaded_at")
    return newest(rows, "id", F.col("loaded_at"), cols).where("source_id is not null and target_id is not null")


def communities(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "communities").select(norm_key("id").alias("id"), "level", "title", "summary", "entity_ids")
    return c.where("id is not null").groupBy("id").agg(F.min("level").alias("level"), F.max("title").alias("title"), F.max("summary").alias("summary"), F.max("entity_ids").alias("entity_ids"))


def units(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "text_units").select("id", "entity_ids", "commit_hashes", "loaded_at")
    return newest(u, "id", F.col("loaded_at"), ["entity_ids", "commit_hashes"])


def experts(s, d):
    return A.experts(entities(s, d), relations(s, d), "src", AS_OF)


def expert_bars(s, d):
    return A.with_bars(experts(s, d)).select("person_id", "percent", "bar")


def coupling(s, d):
    return A.coupling(entities(s, d), relations(s, d), "services")


def silos(s, d):
    return A.silos(entities(s, d), relations(s, d), AS_OF)


def risk_report(s, d):
    return A.risk(silos(s, d))


def entity_cards(s, d):
    e = entities(s, d)
    return A.cards(e, relations(s, d), e.select("id"))


def relations_of_technologies(s, d):
    e = entities(s, d)
    return A.relations_of(relations(s, d), e.where("type = 'TECHNOLOGY'").select("id")).select("entity_id", "other_id", "direction", "id", "type")


def degrees(s, d):
    return A.degrees(relations(s, d))


def export_nodes(s, d):
    return A.export_nodes(entities(s, d), communities(s, d))


def export_edges(s, d):
    return A.export_edges(export_nodes(s, d), relations(s, d))


def type_breakdown(s, d):
    return A.type_breakdown(entities(s, d))


def graph_summary(s, d):
    return A.graph_summary(communities(s, d))


def community_members(s, d):
    return A.community_members(communities(s, d), entities(s, d))


def entity_commits(s, d):
    return A.latest_commits(units(s, d), clean_commits(s, d))


def decision_trace(s, d):
    e = entities(s, d)
    return A.decisions(e, relations(s, d), e.where("type = 'DECISION'"))


def summary_inputs(s, d):
    return A.summary_inputs(communities(s, d), relations(s, d))


def store_stats(s, d):
    out = None
    for name, key in (("entities", "id"), ("relations", "id"), ("text_units", "id"), ("communities", "id"), ("commits", "hash")):
        row = table(s, d, name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"))
        out = row if out is None else out.unionByName(row)
    return out


def embedding_delta(s, d):
    """Entities to embed anew: the text of their last load against the hashes of what was there before 2025-06."""
    rows = table(s, d, "entities").where("id is not null").select("id", F.coalesce("description", F.lit("")).alias("text"), "loaded_at")
    newest_text = F.max_by("text", F.struct("loaded_at", "text")).alias("text")
    before = rows.where(F.col("loaded_at") < F.lit("2025-06-01").cast("timestamp")).groupBy("id").agg(newest_text)
    stored = before.select("id", F.substring(F.sha2("text", 256), 1, 16).alias("text_hash"))
    return A.embedding_delta(rows.groupBy("id").agg(newest_text), stored)


def export_counts(s, d):
    return A.export_counts(entities(s, d), export_nodes(s, d), relations(s, d))


def community_colours(s, d):
    return A.community_colours(communities(s, d))


def units_of_decisions(s, d):
    """Units that hold each decision."""
    u = units(s, d).select("id", F.size("commit_hashes").alias("n_commits"))
    pairs = units(s, d).select(F.col("id").alias("text_unit_id"), F.explode("entity_ids").alias("entity_id")).distinct()
    return A.owners_of(pairs, u, "text_unit_id", entities(s, d).where("type = 'DECISION'"))


def communities_of_modules(s, d):
    """Communities that hold each module."""
    c = communities(s, d).select("id", "level")
    pairs = communities(s, d).select(F.col("id").alias("community_id"), F.explode("entity_ids").alias("entity_id")).distinct()
    return A.owners_of(pairs, c, "community_id", entities(s, d).where("type = 'MODULE'"))


def token_estimate(s, d):
    u = table(s, d, "text_units").groupBy("id").agg(F.max("content").alias("content"))
    return A.token_estimate(u, 100)


def run_costs(s, d):
    """Costs of three runs by rates that are given."""
    rates = s.createDataFrame([("m1", 2.0, 4.0), ("p1", 1.0, 1.0)], "name string, input double, output double")
    usage = table(s, d, "index_runs").select("run_id", F.lit("p1").alias("provider"), F.when(F.col("run_id") % 2 == 0, "m1").otherwise("m9").alias("model"), (F.col("run_id") * 1000).alias("input_tokens"), (F.col("run_id") * 10).alias("output_tokens"))
    return A.actual_cost(usage, rates).select("run_id", F.round("cost", 9).alias("cost"))


QUERIES = {
    f.__name__: f
    for f in (
        experts, expert_bars, coupling, silos, risk_report, entity_cards, relations_of_technologies, degrees, export_nodes, export_edges,
        type_breakdown, graph_summary, community_members, entity_commits, decision_trace, summary_inputs, store_stats,
        embedding_delta, export_counts, community_colours, units_of_decisions, communities_of_modules, token_estimate, run_costs,
    )
}

_K = "nullif(lower(trim({}, concat(' ', chr(9), chr(10), chr(13), chr(11), chr(12), chr(160), chr(12288)))), '')"


def key(c: str) -> str:
    return _K.format(c)


GRAPH = f"""
 e0 as (select *, {key('id')} k, row_number() over (partition by {key('id')} order by loaded_at desc) rn from entities),
 e as (select k id, type, name, aliases, description, first_seen, last_seen, frequency, embedding from e0 where rn = 1 and k is not null),
 r0 as (select *, {key('id')} k, row_number() over (partition by {key('id')} order by loaded_at desc) rn from relations),
 r as (select k id, type, {key('source_id')} source_id, {key('target_id')} target_id, weight, first_seen, last_seen from r0
  where rn = 1 and k is not null and {key('source_id')} is not null and {key('target_id')} is not null),
 cm as (select {key('id')} id, min(level) level, max(title) title, max(summary) summary, max(entity_ids) entity_ids from communities where {key('id')} is not null group by 1),
 u0 as (select *, row_number() over (partition by id order by loaded_at desc) rn from text_units),
 u as (select id, entity_ids, commit_hashes from u0 where rn = 1 and id is not null)
"""
W = "with" + GRAPH
_DAYS = "((epoch_us(timestamptz '2025-12-01 00:00:00+00') - epoch_us(try_cast({} || case when len({}) = 10 then ' 00:00:00+00' else 'Z' end as timestamptz))) / 86400000000.0)"
DAYS = lambda c: _DAYS.format(c, c)
_EXPERTS = W + f""",
 m as (select id, frequency from e where type = 'MODULE' and (name = 'src' or starts_with(name, 'src/'))),
 p as (select source_id, sum(weight) w, max(last_seen) last_active, count(distinct target_id) n_modules from r where type in ('AUTHORED', 'MODIFIED') and target_id in (select id from m) group by 1),
 x as (select p.source_id person_id, e.name, floor(w * (1 / (1 + coalesce({DAYS('last_active')}, 365.0) / 365)) * 100.0::double + 0.5) / 100.0::double score, round(w, 6) weight,
  floor(w / (select coalesce(nullif(sum(frequency), 0), 1) from m) * 10000.0::double + 0.5) / 10000.0::double share, last_active, n_modules
  from p join e on e.id = p.source_id where e.type = 'PERSON' order by score desc, person_id limit 5)
"""
_SILOS = W + f""",
 m as (select id, name, frequency from e where type = 'MODULE' and frequency >= 3),
 o as (select target_id, source_id, last_seen, {DAYS('last_seen')} <= 180 active from r where type in ('AUTHORED', 'MODIFIED')),
 p as (select target_id, count(distinct case when active then source_id end) n, min(case when active then source_id end) solo, max(last_seen) last_activity from o group by 1),
 x as (select m.id module_id, m.name, m.frequency, coalesce(n, 0) active_experts, solo solo_expert, coalesce(last_activity, '') last_activity from m left join p on m.id = p.target_id where coalesce(n, 0) <= 1)
"""
_ENDS = """,
 b as (select source_id entity_id, target_id other_id, 'out' direction, id, type, weight from r union all select target_id, source_id, 'in', id, type, weight from r)
"""
_EXPORT = W + """,
 n0 as (select id, type, name, frequency from e order by frequency desc, id limit 500),
 home as (select eid, min(id) community_id from (select id, unnest(entity_ids) eid from cm where level = 0) group by 1),
 n as (select n0.*, home.community_id, round(1.8 + least(5.2, ln(frequency + 1) * 1.5), 6) size from n0 left join home on home.eid = n0.id)
"""
ORACLE = {
    "experts": _EXPERTS + "select * from x",
    "expert_bars": _EXPERTS + ", y as (select *, floor(score / max(score) over () * 100 + 0.5)::int percent from x) select person_id, percent, repeat('#', floor(percent / 100.0::double * 20 + 0.5)::int) bar from y",
    "coupling": W + """,
 m as (select id, frequency from e where type = 'MODULE' and (name = 'services' or starts_with(name, 'services/'))),
 o as (select source_id id, target_id other, weight from r where type = 'CO_CHANGED' union all select target_id, source_id, weight from r where type = 'CO_CHANGED'),
 c as (select other, sum(weight) w from o where id in (select id from m) and other not in (select id from m) group by 1 having sum(weight) >= 2),
 au as (select r.target_id t, e.name from r join e on e.id = r.source_id where r.type in ('AUTHORED', 'MODIFIED') and e.name <> ''),
 mine as (select distinct name from au where t in (select id from m)),
 sh as (select t, count(distinct name) n from au where name in (select name from mine) group by 1)
 select c.other module_id, e.name, round(w, 6) weight, round(w / (select sum(frequency) from m), 6) co_change_ratio, coalesce(sh.n, 0) shared_authors from c join e on e.id = c.other left join sh on sh.t = c.other""",
    "silos": _SILOS + "select * from x",
    "risk_report": _SILOS + "select count(*) filter (active_experts = 0) orphans, count(*) filter (active_experts = 1) silos from x",
    "entity_cards": W + _ENDS + """, k as (select *, row_number() over (partition by entity_id order by weight desc, id, direction) place, count(*) over (partition by entity_id) n from b where entity_id in (select id from e))
 select entity_id, place, direction, k.type, k.id relation_id, other_id, coalesce(e.name, other_id) other_name, round(weight, 6) weight, greatest(n - 50, 0) hidden from k left join e on e.id = k.other_id where place <= 50""",
    "relations_of_technologies": W + _ENDS + "select entity_id, other_id, direction, id, type from b where entity_id in (select id from e where type = 'TECHNOLOGY')",
    "degrees": W + _ENDS + "select entity_id, count(*) degree from b group by 1",
    "export_nodes": _EXPORT + "select * from n",
    "export_edges": _EXPORT + """, k as (select r.*, a.community_id ca, b.community_id cb, row_number() over (partition by least(source_id, target_id), greatest(source_id, target_id) order by weight desc, reverse(r.id) desc) rn
  from r join n a on a.id = source_id join n b on b.id = target_id where source_id <> target_id)
 select id relation_id, type, source_id, target_id, round(weight, 6) weight, coalesce(ca <> cb, false) cross_community from k where rn = 1 order by k.weight desc, id limit 2000""",
    "type_breakdown": W + ", k as (select *, row_number() over (partition by type order by frequency desc, id) rn from e) select type, count(*) n, string_agg(name, '|' order by rn) filter (rn <= 5) examples from k group by 1",
    "graph_summary": W + "select id, level, title from cm where level = (select max(level) from cm where level <= 2) order by id limit 10",
    "community_members": W + ", m as (select distinct id community_id, unnest(entity_ids) eid from cm), k as (select community_id, eid, name, frequency, row_number() over (partition by community_id order by frequency desc, name, eid) place from m join e on e.id = m.eid) select community_id, place, eid entity_id, name, frequency from k where place <= 5",
    "entity_commits": CLEAN + "," + GRAPH.replace(" r as (", " rr as (").replace(" e as (", " ee as (") + ", p as (select distinct entity_id, unnest(commit_hashes) hash from (select unnest(entity_ids) entity_id, commit_hashes from u)), k as (select entity_id, hash, date, row_number() over (partition by entity_id order by date desc, hash) place from p join c using (hash)) select entity_id, place, hash, date from k where place <= 10",
    "decision_trace": W + """, d as (select id decision_id, first_seen from e where type = 'DECISION'),
 mk as (select distinct decision_id, d.first_seen, r.source_id other_id from d join r on r.target_id = d.decision_id and r.type = 'DECIDED')
 select decision_id, first_seen, 'maker' as role, other_id from mk
 union select d.decision_id, d.first_seen, 'supersedes', r.target_id from d join r on r.source_id = d.decision_id and r.type = 'SUPERSEDES'
 union select mk.decision_id, mk.first_seen, 'module', r.target_id from mk join r on r.source_id = mk.other_id and r.type in ('AUTHORED', 'MODIFIED')""",
    "summary_inputs": W + """, m as (select distinct id community_id, unnest(entity_ids) member from cm), z as (select community_id, count(*) members from m group by 1),
 x as (select source_id member, id from r union select target_id, id from r), i as (select community_id, count(distinct id) relations from m join x using (member) group by 1)
 select z.community_id, members, coalesce(relations, 0) relations from z left join i on i.community_id = z.community_id""",
    "embedding_delta": """with x as (select id, coalesce(description, '') t, loaded_at from entities where id is not null), n as (select id, max({loaded_at: loaded_at, t: t}).t t from x group by 1),
 b as (select id, max({loaded_at: loaded_at, t: t}).t t from x where loaded_at < timestamp '2025-06-01' group by 1), h as (select n.id, substr(sha256(n.t), 1, 16) text_hash, substr(sha256(b.t), 1, 16) old from n left join b on b.id = n.id)
 select id, text_hash, case when old is null then 'new' else 'changed' end state from h where old is null or old <> text_hash""",
    "export_counts": _EXPORT + """, p as (select count(*) t from (select distinct least(source_id, target_id) a, greatest(source_id, target_id) b from r where source_id <> target_id and source_id in (select id from n) and target_id in (select id from n)))
 select (select count(*) from n) shown_nodes, (select count(*) from e) total_nodes, least(t, 2000) shown_edges, t total_edges from p""",
    "community_colours": W + f"select id, title, {A.COLOURS}[(row_number() over (order by id) - 1) % {len(A.COLOURS)} + 1] colour from cm where level = 0",
    "units_of_decisions": W + "select distinct x entity_id, id, n_commits from (select id, unnest(entity_ids) x, coalesce(len(commit_hashes), -1) n_commits from u) where x in (select id from e where type = 'DECISION')",
    "communities_of_modules": W + "select distinct x entity_id, id, level from (select id, level, unnest(entity_ids) x from cm) where x in (select id from e where type = 'MODULE')",
    "token_estimate": "with u as (select id, max(content) content from text_units group by 1), x as (select count(*) n_units, floor((sum(ceil(length(coalesce(content, '')) / 4)) + count(*) * 1100) * 1.4 + 0.5)::bigint extraction_tokens from u) select n_units, extraction_tokens, 80000::bigint summary_tokens, extraction_tokens + 80000 total_tokens, round((extraction_tokens + 80000) * 0.6::double, 3) input_tokens, round((extraction_tokens + 80000) * 0.4::double, 3) output_tokens from x",
    "run_costs": "select run_id, round(case when run_id % 2 = 0 then run_id * 1000 * 2.0::double + run_id * 10 * 4.0::double else run_id * 1000 * 1.0::double + run_id * 10 * 1.0::double end / 1000000, 9) cost from index_runs",
    "store_stats": " union all ".join(f"select '{t}' table_name, count(*) n_rows, count(distinct {k}) n_keys from {t}" for t, k in (("entities", "id"), ("relations", "id"), ("text_units", "id"), ("communities", "id"), ("commits", "hash"))),
}
