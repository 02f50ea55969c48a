"""Queries of graph algorithms, chunking, resolution and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import similar_names
from ..functions.text import norm_key
from ..operators import chunking, extraction, graph_algorithms as G, resolution
from ..operators.graph_build import newest
from ..session import cut, table
from .build import module_sql
from .questions import W, communities, entities, relations

START = "module:src/api"


def _edges(s: SparkSession, d: str) -> DataFrame:
    # The newest relations, of which only ends and weight are shuffled.
    cols = ["source_id", "target_id", "weight"]
    rows = table(s, d, "relations").select(norm_key("id").alias("id"), *[norm_key(c).alias(c) for c in cols[:2]], "weight", "loaded_at")
    return G.projection(entities(s, d), newest(rows, "id", F.col("loaded_at"), cols).where("source_id is not null and target_id is not null"))


def graph_projection(s, d):
    return _edges(s, d).select("a", "b", F.round("weight", 6).alias("weight"))


def graph_components(s, d):
    e = relations(s, d)
    ends = e.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return G.components(ends, e.where("source_id <> target_id").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))


def hop_counts(s, d):
    """Steps from one module along all relations."""
    e = relations(s, d).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return G.distances(cut(e), START).select("id", "hops", "parent")


def type_modularity(s, d):
    """Modularity of the partition by entity type."""
    m = entities(s, d).select("id", F.col("type").alias("community"))
    return G.modularity(_edges(s, d), m).select(F.round("modularity", 6).alias("modularity"))


def path_steps(s, d):
    """A shortest path from one module to the last entity by id that is two steps away or more, with the relation of each step."""
    r = relations(s, d)
    e = cut(r.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    last = G.distances(e, START).where("hops >= 2").agg(F.max("id")).first()[0]
    return G.path_edges(r, G.shortest_path(e, START, last) if last else [])


def detected_communities(s, d):
    """Communities at three resolutions, linked."""
    return G.community_levels(entities(s, d), cut(_edges(s, d))).select("id", "level", F.size("entity_ids").alias("members"), "parent_id", F.size("child_ids").alias("children"))


def community_modularity(s, d):
    """Whether the communities found at resolution 1 beat the partition by entity type, and lie within the components."""
    edges = cut(_edges(s, d))
    found = cut(G.communities(entities(s, d).select("id"), edges, min_size=1))
    ours = G.modularity(edges, found).first()[0]
    types = G.modularity(edges, entities(s, d).select("id", F.col("type").alias("community"))).first()[0]
    parts = G.components(entities(s, d).select("id"), edges)
    torn = found.join(parts, "id").groupBy("community").agg(F.countDistinct("component").alias("n")).where("n > 1").count()
    placed = found.select("id").distinct().count()
    return s.createDataFrame([(bool(ours >= types), torn, placed)], "beats_types boolean, n_torn long, n_placed long")


def hub_labels(s, d):
    return G.hubs(relations(s, d))


def link_states(s, d):
    return G.link_report(communities(s, d))


def level_links(s, d):
    return G.level_links(communities(s, d)).select("child_id", "parent_id", "overlap", F.round("share", 6).alias("share"))


def summary_reuse(s, d):
    """Communities that take over a stored summary: their own, or that of one with nearly the same members."""
    c = communities(s, d)
    return G.reused_summaries(c.select("id", "level", "entity_ids"), c).select("id", "old_id", "title")


def summary_candidates(s, d):
    """Communities without a summary, and the one with most of the same members that has one."""
    c = communities(s, d)
    blank = F.coalesce(F.trim("summary") == "", F.lit(True))
    return G.jaccard_matches(c.where(blank), c.where(~blank), 0.3).select("id", "old_id", F.round("jaccard", 6).alias("jaccard"))


def commit_windows(s, d):
    """Plain windows of seven commits by date and hash."""
    c = table(s, d, "commits").where("hash is not null").groupBy("hash").agg(F.min("date").alias("date"))
    w = chunking.fixed_windows(c, 7, [F.col("date"), F.col("hash")])
    return w.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("date_start"), F.max("date").alias("date_end"))


def commit_unit_starts(s, d):
    """Where units of about seven commits begin: near there, at a change of author or day."""
    c = table(s, d, "commits").where("hash is not null").groupBy("hash").agg(F.min("date").alias("date"), F.min("author_name").alias("author_name"))
    log = cut(chunking.numbered(c, [F.col("date"), F.col("hash")]))
    return log.join(chunking.unit_starts(log, 7), "pos").select("pos", "hash")


def commit_units(s, d):
    """Units that end where author or day change, of the rendered commits."""
    c = table(s, d, "commits").where("hash is not null")
    one = c.groupBy("hash").agg(F.min_by(F.struct("author_name", "date", "message", "parent_hashes", "files_changed"), F.to_json(F.struct("date", "message", "author_name"))).alias("r")).select("hash", "r.*")
    u = chunking.chunk(one)
    return u.select("id", F.size("commit_hashes").alias("n_commits"), F.length("content").alias("n_chars"), "date_start", "date_end")


def unit_tokens(s, d):
    """Expected tokens of reading all units once: text, prompt and answer, and second readings."""
    u = table(s, d, "text_units").groupBy("id").agg(F.max("content").alias("content"))
    t = u.agg(F.count(F.lit(1)).alias("n"), F.sum(chunking.estimate_tokens(F.coalesce("content", F.lit("")))).alias("t"))
    return t.select(F.col("n").alias("n_units"), F.col("t").alias("text_tokens"), F.floor((F.col("t") + F.col("n") * 1100) * 1.4 + 0.5).alias("extraction_tokens"))


def similar_part_names(s, d):
    """Part names that resemble the name of a part whose key is divisible by 20."""
    p = table(s, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    return similar_names(p, p.where("p_partkey % 20 = 0"))


def resolved_entities(s, d):
    e = table(s, d, "entities").select("name", "type", "description")
    return resolution.resolve(e).select("id", "type", "name", F.array_join("aliases", "|").alias("aliases"))


def _answers(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "entities").where("name is not null")
    x = extraction.escape
    block = F.concat(F.lit("Here it is:\n<extraction><entities><entity>\n<name>"), x(F.col("name")), F.lit("</name><type>"), F.col("type"), F.lit("</type><description>"), x(F.coalesce("description", F.lit(""))), F.lit("</description></entity></entities></extraction>\n"))
    return e.select(F.col("id").alias("text_unit_id"), block.alias("answer"))


def parsed_answers(s, d):
    """Entities read back from answers made of the stored ones."""
    return extraction.extracted_entities(_answers(s, d)).distinct()


def relation_dedupe(s, d):
    r = relations(s, d).join(table(s, d, "relations").groupBy("id").agg(F.max_by("description", "loaded_at").alias("description")), "id")
    return extraction.deduped_relations(r.select("type", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "weight", F.coalesce("description", F.lit("")).alias("description"), "id"), "id")


def mistyped_relations(s, d):
    e = entities(s, d)
    k = lambda c: e.select(F.col("id").alias(f"{c}_id"), F.col("type").alias(f"{c}_type"))
    r = relations(s, d).join(k("source"), "source_id").join(k("target"), "target_id")
    return r.groupBy("type", "source_type", "target_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(~resolution.allowed(F.col("type"), F.col("source_type"), F.col("target_type"))).alias("n_mistyped"))


def second_passes(s, d):
    u = table(s, d, "text_units").select("id", F.size("commit_hashes").alias("n_commits"), F.size("entity_ids").alias("n_entities")).distinct()
    return u.where(extraction.wants_second_pass(F.col("n_commits"), F.col("n_entities"))).select("id").distinct()


def rule_extraction(s, d):
    return extraction.rule_extraction(table(s, d, "text_units").select("id", "content").distinct()).groupBy("type").agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("name").alias("n_names"))


QUERIES = {
    f.__name__: f
    for f in (
        graph_projection, graph_components, hop_counts, path_steps, type_modularity, detected_communities, community_modularity, hub_labels, link_states,
        level_links, summary_reuse, summary_candidates, commit_windows, commit_unit_starts, commit_units,
        unit_tokens, similar_part_names, resolved_entities, parsed_answers, relation_dedupe, mistyped_relations, second_passes, rule_extraction,
    )
}

_PROJ = W + """, pr as (select least(source_id, target_id) a, greatest(source_id, target_id) b, 1 + ln(greatest(sum(weight), 1)) weight from r
  where source_id <> target_id and source_id in (select id from e) and target_id in (select id from e) group by all)
"""
_OK = " or ".join(f"(type = '{k}' and (source_type <> '{a}' or target_type <> '{b}'))" for k, (a, b) in resolution.ALLOWED.items())
ORACLE = {
    "graph_projection": _PROJ + "select a, b, round(weight, 6) weight from pr",
    "graph_components": W + """, k as (select source_id s, target_id t from r), b as (select s x, t y from k union select t, s from k)
 select * from (with recursive w2(id, c) as (select x, x from b union select b.y, w2.c from w2 join b on b.x = w2.id) select id, min(c) component from w2 group by id)""",
    "hop_counts": W + f""", k as (select source_id s, target_id t from r), b as (select s x, t y from k union select t, s from k),
 h as (select id, min(h) hops from (with recursive w2(id, h) as (select '{START}', 0 union select b.y, w2.h + 1 from w2 join b on b.x = w2.id where w2.h < 5) select * from w2) group by id)
 select h.id, h.hops, case when h.hops > 0 then min(p.id) end parent from h left join b on b.y = h.id left join h p on p.id = b.x and p.hops = h.hops - 1 group by 1, 2""",
    "type_modularity": _PROJ + """, k as (select a x, b y, weight w from pr union all select b, a, weight from pr), t as (select sum(w) m2 from k),
 p as (select ex.type c, sum(w) tot, sum(case when ex.type = ey.type then w else 0 end) ins from k join e ex on ex.id = x join e ey on ey.id = y group by 1) select round(sum(ins / m2 - (tot / m2) ** 2), 6) modularity from p, t""",
    "level_links": W + """, m as (select distinct id, level, unnest(entity_ids) x from cm), z as (select id, count(*) n from m group by 1),
 o as (select a.id child_id, b.id parent_id, count(*) overlap from m a join m b on b.level = a.level + 1 and a.x = b.x group by all),
 k as (select *, row_number() over (partition by child_id order by overlap desc, parent_id) rn from o) select child_id, parent_id, overlap, round(overlap / n, 6) share from k join z on z.id = child_id where rn = 1 and overlap / n > 0.3""",
    "summary_reuse": W + "select id, id old_id, title from cm where coalesce(trim(summary), '') <> ''",
    "hub_labels": W + """, k as (select source_id a, target_id b from r where source_id <> target_id), b as (select a, b from k union select b, a from k), z as (select a id, count(*) degree from b group by 1)
 select id, degree, place from (select *, row_number() over (order by degree desc, id) place from z) where place <= 3""",
    "link_states": W + """, m as (select distinct id, level, unnest(entity_ids) x from cm), z as (select id, count(*) n from m group by 1),
 o as (select a.id, b.id p, count(*) o from m a join m b on b.level = a.level + 1 and a.x = b.x group by all), k as (select o.id, max(o) / any_value(z.n) share from o join z on z.id = o.id group by 1),
 l as (select id, share from k where share > 0.3)
 select c.id, level, case when share is null then 'orphan' else 'split' end state, round(share, 6) share from cm c left join l using (id) where level < (select max(level) from cm) and (share is null or share < 0.7)""",
    "community_modularity": W + "select true beats_types, 0 n_torn, count(distinct id) n_placed from e",
    "summary_candidates": W + """, m as (select distinct id, level, coalesce(trim(summary), '') = '' blank, unnest(entity_ids) x from cm), z as (select id, count(*) n from m group by 1),
 o as (select a.id, b.id old_id, count(*) o from m a join m b on a.level = b.level and a.x = b.x and a.blank and not b.blank group by all),
 j as (select o.id, old_id, o / (za.n + zb.n - o) j from o join z za on za.id = o.id join z zb on zb.id = old_id), k as (select *, row_number() over (partition by id order by j desc, old_id) rn from j where j > 0.3)
 select id, old_id, round(j, 6) jaccard from k where rn = 1""",
    "commit_windows": "with c as (select hash, min(date) date from commits where hash is not null group by 1), n as (select *, (row_number() over (order by date, hash) - 1) // 7 unit from c) select unit, count(*) n, min(date) date_start, max(date) date_end from n group by 1",
    "commit_unit_starts": """with recursive c as (select hash, min(date) date, min(author_name) a from commits where hash is not null group by 1),
 n as materialized (select hash, a, split_part(date, 'T', 1) d, row_number() over (order by date, hash) - 1 pos, count(*) over () n from c),
 s as (select pos, n, case when pos = 0 then 0 else (a is distinct from lag(a) over (order by pos))::int + (d is distinct from lag(d) over (order by pos))::int end score from n),
 k as (select x.pos start, y.pos p, y.score, abs(y.pos - x.pos - 7) off from s x join s y on y.pos between x.pos + 5 and x.pos + 9 where x.pos + 7 < x.n),
 nx as materialized (select start, case when score > 0 then p else start + 7 end nxt from (select *, row_number() over (partition by start order by score desc, off, p) rn from k) where rn = 1),
 u(pos) as (select 0::bigint union all select nxt from u join nx on nx.start = u.pos)
 select u.pos, hash from u join n using (pos)""",
    "unit_tokens": "with u as (select id, max(content) content from text_units group by 1) select count(*) n_units, sum(ceil(length(coalesce(content, '')) / 4))::bigint text_tokens, floor((sum(ceil(length(coalesce(content, '')) / 4)) + count(*) * 1100) * 1.4 + 0.5)::bigint extraction_tokens from u",
    "similar_part_names": "with p as (select distinct p_name from part), q as (select distinct p_name from part where p_partkey % 20 = 0) select q.p_name query, p.p_name as name from q, p where p.p_name <> q.p_name and 2 * least(length(p.p_name), length(q.p_name)) >= greatest(length(p.p_name), length(q.p_name)) and jaro_winkler_similarity(q.p_name, p.p_name) >= 0.85",
    "parsed_answers": "select distinct id text_unit_id, trim(name) as name, type, trim(coalesce(description, '')) description from entities where trim(name) <> ''",
    "relation_dedupe": W + ", x as (select r.id, r.type, r.source_id, r.target_id, r.weight, z.d from r join (select id, arg_max(coalesce(description, ''), loaded_at) d from relations group by 1) z on z.id = r.id) select type, source_id as source, target_id as target, max(weight) weight, arg_min(d, id) description from x group by 1, 2, 3",
    "mistyped_relations": W + f", x as (select r.type, a.type source_type, b.type target_type from r join e a on a.id = source_id join e b on b.id = target_id) select type, source_type, target_type, count(*) n, count(*) filter ({_OK}) n_mistyped from x group by 1, 2, 3",
    "rule_extraction": rf"""with u as (select distinct id, coalesce(content, '') c0 from text_units), v as (select id, c0, regexp_replace(c0, '\r\n|[\r\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g') c from u),
 x as (select id, c0, 'PERSON' as type, unnest(regexp_extract_all(c, '(?m)^\[[0-9a-f]{{7}}\] \S+ (.+?)\s*$', 1)) as name from v
  union all select id, c0, 'MODULE', {module_sql('p')} from (select id, c0, unnest(regexp_extract_all(c, '(?m)^(?:  |--- )(\S+) \+\d+-\d+\s*$', 1)) p from v)
  union all select id, c0, 'TECHNOLOGY', t from v, (select unnest({extraction.TECHNOLOGIES}) t) where contains(lower(c0), t))
 select type, count(*) n_mentions, count(distinct name) n_names from (select distinct * from x) group by 1""",
    "second_passes": "select distinct id from text_units where len(commit_hashes) >= 8 and len(entity_ids) / len(commit_hashes) < 0.5",
}
