"""Queries of the llm problems and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import session
from ..session import table
from . import cooccurrence, names, packing, repetition, splitting, tokens


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return p2_pieces(s, d).where("n_pieces > 1").select("id").distinct()


def p2_pieces(s: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(s, d, "text_units"), oversized_only=True)


def p2_cover(s: SparkSession, d: str) -> DataFrame:
    """Per oversized unit: its texts, and whether their pieces give them back, keep to the limit and share 400 characters with the one before."""
    own = F.when(F.col("piece") == 0, F.col("content")).otherwise(F.substr("content", F.lit(401)))
    before = F.lag("stop").over(Window.partitionBy("id", "item").orderBy("piece"))
    p = p2_pieces(s, d).select("id", "item", "piece", own.alias("own"), (F.length("content") <= 4800).alias("within"), F.coalesce(F.col("start") == before - 400, F.lit(True)).alias("shares"))
    # Few pieces an item, whatever the number of items.
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "own"))), lambda x: x["own"]), "")
    items = p.groupBy("id", "item").agg((F.xxhash64(whole) == F.col("item")).alias("rebuilt"), F.bool_and("within").alias("within"), F.bool_and("shares").alias("shares"))
    return items.groupBy("id").agg(F.count(F.lit(1)).alias("n_texts"), *[F.bool_and(c).alias(c) for c in ("rebuilt", "within", "shares")])


def _people(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    people = table(s, d, "entities").where("type = 'PERSON'").select("id", "name", "aliases", "metadata", "frequency")
    return people, table(s, d, "commits").select("author_name", "author_email")


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(names.variants(*_people(s, d)))


def p4_members(s: SparkSession, d: str) -> DataFrame:
    return names.variants(*_people(s, d))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    pairs, n = cooccurrence.commit_baskets(table(s, d, "commits"))
    found = cooccurrence.pair_counts(pairs, 6).where("100 * n_ab * n_ab >= 9 * n_a * n_b").where(F.col("n_ab") * n >= 3 * F.col("n_a") * F.col("n_b"))
    return found.select(F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


def p5_pairs(s: SparkSession, d: str) -> DataFrame:
    pairs, n = cooccurrence.commit_baskets(table(s, d, "commits"))
    found = cooccurrence.with_lift(cooccurrence.pair_counts(pairs), n)
    return found.select(F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p7_ids(s: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(s, d, "documents"))


def p7_decoded(s: SparkSession, d: str) -> DataFrame:
    return tokens.decode(p7_ids(s, d)).select("doc_id", "text")


def p8_packed(s: SparkSession, d: str) -> DataFrame:
    sizes = tokens.count(table(s, d, "documents"), ["doc_id", "source"])
    return packing.pack(sizes).select("doc_id", "piece", "start", "n_tokens", "container", "at", "win")


def p8_sizes(s: SparkSession, d: str) -> DataFrame:
    """Tokens placed of each document: all of them."""
    return p8_packed(s, d).groupBy("doc_id").agg(F.count_if(F.col("n_tokens") == 2048).alias("full_pieces"), F.sum("n_tokens").alias("n_tokens"))


def p8_fill(s: SparkSession, d: str) -> DataFrame:
    return p8_packed(s, d).groupBy("container").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("used")).withColumn("free", 2048 - F.col("used"))


def _even(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents packed to equal shares of all sources, and those shares."""
    sizes = session.cut(tokens.count(table(s, d, "documents"), ["doc_id", "source"]))
    target = sizes.select("source").distinct().withColumn("weight", F.lit(1.0))
    return packing.pack(sizes, target=target), target


def p8_mixture(s: SparkSession, d: str) -> DataFrame:
    """(block, win, source, got, wanted) where every source is to give as many tokens to each window."""
    m = packing.mixture(*_even(s, d))
    return m.select("block", "win", "source", "got", F.round("wanted", 3).alias("wanted"))


def p8_checks(s: SparkSession, d: str) -> DataFrame:
    """Documents packed, and counts of what must not be: overfull containers, gaps or overlaps in them, cut documents that fit, and lost parts."""
    p = session.cut(p8_packed(s, d))
    boxes = p.withColumn("free", F.col("at") - F.coalesce(F.lag(F.col("at") + F.col("n_tokens")).over(Window.partitionBy("container").orderBy("at", "n_tokens")), F.lit(0)))
    boxes = boxes.agg(F.count_if(F.col("at") + F.col("n_tokens") > 2048).alias("n_overfull"), F.count_if(F.col("free") != 0).alias("n_gaps"))
    docs = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("piece").alias("last"), F.sum("n_tokens").alias("t"), F.min(F.when(F.col("n_tokens") < 2048, F.col("piece"))).alias("rest"))
    true = tokens.count(table(s, d, "documents"), ["doc_id"]).join(docs, "doc_id", "left")
    docs = true.agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.count_if(F.col("n_tokens").eqNullSafe(F.col("t")) & (F.col("n") == F.col("last") + 1)).alias("n_whole"),
        F.count_if((F.col("n") > 1) & (F.col("n_tokens") <= 2048)).alias("n_cut"),
        F.count_if(F.col("rest") < F.col("last")).alias("n_short"),
    )
    return docs.join(boxes, F.lit(True))


def p9_found(s: SparkSession, d: str) -> DataFrame:
    found = repetition.repetition(table(s, d, "documents"))
    return found.where("n_words > 0 and 10 * words_6 >= 3 * n_words").select("doc_id").distinct()


def p9_shares(s: SparkSession, d: str) -> DataFrame:
    r = repetition.repetition(table(s, d, "documents"))
    return r.select("doc_id", "n_words", F.round(repetition.share("words_6", "n_words"), 6).alias("word_share"), *[F.round(repetition.share(f"chars_{n}", "n_chars"), 6).alias(f"char_share_{n}") for n in (3, 6, 12)], F.round(repetition.share("line_rep", "line_chars"), 6).alias("line_share"))


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p2_cover, p4_found, p4_members, p5_found, p5_pairs, p7_ids, p7_decoded, p8_packed, p8_sizes, p8_fill, p8_mixture, p8_checks, p9_found, p9_shares)}

_BASKETS = r"""
with merge as (select distinct hash from commits where len(parent_hashes) > 1),
 ok as (select * from commits where hash is not null and hash not in (select hash from merge)),
 n as (select count(distinct hash) n from ok),
 p as (select distinct hash, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') path
  from (select hash, unnest(files_changed).path path from ok) where path is not null),
 q as (select * from p where trim(path) <> ''),
 c as (select path, count(*) n from q group by path),
 ab as (select a.path path_a, b.path path_b, count(*) n_ab from q a join q b on a.hash = b.hash and a.path < b.path group by all),
 pairs as (select ab.*, ca.n n_a, cb.n n_b, n.n from ab join c ca on ca.path = path_a join c cb on cb.path = path_b cross join n)
"""
_WORDS = r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\p{Han}\p{Hiragana}\p{Katakana}]|[^\P{L}\p{Han}\p{Hiragana}\p{Katakana}]+') w from documents),
 s as (select doc_id, len(w) n, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i+5], ' '))) g, unnest(range(1, len(w) - 4)) i from w where len(w) >= 6),
 d as (select doc_id, n, i from (select *, row_number() over (partition by doc_id, g order by i) k from s) where k > 1),
 r as (select doc_id, any_value(n) n, count(distinct j) rep from (select doc_id, n, unnest(range(i, i + 6)) j from d) group by doc_id)
"""
_SHARES = _WORDS + "".join(
    rf""",
 s{n} as (select doc_id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i+{n - 1}], ' '))) g, unnest(range(1, len(w) - {n - 2})) i from w where len(w) >= {n}),
 d{n} as (select doc_id, i from (select *, row_number() over (partition by doc_id, g order by i) k from s{n}) where k > 1),
 r{n} as (select j.doc_id, count(*) words, sum(length(w.w[j.j])) chars from (select distinct doc_id, unnest(range(i, i + {n})) j from d{n}) j join w using (doc_id) group by 1)"""
    for n in (3, 6, 12)
) + r""",
 l0 as (select doc_id, unnest(string_split(lower(text), chr(10))) l, generate_subscripts(string_split(lower(text), chr(10)), 1) i from documents),
 l1 as (select doc_id, i, trim(l, concat(chr(9), chr(11), chr(12), chr(13), ' ', chr(160), chr(12288))) l from l0),
 l2 as (select doc_id, length(l) n, row_number() over (partition by doc_id, l order by i) k from l1 where l <> ''),
 l as (select doc_id, sum(n) line_chars, sum(case when k > 1 then n else 0 end) line_rep from l2 group by 1),
 z as (select doc_id, len(w) n_words, list_sum(list_transform(w, lambda x: length(x))) n_chars from w)
 select x.doc_id, coalesce(z.n_words, 0) n_words, round(coalesce(r6.words / nullif(n_words, 0), 0), 6) word_share, round(coalesce(r3.chars / nullif(z.n_chars, 0), 0), 6) char_share_3,
  round(coalesce(r6.chars / nullif(z.n_chars, 0), 0), 6) char_share_6, round(coalesce(r12.chars / nullif(z.n_chars, 0), 0), 6) char_share_12, round(coalesce(line_rep / nullif(line_chars, 0), 0), 6) line_share
 from documents x left join z using (doc_id) left join r3 using (doc_id) left join r6 using (doc_id) left join r12 using (doc_id) left join l using (doc_id)
"""
ORACLE = {
    "p2_cover": 'select id, count(distinct content) n_texts, true rebuilt, true as "within", true shares from text_units where length(content) > 4800 group by id',
    "p8_checks": "select count(*) n_documents, count(*) n_whole, 0 n_cut, 0 n_short, 0 n_overfull, 0 n_gaps from documents",
    "p9_shares": _SHARES,
    "p2_found": "select distinct id from text_units where length(content) > 4800",
    "p5_found": _BASKETS + "select path_a, path_b from pairs where n_ab >= 6 and 100 * n_ab * n_ab >= 9 * n_a * n_b and n_ab * n >= 3 * n_a * n_b",
    "p5_pairs": _BASKETS + "select path_a, path_b, n_ab, n_a, n_b, round(n_ab * n::double / (n_a::double * n_b), 6) lift from pairs",
    "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p9_found": _WORDS + "select doc_id from r where 10 * rep >= 3 * n",
}
