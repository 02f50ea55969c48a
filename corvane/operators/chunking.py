"""Text units from a commit log.

A unit ends near every ``target`` commits, where author or day change. Where the next unit ends depends
only on where this one began, so the choice is computed for every position at once by window functions;
the chain of actual ends is then followed block by block: each block reports, for the few positions at
which a unit can enter it, where the unit leaves it, and one short pass over the blocks joins them up.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import unit_id
from ..session import cut

RADIUS = 2
MIN_SEARCH = 4
#: Positions that one task follows.
BLOCK = 100_000


def fixed_windows(commits: DataFrame, target: int, order: list[Column]) -> DataFrame:
    """Adds the unit number of plain windows of ``target`` commits."""
    return numbered(commits, order).withColumn("unit", F.floor(F.col("pos") / target))


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``pos``, the place in the order, by sorted ranges and their sizes: no single task sees all rows."""
    n = max(1, df.sparkSession.sparkContext.defaultParallelism)
    ranged = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part, row = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND((1 << 33) - 1)
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition.
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return ranged.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("pos", F.col("_before") + row).drop("_p", "_mid", "_before")


def unit_starts(log: DataFrame, target: int) -> DataFrame:
    """(pos) where units begin. ``log``: pos, author_name, date."""
    spark = log.sparkSession
    n = log.count()
    if not n:
        return spark.createDataFrame([], "pos long")
    if target < MIN_SEARCH:
        return log.select("pos").where(F.col("pos") % target == 0)
    # Neighbours meet by a block and a copy of its border: windows never span the whole log.
    day = F.split("date", "T")[0]
    rows = log.select("pos", "author_name", day.alias("day"))
    border = rows.where((F.col("pos") + 1) % BLOCK == 0).select((F.col("pos") + 1).alias("b"), "pos", "author_name", "day")
    blocks = rows.select((F.col("pos") - F.col("pos") % BLOCK).alias("b"), "pos", "author_name", "day").unionByName(border)
    w = Window.partitionBy("b").orderBy("pos")
    changed = lambda c: (~F.col(c).eqNullSafe(F.lag(c).over(w))).cast("int")
    score = blocks.select("b", "pos", F.when(F.lag("pos").over(w).isNull(), 0).otherwise(changed("author_name") + changed("day")).alias("score")).where("pos >= b")
    cand = score.select("pos", "score", F.explode(F.sequence(F.lit(-RADIUS), F.lit(RADIUS))).alias("off")).select((F.col("pos") - target - F.col("off")).alias("start"), "pos", "score", "off").where("start >= 0")
    # Best score, then nearest, then first; without any change the target itself.
    pick = F.max_by("pos", F.struct("score", -F.abs("off"), -F.col("pos")))
    nxt = cand.groupBy("start").agg(F.when(F.max("score") > 0, pick).otherwise(F.col("start") + target).alias("next"))
    nxt = cut(nxt.where(F.col("start") + target < n).select((F.col("start") - F.col("start") % BLOCK).alias("b"), "start", "next"))
    entries = target + RADIUS + 1

    def leave(key, pdf: pd.DataFrame) -> pd.DataFrame:
        b = key[0]
        step = dict(zip(pdf["start"], pdf["next"]))
        out = []
        for e in range(b, b + entries):
            p = e
            while p in step and p < b + BLOCK:
                p = step[p]
            out.append((b, e, p))
        return pd.DataFrame(out, columns=["b", "entry", "exit"])

    def starts(key, pdf: pd.DataFrame) -> pd.DataFrame:
        b, out = key[0], []
        step = dict(zip(pdf["start"], pdf["next"]))
        p = pdf["enter"].iloc[0]
        while p < b + BLOCK:
            out.append(p)
            if p not in step:
                break
            p = step[p]
        return pd.DataFrame({"pos": out})

    exits = {(r["b"], r["entry"]): r["exit"] for r in nxt.groupBy("b").applyInPandas(leave, "b long, entry long, exit long").toLocalIterator()}
    enter, p = [], 0
    while True:
        b = p - p % BLOCK
        enter.append((b, p))
        q = exits.get((b, p), p)
        if q - q % BLOCK == b:
            break
        p = q
    entered = spark.createDataFrame(enter, "b long, enter long")
    blocks_in = entered.join(nxt, "b", "left")
    return blocks_in.select("b", "enter", F.coalesce("start", F.lit(-1)).alias("start"), F.coalesce("next", F.lit(-1)).alias("next")).groupBy("b").applyInPandas(starts, "pos long")


def rendered(commits: DataFrame, max_files: int = 50, max_diff_lines: int = 200, max_message: int = 5000) -> Column:
    """The text of one commit: header, message, files without a diff, then files with one. Merges show no files."""
    files = F.when(F.size("parent_hashes") > 1, F.array().cast(commits.schema["files_changed"].dataType)).otherwise(F.coalesce("files_changed", F.array().cast(commits.schema["files_changed"].dataType)))
    shown = lambda f: F.coalesce((F.trim(f["diff"]) != "") & ~f["diff"].startswith("Binary files") & ~f["diff"].startswith("GIT binary patch"), F.lit(False))
    plain, diffs = F.filter(files, lambda f: ~shown(f)), F.filter(files, shown)
    n_plain, n_diffs = F.size(plain), F.size(diffs)
    count = lambda f: F.concat(F.lit(" +"), F.coalesce(f["additions"], F.lit(0)), F.lit("-"), F.coalesce(f["deletions"], F.lit(0)))
    room = F.greatest(F.lit(max_files) - F.least(n_plain, F.lit(max_files)), F.lit(1))

    def diff(f: Column) -> Column:
        lines = F.split(f["diff"], "\n")
        over = F.size(lines) - max_diff_lines
        return F.when(over <= 0, f["diff"]).otherwise(F.concat(F.array_join(F.slice(lines, 1, max_diff_lines), "\n"), F.lit("\n... "), over, F.lit(" more lines")))

    none = F.array().cast("array<string>")
    day = F.split("date", "T")[0]
    head = F.array(
        F.concat(F.lit("["), F.substring("hash", 1, 7), F.lit("] "), F.coalesce(day, F.lit("")), F.lit(" "), F.coalesce("author_name", F.lit(""))),
        F.when(F.length("message") > max_message, F.concat(F.substring("message", 1, max_message), F.lit("..."))).otherwise(F.coalesce("message", F.lit(""))),
    )
    parts = F.concat(
        head,
        F.transform(F.slice(plain, 1, max_files), lambda f: F.concat(F.lit("  "), f["path"], count(f))),
        F.when(n_plain > max_files, F.array(F.concat(F.lit("  ... and "), n_plain - max_files, F.lit(" more files")))).otherwise(none),
        F.flatten(F.transform(F.slice(diffs, F.lit(1), room), lambda f: F.array(F.concat(F.lit("--- "), f["path"], count(f)), diff(f)))),
        F.when(n_diffs > room, F.array(F.concat(F.lit("... and "), n_diffs - room, F.lit(" more diffs")))).otherwise(none),
    )
    return F.array_join(parts, "\n")


def chunk(commits: DataFrame, target: int = 7, max_tokens: int = 5000, order: list[Column] | None = None, **limits: int) -> DataFrame:
    """(id, content, commit_hashes, date_start, date_end) of units; too long ones are halved until they fit or hold one commit."""
    order = order or [F.col("date"), F.col("hash")]
    log = cut(numbered(commits.withColumn("_text", rendered(commits, **limits)).select("hash", "author_name", "date", "_text"), order))
    starts = unit_starts(log.select("pos", "author_name", "date"), target).select(F.col("pos").alias("start"))
    # A unit has at most target + RADIUS commits, so each commit looks that far back for its start; texts stay out of it.
    near = log.select("pos", F.explode(F.sequence(F.lit(0), F.lit(target + RADIUS))).alias("back")).select("pos", (F.col("pos") - F.col("back")).alias("start"))
    placed = log.withColumnRenamed("_text", "text").join(near.join(starts, "start").groupBy("pos").agg(F.max("start").alias("start")), "pos")
    schema = "content string, commit_hashes array<string>, date_start string, date_end string"

    def render(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        out, todo = [], [pdf]
        while todo:
            part = todo.pop(0)
            text = "\n\n".join(part["text"]).strip()
            if -(-len(text) // 4) <= max_tokens or len(part) <= 1:
                out.append((text, part["hash"].tolist(), part["date"].iloc[0], part["date"].iloc[-1]))
            else:
                mid = -(-len(part) // 2)
                todo[:0] = [part.iloc[:mid], part.iloc[mid:]]
        return pd.DataFrame(out, columns=["content", "commit_hashes", "date_start", "date_end"])

    units = placed.groupBy("start").applyInPandas(render, schema)
    return units.select(unit_id(F.col("commit_hashes")).alias("id"), "content", "commit_hashes", "date_start", "date_end")


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)
