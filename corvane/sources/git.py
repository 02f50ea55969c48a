"""Git history as a source: a batch data source and parsers that turn log output into commit rows.

    spark.dataSource.register(GitLog)
    spark.read.format("gitlog").option("path", repo).option("since", "2024-01-01").load()

Options: path, branch, since (date), since_commit, max_commits (the oldest N, in the log's order).
A repository without commits gives no rows. The parsers work on raw text columns, too, so stored log
output can be read with ``spark.read.text`` and parsed in parallel.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import is_noise, renamed_to

RECORD, FIELD = "\x1e", "\x1f"
HEADER = f"--format={RECORD}%H{FIELD}%an{FIELD}%ae{FIELD}%aI{FIELD}%P{FIELD}%s{FIELD}"
MAX_DIFF_LINES = 500
PASSES = {
    "status": ["--name-status", "-M"],
    "numstat": ["--numstat", "-M"],
    "patch": ["-p", "--no-merges", "--diff-filter=AMRT", "-M"],
}


def log_args(options: dict[str, str]) -> list[str]:
    args = ["log", "--reverse", "--topo-order"]
    if options.get("since"):
        args.append(f"--since={options['since']}")
    if options.get("since_commit"):
        args.append(f"{options['since_commit']}..{options.get('branch') or 'HEAD'}")
    elif options.get("branch"):
        args.append(options["branch"])
    return args


def git(path: str, *args: str) -> str:
    return subprocess.run(["git", "-C", path, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def records(args: list[str], size: int = 1 << 20) -> Iterator[str]:
    """The records of a log as git writes it: one record is held at a time, however long the log."""
    with subprocess.Popen(args, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as run:
        rest, mark = b"", RECORD.encode()
        while block := run.stdout.read(size):
            *whole, rest = (rest + block).split(mark)
            yield from (r.decode("utf-8", "replace") for r in whole if r.strip())
        if rest.strip():
            yield rest.decode("utf-8", "replace")
        error = run.stderr.read()
    if run.returncode:
        raise subprocess.CalledProcessError(run.returncode, args, stderr=error)


def has_commits(path: str) -> bool:
    return subprocess.run(["git", "-C", path, "rev-parse", "--verify", "-q", "HEAD"], capture_output=True).returncode == 0


def head(path: str) -> str | None:
    return git(path, "rev-parse", "HEAD").strip() if has_commits(path) else None


def file_tree(path: str) -> list[str]:
    return [x for x in git(path, "ls-tree", "-r", "--name-only", "-z", "HEAD").split("\0") if x] if has_commits(path) else []


class _Pass(InputPartition):
    def __init__(self, kind: str):
        self.kind = kind


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Pass(k) for k in PASSES] if has_commits(self.options["path"]) else []

    def read(self, partition: _Pass | None) -> Iterator[tuple]:
        if partition is None:  # how Spark reads a source without partitions
            return
        args = ["git", "-C", self.options["path"], "-c", "core.quotepath=off", *log_args(self.options), HEADER, *PASSES[partition.kind]]
        for seq, record in enumerate(records(args)):
            yield partition.kind, seq, record


class GitLog(DataSource):
    """Rows (pass, seq, record): the three passes of the log, one raw record a commit."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "pass string, seq long, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _fields(record: Column) -> Column:
    return F.split(record, FIELD)


def headers(records: DataFrame) -> DataFrame:
    """(hash, author_name, author_email, date, parent_hashes, message, body, seq); records of fewer fields are skipped."""
    f = records.select("seq", _fields(F.col("record")).alias("f")).where(F.size("f") >= 6)
    parents = F.filter(F.split(F.get("f", F.lit(4)), " "), lambda p: p != "")
    return f.select(
        "seq", F.trim(F.get("f", F.lit(0))).alias("hash"), F.get("f", F.lit(1)).alias("author_name"), F.lower(F.get("f", F.lit(2))).alias("author_email"),
        F.get("f", F.lit(3)).alias("date"), parents.alias("parent_hashes"), F.get("f", F.lit(5)).alias("message"), F.coalesce(F.get("f", F.lit(6)), F.lit("")).alias("body"),
    )


def status_lines(commits: DataFrame) -> DataFrame:
    """(hash, n, path, old_path, status) of ``body`` lines of a name-status log."""
    lines = commits.select("hash", F.posexplode(F.split("body", "\n")).alias("n", "line")).where(F.contains("line", F.lit("\t")))
    p = F.split("line", "\t")
    code, moved = F.substring(p[0], 1, 1), F.substring(p[0], 1, 1).isin("R", "C") & (F.size(p) >= 3)
    status = F.when(code.isin("R", "C"), "renamed").when(code == "A", "added").when(code == "D", "deleted").otherwise("modified")
    return lines.select("hash", "n", F.when(moved, F.get(p, F.lit(2))).otherwise(p[1]).alias("path"), F.when(moved, p[1]).alias("old_path"), status.alias("status"))


def numstat_lines(commits: DataFrame) -> DataFrame:
    """(hash, path, additions, deletions) of a numstat log; binary files count 0. The last line of a path holds."""
    lines = commits.select("hash", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    p = F.split("line", "\t")
    n = lambda i: F.coalesce(p[i].try_cast("long"), F.lit(0))
    rows = lines.where(F.size(p) >= 3).select("hash", "n", renamed_to(p[2]).alias("path"), n(0).alias("additions"), n(1).alias("deletions"))
    return rows.groupBy("hash", "path").agg(F.max_by(F.struct("additions", "deletions"), "n").alias("s")).select("hash", "path", "s.*")


def patches(commits: DataFrame, max_lines: int = MAX_DIFF_LINES) -> DataFrame:
    """(hash, path, diff) of a patch log: hunks of each file, at most ``max_lines`` lines, without noisy paths."""
    parts = commits.select("hash", F.posexplode(F.slice(F.split(F.concat(F.lit("\n"), "body"), "\ndiff --git "), F.lit(2), F.lit(1 << 30))).alias("n", "part"))
    path = F.regexp_extract("part", r"^\S.* b/(.*?)(?:\n|$)", 1)
    body = F.regexp_extract("part", r"(?s)\n((?:@@|Binary files|GIT binary patch).*)$", 1)
    diff = F.array_join(F.slice(F.split(F.regexp_replace(body, r"\n+$", ""), "\n"), 1, max_lines), "\n")
    rows = parts.select("hash", "n", path.alias("path"), diff.alias("diff")).where((F.col("path") != "") & (F.col("diff") != ""))
    return rows.where(~is_noise(F.col("path"))).groupBy("hash", "path").agg(F.max_by("diff", "n").alias("diff"))


def commits(log: DataFrame, max_commits: int | None = None) -> DataFrame:
    """Commit rows in the layout of the ``commits`` table, with ``seq``, from (pass, seq, record)."""
    one = lambda kind: headers(log.where(F.col("pass") == kind))
    base = one("status")
    if max_commits is not None:
        base = base.orderBy("seq").limit(max_commits)
    files = status_lines(base)
    stats, diffs = numstat_lines(one("numstat")), patches(one("patch"))

    def looked_up(files: DataFrame, facts: DataFrame, names: list[str]) -> DataFrame:
        """Facts by path, else by the old path."""
        by_new = facts.select("hash", "path", F.struct(*names).alias("a"))
        by_old = facts.select("hash", F.col("path").alias("old_path"), F.struct(*names).alias("b"))
        out = files.join(by_new, ["hash", "path"], "left").join(by_old, ["hash", "old_path"], "left").withColumn("x", F.coalesce("a", "b"))
        return out.select("hash", "n", "path", "old_path", "status", *[c for c in files.columns if c not in ("hash", "n", "path", "old_path", "status")], *[F.col(f"x.{k}").alias(k) for k in names])

    files = looked_up(looked_up(files, stats, ["additions", "deletions"]), diffs, ["diff"])
    f = F.struct("n", "path", "old_path", "status", F.coalesce("additions", F.lit(0)).cast("long").alias("additions"), F.coalesce("deletions", F.lit(0)).cast("long").alias("deletions"), "diff")
    lists = files.groupBy("hash").agg(F.transform(F.sort_array(F.collect_list(f)), lambda x: x.dropFields("n")).alias("files_changed"))
    none = F.array().cast("array<struct<path:string,old_path:string,status:string,additions:bigint,deletions:bigint,diff:string>>")
    return base.drop("body").join(lists, "hash", "left").withColumn("files_changed", F.coalesce("files_changed", none))
