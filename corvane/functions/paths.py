"""Path expressions: separators, module names, diff noise, rename notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and directories whose diffs are noise.
NOISE_SUFFIXES = [
    ".lock", ".sum", ".min.js", ".min.css", ".map", ".snap", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico",
    ".woff", ".woff2", ".ttf", ".eot", ".pb", ".pyc", ".pyo", ".class", ".o", ".so", ".dylib",
]
NOISE_DIRS = ["node_modules/", "vendor/", "dist/", "build/", ".next/", "__pycache__/", ".git/"]


def norm_path(c: Column) -> Column:
    """``\\`` as ``/``, without leading ``./``; blank paths become null."""
    path = F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(\./)+", "")
    return F.when(F.trim(path) != "", path)


def module_path(c: Column, depth: int | None = None) -> Column:
    """Module of a file: an index file stands for its directory; other files of three parts or more lose their name."""
    p = F.regexp_replace(c, r"/index\.[^/]+$", "")
    parts = F.split(p, "/")
    parts = F.when(p.rlike(r"(?i)\.[a-z]+$") & (F.size(parts) >= 3), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.array_join(parts if depth is None else F.slice(parts, 1, depth), "/")


def is_noise(c: Column) -> Column:
    """Whether a path's diff isn't worth reading, by its last suffix or a directory in it."""
    suffix = F.lower(F.regexp_extract(c, r"(\.[^.]*)$", 1))
    dirs = F.lit(False)
    for d in NOISE_DIRS:
        dirs = dirs | c.startswith(d) | F.contains(c, F.lit("/" + d))
    return suffix.isin(NOISE_SUFFIXES) | dirs


def renamed_to(c: Column) -> Column:
    """New path of ``{a => b}/f`` and ``a => b``."""
    braces = F.regexp_replace(F.regexp_replace(c, r"\{[^{}]* => ([^{}]*)\}", "$1"), "//", "/")
    return F.when(c.rlike(r"\{[^{}]* => [^{}]*\}"), braces).when(F.contains(c, F.lit(" => ")), F.substring_index(c, " => ", -1)).otherwise(c)


def entity_id(kind: Column, name: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9/_.-]", "-"), "-+", "-"), "^-|-$", "")
    return F.concat(F.lower(kind), F.lit(":"), slug)


def relation_id(kind: Column, a: Column, b: Column) -> Column:
    """The same id in either direction."""
    return F.concat(F.lit("rel:"), F.substring(F.sha2(F.concat_ws(",", kind, F.least(a, b), F.greatest(a, b)), 256), 1, 12))


def unit_id(hashes: Column) -> Column:
    return F.concat(F.lit("tu:"), F.substring(F.sha2(F.array_join(hashes, ","), 256), 1, 12))
