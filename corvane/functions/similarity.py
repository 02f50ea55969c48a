"""String similarity that the JVM lacks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised by a tenth of the distance to 1 for each of up to four equal first letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = list(b)
    mine, places = [], []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] == c:
                free[j] = None
                mine.append(c)
                places.append(j)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [b[j] for j in sorted(places)]
    swapped = sum(x != y for x, y in zip(mine, theirs)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def similar_names(names: DataFrame, queries: DataFrame, least: float = 0.85, block: int = 1000) -> DataFrame:
    """(query, name) of the names that resemble each of a stated set of queries. Both: name. Queries go round in blocks."""
    q = queries.select(F.col("name").alias("q")).where("q is not null").distinct()
    n = max(1, -(-q.count() // block))
    lists = q.groupBy(F.pmod(F.xxhash64("q"), F.lit(n)).alias("b")).agg(F.collect_list("q").alias("qs")).select("qs")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(x, name) for name, qs in zip(batch["name"], batch["qs"]) for x in qs if x != name and 2 * min(len(x), len(name)) >= max(len(x), len(name)) and jaro_winkler(x, name) >= least]
            yield pd.DataFrame(out, columns=["query", "name"])

    rows = names.select("name").where("name is not null").distinct().join(lists, F.lit(True))
    return rows.mapInPandas(compare, "query string, name string")
