"""Stratified samples: automatic histogram edges, right-closed bins, strata, and a hash-ordered split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def histogram_edges(df: DataFrame, col: str) -> list[float]:
    """Edges of the narrower of the Sturges and Freedman-Diaconis widths; integers get width 1 at least. Scalars only
    come to the driver."""
    c = F.col(col).cast("double")
    r = df.agg(F.min(c), F.max(c), F.count(c), F.percentile(c, 0.25), F.percentile(c, 0.75)).first()
    low, high, n, q1, q3 = r
    if not n:
        return []
    if low == high:
        return [low - 0.5, high + 0.5]
    widths = [(high - low) / (math.log2(n) + 1), 2 * (q3 - q1) / n ** (1 / 3)]
    width = min([w for w in widths if w > 0])
    if dict(df.dtypes)[col] in ("int", "bigint", "smallint", "tinyint"):
        width = max(width, 1.0)
    bins = max(1, math.ceil((high - low) / width))
    return [low + (high - low) * k / bins for k in range(bins + 1)]


def bucket(col: Column, edges: list[float]) -> Column:
    """Number of the right-closed bin, the lowest edge included; null outside, and everywhere without edges."""
    out = F.when(F.lit(False), F.lit(0))
    for k in range(1, len(edges)):
        low = col >= edges[0] if k == 1 else col > edges[k - 1]
        out = out.when(low & (col <= edges[k]), F.lit(k - 1))
    return out.otherwise(F.lit(None).cast("int"))


def split(df: DataFrame, stratum: str, key: str, small: float = 0.05, total: int | None = None) -> DataFrame:
    """Adds `chosen`: of each stratum's rows round(small * n), one at least, or, with `total`, its share of that many rows by
    largest remainders (see `quotas`); the first in md5 order of the key. Rows are ranked over all tasks, so a stratum may
    hold most of them; rows without a stratum are one."""
    ranked = numbered(df.withColumn("_md5", F.md5(F.col(key).cast("string"))), [stratum], ["_md5", key], "_place", "_n")
    if total is None:
        quota = F.greatest(F.lit(1), F.round(F.col("_n") * small)).cast("long")
        return ranked.withColumn("chosen", F.col("_place") < quota).drop("_md5", "_place", "_n")
    sizes = ranked.where("_place = 0").select(F.col(stratum).alias("stratum"), F.col("_n").alias("n"))
    dealt = quotas(sizes, total).select(F.col("stratum").alias("_stratum"), F.col("quota").alias("_quota"))
    return ranked.join(dealt, F.col(stratum).eqNullSafe(F.col("_stratum"))).withColumn("chosen", F.col("_place") < F.col("_quota")).drop("_md5", "_place", "_n", "_stratum", "_quota")


def quotas(sizes: DataFrame, total: int) -> DataFrame:
    """(stratum, n, quota): `total` rows dealt to strata in proportion to their sizes by largest remainders, one at least
    and all at most; sizes(stratum, n) is one row a stratum. A total outside what the strata allow is clamped to it."""
    n, strata = sizes.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not n:
        return sizes.select("stratum", "n", F.lit(0).cast("long").alias("quota"))
    total = min(max(total, strata), n)
    share = F.col("n") * F.lit(total - strata) / F.lit(n - strata if n > strata else 1) - F.lit((total - strata) / (n - strata) if n > strata else 0)
    base = sizes.withColumn("_x", F.greatest(F.lit(0.0), F.round(share, 9))).withColumn("_f", F.floor("_x"))
    left = total - strata - (base.agg(F.sum("_f")).first()[0] or 0)
    # strata are few beside rows: they are ranked as one row each
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("_x") - F.col("_f")), "stratum"))
    return base.withColumn("quota", (1 + F.col("_f") + F.when(rank <= F.lit(int(left)), 1).otherwise(0)).cast("long")).select("stratum", "n", "quota")
