"""Upserts without row-level merge: the new table is derived from old and new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_wins(old: DataFrame, new: DataFrame, keys: list[str], *order) -> DataFrame:
    """``new`` and the rows of ``old`` whose keys it lacks. A key that is twice in ``new`` keeps its last row by ``order``;
    without an order, its greatest by all other columns."""
    rest = [F.desc_nulls_last(c) for c in new.columns if c not in keys]
    last = first_kept(new, keys, *([F.desc_nulls_last(c) if isinstance(c, str) else c.desc_nulls_last() for c in order]), *rest) if rest else new.dropDuplicates(keys)
    return last.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def preserving(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Columns that ``new`` has are replaced for its keys; the others keep their old value."""
    listed = [c for c in new.columns if c not in keys]
    fresh = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in listed), F.lit(True).alias("_hit"))
    out = old.join(fresh, keys, "full_outer")
    for c in listed:
        kept = F.when(F.col("_hit"), F.col(f"_new_{c}"))
        out = out.withColumn(c, kept.otherwise(F.col(c)) if c in old.columns else kept)
    return out.drop("_hit", *(f"_new_{c}" for c in listed))


def first_kept(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """Insert-or-ignore: one row per key, the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
