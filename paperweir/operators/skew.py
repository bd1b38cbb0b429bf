"""Joins that stay even when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweir.session import cut

#: Rows of one key that one task takes; a key with more is spread over as many salts as that asks for.
HOT_ROWS = 100_000
#: Hot keys whose list is broadcast; a longer list is joined by a shuffle.
LISTED = 100_000


def key_counts(left: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key, summed in each task before the shuffle: `*keys, _n`. A written table."""
    return cut(left.groupBy(*keys).agg(F.count("*").alias("_n")), "keys")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = HOT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """`left` joined with `right`, which should hold few rows for each key.

    A key with n > `hot_rows` rows on the left is spread over ceil(n / `hot_rows`) salts, against a copy each of its rows
    on the right, so no task holds more than about `hot_rows` of it; without such keys it is a plain join. The
    list of hot keys is written and counted first, and broadcast only if it is short. `left` is read twice, for
    the counts by its keys alone; `counts` (of `key_counts`) saves that. Null keys match nothing, as in any equi-join.
    """
    hot = cut((key_counts(left, keys) if counts is None else counts).where(F.col("_n") > hot_rows).select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")), "hot")
    n = hot.count()
    if not n:
        return left.join(right, keys, how)
    listed = F.broadcast(hot) if n <= LISTED else hot
    bare = F.lit(False)
    for k in keys:
        bare = bare | F.col(k).isNull()  # many rows without a key go to many tasks too
    salts = F.when(bare, F.lit(1024)).otherwise(F.coalesce("_salts", F.lit(1)))
    spread = left.join(listed, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("_salts")
    copied = right.join(listed, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return spread.join(copied, [*keys, "_salt"], how).drop("_salt")
