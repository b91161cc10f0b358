"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.01  # a key is hot from this share of the rows; no more than 1 / HOT_SHARE keys can be
FANOUT = 64


def hot_key_hashes(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """One row: hashes of the heaviest keys, at most ``1 / share`` of them.

    A mergeable heavy-hitter sketch: one small state per map task, no shuffle of the keys. The list
    only steers salting, so an estimate is enough: joins below are exact for any list.
    """
    key = "xxhash64(" + ", ".join(f"`{k}`" for k in keys) + ")"
    most = min(1000, int(1 / max(share, 1e-3)))
    return df.agg(
        F.expr(
            f"transform(filter(approx_top_k({key}, {most}, {64 * most}), x -> x.count >= {share} * count(1)), x -> x.item)"
        ).alias("hot")
    )


def spread_join(
    big: DataFrame,
    other: DataFrame,
    keys: list[str],
    how: str = "inner",
    share: float = HOT_SHARE,
    fanout: int = FANOUT,
    hot: list[int] | None = None,
) -> DataFrame:
    """Equi join whose hot keys are spread over ``fanout`` tasks.

    Rows of ``big`` under a hot key get a salt from their own content, rows of ``other`` under
    that key are repeated once per salt. Each pair still meets exactly once, so inner, left,
    left_semi and left_anti joins are exact. Cold keys are not touched. ``hot`` reuses a list taken
    before; otherwise it is a scalar subquery of the join itself.
    """
    if hot is None:
        listed = hot_key_hashes(big, keys, share).scalar()
    elif hot:
        listed = F.array(*[F.lit(h).cast("long") for h in hot])
    else:
        return big.join(other, keys, how)
    content = [c for c in big.columns if big.schema[c].dataType.typeName() not in ("map", "struct", "array")]
    is_hot = F.array_contains(listed, F.xxhash64(*keys))
    salted = big.withColumn(
        "_salt", F.when(is_hot, F.pmod(F.xxhash64(*content), F.lit(fanout))).otherwise(F.lit(0)).cast("int")
    )
    spread = other.withColumn(
        "_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(fanout - 1))).otherwise(F.array(F.lit(0))))
    )
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


def previous_value(df: DataFrame, keys: list[str], order: Column | list[str], bucket: Column, value: str, name: str) -> DataFrame:
    """``lag(value)`` per key in ``order``, with the rows of one key split into ordered buckets.

    ``bucket`` must not decrease along ``order`` (columns travel once; an expression travels beside them). The window
    sorts only one bucket of a key at a time. The value that enters a bucket comes from the last row of the one
    before: only first and last rows of buckets are ordered over the whole key.
    """
    from pyspark.sql import Window as W

    places = list(order) if isinstance(order, list) else ["_o"]
    rows = df.withColumn("_b", bucket) if isinstance(order, list) else df.withColumn("_b", bucket).withColumn("_o", order)
    # The hash comes first so that sorting compares numbers, not the texts of the keys.
    rows = rows.withColumn("_h", F.xxhash64(*keys, "_b"))
    mine = W.partitionBy("_h", *keys, "_b").orderBy(*places)
    current = F.struct(F.col(value).alias("v"))
    inside = rows.withColumn("_p", F.lag(current).over(mine)).withColumn("_n", F.lead(F.lit(True)).over(mine))
    first, last = F.col("_p").isNull(), F.col("_n").isNull()
    entered = (
        inside.filter(first | last)
        .withColumn("_in", F.lag(current).over(W.partitionBy(*keys).orderBy("_b", *places)))
        .filter(first).withColumn("_p", F.col("_in")).drop("_in")
    )
    return inside.filter(~first).unionByName(entered).withColumn(name, F.col("_p")["v"]).drop("_b", "_o", "_h", "_p", "_n")
