"""A few keys holding most records (problem 6): value-frequency compression.

Rows are grouped by (key, value) first, so each repeated value becomes one weighted row and the
shuffle is spread over values, not keys. The second grouping, by key alone, runs on weighted rows
with a map-side combine: a key holding a third of all rows reaches its reducer as one partial row
per map task. Percentiles never sort a key in one task: weights are first added per coarse bucket
of the value, the bucket with the wanted rank is found from those few sums, and only the weighted
values inside that bucket are ranked.

Defined cases: null keys and keys empty after normalising form no group; null values count as rows
but not as distinct values, modes or percentiles; ties of the mode go to the smallest value;
``percentile`` is the lower nearest-rank value; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_title
from ..session import cut


def compress(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value, weight): one row per distinct pair."""
    return df.select(key.alias("key"), value.alias("value")).where("key is not null").groupBy("key", "value").agg(F.count("*").alias("weight"))


def key_counts(weighted: DataFrame) -> DataFrame:
    """Per key: rows, exact distinct non-null values, from weighted values."""
    return weighted.groupBy("key").agg(F.sum("weight").alias("n_rows"), F.count("value").alias("n_values"))


def key_modes(weighted: DataFrame) -> DataFrame:
    """Per key the most frequent value; of equals the smallest."""
    best = weighted.where("value is not null").groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), "value")).alias("b"))
    return best.select("key", F.col("b.value").alias("mode"), (-F.col("b.w")).alias("mode_rows"))


def key_percentile(weighted: DataFrame, p: float, width: int) -> DataFrame:
    """Exact weighted percentile per key of integer values, by bucket sums of ``width`` values.

    A key's bucket table has at most range / width rows and a bucket at most ``width`` weighted
    values, whatever the number of rows.
    """
    v = weighted.where("value is not null").withColumn("bucket", F.floor(F.col("value") / F.lit(width)))
    sums = v.groupBy("key", "bucket").agg(F.sum("weight").alias("w"))
    run = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("key")
    picked = (
        sums.withColumn("upto", F.sum("w").over(run))
        .withColumn("total", F.sum("w").over(whole))
        .withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(p))))
        .where("upto >= rank and upto - w < rank")
        .select("key", "bucket", (F.col("rank") - F.col("upto") + F.col("w")).alias("rest"))
    )
    inner = Window.partitionBy("key").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        v.join(picked, ["key", "bucket"])
        .withColumn("upto", F.sum("weight").over(inner))
        .where("upto >= rest and upto - weight < rest")
        .select("key", F.col("value").alias("percentile"))
    )


def heavy_keys(weighted: DataFrame, share: float, total: int | Column) -> DataFrame:
    """Key counts with ``share`` and ``is_heavy``: at least ``share`` of ``total`` rows."""
    total = F.lit(total) if isinstance(total, int) else total
    return key_counts(weighted).withColumn("share", F.col("n_rows") / total).withColumn("is_heavy", F.col("n_rows") >= F.lit(share) * total)


def category_members(categorylinks: DataFrame, share: float = 0.02) -> DataFrame:
    """Per normalised category: rows, distinct members, share of the rows with a name, heavy or not.

    ``share`` is measured against all rows with non-null cl_to; names empty after normalising
    count in that total but are no category.
    """
    weighted = compress(categorylinks, norm_title("cl_to"), F.col("cl_from"))
    total = categorylinks.where("cl_to is not null").agg(F.count("*").alias("n")).scalar()
    return heavy_keys(weighted.where("key <> ''"), share, total).withColumnsRenamed({"key": "category", "n_values": "n_members"})


def compress_several(df: DataFrame, key: Column, values: dict[str, Column]) -> DataFrame:
    """(key, kind, n, t, weight): as compress() for several values of a row at once, over one scan and one shuffle.

    ``kind`` is the name of the value, which stands in ``n`` if it is a number and in ``t`` if it is a string.
    """
    kinds = dict(df.select(*(c.alias(k) for k, c in values.items())).dtypes)
    number = lambda k, c: (c if kinds[k] != "string" else F.lit(None)).cast("bigint").alias("n")
    text = lambda k, c: (c if kinds[k] == "string" else F.lit(None)).cast("string").alias("t")
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), number(k, c), text(k, c)) for k, c in values.items()))
    x = df.select(key.alias("key"), F.explode(rows).alias("v")).where("key is not null").select("key", "v.*")
    return x.groupBy("key", "kind", "n", "t").agg(F.count("*").alias("weight"))


def category_profile(categorylinks: DataFrame, share: float = 0.02) -> DataFrame:
    """category_members with the commonest cl_type and the median cl_timestamp in Unix seconds.

    The compressed values are written once; all results derive from them.
    """
    stamp = F.unix_seconds(F.col("cl_timestamp").cast("timestamp"))
    w = cut(compress_several(categorylinks, norm_title("cl_to"), {"member": F.col("cl_from"), "type": F.col("cl_type"), "stamp": stamp}))
    of = lambda kind, value: w.where(F.col("kind") == kind).select("key", F.col(value).alias("value"), "weight")
    # Rows with an empty name count in the total, but are no category.
    total = w.where("kind = 'type'").agg(F.sum("weight").alias("n")).first()["n"] or 0
    members = heavy_keys(of("member", "n").where("key <> ''"), share, total).withColumnsRenamed({"key": "category", "n_values": "n_members"})
    types, stamps = key_modes(of("type", "t")), key_percentile(of("stamp", "n"), 0.5, 86_400)
    return members.join(types.select(F.col("key").alias("category"), F.col("mode").alias("main_type"), "mode_rows"), "category", "left").join(
        stamps.select(F.col("key").alias("category"), F.col("percentile").alias("median_ts")), "category", "left"
    )
