"""Building blocks that keep ranks, quantiles and samples distributed when one key holds most rows.

A plain ``row_number() over (partition by key)`` puts a whole key into one task. Here every key is first cut into
buckets by a coarse, order-preserving function of the sort key; only the small bucket table is accumulated and the
sort happens inside (key, bucket).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.numbers import any_of, bin_by_edges
from tidemark.session import ensure_checkpoint_dir


def materialize(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a shared intermediate once to the folder the cluster names and read it back.

    Unlike a cache it survives lost executors, cuts the lineage and gives the planner a true size.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the cluster delete shuffle files of finished steps now.

    Spark removes them when the driver's JVM collects the plans that made them, which a driver with little to do may put off for half
    an hour. Worth a call between the large steps of an operator that has written its result with ``materialize``.
    """
    spark.sparkContext._jvm.java.lang.System.gc()


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more: all that was made of them must have been written itself."""
    for df in written:
        spark = df.sparkSession.sparkContext
        for file in df.inputFiles()[:1]:
            place = spark._jvm.org.apache.hadoop.fs.Path(file)
            while not place.getName().startswith("tidemark-"):
                place = place.getParent()
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread_scan(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Deal the rows of a table scan to all cores when its files give too few splits (one huge row group, say).

    Only such a scan is dealt out, so what moves is less than ``per_core`` splits a core; a scan with enough splits stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= per_core * cores else df.repartition(per_core * cores)


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """Deal a written table to tasks of about ``rows`` rows, however few files hold it; for rows that a task is about to multiply and sort.

    With ``by`` they are dealt by the hash of a nearly unique key; without it Spark sorts the rows of a reading task before it deals them.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *by)


def hash_bucket(digest: Column, digits: int = 4) -> Column:
    """Leading hex digits of a digest as a number; rises with the digest, so it may bucket an order by digest."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")


HOT_ROWS = 1_000_000  # a key with fewer rows may be sorted by one task


def range_buckets(
    df: DataFrame, keys: Sequence[str], value: Column, hot_rows: int = HOT_ROWS, grid: int = 64, fine: int = 64
) -> DataFrame:
    """Adds ``__bucket``, which rises with the value inside each key and cuts hot keys into up to grid * fine parts.

    Only keys with more than ``hot_rows`` rows are sketched: a mergeable sketch gives ``grid`` split points and every
    range between two of them is divided evenly. All other keys keep the single bucket 0.
    """
    keys = list(keys)
    rows = df.withColumn("__v", value.cast("double"))
    points = [i / grid for i in range(1, grid)]
    facts = [F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.percentile_approx("__v", points, 20 * grid).alias("splits")]
    if keys:
        hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).select(*keys)
        sketch = rows.join(hot, keys, "left_semi").groupBy(*keys).agg(*facts)
        joined = rows.join(sketch.select(*keys, F.struct("lo", "hi", "splits").alias("__s")), keys, "left")
    else:
        sketch = rows.agg(F.count(F.lit(1)).alias("n"), *facts)
        one = sketch.select(F.when(F.col("n") > hot_rows, F.struct("lo", "hi", "splits")).alias("s")).scalar()
        joined = rows.withColumn("__s", one)
    joined = joined.withColumn("__i", bin_by_edges(F.col("__v"), F.col("__s.splits")))
    low = F.when(F.col("__i") == 0, F.col("__s.lo")).otherwise(F.get("__s.splits", F.col("__i") - 1))
    high = F.when(F.col("__i") == F.size("__s.splits"), F.col("__s.hi")).otherwise(F.get("__s.splits", F.col("__i")))
    part = F.floor(F.try_divide(F.col("__v") - low, high - low) * fine)
    inside = F.least(F.greatest(F.coalesce(part, F.lit(0)), F.lit(0)), F.lit(fine - 1))
    bucket = F.when(F.col("__s").isNotNull(), F.col("__i") * fine + inside).otherwise(0).cast("int")
    return joined.withColumn("__bucket", bucket).drop("__v", "__s", "__i")


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column | None = None,
    position: Column | None = None,
    out: str = "rn",
    upto: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """1-based row number per key in the given order; rows without a key or bucket are left out.

    Give either ``bucket``, which must never fall while the order rises, or ``position``, a numeric form of the first
    order column from which buckets are made for hot keys. With ``upto`` only the first rows of each key are kept and
    buckets that start beyond it are skipped before the sort.
    """
    keys = list(keys)
    if bucket is not None:
        marked = df.withColumn("__bucket", bucket)
    elif position is not None:
        marked = range_buckets(df, keys, position, hot_rows)
    else:
        raise ValueError("bucket or position is needed")
    counts = marked.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    placed = marked.join(offsets, [*keys, "__bucket"])
    if upto is not None:
        placed = placed.where(F.col("__off") < upto)
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    ranked = placed.withColumn(out, F.row_number().over(inside) + F.col("__off"))
    if upto is not None:
        ranked = ranked.where(F.col(out) <= upto)
    return ranked.drop("__bucket", "__off")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str = "q", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, as an array column.

    Equal values are counted once; keys with very many distinct values are cut into ranges, and only the ranges that
    hold a wanted rank are sorted. Null keys and null values are left out.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("__x")).where(F.col("__x").isNotNull())
    counted = rows.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__c"))
    bucketed = range_buckets(counted, keys, F.col("__x"), hot_rows)

    per_bucket = bucketed.groupBy(*keys, "__bucket").agg(F.sum("__c").alias("__bn"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, "__bucket", "__bn",
        F.coalesce(F.sum("__bn").over(before), F.lit(0)).alias("__off"),
        F.sum("__bn").over(whole).alias("__total"),
    )
    placed = bucketed.join(offsets, [*keys, "__bucket"])

    def rank_low(p: float) -> Column:
        return F.floor(F.lit(float(p)) * (F.col("__total") - 1))

    def rank_high(p: float) -> Column:
        return F.ceil(F.lit(float(p)) * (F.col("__total") - 1))

    ranks = [r(p) for p in probs for r in (rank_low, rank_high)]
    wanted = any_of([(r >= F.col("__off")) & (r < F.col("__off") + F.col("__bn")) for r in ranks])
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    walked = placed.where(wanted).withColumn(
        "__first", F.col("__off") + F.coalesce(F.sum("__c").over(inside), F.lit(0))
    )

    def value_at(rank: Column) -> Column:
        hit = (rank >= F.col("__first")) & (rank < F.col("__first") + F.col("__c"))
        return F.max(F.when(hit, F.col("__x")))

    named = [value_at(r).alias(f"__p{i}") for i, r in enumerate(ranks)]
    agg = walked.groupBy(*keys).agg(F.max("__total").alias("__total"), *named)
    quantiles = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        low, high = F.col(f"__p{2 * i}"), F.col(f"__p{2 * i + 1}")
        quantiles.append(low + (high - low) * (pos - F.floor(pos)))
    return agg.select(*keys, F.array(*quantiles).alias(out))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per key. Spark prunes to k per key inside each task before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each key. One partial aggregate per task, so a hot key ships one row per task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)
