"""Tabular features: smoothed target encoding, label encoding, splits and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.calendar import cyclic
from tidemark.functions.numbers import cut
from tidemark.operators.cleaning import feature_crosses
from tidemark.operators.distributed import hash_bucket, materialize, ordinal


def encoding_stats(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Sum and count of the label per (column, key), all columns in one pass and one shuffle.

    Counting per combination of the encoded columns first would not bound the size, so the unpivoted rows are
    aggregated in the map stage: each task ships at most one row per key it has seen.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("key")) for c in cols])
    long = df.select(F.col(label).cast("double").alias("y"), F.explode(pairs).alias("e")).where("e.key is not null")
    return long.groupBy(F.col("e.col").alias("col"), F.col("e.key").alias("key")).agg(
        F.sum("y").alias("s"), F.count("y").alias("n")
    )


def smoothed(sum_: Column, count: Column, prior: Column, alpha: Column | float) -> Column:
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return (sum_ + a * prior) / (count + a)


class SmoothedTargetEncoder:
    """``(sum + alpha * prior) / (count + alpha)`` per category; unseen and null categories take the prior.

    ``fit`` reads the data once and writes one small statistics table, split by column, to the shared folder. Each
    encoded column then is one equi-join against its own part, whose size Spark knows before it plans the join.
    """

    def __init__(self, cols: Sequence[str], alphas: Mapping[str, float] | None = None, default_alpha: float = 15.0):
        self.cols = list(cols)
        self.alphas = dict(alphas or {})
        self.default_alpha = default_alpha
        self.stats: DataFrame | None = None

    def fit(self, df: DataFrame, label: str) -> "SmoothedTargetEncoder":
        stats = encoding_stats(df, self.cols, label)
        prior = df.agg(F.avg(F.col(label).cast("double")).alias("g")).scalar()
        self.stats = materialize(stats.withColumn("prior", prior), "te", partition_by=["col"])
        return self

    def prior(self) -> Column:
        return self.stats.agg(F.max("prior").alias("g")).scalar()

    def table(self, col: str) -> DataFrame:
        """(key, encoded value) of one column."""
        alpha = self.alphas.get(col, self.default_alpha)
        return self.stats.where(F.col("col") == col).select(
            F.col("key").alias("__key"),
            smoothed(F.col("s"), F.col("n"), F.col("prior"), alpha).alias(f"{col}_te"),
        )

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.cols:
            t = self.table(c)
            out = out.join(t, out[c].cast("string") == t["__key"], "left").drop("__key")
        return out.withColumns({f"{c}_te": F.coalesce(F.col(f"{c}_te"), self.prior()) for c in self.cols})


def out_of_fold_encoding(
    df: DataFrame, key: str, label: str, row_id: str, folds: int = 5, alpha: float = 15.0, prior: str = "outside"
) -> DataFrame:
    """Encode each row from the other folds only, so that no row sees its own label.

    One aggregate per (key, fold) gives both the key totals and the part to subtract.
    """
    fold = fold_of(F.col(row_id), folds)
    marked = df.withColumn("fold", fold)
    part = marked.groupBy(key, "fold").agg(
        F.sum(F.col(label).cast("double")).alias("s"), F.count(label).alias("n")
    )
    whole = part.groupBy(key).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    fold_sums = part.groupBy("fold").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    grand = part.agg(F.struct(F.sum("s").alias("s"), F.sum("n").alias("n")).alias("g")).scalar()
    priors = fold_sums.select("fold", F.try_divide(grand["s"] - F.col("fs"), grand["n"] - F.col("fn")).alias("prior"))
    table = (
        part.join(whole, key)
        .join(priors, "fold")
        .select(key, "fold", smoothed(F.col("ts") - F.col("s"), F.col("tn") - F.col("n"), F.col("prior"), alpha).alias("te"))
    )
    return marked.join(table, [key, "fold"], "left")


def fold_of(row_id: Column, folds: int) -> Column:
    digest = F.md5(row_id.cast("string"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values numbered from 0.

    The classes are written once in ranges of the whole string, so values with one common beginning still spread over many tasks.
    """
    classes = df.select(F.coalesce(F.col(col).cast("string"), F.lit("nan")).alias("cls")).distinct()
    ranged = materialize(classes.repartitionByRange("cls").withColumn("__range", F.spark_partition_id()), "classes")
    return ordinal(ranged, [], [F.col("cls")], F.col("__range"), out="code").select("cls", (F.col("code") - 1).alias("code"))


def label_encode(df: DataFrame, col: str, codes: DataFrame, out: str) -> DataFrame:
    """Join class codes; unknown values take the first class."""
    text = F.coalesce(F.col(col).cast("string"), F.lit("nan"))
    named = codes.select(F.col("cls").alias("__cls"), F.col("code").alias(out))
    return df.join(named, text == named["__cls"], "left").drop("__cls").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


# Hour bins and their names.
HOUR_EDGES = [-1, 5, 11, 17, 23]
HOUR_NAMES = ["night", "morning", "afternoon", "evening"]


def time_features(df: DataFrame, hour: str, day_name: str) -> DataFrame:
    """Time of day, cyclic hour, weekend and evening-peak flags; needs no label, so it is safe on any split."""
    sin, cos = cyclic(F.col(hour), 24.0)
    return df.withColumns(
        {
            "time_of_day": cut(F.col(hour), HOUR_EDGES, HOUR_NAMES),
            "hour_sin": sin,
            "hour_cos": cos,
            "is_weekend": F.col(day_name).isin("Sat", "Sun").cast("int"),
            "is_peak_hour": F.col(hour).between(18, 21).cast("int"),
        }
    )


def make_features(
    train: DataFrame,
    other: DataFrame | None,
    label: str,
    te_cols: Sequence[str],
    crosses: Sequence[tuple[str, str]],
    label_cols: Sequence[str],
    drop: Sequence[str],
    alphas: Mapping[str, float] | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Crosses, target encoding and label codes fitted on train and applied to both sides; columns aligned."""
    cross_names = [f"{a}_x_{b}" for a, b in crosses]
    train = feature_crosses(train, crosses)
    encoder = SmoothedTargetEncoder([*te_cols, *cross_names], alphas).fit(train, label)
    codes = {c: label_codes(train, c) for c in label_cols}

    def encode(side: DataFrame) -> DataFrame:
        out = encoder.transform(side)
        for c, table in codes.items():
            out = label_encode(out, c, table, f"__{c}_code").drop(c).withColumnRenamed(f"__{c}_code", c)
        replaced = [c for c in [*te_cols, *cross_names] if c not in label_cols]
        return out.drop(*drop, *replaced)

    train_out = encode(train)
    if other is None:
        return train_out, None
    other_out = encode(feature_crosses(other, crosses))
    have = set(other_out.columns)
    return train_out, other_out.select(*[F.col(c) if c in have else F.lit(0).alias(c) for c in train_out.columns])


# --- samples and splits ------------------------------------------------------------------------------------------


def sample_key(row_id: Column, seed: int) -> Column:
    """Seeded pseudo-random order that any engine with md5 reproduces."""
    return F.md5(F.concat(row_id.cast("string"), F.lit(f"-{seed}")))


def balanced_undersample(df: DataFrame, label: str, row_id: str, seed: int, sizes: Mapping[object, int] | None = None) -> DataFrame:
    """Exactly n rows of each class in seeded order; without sizes every class shrinks to the rarest one."""
    keyed = df.withColumn("__k", sample_key(F.col(row_id), seed))
    if sizes is None:
        counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
        upto = counts.agg(F.min("n").alias("m")).scalar()
    else:
        upto = F.lit(0)
        for value, n in sizes.items():
            upto = F.when(F.col(label) == F.lit(value), F.lit(n)).otherwise(upto)
    picked = ordinal(keyed, [label], [F.col("__k"), F.col(row_id)], hash_bucket(F.col("__k")), out="__rn", upto=upto)
    return picked.drop("__k", "__rn")


def stratified_split(df: DataFrame, label: str, row_id: str, train_share: float, seed: int) -> DataFrame:
    """Adds ``split``: the first share of each class in seeded order is ``train``; exact to one row per class."""
    keyed = df.withColumn("__k", sample_key(F.col(row_id), seed))
    ranked = ordinal(keyed, [label], [F.col("__k"), F.col(row_id)], hash_bucket(F.col("__k")), out="__rn")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    cutoff = F.floor(F.col("__n") * train_share + 0.5)
    joined = ranked.join(sizes, label)
    return joined.withColumn("split", F.when(F.col("__rn") <= cutoff, "train").otherwise("test")).drop("__k", "__rn", "__n")


def hash_split(df: DataFrame, row_id: str, train_pct: int, seed: int) -> DataFrame:
    """Split by a hash of the id: no shuffle, and a row keeps its side when the table grows."""
    digest = sample_key(F.col(row_id), seed)
    slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn("split", F.when(slot < train_pct, "train").otherwise("test"))


def time_split(df: DataFrame, ts: str, at: str) -> DataFrame:
    return df.withColumn("split", F.when(F.col(ts) >= F.lit(at).cast("timestamp_ntz"), "validation").otherwise("train"))


def split_report(df: DataFrame, label: str) -> DataFrame:
    """Rows, share and label rate of each side."""
    sides = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate"))
    total = sides.agg(F.sum("n").alias("t")).scalar()
    return sides.withColumn("share", F.col("n") / total)


def seeded_sample(df: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """At most n rows in seeded order: each task keeps its own n before the merge."""
    return df.withColumn("__k", sample_key(F.col(row_id), seed)).orderBy("__k", row_id).limit(n).drop("__k")
