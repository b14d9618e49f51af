"""Whitening of embedding vectors: weighted multiplicity covariance over distinct integer vectors.

1. Every usable vector becomes whole numbers, ``floor(scale * c) + shift``; equal ones are grouped, with their number of copies.
2. The fit list is each distinct vector once (``weights="one"``) or as often as it occurs (``"count"``). Sums are exact decimals added up in
   the JVM; every task then centres its vectors and multiplies them (one GEMM a batch), and Spark adds the small matrices entry by entry.
3. The driver decomposes that one matrix, whose size is the square of the vector length whatever the number of rows.
4. Each distinct vector is projected once; rows take the result of their vector by a join on two 64-bit hashes. A vector that very many rows
   share makes one wide join key, whose partition adaptive execution splits.
5. The covariance of the projections is measured in a second pass, centred on their own mean, and compared with the identity.

Defined results. Rows whose vector is null or empty, or holds a null, a non-finite entry or one beyond 2**52 / scale, are dropped; all others
are kept, repeated rows and null ids included. Vectors of another length are another fit, with its own n. A component without variance (an
eigenvalue below 1e-12 of the trace; a single distinct vector has no other) has whitened null. ``deviation`` is null where it does not fit in a long. Only
the two named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.distributed import materialize

LARGEST = float(2**52)
FLAT = 1e-12
LONG_MAX = 2**63 - 1


def usable(vec: Column, scale: float) -> Column:
    """Whether all entries exist and can be scaled exactly. NaN is above every number in Spark."""
    inside = lambda c: c.isNotNull() & (F.abs(c.cast("double") * scale) < LARGEST)
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda c: F.coalesce(inside(c), F.lit(False)))


def whole_numbers(vec: Column, scale: float, shift: int) -> Column:
    return F.transform(vec, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long"))


def identity_of(x: Column) -> list[Column]:
    """128 bits that name a vector of whole numbers."""
    return [F.xxhash64(x).alias("k1"), F.xxhash64(F.lit(7), x).alias("k2")]


@dataclass(frozen=True)
class Fit:
    """Mean and components of one vector length. ``base`` and ``rest`` hold the mean as S = n * base + rest, without rounding."""

    length: int
    n: int
    base: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN along components without variance."""
        spread = np.where(self.values > FLAT * self.trace, self.values, np.nan)
        return self.centred(x) @ self.axes / np.sqrt(spread)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2 of every row, exact."""
        rough = ((self.centred(x) * self.n) ** 2).sum(axis=1)
        with np.errstate(over="ignore"):
            exact = ((self.n * (x - self.base) - self.rest) ** 2).sum(axis=1)
        out: list[int | None] = exact.tolist()
        for i in np.flatnonzero(rough > 9.2e18):
            total = sum((self.n * (int(v) - int(b)) - int(r)) ** 2 for v, b, r in zip(x[i], self.base, self.rest, strict=True))
            out[i] = total if total <= LONG_MAX else None
        return out


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def gram(rows: DataFrame, column: str, length: int, centre: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the rows of ``weight`` times the outer product of the centred vector with itself.

    A task multiplies batch by batch and gives its half matrix once; Spark adds the entries up.
    """
    upper = np.triu_indices(length)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((length, length))
        for batch in batches:
            c = centre(matrix(batch.column("v"), length))
            w = batch.column("weight").to_numpy(zero_copy_only=False).astype(np.float64)
            total += (c * w[:, None]).T @ c
        yield pa.RecordBatch.from_pydict({"i": upper[0].astype(np.int32), "j": upper[1].astype(np.int32), "s": total[upper]})

    parts = rows.select(F.col(column).alias("v"), "weight").mapInArrow(multiply, "i int, j int, s double")
    out = np.zeros((length, length))
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # length squared entries
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


def fit(distinct: DataFrame, length: int, components: int) -> Fit:
    """Fit over rows (x, weight) of one length."""
    entries = distinct.select("weight", F.posexplode("x").alias("i", "v"))
    exact = F.sum(F.col("v").cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)"))
    sums = {r["i"]: int(r["s"]) for r in entries.groupBy("i").agg(exact.alias("s")).collect()}
    n = distinct.agg(F.sum("weight")).first()[0]
    parts = [divmod(sums[i], n) for i in range(length)]
    base, rest = (np.array(p, dtype=np.int64) for p in zip(*parts, strict=True))
    centre = lambda x: (x - base).astype(np.float64) - rest / n
    values, axes = np.linalg.eigh(gram(distinct, "x", length, centre) / n)
    order = np.argsort(-values, kind="stable")[:components]
    trace, values, axes = float(values.sum()), values[order], axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return Fit(length, n, base, rest, values, axes, trace)


def apply(distinct: DataFrame, model: Fit) -> DataFrame:
    """(k1, k2, weight, deviation, z) of every distinct vector."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), model.length)
            z = pa.array(model.project(x).tolist(), pa.list_(pa.float64()))
            deviation = pa.array(model.deviation(x), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "weight")), deviation, z], ["k1", "k2", "weight", "deviation", "z"])

    return distinct.select("k1", "k2", "weight", "x").mapInArrow(project, "k1 long, k2 long, weight long, deviation long, z array<double>")


def identity_error(projected: DataFrame, model: Fit) -> float | None:
    """Largest absolute entry of the projections' covariance minus the identity, over the components with variance."""
    alive = np.flatnonzero(model.values > FLAT * model.trace)
    if not len(alive):
        return None
    means = projected.select("weight", F.posexplode("z").alias("i", "v")).groupBy("i").agg((F.sum(F.col("v") * F.col("weight")) / model.n).alias("m"))
    mean = np.array([m for _, m in sorted((r["i"], r["m"]) for r in means.collect())])
    found = gram(projected, "z", len(model.values), lambda z: z - mean) / model.n
    return float(np.abs(found[np.ix_(alive, alive)] - np.eye(len(alive))).max())


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(
    vectors: DataFrame, key: str, vec: str, components: int = 16, scale: float = 64, shift: int = 1_000_000, weights: str = "one"
) -> DataFrame:
    """One row per usable vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error."""
    clean = vectors.where(usable(F.col(vec), scale)).select(F.col(key).alias("id"), whole_numbers(F.col(vec), scale, shift).alias("x"))
    copies = F.count(F.lit(1)) if weights == "count" else F.lit(1).cast("long")
    distinct = materialize(clean.groupBy("x").agg(copies.alias("weight")).select(*identity_of(F.col("x")), "weight", "x"), "distinct-vectors")
    rows = clean.select("id", F.size("x").alias("length"), *identity_of(F.col("x")))
    spark, out = vectors.sparkSession, None
    for length in sorted(r[0] for r in distinct.select(F.size("x")).distinct().collect()):
        part = distinct.where(F.size("x") == length)
        model = fit(part, length, components)
        projected = materialize(apply(part, model), "whitened-vectors")
        error = identity_error(projected, model)
        share = [float(e / model.trace) if model.trace > 0 else None for e in model.values]
        found = rows.where(F.col("length") == length).join(projected.drop("weight"), ["k1", "k2"])
        each = found.select("id", "deviation", F.posexplode("z").alias("at", "whitened"))
        part_out = each.select(
            F.col("id").alias(key),
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(model.n).cast("long").alias("n"),
            "deviation",
            F.nanvl("whitened", F.lit(None).cast("double")).alias("whitened"),
            F.get(F.array(*[F.lit(s).cast("double") for s in share]), F.col("at")).alias("explained"),
            F.lit(error).cast("double").alias("identity_error"),
        )
        out = part_out if out is None else out.unionByName(part_out)
    if out is None:
        return spark.createDataFrame([], f"`{key}` {vectors.schema[key].dataType.simpleString()}, {SCHEMA}")
    return out
