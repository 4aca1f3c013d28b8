"""Vector similarity: in the JVM for pairs of rows, in blocks of BLAS products for all pairs of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.operators.ranking import running_offsets, spread_key


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, clamp: bool = True) -> Column:
    """Cosine in double precision, below 0 raised to 0 if `clamp`; null if a vector is null, of length 0, or the
    lengths differ."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    c = dot(a, b) / F.when(norm > 0, norm)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0))) if clamp else c


def pairwise_mean(df: DataFrame, group: str, id: str, vector: str, clamp: bool = True, block: int = 512) -> DataFrame:
    """group, n, mean cosine of all pairs of different ids of the group (null below two), min, max and std of them.

    Every pair counts, but none becomes a row: a group's vectors are gathered in blocks of at most about `block`, two
    blocks meet in one matrix product, and only sums leave it. Rows without a vector are left out. The work per group is
    quadratic by definition (the clamp forbids a sum of vectors), spread over its pairs of blocks.
    """
    rows = df.filter(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(id).alias("i"), F.col(vector).alias("v"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    blocks = rows.join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("i"), F.ceil(F.col("n") / block)).cast("int"))
    packed = blocks.groupBy("g", "n", "b").agg(F.collect_list("v").alias("m"), F.max(F.ceil(F.col("n") / block)).alias("k"))
    left = packed.select("g", "n", F.col("b").alias("b1"), F.col("m").alias("m1"), F.explode(F.sequence(F.col("b"), (F.col("k") - 1).cast("int"))).alias("b2"))
    right = packed.select(F.col("g").alias("g2"), F.col("b").alias("b3"), F.col("m").alias("m2"))
    meet = left.join(right, (F.col("g") == F.col("g2")) & (F.col("b2") == F.col("b3"))).select("g", "n", "b1", "b2", "m1", "m2")

    def matrix(s: pa.Scalar) -> np.ndarray:
        flat = s.values
        m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, length, out=np.full_like(m, np.nan), where=length > 0)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                one, two = matrix(b.column(4)[r]), matrix(b.column(5)[r])
                c = one @ two.T
                same = b.column(2)[r].as_py() == b.column(3)[r].as_py()
                c = c[np.triu_indices(len(c), 1)] if same else c.ravel()
                c = c[~np.isnan(c)]
                c = np.maximum(c, 0.0) if clamp else c
                yield pa.RecordBatch.from_arrays([b.column(0).slice(r, 1), b.column(1).slice(r, 1), pa.array([len(c)]), *(pa.array([x], pa.float64()) for x in (float(c.sum()), float((c * c).sum()), float(c.min()) if len(c) else None, float(c.max()) if len(c) else None))], names=["g", "n", "c", "s", "ss", "lo", "hi"])

    kind = rows.schema["g"].dataType.simpleString()
    part = meet.mapInArrow(multiply, f"g {kind}, n bigint, c bigint, s double, ss double, lo double, hi double")
    out = part.groupBy("g", "n").agg(*[f(x).alias(x) for f, x in ((F.sum, "c"), (F.sum, "s"), (F.sum, "ss"), (F.min, "lo"), (F.max, "hi"))])
    mean = F.col("s") / F.when(F.col("c") > 0, F.col("c"))
    return out.select(F.col("g").alias(group), "n", F.col("c").alias("n_pairs"), mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.when(F.col("c") > 0, F.col("c")) - mean * mean, F.lit(0.0))).alias("std"), F.col("lo").alias("min"), F.col("hi").alias("max"))


def similarity_health(df: DataFrame, id: str, vector: str, label: str, block: int = 512) -> DataFrame:
    """One row over all pairs of vectors: n, mean, std, min and max of their cosines, and separation, the mean within
    labels less that between. Null vectors and vectors of length 0 are left out; null without pairs.

    Without a clamp, sums over pairs follow from sums over vectors: the squared length of a sum of unit vectors holds
    every product once per order, and the sum of squared products is the squared length of the sum of their outer
    products. So mean, std and separation take one pass (a moment matrix per task, its size that of a vector squared);
    only min and max look at pairs, in blocks of matrix products."""
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(id).alias("i"), F.col(label).cast("string").alias("l"), F.col(vector).alias("v"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(label, n, sum of unit vectors) and, with a null label and n = -1, the sum of outer products."""
        outer = None
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(1)
            m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
            length = np.sqrt((m * m).sum(axis=1))
            keep = length > 0
            m = m[keep] / length[keep, None]
            outer = m.T @ m if outer is None else outer + m.T @ m
            labels = b.column(0).filter(pa.array(keep)).dictionary_encode(null_encoding="encode")
            codes = labels.indices.to_numpy(zero_copy_only=False)
            total = np.zeros((len(labels.dictionary), m.shape[1]))
            np.add.at(total, codes, m)
            yield pa.RecordBatch.from_arrays([labels.dictionary.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["l", "n", "s"])
        if outer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([-1]), pa.array([outer.ravel()], pa.list_(pa.float64()))], names=["l", "n", "s"])

    part = rows.select("l", "v").mapInArrow(sums, "l string, n bigint, s array<double>").select("l", "n", F.posexplode("s").alias("k", "x"))
    per = part.groupBy("l", (F.col("n") < 0).alias("o"), "k").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    square = F.sum(F.col("x") * F.col("x"))
    within = per.filter("NOT o AND l IS NOT NULL").groupBy("l").agg(square.alias("q"), F.max("n").alias("n")).agg(F.sum(F.col("q") - F.col("n")).alias("w"), F.sum(F.col("n") * (F.col("n") - 1)).alias("wn"))
    all_ = per.filter("NOT o").groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).agg(square.alias("q"), F.max("n").alias("n"))
    outer = per.filter("o").agg(square.alias("o2"))
    ends = pairwise_mean(rows.withColumn("g", F.lit(0)), "g", "i", "v", clamp=False, block=block).select("min", "max")
    one = lambda t: t.withColumn("_k", F.lit(1))
    j = one(all_).join(one(outer), "_k").join(one(within), "_k").join(one(ends), "_k", "left")
    n = F.col("n").cast("double")
    pairs = F.when(n > 1, n * (n - 1))
    mean = (F.col("q") - n) / pairs
    std = F.sqrt(F.greatest((F.col("o2") - n) / pairs - mean * mean, F.lit(0.0)))
    between = (F.col("q") - n - F.col("w")) / F.when(pairs > F.col("wn"), pairs - F.col("wn"))
    return j.select("n", mean.alias("mean"), std.alias("std"), "min", "max", (F.col("w") / F.when(F.col("wn") > 0, F.col("wn")) - between).alias("separation"))


def adjacent(df: DataFrame, group: str, order: str, vector: str, clamp: bool = True, long: bool = False) -> DataFrame:
    """df with `pos` (from 0 within the group) and `sim`, the cosine with the vector before (null for the first).

    Groups are sequences, a participant's answers, and a window holds one at a time. `long` is for sequences of any
    length (`order` a number): they are ordered in buckets, no group in one task, with the same result."""
    if long:
        seen = running_offsets(df, [group], spread_key(df, order), {"pos": F.lit(1)}, [order], previous=[vector], prefix="_prev_")
        return seen.withColumn("sim", cosine(F.col(f"_prev_{vector}"), F.col(vector), clamp)).drop(f"_prev_{vector}")
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumns({"pos": F.row_number().over(w) - 1, "_prev": F.lag(vector).over(w)}).withColumn("sim", cosine(F.col("_prev"), F.col(vector), clamp)).drop("_prev")
