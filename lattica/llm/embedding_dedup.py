"""Embedding near-dedup (operator 6): Euclidean p-stable hashing with exact cosine checks.

Normalised vectors are projected on Gaussian directions, shifted and quantised with a width; m such values make the key of one
table. m follows the logarithm of the number of vectors, so that about one unrelated vector shares a bucket, and the number
of tables follows from m so that a pair just at the threshold is missed with probability miss at most (nearer pairs with less).
Equal vectors are one class throughout. Buckets above `block` members are compared in pairs of blocks, so no
task holds a bucket; a linked pair counts in the first table whose key it shares, so no pair is emitted or counted twice.
Inside a task linked members are joined to their least one; those stars make the graph whose components are found.

Defined results: rows whose vector is null, empty, zero or holds null or non-finite components have no links and are their own
component; vectors of different lengths never link; repeated vec_ids are rows of their own; a component's id is its least
vec_id (nulls aside); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import components, local_components, materialize, mix64, with_uid


def collision(width: float, distance: float) -> float:
    """Probability that two points at this distance share a quantised Gaussian projection."""
    c = width / distance
    return math.erf(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def shape(n: int, threshold: float, width: float, miss: float) -> tuple[int, int]:
    """(projections of a key, tables) for n vectors."""
    near, far = collision(width, math.sqrt(2 - 2 * threshold)), collision(width, math.sqrt(2))
    m = max(4, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return m, math.ceil(math.log(miss) / math.log1p(-(near**m)))


class Tables:
    def __init__(self, m: int, tables: int, width: float, seed: int):
        self.m, self.tables, self.width, self.seed, self.known = m, tables, width, seed, {}

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """64-bit bucket keys, one column per table."""
        n, dim = unit.shape
        if dim not in self.known:
            rng = np.random.default_rng([self.seed, dim])
            a = rng.normal(size=(dim, self.m * self.tables))
            self.known[dim] = a, rng.uniform(0, self.width, self.m * self.tables), rng.integers(1, 1 << 62, self.m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        a, b, mult = self.known[dim]
        cells = np.floor((unit @ a + b) / self.width).astype(np.int64).view(np.uint64).reshape(n, self.tables, self.m)
        return mix64((cells * mult).sum(2, dtype=np.uint64) ^ (np.arange(self.tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim)))


def units(column) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def by_length(pdf: pd.DataFrame):
    size = pdf["v"].map(len)
    for _, part in pdf.groupby(size):
        yield part


def links(classes: DataFrame, tables: Tables, threshold: float, block: int, tasks: int) -> DataFrame:
    """(c, n, root): class c is linked to classes of n vectors altogether in one bucket (or pair of blocks), there led by root."""

    def keyed(batches):
        for pdf in batches:
            for part in by_length(pdf):
                k = tables.keys(units(part["v"]))
                yield pd.DataFrame({"c": np.repeat(part["c"].to_numpy(), tables.tables), "t": np.tile(np.arange(tables.tables), len(part)), "key": k.ravel().view(np.int64)})

    keys = materialize(classes.select("c", "v").mapInPandas(keyed, "c long, t int, key long"), "keys")
    counts = keys.groupBy(F.col("key").alias("k_key")).agg(F.count("*").alias("n")).filter("n > 1")
    shared = keys.join(counts, F.col("key") == F.col("k_key")).withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
    own = shared.withColumn("b", F.pmod(F.xxhash64("c"), "nb").cast("int")).withColumn("o", F.explode(F.expr("sequence(0, nb - 1)")))
    placed = own.select("c", "t", "key", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))
    full = placed.join(classes.select(F.col("c").alias("v_c"), "v", "mult"), F.col("c") == F.col("v_c")).drop("v_c")
    dealt = full.repartition(tasks, "key", "p", "q").sortWithinPartitions("key", "p", "q", "c")

    def compare(g: pd.DataFrame) -> pd.DataFrame | None:
        u = units(g["v"])
        near = u @ u.T >= threshold
        if g["p"].iat[0] != g["q"].iat[0]:
            b = g["b"].to_numpy()
            near &= b[:, None] < b[None, :]
        i, j = np.nonzero(np.triu(near, 1) if g["p"].iat[0] == g["q"].iat[0] else near)
        if not len(i):
            return None
        used = np.unique(np.concatenate([i, j]))
        k = tables.keys(u[used])
        a, b = np.searchsorted(used, i), np.searchsorted(used, j)
        first = (k[a] == k[b]).argmax(1) == g["t"].iat[0]
        mult, n = g["mult"].to_numpy(), np.zeros(len(g), np.int64)
        np.add.at(n, i[first], mult[j[first]])
        np.add.at(n, j[first], mult[i[first]])
        c = g["c"].to_numpy()
        root = local_components(len(used), a, b)
        return pd.DataFrame({"c": c[used], "n": n[used], "root": c[used][root]})

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            cuts = np.flatnonzero((np.diff(pdf["key"]) != 0) | (np.diff(pdf["p"]) != 0) | (np.diff(pdf["q"]) != 0)) + 1
            out = [compare(pdf.iloc[a:b]) for a, b in zip([0, *cuts[:-1]], cuts, strict=True) if b - a > 1] if len(cuts) else []
            rest = pdf.iloc[cuts[-1] :] if len(cuts) else pdf
            if out := [x for x in out if x is not None]:
                yield pd.concat(out)
        if rest is not None and len(rest) > 1 and (x := compare(rest)) is not None:
            yield x

    return dealt.mapInPandas(run, "c long, n long, root long")


def dedup(vectors: DataFrame, threshold: float = 0.95, width: float = 2.0, miss: float = 1e-3, block: int = 512, seed: int = 23) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    rows = with_uid(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")))
    fine = F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    good = rows.filter(fine)
    classes = materialize(good.groupBy("v").agg(F.min("uid").alias("c"), F.count("*").alias("mult"), F.min("vec_id").alias("least")), "classes")
    n = classes.count()
    m, tables = shape(n, threshold, width, miss)
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * tables // 200_000)
    found = materialize(links(classes, Tables(m, tables, width, seed), threshold, block, tasks), "links")
    roots = components(found.select(F.col("c").alias("a"), F.col("root").alias("b"))).withColumnRenamed("v", "r_c")
    degree = found.groupBy(F.col("c").alias("d_c")).agg(F.sum("n").alias("n"))
    told = classes.join(degree, F.col("c") == F.col("d_c"), "left").join(roots, F.col("c") == F.col("r_c"), "left").select(
        "c", F.col("v").alias("c_v"), "mult", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "c").alias("root")
    )
    told = materialize(told, "told")
    ids = told.groupBy(F.col("root").alias("i_root")).agg(F.min("least").alias("component_id"))
    classed = told.join(ids, F.col("root") == F.col("i_root")).select("c_v", (F.col("n") + F.col("mult") - 1).alias("n_links"), "component_id")
    linked = good.join(classed, F.col("v") == F.col("c_v")).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
