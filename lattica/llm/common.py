"""Shared plumbing: shared-folder tables, stable hashing, tiered table lookups, graph components."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans.rounds import cut

MASK = (1 << 64) - 1


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    return cut(df, name)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, mb: float = 24, blowup: float = 1.0) -> int:
    """Partitions so that one holds about mb MB, from the optimizer's size estimate of df (no job is run).

    Sources without a size (local rows, which Spark takes for endless) get the session's number of shuffle partitions.
    """
    est = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if est >= 1 << 55:
        return shuffle_parts(df.sparkSession)
    return int(min(200_000, max(shuffle_parts(df.sparkSession), est * blowup / (mb * 1e6))))


def with_uid(df: DataFrame) -> DataFrame:
    """One id per input row, so that rows that repeat a key stay apart. Stable over retries of file scans."""
    return df.withColumn("uid", F.monotonically_increasing_id())


def chunks(pdf: pd.DataFrame, col: str, limit: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Slices of pdf with about limit characters each; a longer text stands alone."""
    size = pdf[col].str.len().fillna(0).to_numpy(dtype=np.int64)
    if len(pdf):
        group = np.cumsum(size) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
            yield pdf.iloc[a:b]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply, xor-shift); bijective."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class SpanHash:
    """Hashes of substrings of a byte buffer from prefix sums of a polynomial modulo 2^64.

    span(a, b) names bytes[a:b] by content alone. Equal bytes have equal names; seeds give independent names.
    """

    def __init__(self, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = (int(rng.integers(1, 1 << 62)) << 3 | 5) & MASK
        self.inverse = pow(self.base, -1, 1 << 64)
        self.fit(size)

    def fit(self, size: int) -> None:
        def powers(b: int) -> np.ndarray:
            out = np.ones(size + 1, np.uint64)
            done = 1
            while done <= size:
                n = min(done, size + 1 - done)
                out[done : done + n] = out[:n] * np.uint64(pow(b, done, 1 << 64))
                done += n
            return out

        self.size, self.up, self.down = size, powers(self.base), powers(self.inverse)

    def read(self, buf: np.ndarray) -> None:
        if len(buf) > self.size:
            self.fit(len(buf) * 2)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.table[buf] * self.up[: len(buf)], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        """span(i, i + k) for every i, without gathering."""
        return mix64((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k] ^ np.uint64((k << 48) & MASK))

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * self.down[a] ^ (np.asarray(b - a).astype(np.uint64) << np.uint64(48)))


def counted_keys(df: DataFrame, keys: Callable, text: str = "text", flush: int = 400_000) -> DataFrame:
    """(key binary, n long): how often each key occurs in keys(text bytes), summed over all rows of df.

    Counts meet first in each task, so the shuffle carries a key at most a few times per task, hot or not.
    """

    def run(batches):
        seen: Counter = Counter()
        for pdf in batches:
            for x in pdf["text"]:
                seen.update(keys(b"" if x is None else x.encode()))
                if len(seen) > flush:
                    yield pd.DataFrame({"key": list(seen), "n": list(seen.values())})
                    seen = Counter()
        if seen:
            yield pd.DataFrame({"key": list(seen), "n": list(seen.values())})

    return df.select(F.col(text).alias("text")).mapInPandas(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Lookup:
    """A bounded table for a broadcast: Arrow columns that travel as they are; a worker builds its dict once."""

    def __init__(self, table, values: list[str]):
        self.table, self.values, self.known = table, values, None

    def __getstate__(self):
        return {"table": self.table, "values": self.values, "known": None}

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()

    def dict(self) -> dict:
        """key bytes -> its value, or the tuple of its values."""
        if self.known is None:
            cols = [self.table.column(v).to_pylist() for v in self.values]
            rows = cols[0] if len(cols) == 1 else zip(*cols, strict=True)
            self.known = dict(zip(self.table.column("key").to_pylist(), rows, strict=True))
        return self.known


def count_floor(table: DataFrame, hot: int) -> int:
    """The least n of table such that at most hot rows have it or more (beyond all counts if none fits).

    It is read off a histogram of counts in steps of a 64th of a power of two, so the driver gets a few thousand rows.
    """
    steps = table.groupBy(F.floor(F.log2("n") * 64).alias("step")).agg(F.min("n").alias("least"), F.count("*").alias("rows")).collect()
    floor, total = 1 << 62, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["rows"]
        if total > hot:
            break
        floor = r["least"]
    return floor


def hot_rows(table: DataFrame, hot: int, values: list[str]) -> Lookup:
    """The most frequent rows of table (key binary, n, ...), at most hot of them. Keys should be short: see `short`."""
    kept = table.filter(F.col("n") >= count_floor(table, hot))
    return Lookup(kept.select("key", "n", *[v for v in values if v != "n"]).toArrow(), values)


def short(word: bytes, width: int = 64) -> bytes:
    """A key for word: itself, or its digest where it is longer than width, so that keys are of bounded size whatever the text."""
    return word if len(word) <= width else b"\xff" + hashlib.sha256(word).digest()


def looked_up(rows: DataFrame, spread: Callable, table: DataFrame, values: list[str], extra: str = "", other: dict | None = None) -> DataFrame:
    """Finish a two-tier lookup: per uid, the sums over its keys of each value, times the key's count.

    spread(batches) is a mapInPandas function over rows. It adds up what its bounded broadcast of frequent keys
    answers and yields one row with key null, n 1 and the sums for each uid, then a row (uid, key, n) for every
    other key of that uid. Those are joined to the whole table here; a key absent from it counts as 0. extra columns are
    those of the first row; other names those of them that have an aggregate of their own.
    """
    schema = "uid long, key binary, n double, " + ", ".join(f"{v} double" for v in values) + (", " + extra if extra else "")
    side = table.select(F.col("key").alias("t_key"), *[F.col(v).cast("double").alias(f"t_{v}") for v in values])
    # rows without a key get one of their own, which no text holds, so that they spread over all tasks
    own = F.concat(F.unhex(F.lit("FE")), F.col("uid").cast("string").cast("binary"))
    sent = rows.mapInPandas(spread, schema).withColumn("ask", F.coalesce("key", own))
    joined = sent.join(side.hint("merge"), F.col("ask") == F.col("t_key"), "left")
    names = [x.split()[0] for x in extra.split(",")] if extra else []
    return joined.groupBy("uid").agg(
        *[F.sum(F.coalesce(F.col(v), F.lit(0.0)) + F.when(F.col("key").isNotNull(), F.coalesce(F.col(f"t_{v}"), F.lit(0.0)) * F.col("n")).otherwise(0.0)).alias(v) for v in values],
        *[(other or {}).get(x, F.max(x)).alias(x) for x in names],
    )


def components(vertices_edges: DataFrame, limit: int = 40) -> DataFrame:
    """(v, root): for every v of the undirected edges (a, b), the smallest vertex reachable from it.

    Each round gives a vertex the least label among its own, its neighbours' and its label's label (pointer
    jumping), so long chains take a logarithmic number of rounds. Aggregates are combined before the shuffle;
    a vertex of many edges is split by the skew join. Rounds are cut by tables in the shared folder.
    """
    spark = vertices_edges.sparkSession
    e = vertices_edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    e = materialize(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(e.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(limit):
        near = e.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("root").alias("m"))
        hooked = labels.join(near, F.col("v") == F.col("a")).select("v", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        up = labels.select(F.col("v").alias("u"), F.col("root").alias("r2"))
        new = materialize(hooked.join(up, F.col("root") == F.col("u"), "left").select("v", F.least("root", F.coalesce("r2", "root")).alias("root"), "was"), "labels")
        changed = new.filter("root <> was").limit(1).count()
        labels = new.select("v", "root")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {limit} rounds")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root of each of n items under edges a-b, in one task."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low

