"""Associative memory: patterns (idx, key, value, domain, active) that a query finds by similarity of keys.

Weights are a softmax of beta * similarity * dim, each pattern's beta damped by a sigmoid of its similarity unless damped is
off; the largest logit is subtracted first, so that no beta overflows. What is returned is the pattern's value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import vectors
from lattica.plans.rounds import cut

FEW = 1_024
PATTERN = "idx long, key array<int>, value array<int>, domain string, active boolean"


def stored(memory: DataFrame, new: DataFrame) -> DataFrame:
    """memory with new patterns (key, value, domain, and seq for their order) after those that are there."""
    top = memory.agg(F.coalesce(F.max("idx"), F.lit(-1))).first()[0]
    keyed = new.select((F.col("seq") + F.lit(top + 1)).alias("idx"), F.col("key").cast("array<int>").alias("key"), F.col("value").cast("array<int>").alias("value"), "domain", F.lit(True).alias("active"))
    return memory.unionByName(keyed)


def superseded(memory: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """Patterns idx of gone stop being active; new ones follow. Nothing is deleted."""
    marks = gone.select("idx").distinct().withColumn("_g", F.lit(True))
    old = memory.join(marks, "idx", "left").withColumn("active", F.col("active") & F.col("_g").isNull()).drop("_g")
    return stored(old.select(*memory.columns), new)


def beta_of(sim: Column, beta: float, gain: float, centre: float) -> Column:
    """A pattern's own beta: 0.1 to 1 times beta by a sigmoid of its similarity."""
    return F.lit(beta) * (F.lit(0.1) + F.lit(0.9) / (F.lit(1.0) + F.exp(F.lit(-gain) * (sim - centre))))


def retrieve(queries: DataFrame, memory: DataFrame, top_k: int = 1, beta: float = 1.0, damped: bool = True, gain: float = 100.0, centre: float = 0.05, min_similarity: float = 0.3, max_queries: int = 10_000) -> DataFrame:
    """(id, idx, sim, weight, value, domain): per query (id, vec) the top_k active patterns by weight, higher idx first on ties, then those
    at least min_similarity alike.

    A memory of at most FEW active patterns is broadcast to the queries wherever they are. Before a larger one, queries are taken in
    blocks of about max_queries. A block is broadcast; each task scores its patterns against it in turn and
    keeps per query its best top_k, its largest logit and its sum of weights relative to that, so a task sends a block's worth of
    rows however many patterns it has."""
    active = memory.filter("active").select("idx", "key", "value", "domain")
    few = active.select("idx", "key").limit(FEW + 1).toArrow()
    if few.num_rows <= FEW:
        part = scored_by(queries, few, top_k, beta, damped, gain, centre).filter(F.col("sim") >= min_similarity)
        return part.join(F.broadcast(active.drop("key")), "idx").select("id", "idx", "sim", "weight", "value", "domain")
    n = queries.count()
    blocks = max(1, -(-n // max_queries))
    out = None
    dealt = cut(queries.select("id", "vec").withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks))), "queries") if blocks > 1 else queries.withColumn("_b", F.lit(0))
    for b in range(blocks):
        part = scored(dealt.filter(F.col("_b") == b).select("id", "vec"), active, top_k, beta, damped, gain, centre)
        part = part.filter(F.col("sim") >= min_similarity)
        part = cut(part, "retrieved") if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    got = out.join(active.drop("key"), "idx")
    return got.select("id", "idx", "sim", "weight", "value", "domain")


def scored_by(queries: DataFrame, patterns, top_k: int, beta: float, damped: bool, gain: float, centre: float) -> DataFrame:
    """scored, for any number of queries against a few patterns (idx, key) in Arrow."""
    import numpy as np
    import pyarrow as pa

    made = "id long, idx long, sim double, weight double"
    spark = queries.sparkSession
    if not patterns.num_rows:
        return spark.createDataFrame([], made)
    idx = patterns.column("idx").to_numpy()
    order = np.argsort(-idx)  # so that of equal logits the first is the higher idx
    held = spark.sparkContext.broadcast((idx[order], np.array(patterns.column("key").to_pylist(), np.float64)[order]))

    def run(batches):
        idx, k = held.value
        m, dim = k.shape
        for batch in batches:
            for a in range(0, batch.num_rows, step := max(1, (1 << 20) // max(m, dim))):
                part = batch.slice(a, step)
                q = np.array(part.column("vec").to_pylist(), np.float64)
                sim = q @ k.T / dim
                logit = (beta * (0.1 + 0.9 / (1 + np.exp(-gain * (sim - centre)))) if damped else beta) * sim * dim
                best = np.argmax(logit, 1)[:, None] if top_k == 1 else np.argsort(-logit, axis=1, kind="stable")[:, :top_k]
                w = np.exp(logit - logit.max(1, keepdims=True))
                take = lambda x: np.take_along_axis(x, best, 1).ravel()  # noqa: E731, B023
                ids = part.column("id").take(pa.array(np.repeat(np.arange(len(q)), best.shape[1])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(idx[best].ravel()), pa.array(take(sim)), pa.array(take(w / w.sum(1, keepdims=True)))], ["id", "idx", "sim", "weight"])

    return queries.filter(F.col("vec").isNotNull()).select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, made)


def alike(queries: DataFrame, memory: DataFrame, least: float, max_queries: int = 10_000) -> DataFrame:
    """(idx): the active patterns that are least or more alike to any query (vec). Queries are taken in blocks of about max_queries; a task
    sends one row per pattern found and block, not one per pair."""
    import numpy as np
    import pandas as pd

    spark, active = queries.sparkSession, memory.filter("active").select("idx", "key")
    blocks, out = max(1, -(-queries.count() // max_queries)), spark.createDataFrame([], "idx long")

    def search(held):
        def run(batches):
            q = held.value
            for pdf in batches:
                for a in range(0, len(pdf), 512):
                    part = pdf.iloc[a : a + 512]
                    hit = (q @ np.stack(part["key"].to_numpy()).astype(np.float64).T / q.shape[1] >= least).any(0)
                    yield pd.DataFrame({"idx": part["idx"].to_numpy()[hit]})

        return run

    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("vec"), F.lit(blocks)) == b).select("vec").distinct().collect()  # about max_queries at most
        if rows:
            held = spark.sparkContext.broadcast(np.array([r["vec"] for r in rows], np.float64))
            out = out.unionByName(active.mapInPandas(search(held), "idx long"))
    return out.distinct()


def scored(block: DataFrame, active: DataFrame, top_k: int, beta: float, damped: bool, gain: float, centre: float) -> DataFrame:
    import numpy as np
    import pandas as pd

    rows = block.collect()  # at most about max_queries
    if not rows:
        return active.sparkSession.createDataFrame([], "id long, idx long, sim double, weight double")
    ids = [r["id"] for r in rows]
    held = active.sparkSession.sparkContext.broadcast((ids, np.array([r["vec"] for r in rows], np.float64)))

    def run(batches):
        ids, q = held.value
        dim, m = q.shape[1], len(q)
        peak, total = np.full(m, -np.inf), np.zeros(m)
        best_logit, best_sim, best_idx = np.full((m, 0), 0.0), np.full((m, 0), 0.0), np.zeros((m, 0), np.int64)
        for pdf in batches:
            for a in range(0, len(pdf), 2048):
                k, idx = np.stack(pdf["key"].iloc[a : a + 2048].to_numpy()).astype(np.float64), pdf["idx"].iloc[a : a + 2048].to_numpy()
                sim = q @ k.T / dim
                b = beta * (0.1 + 0.9 / (1 + np.exp(-gain * (sim - centre)))) if damped else beta
                logit = b * sim * dim
                top = np.maximum(peak, logit.max(1))
                total = total * np.exp(np.where(np.isneginf(peak), 0, peak - top)) + np.exp(logit - top[:, None]).sum(1)
                peak = top
                best_logit, best_sim = np.concatenate([best_logit, logit], 1), np.concatenate([best_sim, sim], 1)
                best_idx = np.concatenate([best_idx, np.broadcast_to(idx, sim.shape)], 1)
                order = np.lexsort((-best_idx, -best_logit), axis=1)[:, :top_k]
                best_logit, best_sim, best_idx = (np.take_along_axis(x, order, 1) for x in (best_logit, best_sim, best_idx))
        if best_idx.shape[1]:
            w = best_idx.shape[1]
            yield pd.DataFrame({"id": np.repeat(ids, w), "idx": best_idx.ravel(), "sim": best_sim.ravel(), "logit": best_logit.ravel(), "peak": np.repeat(peak, w), "part": np.repeat(total, w), "first": np.tile(np.arange(w) == 0, m)})

    parts = active.select("idx", "key").mapInPandas(run, "id long, idx long, sim double, logit double, peak double, part double, first boolean")
    tops = parts.groupBy("id").agg(F.max("peak").alias("_m"))
    from pyspark.sql import Window

    both = parts.join(tops, "id")
    whole = Window.partitionBy("id")
    z = F.sum(F.when(F.col("first"), F.col("part") * F.exp(F.col("peak") - F.col("_m")))).over(whole)
    rank = F.row_number().over(whole.orderBy(F.desc("logit"), F.desc("idx")))
    return both.withColumns({"_z": z, "_r": rank}).filter(F.col("_r") <= top_k).select("id", "idx", "sim", (F.exp(F.col("logit") - F.col("_m")) / F.col("_z")).alias("weight"))


def stats(memory: DataFrame) -> DataFrame:
    """(domain, n): active patterns per domain."""
    return memory.filter("active").groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count("*").alias("n"))


def counts(memory: DataFrame) -> DataFrame:
    """One row: patterns, active."""
    return memory.agg(F.count("*").alias("patterns"), F.count_if("active").alias("active"))


def blended(state: Column, found: Column, share: float) -> Column:
    return vectors.sign(F.zip_with(state, found, lambda x, y: x * (1 - share) + y * share))


def refine(queries: DataFrame, memory: DataFrame, rounds: int = 5, settled: float = 0.98, share: float = 0.3, **options) -> DataFrame:
    """(id, vec, rounds, sim, idx): queries moved towards what they retrieve until a step changes little; those that find nothing
    stay as they are. All queries move together, a table per round."""
    state = cut(queries.select("id", F.col("vec").cast("array<int>").alias("vec"), F.lit(0).alias("rounds"), F.lit(0.0).alias("sim"), F.lit(None).cast("long").alias("idx"), F.lit(False).alias("done")), "refine")
    for k in range(1, rounds + 1):
        got = retrieve(state.filter("not done").select("id", "vec"), memory, 1, **options).select("id", F.col("idx").alias("f_idx"), F.col("sim").alias("f_sim"), "value")
        moved = state.join(got, "id", "left")
        new = blended(F.col("vec"), F.col("value"), share)
        still = vectors.similarity(new, F.col("vec")) > settled
        state = cut(moved.select(
            "id", F.when(F.col("done") | F.col("value").isNull(), F.col("vec")).otherwise(new).alias("vec"), F.when(F.col("done"), F.col("rounds")).otherwise(k).alias("rounds"),
            F.coalesce("f_sim", "sim").alias("sim"), F.coalesce("f_idx", "idx").alias("idx"), (F.col("done") | F.col("value").isNull() | still).alias("done"),
        ), "refine")
        if not state.filter("not done").limit(1).count():
            break
    return state.drop("done")


# The four questions that a problem is taken apart with.
ASPECTS = {
    "discover_entities": "find all objects and elements that appear in this problem",
    "discover_constraints": "what are the limits and rules that restrict the solution",
    "find_solution": "how to assign values that satisfy all limits and rules",
    "validate_result": "check that the assignment satisfies every requirement and limit",
}


def decomposed(states: DataFrame, memory: DataFrame, dim: int, **options) -> DataFrame:
    """(id, aspect, sim, idx): each state (id, vec) bound with the vector of each aspect, and what that retrieves."""
    spark = states.sparkSession
    names = sorted(ASPECTS)
    aspects = spark.createDataFrame([(i, a, ASPECTS[a]) for i, a in enumerate(names)], "_a int, aspect string, _t string").withColumn("_p", vectors.named(F.col("_t"), dim))
    parts = cut(states.join(F.broadcast(aspects), F.lit(True)).select((F.col("id") * len(names) + F.col("_a")).alias("id"), vectors.bind(F.col("vec"), F.col("_p")).alias("vec")), "aspects")
    got = retrieve(parts, memory, 1, **options).select("id", "sim", "idx")
    pick = F.element_at(F.array(*[F.lit(a) for a in names]), (F.pmod("id", F.lit(len(names))) + 1).cast("int"))
    return parts.join(got, "id", "left").select((F.col("id") / len(names)).cast("long").alias("id"), pick.alias("aspect"), F.coalesce("sim", F.lit(0.0)).alias("sim"), "idx")
