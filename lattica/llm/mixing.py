"""Mixing sources to target weights (operator 5).

1. Sizes are words; a source's target is its share by weight of the wanted total, at most cap times its size, the excess
   reshared by weight until none is above (water filling).
2. The words of each source are packed into blocks of fixed length, documents in order of doc_id; a document's place comes
   from two-level prefix sums (inside chunks of about the square root of the source's documents, then over chunks), so no task holds
   a whole source.
3. Every output shard draws multinomial slot counts over sources, from what the targets still need; the totals over all
   shards are so the targets themselves, and a rerun draws the same (seeded).
4. Slot j of a source reads, in pass j div B over its B blocks, the block to which that pass's pseudorandom permutation
   (swap-or-not rounds, a bijection of 0..B-1) maps j mod B. Slots and blocks are joined by index. Since the
   slots are at most cap * B, no block is read more than ceil(cap) times.

Defined results: null or empty texts have size 0 and are never taken; a null source is a source, ordered last; repeated
rows are packed and counted each; an empty table gives an empty table; other columns are ignored. The table of sources is
read to the driver and must hold at most max_sources rows (an error otherwise).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import MASK, materialize, mix64, shuffle_parts, with_uid

ROUNDS = 12


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Water filling: shares of total by weight, none above cap times its size."""
    out: list[float | None] = [None] * len(sizes)
    while True:
        free = [i for i, x in enumerate(out) if x is None]
        if not free:
            break
        level = max(0.0, total - sum(x for x in out if x is not None)) / sum(weights[i] for i in free)
        above = [i for i in free if weights[i] * level > cap * sizes[i]]
        for i in above:
            out[i] = float(cap * sizes[i])
        if not above:
            for i in free:
                out[i] = weights[i] * level
    return out


def draw(slots: list[int], shards: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(shard, source, first, count): multinomial counts per shard from the remaining slots; all are used at the end."""
    rng, left, out = np.random.default_rng(seed), np.array(slots, np.int64), []
    done = np.zeros_like(left)
    for k in range(shards):
        want = int(left.sum()) if k == shards - 1 else int(left.sum()) // (shards - k)
        n = np.minimum(rng.multinomial(want, left / left.sum()), left) if want else np.zeros_like(left)
        for i in np.argsort(n - left):  # what clipping took away goes where most is left
            if (short := want - int(n.sum())) <= 0:
                break
            n[i] += min(short, int(left[i] - n[i]))
        out += [(k, i, int(done[i]), int(c)) for i, c in enumerate(n) if c]
        done, left = done + n, left - n
    return out


def permuted(x: np.ndarray, blocks: np.ndarray, keys: np.ndarray, seed: int) -> np.ndarray:
    """x sent through the pseudorandom bijection of 0..blocks-1 that its key (64 bits) chooses: swap-or-not rounds."""
    x = x.astype(np.int64)
    for i in range(ROUNDS):
        key = mix64(keys ^ np.uint64((seed + i) * 0x9E3779B97F4A7C15 & MASK))
        other = ((key % blocks.astype(np.uint64)).astype(np.int64) - x) % blocks
        toss = mix64(key ^ np.maximum(x, other).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(63) == 1
        x = np.where(toss, other, x)
    return x


def plain_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, source, uid)."""
    return with_uid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")))


def sized(plain: DataFrame) -> DataFrame:
    n = F.coalesce(F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')").cast("long"), F.lit(0).cast("long"))
    return materialize(plain.select("uid", "doc_id", "source", n.alias("size")), "sizes")


def plan(sizes: DataFrame, weights: tuple, share: float, cap: float, block: int, max_sources: int) -> pd.DataFrame:
    """Per source: idx, source, docs, words, target, blocks, slots."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    words = [r["words"] for r in rows]
    goal = targets(words, [weights[i % len(weights)] for i in range(len(rows))], share * sum(words), cap)
    out = pd.DataFrame({"idx": range(len(rows)), "source": [r["source"] for r in rows], "docs": [r["docs"] for r in rows], "words": words, "target": goal})
    out["blocks"] = [math.ceil(w / block) for w in words]
    out["slots"] = [min(math.floor(cap * b), round(t * b / w)) if w else 0 for t, b, w in zip(goal, out["blocks"], words, strict=True)]
    return out


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 64, shards: int = 64, seed: int = 17, max_sources: int = 100_000, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with their source's figures: uid, doc_id, source, size, source_size, target;
    the mix: shard, slot, idx (source), block, uid, start, words - the words [start, start + words) of that document).
    rows: docs as plain_rows, already numbered."""
    spark = docs.sparkSession
    sizes = sized(plain_rows(docs) if rows is None else rows)
    table = plan(sizes, weights, share, cap, block, max_sources)
    sources = spark.createDataFrame(list(table.itertuples(index=False, name=None)), "idx long, p_source string, docs long, source_size long, target double, blocks long, slots long")
    known = sizes.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    chunk = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("uid"))), F.ceil(F.sqrt("docs")).cast("long"))
    inner = Window.partitionBy("idx", "chunk").orderBy("doc_id", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.filter("size > 0").withColumn("chunk", chunk).withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    outer = Window.partitionBy("idx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = known.filter("size > 0").withColumn("chunk", chunk).groupBy("idx", "chunk").agg(F.sum("size").alias("n")).select("idx", "chunk", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("base"))
    at = placed.join(bases, ["idx", "chunk"]).select("idx", "uid", "size", (F.col("base") + F.col("before")).alias("first"))
    cells = at.withColumn("block", F.explode(F.expr(f"sequence(first div {block}, (first + size - 1) div {block})")))
    lo, hi = F.greatest(F.col("first"), F.col("block") * block), F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block)
    pieces = cells.select("idx", "block", "uid", (lo - F.col("first")).alias("start"), (hi - lo).alias("words"))
    blocks = dict(zip(table["idx"], table["blocks"], strict=True))
    rows = [(*r, int(blocks[r[1]])) for r in draw(list(table["slots"]), shards, seed)] if len(table) else []
    counts = spark.createDataFrame(rows, "shard long, idx long, first long, n long, blocks long")
    step = 1 << 16
    tasks = int(min(200_000, max(shuffle_parts(spark), sum(table["slots"]) // (16 * step)))) if len(table) else 1
    runs = counts.withColumn("k", F.explode(F.expr(f"sequence(0, (n - 1) div {step})"))).repartition(tasks, F.col("idx"), F.col("shard"), F.col("k"))

    def slots_of(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                slot = np.arange(r.first + r.k * step, r.first + min(r.n, (r.k + 1) * step), dtype=np.int64)
                size = np.full(len(slot), r.blocks, np.int64)
                key = mix64((slot // size).astype(np.uint64) * np.uint64(0x165667B19E3779F9) + np.uint64(r.idx))
                yield pd.DataFrame({"shard": r.shard, "slot": slot, "idx": r.idx, "block": permuted(slot % size, size, key, seed)})

    slots = runs.mapInPandas(slots_of, "shard long, slot long, idx long, block long")
    # slots grow with the input, though the runs they come from are few rows: never a broadcast
    mixed = slots.hint("merge").join(pieces, ["idx", "block"])
    return known.select("uid", "doc_id", "source", "size", "source_size", "target"), mixed


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for every row of docs (doc_id, text, source)."""
    known, mixed = mix(docs, **options)
    used = mixed.groupBy(F.col("uid").alias("m_uid")).agg(F.sum("words").alias("taken"))
    out = known.join(used, F.col("uid") == F.col("m_uid"), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def texts(docs: DataFrame, **options) -> DataFrame:
    """(shard, slot, idx, block, uid, start, text): the mix itself. A slot's rows, by uid and start, are its block of words; a document's
    pieces are cut from its text once, however often they are read."""
    rows = materialize(plain_rows(docs), "mix-rows")
    _, mixed = mix(docs, rows=rows, **options)
    mixed = materialize(mixed, "mix")
    wanted = mixed.select("uid", "start", "words").distinct().groupBy(F.col("uid").alias("w_uid")).agg(F.collect_list(F.struct("start", "words")).alias("cuts"))
    ws = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    said = rows.join(wanted.hint("shuffle_hash"), F.col("uid") == F.col("w_uid")).withColumn("ws", ws)
    cut = F.transform("cuts", lambda c: F.struct(c["start"].alias("start"), F.array_join(F.slice("ws", c["start"].cast("int") + 1, c["words"].cast("int")), " ").alias("text")))
    parts = said.select(F.col("uid").alias("p_uid"), F.inline(cut)).withColumnRenamed("start", "p_start")
    return mixed.join(parts.hint("merge"), (F.col("uid") == F.col("p_uid")) & (F.col("start") == F.col("p_start"))).select("shard", "slot", "idx", "block", "uid", "start", "text")
