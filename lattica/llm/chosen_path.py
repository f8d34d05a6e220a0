"""N-gram Jaccard join (operator 2): a chosen-path join of word-shingle sets.

Sets: the distinct runs of `words` words of the A-Z-lower-cased text (white space divides words; a shorter text is one run).
Equal sets are one class and travel once. A class has `t` minhash values. A run is a random tree: at each node
coordinates are sampled (1/threshold of t on average, one at least) and the node's sets are split on their values
there. A node of at most `limit` sets is compared by brute force. So is, in pairs of blocks, a larger child that
kept more than half of its parent, since its sets are alike and splitting would only repeat them, and what is left at
`depth`. Runs repeat until a pair at the threshold is missed with probability 1 - recall at most.

Brute force has two steps. Signatures that agree too little are set aside (a pair at the threshold passes this with
probability 0.9999 or more), and what is left of a node falls apart in groups; the same group found by several runs is
kept once. Then the exact sets of a group are compared through products of incidence matrices. A linked pair is counted in the
least group that holds both, so no pair is emitted and none counted twice; stars of links make the graph.

Defined results: null, empty and blank texts have no set, no links and are classes of their own; a class id is the least doc_id
of equal sets, a component id the least of linked ones (nulls aside); rows that repeat a doc_id are rows of their own. One row of
each component is kept: that of the least doc_id, null last, ties by place in the input; rows without a set are all kept. Other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import MASK, SpanHash, chunks, components, local_components, materialize, mix64, shuffle_parts, with_uid
from lattica.plans.rounds import scratch

SALT = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(texts: list[str | None], words: int, hasher: SpanHash) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    out = []
    for text in texts:
        ws = b"" if text is None else text.encode().lower().split()
        if not ws:
            out.append(np.zeros(0, np.uint64))
            continue
        buf = np.frombuffer(b" ".join(ws), np.uint8)
        starts = np.concatenate([[0], np.flatnonzero(buf == 32) + 1])
        ends = np.concatenate([starts[1:] - 1, [len(buf)]])
        k = min(words, len(ws))
        hasher.read(buf)
        out.append(np.unique(hasher.span(starts[: len(ws) - k + 1], ends[k - 1 :])))
    return out


def minhashes(sets: np.ndarray, t: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 62, t, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, t, dtype=np.uint64)
    out = np.full(t, MASK, np.uint64)
    for i in range(0, len(sets), 2048):
        out = np.minimum(out, (sets[i : i + 2048, None] * a + b).min(0))
    return (out >> np.uint64(32)).astype(np.uint32)


def class_name(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums that name a set."""
    return tuple(int(mix64(x).sum(dtype=np.uint64).view(np.int64)) for x in (s, s ^ SALT))


def signed(docs: DataFrame, words: int, t: int, seed: int) -> DataFrame:
    """(uid, doc_id, h1, h2, size, sig) of every row; h1 null without a set."""

    def run(batches):
        hasher = SpanHash(1 << 18, seed)
        for pdf in batches:
            out = []
            for u, d, text in zip(pdf["uid"], pdf["doc_id"], pdf["text"], strict=True):
                s = shingle_hashes([text], words, hasher)[0]
                d = None if pd.isna(d) else int(d)
                if not len(s):
                    out.append((u, d, None, None, 0, None))
                    continue
                out.append((u, d, *class_name(s), len(s), minhashes(s, t, seed).tobytes()))
            frame = pd.DataFrame(out, columns=["uid", "doc_id", "h1", "h2", "size", "sig"], dtype=object)
            yield frame.astype({"uid": "int64", "doc_id": "Int64", "h1": "Int64", "h2": "Int64", "size": "int64"})

    return docs.mapInPandas(run, "uid long, doc_id long, h1 long, h2 long, size long, sig binary")


def chosen(nodes: np.ndarray, t: int, threshold: float) -> np.ndarray:
    """(nodes, t) booleans: the coordinates sampled at each node. One coordinate always is."""
    coords = np.arange(1, t + 1, dtype=np.uint64) * SALT
    h = mix64(nodes.astype(np.uint64)[:, None] ^ coords)
    out = h < np.uint64(min(MASK, int((1 / threshold - 1) / t * 2**64)))
    out[np.arange(len(nodes)), h.argmin(1)] = True
    return out


def children(nodes: np.ndarray, sigs: np.ndarray, t: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) for every set and coordinate sampled at its node."""
    distinct, at = np.unique(nodes, return_inverse=True)
    row, coord = np.nonzero(chosen(distinct, t, threshold)[at])
    child = mix64(mix64(nodes[row].astype(np.uint64) ^ (coord.astype(np.uint64) + np.uint64(1)) * SALT) + sigs[row, coord].astype(np.uint64))
    return row, child


def sig_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(len(column), -1)


def leaves(classes: DataFrame, runs: int, t: int, threshold: float, limit: int, depth: int, seed: int) -> DataFrame:
    """(node, c, n): the members of all nodes to be compared by brute force, with the node's size."""

    def roots(batches):
        for pdf in batches:
            sigs = sig_matrix(pdf["sig"])
            for r in range(runs):
                row, child = children(np.full(len(pdf), mix64(np.array([seed + r], np.uint64))[0]), sigs, t, threshold)
                yield pd.DataFrame({"node": child.view(np.int64), "c": pdf["c"].to_numpy()[row], "up": 1 << 62})

    def split(batches):
        for pdf in batches:
            row, child = children(pdf["node"].to_numpy().view(np.uint64), sig_matrix(pdf["sig"]), t, threshold)
            yield pd.DataFrame({"node": child.view(np.int64), "c": pdf["c"].to_numpy()[row], "up": pdf["n"].to_numpy()[row]})

    level, done = materialize(classes.select("c", "sig").mapInPandas(roots, "node long, c long, up long"), "level"), None
    for k in range(1, depth + 1):
        counts = level.groupBy(F.col("node").alias("k_node")).agg(F.count("*").alias("n")).filter("n > 1")
        counted = materialize(level.join(counts, F.col("node") == F.col("k_node")).select("node", "c", "n", "up"), "counted")
        ends = F.lit(True) if k == depth else (F.col("n") <= limit) | (F.col("n") * 2 > F.col("up"))
        part = counted.filter(ends).select("node", "c", "n")
        done = part if done is None else done.unionByName(part)
        rest = counted.filter(~ends)
        if k == depth or not rest.limit(1).count():
            return done
        sigs = classes.select(F.col("c").alias("s_c"), "sig")
        level = materialize(rest.join(sigs, F.col("c") == F.col("s_c")).select("node", "c", "n", "sig").mapInPandas(split, "node long, c long, up long"), "level")
    return done


def in_groups(keys: list[str], work):
    """A mapInPandas function that calls work on each run of rows with equal keys; rows must be sorted so."""

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            change = np.zeros(max(0, len(pdf) - 1), bool)
            for k in keys:
                x = pdf[k].to_numpy()
                change |= x[1:] != x[:-1]
            cuts = np.flatnonzero(change) + 1
            out = [work(pdf.iloc[a:b]) for a, b in zip([0, *cuts[:-1]], cuts, strict=True) if b - a > 1] if len(cuts) else []
            rest = pdf.iloc[cuts[-1] :] if len(cuts) else pdf
            if out := [x for x in out if x is not None]:
                yield pd.concat(out)
        if rest is not None and len(rest) > 1 and (x := work(rest)) is not None:
            yield x

    return run


def candidate_groups(members: DataFrame, classes: DataFrame, least: int, limit: int) -> DataFrame:
    """(g, c): groups of classes that some node holds and whose signatures agree in at least `least` places, linked up."""
    spark = members.sparkSession
    own = members.withColumn("nb", F.ceil(F.col("n") / limit).cast("int")).withColumn("b", F.pmod(F.xxhash64("c", "node"), "nb").cast("int"))
    placed = own.withColumn("o", F.explode(F.expr("sequence(0, nb - 1)"))).select("node", "c", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))
    full = placed.join(classes.select(F.col("c").alias("s_c"), "sig"), F.col("c") == F.col("s_c")).drop("s_c")

    def work(g: pd.DataFrame) -> pd.DataFrame | None:
        s, c = sig_matrix(g["sig"]), g["c"].to_numpy()
        n = len(g)
        if n <= 64:
            near = (s[:, None, :] == s[None, :, :]).sum(2) >= least
        else:
            agree = np.zeros((n, n), np.uint16)
            for k in range(s.shape[1]):
                agree += s[:, k][:, None] == s[:, k][None, :]
            near = agree >= least
        i, j = np.nonzero(np.triu(near, 1))
        if not len(i):
            return None
        root = local_components(n, i, j)
        used = np.unique(np.concatenate([i, j]))
        order = used[np.argsort(root[used], kind="stable")]
        cut = np.flatnonzero(np.diff(root[order])) + 1
        name = np.empty(len(order), np.int64)
        for a, b in zip([0, *cut], [*cut, len(order)], strict=True):
            name[a:b] = np.bitwise_xor.reduce(mix64(c[order[a:b]].astype(np.uint64) + SALT)).view(np.int64)
        return pd.DataFrame({"g": name, "c": c[order]})

    dealt = full.repartition(4 * shuffle_parts(spark), "node", "p", "q").sortWithinPartitions("node", "p", "q", "c")
    return dealt.mapInPandas(in_groups(["node", "p", "q"], work), "g long, c long").distinct()


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Upper triangle of: the Jaccard similarity of two sets is threshold or more. Exact, by incidence products."""
    n, size = len(sets), np.array([len(s) for s in sets])
    row = np.repeat(np.arange(n), size)
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    col = place[at]
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    inter = np.zeros((n, n), np.float32)
    for lo in range(0, len(shared), 8192):
        a, b = np.searchsorted(col, [lo, lo + 8192])
        m = np.zeros((n, min(8192, len(shared) - lo)), np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        inter += m @ m.T
    inter = inter.astype(np.float64)
    return np.triu(inter / (size[:, None] + size[None, :] - inter) >= threshold, 1)


def links(groups: DataFrame, classes: DataFrame, docs: DataFrame, words: int, threshold: float, seed: int, limit_rows: int) -> DataFrame:
    """(c, n, k, root): within a group, class c is linked to k classes with n documents, led by root."""
    spark = groups.sparkSession
    lists = groups.groupBy(F.col("c").alias("l_c")).agg(F.sort_array(F.collect_list("g")).alias("gs"))
    wanted = materialize(lists.join(classes.select("c", "mult", "class_id", "h1", "h2"), F.col("l_c") == F.col("c")).select("l_c", "gs", "mult", "class_id", "h1", "h2"), "wanted")
    ids = wanted.select("class_id").distinct()
    ids = F.broadcast(ids) if wanted.count() <= limit_rows else ids.hint("shuffle_hash")

    def sets_of(batches):
        hasher = SpanHash(1 << 18, seed)
        for pdf in batches:
            for part in chunks(pdf, "text"):
                sets = [s for s in shingle_hashes(list(part["text"]), words, hasher) if len(s)]
                names = [class_name(s) for s in sets]
                yield pd.DataFrame({"s1": [a for a, _ in names], "s2": [b for _, b in names], "set": [s.tobytes() for s in sets]})

    # a class is found again by its name, through the rows that bear its least doc_id
    sets = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("class_id")), "left_semi").select("text").mapInPandas(sets_of, "s1 long, s2 long, set binary")
    sets = sets.groupBy("s1", "s2").agg(F.first("set").alias("set"))
    told = wanted.join(sets, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2"))).select("l_c", "gs", "mult", "set")
    full = groups.join(told, F.col("c") == F.col("l_c")).drop("l_c")

    def work(g: pd.DataFrame) -> pd.DataFrame | None:
        near = similar([np.frombuffer(x, np.uint64) for x in g["set"]], threshold)
        i, j = np.nonzero(near)
        if not len(i):
            return None
        here, gs = g["g"].iat[0], [np.asarray(x) for x in g["gs"]]
        only = np.array([len(x) == 1 for x in gs])
        mine = only[i] | only[j]
        for k in np.flatnonzero(~mine):
            mine[k] = np.intersect1d(gs[i[k]], gs[j[k]], assume_unique=True)[0] == here
        mult, c = g["mult"].to_numpy(), g["c"].to_numpy()
        n, k = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        a, b = i[mine], j[mine]
        np.add.at(n, a, mult[b])
        np.add.at(n, b, mult[a])
        np.add.at(k, a, 1)
        np.add.at(k, b, 1)
        used = np.unique(np.concatenate([i, j]))
        return pd.DataFrame({"c": c[used], "n": n[used], "k": k[used], "root": c[local_components(len(g), i, j)[used]]})

    dealt = full.repartition(4 * shuffle_parts(spark), "g").sortWithinPartitions("g", "c")
    return dealt.mapInPandas(in_groups(["g"], work), "c long, n long, k long, root long")


def join(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.999, t: int = 64, limit: int = 512, depth: int = 8, seed: int = 29, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, class_id, n_links, n_class_links, component_id, kept for every row of docs (doc_id, text).

    n_links counts the other documents of similarity threshold or more (equal sets too), n_class_links the other classes.
    """
    runs = math.ceil(math.log(1 - recall) / math.log(1 - threshold**2))  # a pair that must pass two levels
    least = math.floor(threshold * t - 4 * math.sqrt(t * threshold * (1 - threshold)))
    rows = with_uid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    with scratch() as tables:
        marked = materialize(signed(rows, words, t, seed), "signed")
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
        classes = marked.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("uid").alias("c"), F.count("*").alias("mult"), F.min("doc_id").alias("class_id"), F.min(first).alias("first"), F.min_by("sig", "uid").alias("sig"))
        classes = materialize(classes, "classes")
        marked = tables.keep(materialize(marked.drop("sig"), "named"))
        groups = materialize(candidate_groups(leaves(classes, runs, t, threshold, limit, depth, seed), classes, least, limit), "groups")
        found = materialize(links(groups, classes, rows, words, threshold, seed, broadcast_rows), "links")
        roots = components(found.select(F.col("c").alias("a"), F.col("root").alias("b"))).withColumnRenamed("v", "r_c")
        degree = found.groupBy(F.col("c").alias("d_c")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        lean = classes.select("h1", "h2", "c", "mult", "class_id", "first")
        told = lean.join(degree, F.col("c") == F.col("d_c"), "left").join(roots, F.col("c") == F.col("r_c"), "left")
        told = told.select("h1", "h2", "mult", "class_id", "first", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("root", "c").alias("root"))
        told = tables.keep(materialize(told, "told"))
    ids = told.groupBy(F.col("root").alias("i_root")).agg(F.min("class_id").alias("component_id"), F.min("first").alias("least"))
    classed = told.join(ids, F.col("root") == F.col("i_root")).select(
        F.col("h1").alias("t1"), F.col("h2").alias("t2"), "class_id", (F.col("n") + F.col("mult") - 1).alias("n_links"), F.col("k").alias("n_class_links"), "component_id", F.col("least.uid").alias("first")
    )
    lonely = F.col("h1").isNull()
    has = marked.filter(~lonely).select("uid", "doc_id", "h1", "h2").join(classed, (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2")))
    zero = F.lit(0).cast("long")
    alone = marked.filter(lonely).select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_class_links"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return has.select("doc_id", "class_id", "n_links", "n_class_links", "component_id", (F.col("uid") == F.col("first")).alias("kept")).unionByName(alone)
