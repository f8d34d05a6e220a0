"""Word vectors from co-occurrence in sentences, and senses from clusters of contexts.

A word's own vector comes from its name. Its context is the sum over sentences, for each of its occurrences, of the own
vectors of all other content words there; its memory the sign of both together (zero: +1). Sentences with fewer than two
content words count for nothing.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import vectors
from lattica.functions.text import STOP, content_words, tokenize
from lattica.functions.vectors import own


def spoken(sentences: DataFrame, stop: tuple = STOP) -> DataFrame:
    """sentences with ws, their content words."""
    return sentences.withColumn("ws", content_words(tokenize(F.col("text")), stop))


def train(sentences: DataFrame, dim: int = 256, stop: tuple = STOP, hold: int = 20_000) -> DataFrame:
    """(word, freq, ctx array<double>): sums meet in each task first (hold words at a time), then per word."""

    def run(batches):
        freq, ctx = {}, {}
        for pdf in batches:
            for ws in pdf["ws"]:
                if len(ws) < 2:
                    continue
                names, n = np.unique(np.asarray(ws, object).astype(str), return_counts=True)
                total = sum(k * own(w, dim) for w, k in zip(names, n, strict=True))
                for w, k in zip(names, n, strict=True):
                    add = k * (total - own(w, dim))
                    freq[w] = freq.get(w, 0) + int(k)
                    ctx[w] = ctx[w] + add if w in ctx else add
                if len(freq) >= hold:
                    yield frame(freq, ctx)
                    freq, ctx = {}, {}
        if freq:
            yield frame(freq, ctx)

    def frame(freq, ctx):
        return pd.DataFrame({"word": list(freq), "freq": list(freq.values()), "ctx": [x.astype(np.float64) for x in ctx.values()]})

    parts = spoken(sentences, stop).select("ws").mapInPandas(run, "word string, freq long, ctx array<double>")
    return vectors.summed(parts, ["word"], "ctx", None, (F.sum("freq").alias("freq"),)).select("word", "freq", "ctx")


def merged(model: DataFrame, more: DataFrame) -> DataFrame:
    """Two models as one: training on more sentences is training on them alone, and adding."""
    return vectors.summed(model.unionByName(more), ["word"], "ctx", None, (F.sum("freq").alias("freq"),)).select("word", "freq", "ctx")


def memories(model: DataFrame, dim: int) -> DataFrame:
    """(word, mem)."""
    return model.select("word", vectors.sign(F.zip_with(vectors.named(F.col("word"), dim), "ctx", lambda x, y: x + y)).alias("mem"))


def stats(model: DataFrame, sentences: DataFrame, dim: int, stop: tuple = STOP) -> DataFrame:
    """One row: dim, words, sentences trained on, kb."""
    n = spoken(sentences, stop).agg(F.count_if(F.size("ws") >= 2).alias("sentences"))
    return model.agg(F.count("*").alias("words")).join(F.broadcast(n), F.lit(True)).select(F.lit(dim).alias("dim"), "words", "sentences", F.floor(F.col("words") * dim / 1024).alias("kb"))


def similarities(pairs: DataFrame, model: DataFrame, dim: int) -> DataFrame:
    """(a, b, sim) for pairs (a, b): 0 where either is unknown."""
    m = memories(model, dim)
    x, y = m.select(F.col("word").alias("a"), F.col("mem").alias("_x")), m.select(F.col("word").alias("b"), F.col("mem").alias("_y"))
    return pairs.join(x, "a", "left").join(y, "b", "left").select("a", "b", F.coalesce(vectors.similarity(F.col("_x"), F.col("_y")), F.lit(0.0)).alias("sim"))


def vectors_of(words: DataFrame, model: DataFrame, dim: int) -> DataFrame:
    """(word, vec): the memory of a word, or its own vector where it is unknown."""
    return words.select("word").distinct().join(memories(model, dim), "word", "left").select("word", F.coalesce("mem", vectors.named(F.col("word"), dim)).alias("vec"))


def neighbours(words: DataFrame, model: DataFrame, dim: int, top_k: int = 10, max_words: int = 5_000) -> DataFrame:
    """(word, near, sim, rank): of all other words of the model the top_k most alike, by name on ties; unknown words give no rows. The
    words asked about must be max_words at most; each task keeps its best top_k per word."""
    known = memories(model, dim)
    rows = known.join(words.select("word").distinct(), "word", "left_semi").limit(max_words + 1).collect()
    if len(rows) > max_words:
        raise ValueError(f"more than {max_words} words: ask in parts")
    if not rows:
        return words.sparkSession.createDataFrame([], "word string, near string, sim double, rank int")
    names = [r["word"] for r in rows]
    held = words.sparkSession.sparkContext.broadcast((np.array(names, object), np.array([r["mem"] for r in rows], np.float64)))

    def run(batches):
        names, q = held.value
        sim, near = np.zeros((len(q), 0)), np.zeros((len(q), 0), object)
        for pdf in batches:
            m = np.stack(pdf["mem"].to_numpy()).astype(np.float64)
            s = q @ m.T / dim
            s[names[:, None] == pdf["word"].to_numpy()[None, :]] = -2
            sim, near = np.concatenate([sim, s], 1), np.concatenate([near, np.broadcast_to(pdf["word"].to_numpy(), s.shape)], 1)
            keep = np.stack([sorted(range(sim.shape[1]), key=lambda j: (-sim[i, j], near[i, j]))[:top_k] for i in range(len(q))])
            sim, near = np.take_along_axis(sim, keep, 1), np.take_along_axis(near, keep, 1)
        if sim.shape[1]:
            yield pd.DataFrame({"word": np.repeat(names, sim.shape[1]), "near": near.ravel(), "sim": sim.ravel()})

    from pyspark.sql import Window

    best = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("sim"), "near"))
    return known.mapInPandas(run, "word string, near string, sim double").filter("sim > -2").withColumn("rank", best).filter(F.col("rank") <= top_k)


def encoded(texts: DataFrame, model: DataFrame, dim: int, stop: tuple = STOP) -> DataFrame:
    """(key, vec): texts (key, text) as the majority of the vectors of their content words; a text without any is the vector of its key."""
    ws = spoken(texts, stop)
    each = ws.select("key", F.explode("ws").alias("word")).groupBy("key", "word").agg(F.count("*").alias("n"))
    vec = vectors_of(each, model, dim)
    sums = vectors.bundled(each.join(vec, "word"), ["key"], "vec", F.col("n"))
    return texts.select("key").join(sums, "key", "left").select("key", F.coalesce(F.transform("vec", lambda x: x.cast("int")), vectors.named(F.col("key").cast("string"), dim)).alias("vec"))


def contexts(sentences: DataFrame, dim: int, stop: tuple = STOP) -> DataFrame:
    """(word, seq, mark, ctx): each content word of each sentence (seq, text) once; ctx is the sum of the vectors of the other content words in
    the narrowest integers that hold it, mark a hash of the text."""
    import pyarrow as pa

    ws = spoken(sentences, stop).select("seq", F.xxhash64("text").alias("mark"), "ws")  # a filter here would take each text apart once more

    def packed(ctx: np.ndarray) -> list[bytes]:
        top = np.abs(ctx).max(initial=0)
        return [x.tobytes() for x in ctx.astype(np.int8 if top < 1 << 7 else np.int16 if top < 1 << 15 else np.int32)]

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                words, at, ctx = [], [], []
                for i, said in enumerate(batch.column("ws").to_pylist()):
                    if said is None or len(said) < 2:
                        continue
                    n = Counter(said)
                    own_, k = np.stack([own(w, dim) for w in n]), np.fromiter(n.values(), np.int32, len(n))
                    words += n
                    at.append(np.full(len(n), i))
                    ctx += packed(k @ own_ - k[:, None] * own_)
                if words:
                    at = pa.array(np.concatenate(at))
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), batch.column("seq").take(at), batch.column("mark").take(at), pa.array(ctx, pa.binary())], ["word", "seq", "mark", "ctx"])

    return ws.mapInArrow(run, f"word string, seq {ws.schema['seq'].dataType.simpleString()}, mark long, ctx binary")


def unpacked(ctx: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(ctx, {dim: np.int8, 2 * dim: np.int16, 4 * dim: np.int32}[len(ctx)]).astype(np.float64)


def vector_of(words, dim: int) -> np.ndarray:
    return sum((own(str(w), dim) for w in words), np.zeros(dim, np.int32)).astype(np.float64)


def clusters(sentences: DataFrame, dim: int = 256, new: float = 0.15, merge: float = 0.95, stop: tuple = STOP) -> DataFrame:
    """(word, sense, vec, n, example): `grouped`, with the text of the sentence that began each cluster."""
    said = sentences.select(F.col("seq").alias("_seq"), F.xxhash64("text").alias("_mark"), F.col("text").alias("example")).dropDuplicates(["_seq", "_mark"])
    found = grouped(sentences, dim, new, merge, stop)
    both = found.join(said, F.col("seq").eqNullSafe(F.col("_seq")) & (F.col("mark") == F.col("_mark")), "left")
    return both.select("word", "sense", "vec", "n", "example")


def grouped(sentences: DataFrame, dim: int = 256, new: float = 0.15, merge: float = 0.95, stop: tuple = STOP) -> DataFrame:
    """(word, sense, vec, n, seq, mark): per word its contexts in order of seq (of the text's hash on ties), each added to the cluster it is
    most like (cosine new or more; a running mean), or else a cluster of its own, after which clusters alike by more than merge become one.
    seq and mark are of the sentence that began the cluster.

    A word's state is its clusters alone; its rows stream past in order, so a frequent word needs time but no memory."""
    import pyarrow as pa

    dealt = contexts(sentences, dim, stop).repartition("word").sortWithinPartitions("word", "seq", "mark")
    kind = dealt.schema["seq"].dataType.simpleString()

    def unit(v):
        return v / (math.sqrt(v.dot(v)) + 1e-10)

    def run(batches):
        word, state, rows, seq_type = None, [], [], None

        def done():
            rows.extend((word, i, v, n, *e) for i, (v, n, e, _) in enumerate(state))

        def frame():
            w, i, v, n, seq, mark = zip(*rows, strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(i, pa.int32()), pa.array(v, pa.list_(pa.float64())), pa.array(n, pa.int64()), pa.array(seq, seq_type), pa.array(mark, pa.int64())], ["word", "sense", "vec", "n", "seq", "mark"])

        for batch in batches:
            seq_type = batch.schema.field("seq").type
            for w, seq, mark, ctx in zip(*(batch.column(c).to_pylist() for c in ("word", "seq", "mark", "ctx")), strict=True):
                if w != word:
                    done()
                    if len(rows) >= 2_000:
                        yield frame()
                    word, state = w, []
                v = unpacked(ctx, dim)
                u = unit(v)
                sims = [u.dot(c) for _, _, _, c in state]
                top = max(sims, default=-2.0)
                if top >= new:
                    at = sims.index(top)
                    c, n, e, _ = state[at]
                    c = (c * n + v) / (n + 1)
                    state[at] = (c, n + 1, e, unit(c))
                    continue
                state.append((v, 1, (seq, mark), u))
                i = 0
                while i < len(state):
                    j = i + 1
                    while j < len(state):
                        (a, n, e, _), (b, m, _, _) = state[i], state[j]
                        la, lb = math.sqrt(a.dot(a)), math.sqrt(b.dot(b))
                        if la > 1e-10 and lb > 1e-10 and float(a / la @ (b / lb)) > merge:
                            c = (a * n + b * m) / (n + m)
                            state[i] = (c, n + m, e, unit(c))
                            state.pop(j)
                        else:
                            j += 1
                    i += 1
        done()
        if rows:
            yield frame()

    return dealt.mapInArrow(run, f"word string, sense int, vec array<double>, n long, seq {kind}, mark long")


def sense_info(found: DataFrame) -> DataFrame:
    return found.select("word", "sense", "n", F.substring("example", 1, 80).alias("example"))


def sense_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("word").agg(F.count("*").alias("senses"))


def senses(asked: DataFrame, found: DataFrame, dim: int, stop: tuple = STOP) -> DataFrame:
    """(key, word, sense): for each row (key, word, text, or ws where its content words are known) the cluster most like the sentence's other
    words, of equals the first, never one whose vector is zero; 0 without clusters, with one, or in a sentence of fewer than two content words.

    Sentences are taken apart once, in a step that no filter is moved across; a word's clusters meet its rows as one array, so no pair of
    a row and a cluster is shuffled."""
    import pyarrow as pa

    said = (asked if "ws" in asked.columns else spoken(asked, stop)).select("key", "word", "ws")

    def around(word, ws):
        if word is None or ws is None or len(ws) < 2:
            return None
        n = Counter(w for w in ws if w != word)
        return np.fromiter(n.values(), np.int32, len(n)) @ np.stack([own(w, dim) for w in n]) if n else np.zeros(dim, np.int32)

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                v = [around(*x) for x in zip(batch.column("word").to_pylist(), batch.column("ws").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("word"), pa.array(v, pa.list_(pa.int32()))], ["key", "word", "v"])

    each = said.mapInArrow(run, f"key {said.schema['key'].dataType.simpleString()}, word string, v array<int>")
    size = F.sqrt(vectors.dot(F.col("vec"), F.col("vec")))
    unit = vectors.let(size, lambda n: F.when(n > 1e-10, F.transform("vec", lambda x: x / n)))
    known = found.groupBy("word").agg(F.collect_list(F.struct("sense", unit.alias("vec"))).alias("held"))
    like = F.transform(F.filter("held", lambda c: c["vec"].isNotNull()), lambda c: F.struct(vectors.dot(F.col("v"), c["vec"]).alias("sim"), (-c["sense"]).alias("back")))
    best = F.when(F.col("v").isNotNull(), -F.array_max(like)["back"])
    return each.join(known, "word", "left").select("key", "word", F.coalesce(best, F.lit(0)).alias("sense"))


# --- senses by the words of their examples

# Endings that go, the first that fits, if three letters or more are left; words that frame a sentence.
ENDINGS = ("tion", "sion", "ment", "ness", "ance", "ence", "ing", "ied", "ies", "ers", "est", "ity", "ed", "er", "es", "ly", "al", "s")
FRAME = ("is", "are", "was", "were", "be", "been", "the", "a", "an", "has", "have", "had", "do", "does", "did")


def lemma(word: Column) -> Column:
    out = None
    for e in ENDINGS:
        test, cut_ = word.endswith(e) & (F.length(word) - len(e) >= 3), word.substr(F.lit(1), F.length(word) - len(e))
        out = F.when(test, cut_) if out is None else out.when(test, cut_)
    return out.otherwise(word)


def frame_free(text: Column, target: Column, stop: tuple = STOP) -> Column:
    return F.filter(content_words(tokenize(text), stop), lambda w: ~w.isin(*FRAME) & (w != target))


def glosses(examples: DataFrame, stop: tuple = STOP) -> DataFrame:
    """(entity, sense, word, cnt) from examples (entity, sense, text): lemmas and plain words, so a word that is its own lemma counts twice."""
    plain = examples.select(F.lower("entity").alias("entity"), "sense", "text").withColumn("ws", frame_free(F.col("text"), F.col("entity"), stop))
    both = F.concat(F.transform("ws", lemma), "ws")
    return plain.select("entity", "sense", F.explode(both).alias("word")).groupBy("entity", "sense", "word").agg(F.count("*").alias("cnt"))


def resolve(asked: DataFrame, gloss: DataFrame, model: DataFrame | None = None, dim: int = 256, alike: float = 0.3, stop: tuple = STOP) -> DataFrame:
    """(key, sense, score) for rows (key, entity, text, and obj if a fact's object should count too): per sense the shared words plus half
    the smaller of their counts; where a sense shares none and there is a model, the similarities of its words of alike or more.
    The best sense, the lowest on ties; 0 for entities with one sense or none or without words; -1 where nothing speaks for any."""
    plain = asked.withColumn("entity", F.lower("entity"))
    words = frame_free(F.col("text"), F.col("entity"), stop)
    if "obj" in asked.columns:
        words = F.concat(words, frame_free(F.coalesce(F.lower("obj"), F.lit("")), F.col("entity"), stop))
    rows = plain.withColumn("ws", words).select("key", "entity", F.transform("ws", lemma).alias("ws"))
    counts = gloss.groupBy("entity").agg((F.max("sense") + 1).alias("senses"))
    open_ = rows.join(counts, "entity").filter("senses > 1 and size(ws) > 0")
    said = open_.select("key", "entity", F.explode("ws").alias("word")).groupBy("key", "entity", "word").agg(F.count("*").alias("tf"))
    hits = said.join(gloss, ["entity", "word"]).groupBy("key", "entity", "sense").agg(F.sum(1 + 0.5 * F.least("tf", "cnt")).alias("score"))
    if model is not None:
        all_ = open_.select("key", "entity", "senses").withColumn("sense", F.explode(F.expr("sequence(0, senses - 1)"))).drop("senses")
        silent = all_.join(hits, ["key", "entity", "sense"], "left_anti")
        a = said.select("key", "entity", F.col("word").alias("a"))
        pairs = silent.join(a, ["key", "entity"]).join(gloss.select("entity", "sense", F.col("word").alias("b")), ["entity", "sense"])
        sims = similarities(pairs.select("a", "b").distinct(), model, dim).filter(F.col("sim") >= alike)
        hits = hits.unionByName(pairs.join(sims, ["a", "b"]).groupBy("key", "entity", "sense").agg(F.sum("sim").alias("score")))
    best = hits.groupBy("key").agg(F.max(F.struct("score", (-F.col("sense")).alias("s"))).alias("b")).select("key", (-F.col("b.s")).alias("sense"), F.col("b.score").alias("score"))
    mark = open_.select("key", F.lit(-1).alias("none")).distinct()
    out = asked.select("key").join(mark, "key", "left").join(best, "key", "left")
    return out.select("key", F.coalesce("sense", "none", F.lit(0)).cast("int").alias("sense"), F.coalesce("score", F.lit(0.0)).alias("score"))


def gloss_words(gloss: DataFrame, entity: str, sense: int) -> DataFrame:
    return gloss.filter((F.col("entity") == entity.lower()) & (F.col("sense") == sense)).select("word")


def gloss_counts(gloss: DataFrame) -> DataFrame:
    return gloss.groupBy("entity").agg((F.max("sense") + 1).cast("long").alias("senses"))
