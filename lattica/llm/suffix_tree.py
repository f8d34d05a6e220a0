"""LM scoring (operator 9): a probabilistic suffix tree over words.

Tokens: words of the A-Z-lower-cased text (runs outside space and U+0009-U+000D), then one end per document. A run of tokens is
named by a 64-bit hash, chained from its last word backwards.

Root: (c + 1) / (N + V + 1). Level by level, up to depth words of context: a run of one more word is counted where both
the run without its first and the run without its last word occur min_next times, and kept where it does itself. A context (a
run's words but the last) is retained if for some kept next token the probability after it differs from that after its suffix by
the factor ratio or more. A retained context's distribution is smoothed into its suffix's,
P(x | s) = (n(s, x) + (kappa + n(s) - n'(s)) P(x | suffix)) / (n(s) + kappa), n' summing the kept next tokens, so it sums to one;
next tokens that are not kept get the suffix's probability times the weight left. A token is scored in the longest retained
context that ends before it, within its document. What is kept depends on counts alone, not on shares of the corpus, so the tree
grows with it.

Texts are read once and travel as chunks of about chunk_tokens tokens: word numbers and the names of the words. In each round a
chunk sends every distinct run of the next level once, with how often its training texts hold it, as sorted arrays by hash bucket,
and gets the corpus's counts back in the same order; the first chunk that has a kept run also sends what it adds to its
context, and all get back whether their contexts are retained. So a chunk ends with all that its tokens' probabilities are made
of; nothing is broadcast, no list of runs is gathered, and a frequent run meets once per chunk.

Defined results: null or empty text is one end token; an empty training set gives every token probability 1;
repeated rows are counted and scored each; a null doc_id is trained on; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import chunks, materialize, mix64, parts_for, with_uid
from lattica.llm.suffix_dedup import gathered, reduced, spread_out, squeeze
from lattica.plans.rounds import discard

END = b" "


def odd(k: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 + 2 * k) & ((1 << 64) - 1))


class Names(dict):
    """Words numbered as they come, with their 64-bit names; forgotten when there are very many."""

    def __init__(self):
        super().__init__()
        self.made, self.table = [], np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self.made.append(xxhash.xxh3_64_intdigest(word))
        out = self[word] = len(self.made) - 1
        return out

    def names(self) -> np.ndarray:
        if len(self.table) < len(self.made):
            self.table = np.concatenate([self.table, np.array(self.made[len(self.table) :], np.uint64)])
        return self.table


def planes(x: np.ndarray) -> np.ndarray:
    """The bytes of numbers, all lowest first: high bytes that are the same compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).ravel()


def from_planes(x: np.ndarray, kind) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def in_order(key: np.ndarray) -> np.ndarray:
    """argsort, by sorting numbers of the keys' high bits and their places."""
    bits = np.uint64(max(1, len(key)).bit_length())
    at = np.sort((key >> bits << bits) | np.arange(len(key), dtype=np.uint64))
    order = (at & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    s = key[order]
    return order if (s[1:] >= s[:-1]).all() else order[np.argsort(s, kind="stable")]


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and which of them each key is."""
    order = in_order(key)
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    which = np.empty(len(s), np.int32)
    which[order] = np.cumsum(new) - 1
    return s[new], which


def packed(rows: DataFrame, chunk_tokens: int) -> DataFrame:
    """(chunk, data): consecutive rows' doc_ids, whether they have one, whether they are held out, numbers of tokens; the chunk's words'
    names, the most frequent first, and its tokens as numbers of words."""

    def run(batches):
        names, docs, codes, first, total = Names(), [], [], None, 0

        def row():
            ids, has, held, sizes = (np.concatenate(x) for x in zip(*docs, strict=True))
            code, table = np.concatenate(codes), names.names()
            n = np.bincount(code, minlength=len(table))
            words = np.flatnonzero(n)
            words = words[np.argsort(-n[words], kind="stable")]
            rank = np.zeros(len(table), np.uint32)
            rank[words] = np.arange(len(words), dtype=np.uint32)
            return pd.DataFrame([{"chunk": first, "data": squeeze(ids, has, held, sizes, table[words], planes(rank[code]))}])

        for pdf in batches:
            for part in chunks(pdf, "text", 1_000_000):
                first = int(part["uid"].iloc[0]) if first is None else first
                words, sizes = [], []
                for t in part["text"]:
                    ws = t.encode().lower().split() if t is not None else []
                    ws.append(END)
                    words += ws
                    sizes.append(len(ws))
                has = part["doc_id"].notna().to_numpy()
                ids = np.array([int(d) if ok else 0 for d, ok in zip(part["doc_id"], has, strict=True)], np.int64)
                docs.append((ids, has, part["held_out"].to_numpy(bool), np.array(sizes, np.int64)))
                codes.append(np.fromiter(map(names.__getitem__, words), np.int64, len(words)))
                total += len(words)
                if total >= chunk_tokens:
                    yield row()
                    docs, codes, first, total = [], [], None, 0
                    if len(names) > 400_000:
                        names = Names()
        if docs:
            yield row()

    ids = rows.select("uid", F.col("doc_id").cast("string").alias("doc_id"), "text", "held_out")
    return ids.mapInPandas(run, "chunk long, data binary")


class Level:
    """A chunk's distinct runs of some length, sorted; which of them ends at each token (-1: none that was counted); their counts in the corpus
    where they are kept, else 0, and whether it is this chunk that speaks for them. A 0 more stands for -1."""

    def __init__(self, keys: np.ndarray, which: np.ndarray):
        self.keys, self.which = keys, which

    def answered(self, reply: np.ndarray) -> None:
        self.n, self.mine = np.append(reply >> 1, 0), np.append(reply & 1, 0).astype(bool)

    def before(self, m: int, place: np.ndarray) -> np.ndarray:
        """which of the token before, where that has a run of m words."""
        out = np.full(len(self.which), -1, np.int32)
        out[1:] = self.which[:-1]
        out[place < m] = -1
        return out


class Chunk:
    """A chunk's tokens, and level by level what is known of their runs. answers: by question (2 m: counts of the runs of m + 1 words,
    2 m + 1: contexts of m words) the arrays that came back."""

    def __init__(self, data: bytes, answers: dict[int, np.ndarray], min_next: int):
        self.ids, self.has, self.held, self.size, names, code = spread_out(data, np.int64, bool, bool, np.int64, np.uint64, np.uint8)
        code = from_planes(code, np.uint32)
        ends = np.cumsum(self.size)
        self.place = np.arange(len(code)) - np.repeat(ends - self.size, self.size)
        self.train = np.repeat(~self.held, self.size)
        self.answers, self.min_next = answers, min_next
        order = in_order(names)
        rank = np.empty(len(names), np.int32)
        rank[order] = np.arange(len(names), dtype=np.int32)
        self.words = self.run = names[code]
        self.levels = [Level(names[order], rank[code])]
        self.answer(0)

    def answer(self, m: int) -> None:
        if 2 * m in self.answers or not len(self.levels[m].keys):
            self.levels[m].answered(self.answers.get(2 * m, np.zeros(0, np.int64)))

    def grow(self) -> Level:
        """The next level: runs of one more word, both of whose shorter runs are kept."""
        m, below = len(self.levels), self.levels[-1]
        ahead = np.zeros(len(self.run), np.uint64)
        ahead[m:] = self.words[:-m]
        self.run = mix64(self.run ^ ahead * odd(m))
        often = below.n >= self.min_next
        at = np.flatnonzero((self.place >= m) & often[below.which] & often[below.before(m, self.place)])
        keys, found = distinct(self.run[at])
        which = np.full(len(self.run), -1, np.int32)
        which[at] = found
        self.levels.append(Level(keys, which))
        self.answer(m)
        return self.levels[-1]

    def up_to(self, m: int) -> Chunk:
        while len(self.levels) <= m:
            self.grow()
        return self

    def counts(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, n in training texts) of level m."""
        level = self.levels[m]
        return level.keys, np.bincount(level.which[self.train & (level.which >= 0)], minlength=len(level.keys)).astype(np.int64)

    def asked(self, m: int) -> np.ndarray:
        """Which runs of m words may be contexts."""
        return np.flatnonzero(self.levels[m - 1].n[:-1] >= self.min_next)

    def contexts(self, m: int, n_all: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, kept, differs) of the runs of m words that may be contexts: what the kept runs that this chunk speaks for add to them."""
        level, below = self.levels[m], self.levels[m - 1]
        own = np.flatnonzero(level.mine & (level.n >= self.min_next))
        at = np.zeros(len(level.keys) + 1, np.int64)
        at[level.which] = np.arange(len(level.which))
        at = at[own]
        ctx = below.which[at - 1]
        n, n_ctx = level.n[own], below.n[ctx]
        shorter = self.levels[m - 2].n[self.levels[m - 2].which[at - 1]] if m > 1 else max(1, n_all)
        lift = n / n_ctx / (below.n[below.which[at]] / shorter)
        size, sub = len(below.keys), self.asked(m)
        kept = np.bincount(ctx, n, size).astype(np.int64)
        differs = np.bincount(ctx, (lift >= ratio) | (lift <= 1 / ratio), size) > 0
        return below.keys[sub], kept[sub], differs[sub]

    def scored(self, depth: int, n_all: int, v_all: int, kappa: float) -> pd.DataFrame:
        self.up_to(depth)
        doc, docs = np.repeat(np.arange(len(self.size)), self.size), len(self.size)
        total = lambda x: np.bincount(doc, x, docs)
        n = self.levels[0].n[self.levels[0].which]
        p = (n + 1) / (n_all + v_all + 1)
        base, known = total(np.log10(p)), total(n > 0).astype(np.int64)
        for m in range(1, depth + 1):
            level, below = self.levels[m], self.levels[m - 1]
            retained = np.zeros(len(below.keys) + 1, np.int64)
            sub = self.asked(m)
            if len(sub):
                retained[sub] = self.answers[2 * m + 1]
            ctx = below.before(m, self.place)
            kept, n_ctx = retained[ctx], below.n[ctx]
            p = np.where(kept > 0, (level.n[level.which] + (kappa + n_ctx - kept) * p) / (n_ctx + kappa), p)
        ids = pd.array(self.ids, "Int64")
        ids[~self.has] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": self.held, "n_tokens": self.size, "n_known": known, "train_tokens": n_all, "base_score": base, "score": total(np.log10(p))})


def by_bucket(question: int, buckets: int, keys: np.ndarray, *values: np.ndarray):
    """(bucket, array of the keys and values that go there): keys are sorted, and so are the buckets. Keys travel as differences."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for a, z in zip([0, *cut], [*cut, len(keys)], strict=True):
        if z > a:
            yield question * buckets + int(bucket[a]), squeeze(planes(np.diff(keys[a:z], prepend=np.uint64(0))), *(planes(v[a:z]) for v in values))


def answers_of(got, buckets: int) -> dict[int, np.ndarray]:
    """A chunk's replies, put together by question."""
    out: dict = {}
    for r in sorted(got if got is not None else [], key=lambda r: r["bucket"]):
        out.setdefault(r["bucket"] // buckets, []).append(from_planes(spread_out(r["reply"], np.uint8)[0], np.int64))
    return {q: np.concatenate(x) for q, x in out.items()}


def added_up(min_next: int):
    """The reducer of all questions: two arrays are keys and counts, three are contexts, what is kept after them and whether it differs."""

    def work(blobs: list[bytes]) -> list[bytes]:
        contexts = blobs[0][0] == 3
        parts = [[from_planes(x, k) for x, k in zip(spread_out(b, *[np.uint8] * b[0]), (np.uint64, np.int64, bool), strict=False)] for b in blobs]
        key, n = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), np.concatenate([p[1] for p in parts])
        which, keys = pd.factorize(key)
        total = np.bincount(which, n, len(keys)).astype(np.int64)
        if contexts:
            reply = np.where(np.bincount(which, np.concatenate([p[2] for p in parts]), len(keys)) > 0, total, 0)[which]
        else:
            total[total < min_next] = 0
            first = np.zeros(len(keys), np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            reply = total[which] << 1
            reply[first] |= 1
        cut = np.cumsum([0, *(len(p[0]) for p in parts)])
        return [squeeze(planes(reply[a:z])) for a, z in zip(cut[:-1], cut[1:], strict=True)]

    return work


def kept_runs(replies: DataFrame, buckets: int, question: int) -> tuple[int, int]:
    """(how many tokens the kept runs of a question are, how many kept runs there are)."""

    def run(batches):
        for pdf in batches:
            both = [from_planes(spread_out(x, np.uint8)[0], np.int64) for x in pdf["reply"]]
            own = [x[(x & 1 == 1) & (x > 1)] >> 1 for x in both]
            yield pd.DataFrame({"n": [int(x.sum()) for x in own], "v": [len(x) for x in own]})

    found = replies.filter(F.col("bucket").between(question * buckets, (question + 1) * buckets - 1)).select("reply").mapInPandas(run, "n long, v long")
    return tuple(found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first())


def score(docs: DataFrame, held_modulus: int = 7, held_remainder: int = 2, depth: int = 3, ratio: float = 1.5, min_next: int = 3, kappa: float = 4.0, hot: int = 1 << 20, chunk_tokens: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    depth: the most words of context; hot: once the most runs that were broadcast, without effect since none are."""
    if depth > 15:
        raise ValueError("contexts of up to 15 words")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_modulus == held_remainder, F.lit(False))
    rows = with_uid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out")))
    parts = buckets = parts_for(docs, 12)
    table = materialize(packed(rows, chunk_tokens), "packed")

    def with_answers(replies: list[DataFrame]) -> DataFrame:
        if not replies:
            return table.select("chunk", "data", F.lit(None).cast("array<struct<bucket:long,reply:binary>>").alias("got"))
        every = replies[0]
        for r in replies[1:]:
            every = every.unionByName(r)
        return table.repartition(parts, "chunk").join(gathered(every, "got", parts).hint("shuffle_hash"), F.col("chunk") == F.col("got_chunk"), "left").select("chunk", "data", "got")

    def each(batches):
        for pdf in batches:
            for k, data, got in zip(pdf["chunk"], pdf["data"], pdf["got"], strict=True):
                yield k, data, answers_of(got, buckets)

    def asking(m: int, n_all: int):
        """Round m asks for the counts of level m, up to depth, and for the contexts of the level below."""

        def run(batches):
            for k, data, answers in each(batches):
                c, sent = Chunk(data, answers, min_next).up_to(min(m, depth)), []
                if m <= depth:
                    sent += by_bucket(2 * m, buckets, *c.counts(m))
                if m > 1:
                    sent += by_bucket(2 * m - 1, buckets, *c.contexts(m - 1, n_all, ratio))
                yield pd.DataFrame([(k, *x) for x in sent], columns=["chunk", "bucket", "sent"])

        return run

    replies, n_all, v_all, top = [], 0, 0, depth
    for m in range(depth + 2):
        sent = with_answers(replies).mapInPandas(asking(m, n_all), "chunk long, bucket long, sent binary")
        replies.append(materialize(reduced(sent, parts, added_up(min_next if m else 1)), "replies"))
        if m > depth:
            break
        n, v = kept_runs(replies[-1], buckets, 2 * m)
        if m == 0:
            n_all, v_all = n, v
        elif not v:
            top = m - 1
            break

    def finish(batches):
        for _, data, answers in each(batches):
            yield Chunk(data, answers, min_next).scored(top, n_all, v_all, kappa)

    out = with_answers(replies).mapInPandas(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out
