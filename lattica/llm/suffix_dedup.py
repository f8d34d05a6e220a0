"""Suffix-array dedup (operator 3): prefix doubling over a sparse, content-chosen set of suffix positions.

Plain prefix doubling sorts (rank, rank at offset) pairs of every byte position; its shuffles would be tens of times the input.
Here a position is kept if the hash of its `gram` bytes is the least (leftmost) among the grams of some `length`-byte
string, so each such string holds a kept position (anchor) at the same place in all its copies. Rounds:

1. Rank: anchors are sorted by their gram's name, paired with the name of the stretch that reaches length - gram bytes
   further on both sides (all the strings that can rely on this anchor). Unique grams end here: nothing they are in repeats
   in another document. A pair that a smaller document holds is past the threshold: all its strings repeat.
2. Rerank: anchors whose gram repeats in unlike stretches are sorted once per offset, by gram, left and right extension: the names
   of the `length`-byte strings at that offset. A string is covered if a smaller document holds it.

Texts travel packed in chunks of about chunk_bytes. A chunk sends each pair once, with its least document, as sorted arrays by hash
bucket, and gets flags back in the same order; so copies meet in the chunk before any shuffle, and no list of
repeats is gathered anywhere. Reducers see at most one entry per chunk and distinct stretch.

Result of the contract: bytes covered by a `length`-byte string that also starts in a document of smaller doc_id are removed.

Defined results: null text is empty; rows with null doc_id have no order: they are kept whole and cover nothing; rows of equal doc_id
do not cover one another; texts shorter than length stay whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import SpanHash, materialize, mix64, parts_for
from lattica.plans.rounds import discard

NONE = np.uint64((1 << 64) - 1)
RENAME = np.uint64(0xA0761D6478BD642F)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays, one after the other, compressed; their lengths in front."""
    raw = np.array([x.nbytes for x in arrays], np.int64).tobytes() + b"".join(x.tobytes() for x in arrays)
    return len(arrays).to_bytes(1, "little") + zstandard.ZstdCompressor(level=1).compress(raw)


def spread_out(data: bytes, *types) -> list[np.ndarray]:
    k, raw = data[0], zstandard.ZstdDecompressor().decompress(bytes(data[1:]))
    sizes, out, at = np.frombuffer(raw, np.int64, k), [], 8 * k
    for n, t in zip(sizes, types, strict=True):
        out.append(np.frombuffer(raw, t, int(n) // np.dtype(t).itemsize, at))
        at += int(n)
    return out


def packed(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, data): consecutive rows' doc_ids, whether they have one, byte lengths and bytes."""

    def run(batches):
        ids, has, sizes, texts, first, total = [], [], [], [], None, 0

        def row():
            return {"chunk": first, "data": squeeze(np.array(ids, np.int64), np.array(has, bool), np.array(sizes, np.int64), np.frombuffer(b"".join(texts), np.uint8))}

        for pdf in batches:
            for u, d, t in zip(pdf["uid"], pdf["doc_id"], pdf["text"], strict=True):
                first = u if first is None else first
                raw = b"" if t is None else t.encode()
                ids.append(0 if pd.isna(d) else int(d))
                has.append(not pd.isna(d))
                sizes.append(len(raw))
                texts.append(raw)
                total += len(raw)
                if total >= chunk_bytes or len(sizes) >= 20_000:
                    yield pd.DataFrame([row()])
                    ids, has, sizes, texts, first, total = [], [], [], [], None, 0
        if sizes:
            yield pd.DataFrame([row()])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "chunk long, data binary")


class Chunk:
    """A chunk's anchors, and its pairs: sorted by bucket, gram name, stretch name; each with its least document."""

    def __init__(self, data: bytes, hasher: SpanHash, length: int, gram: int, buckets: int):
        self.ids, self.has, self.sizes, self.buf = spread_out(data, np.int64, bool, np.int64, np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.length, self.gram, self.side = length, gram, length - gram
        self.find(hasher, buckets)

    def find(self, hasher: SpanHash, buckets: int) -> None:
        n, w = len(self.buf), self.side + 1
        pos = np.zeros(0, np.int64)
        if n >= self.length:
            hasher.read(self.buf)
            h = hasher.grams(self.gram)
            end = np.repeat(np.where(self.has, self.ends, -1), self.sizes)  # of the document at each byte
            at = np.arange(len(h))
            h[at + self.gram > end[: len(h)]] = NONE
            least, span = h, 1
            while span < w:
                step = min(span, w - span)
                least = np.minimum(least[:-step], least[step:])
                span += step
            ok = at[: len(least)] + self.length <= end[: len(least)]
            # the string one further has another anchor only if the least changes or the anchor itself falls out
            moved = np.ones(len(least), bool)
            moved[1:] = (least[1:] != least[:-1]) | ~ok[:-1] | (h[: len(least) - 1] == least[:-1])
            fine = np.flatnonzero(ok & moved)
            pos = self.leftmost(h, least, fine, w)
            # least hashes are small ones: named anew, so that buckets of names are of one size
            self.h, self.doc = mix64(h[pos] ^ RENAME), np.searchsorted(self.ends, pos, side="right")
        else:
            self.h, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pos = pos
        self.lo = np.maximum(pos - self.side, self.starts[self.doc]) if len(pos) else pos
        self.hi = np.minimum(pos + self.length, self.ends[self.doc]) if len(pos) else pos
        c = hasher.span(self.lo, self.hi) if len(pos) else self.h
        self.c = mix64(c + (pos - self.lo).astype(np.uint64)) & np.uint64(0xFFFFFFFFFFFF)
        bucket = ((self.h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # rises with the name
        ids = self.ids[self.doc]
        order = np.argsort(self.h)
        s = self.h[order]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        tied = np.flatnonzero(same[1:] | same[:-1])
        few = order[tied]
        order[tied] = few[np.lexsort((ids[few], self.c[few], self.h[few]))]
        self.order = order
        b, h, c = bucket[order], self.h[order], self.c[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        self.first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.g_bucket, self.g_h, self.g_c, self.g_id = b[self.first], h[self.first], c[self.first], ids[order][self.first]

    @staticmethod
    def leftmost(h: np.ndarray, least: np.ndarray, fine: np.ndarray, w: int) -> np.ndarray:
        """For each string start in fine, the first of its w grams whose hash is least there; distinct, sorted."""
        found, todo, want = np.zeros(len(h), bool), fine, least[fine]
        for j in range(w):
            hit = h[todo + j] == want
            found[todo[hit] + j] = True
            todo, want = todo[~hit], want[~hit]
            if not len(todo):
                break
        return np.flatnonzero(found)

    def by_bucket(self):
        cut = np.flatnonzero(np.diff(self.g_bucket)) + 1
        for a, b in zip([0, *cut], [*cut, len(self.g_bucket)], strict=True):
            if b > a:
                yield int(self.g_bucket[a]), a, b


def low48(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).ravel()


def from48(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = x.reshape(-1, 6)
    return out.view("<u8").ravel()


def flags(h: np.ndarray, c: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per pair: 1 if a smaller document has the same pair, else 2 if its gram has unlike stretches in several documents."""
    out = np.zeros(len(h), np.uint8)
    by = np.argsort(h, kind="stable")
    s = h[by]
    same = s[1:] == s[:-1]
    several = np.zeros(len(h), bool)
    several[1:] |= same
    several[:-1] |= same
    sub = by[several]
    if not len(sub):
        return out
    sub = sub[np.lexsort((ids[sub], c[sub], h[sub]))]
    hh, cc, dd = h[sub], c[sub], ids[sub]
    new_h = np.concatenate([[True], hh[1:] != hh[:-1]])
    new_c = new_h | np.concatenate([[True], cc[1:] != cc[:-1]])
    g, k = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
    lowest = dd[np.flatnonzero(new_c)][k]
    start = np.flatnonzero(new_h)
    multi = (np.add.reduceat(new_c.astype(np.int64), start) > 1) & (np.minimum.reduceat(dd, start) != np.maximum.reduceat(dd, start))
    out[sub] = np.where(dd > lowest, 1, np.where(multi[g], 2, 0))
    return out


def masks(h: np.ndarray, ctx: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray, side: int) -> np.ndarray:
    """Per pair and offset j: whether a smaller document has the string that starts j bytes before the anchor.

    ctx: side bytes before the gram (right-aligned), then side bytes after it; left, right: how many of them there are.
    """
    n = len(h)
    mult = np.uint64(0x9E3779B97F4A7C15)
    pre, post = np.zeros((side + 1, n), np.uint64), np.zeros((side + 1, n), np.uint64)
    for j in range(1, side + 1):
        pre[j] = mix64(pre[j - 1] * mult + ctx[:, side - j].astype(np.uint64) + np.uint64(j))
        post[j] = mix64(post[j - 1] * mult + ctx[:, side + j - 1].astype(np.uint64) + np.uint64(512 * j))
    out = np.zeros((n, side + 1), bool)
    for j in range(side + 1):
        ok = np.flatnonzero((left >= j) & (right >= side - j))
        key = mix64(mix64(h[ok] + pre[j][ok]) + post[side - j][ok])
        by = np.lexsort((ids[ok], key))
        s, d = key[by], ids[ok][by]
        new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        lowest = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(s) else d
        out[ok[by], j] = d > lowest
    return out


def reduced(sent: DataFrame, parts: int, work) -> DataFrame:
    """(chunk, bucket, reply): work on all arrays of a bucket together, and cut its answer up again by chunk."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        replies = work([bytes(x) for x in pdf["sent"]])
        return pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "reply": replies})

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            cuts = np.flatnonzero(np.diff(pdf["bucket"])) + 1
            for a, b in zip([0, *cuts[:-1]], cuts, strict=True) if len(cuts) else ():
                yield answer(pdf.iloc[a:b])
            rest = pdf.iloc[cuts[-1] :] if len(cuts) else pdf
        if rest is not None and len(rest):
            yield answer(rest)

    dealt = sent.repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk")
    return dealt.mapInPandas(run, "chunk long, bucket long, reply binary")


def gathered(replies: DataFrame, name: str, parts: int) -> DataFrame:
    """A chunk's replies as one list, dealt like the chunks themselves."""
    return replies.repartition(parts, "chunk").groupBy(F.col("chunk").alias(f"{name}_chunk")).agg(F.collect_list(F.struct("bucket", "reply")).alias(name))


def work_flags(blobs: list[bytes]) -> list[bytes]:
    parts = [spread_out(x, np.uint64, np.uint8, np.int64) for x in blobs]
    got = flags(np.concatenate([p[0] for p in parts]), np.concatenate([from48(p[1]) for p in parts]), np.concatenate([p[2] for p in parts]))
    cut = np.cumsum([0, *(len(p[0]) for p in parts)])
    return [squeeze(got[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def dedup(docs: DataFrame, length: int = 50, gram: int = 24, chunk_bytes: int = 2_000_000, seed: int = 5) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) for every row of docs (doc_id, text)."""
    side = length - gram
    parts = parts_for(docs, 12)
    buckets = 4 * parts
    table = materialize(packed(docs, chunk_bytes), "packed")

    def pairs(batches):
        hasher = SpanHash(4_000_000, seed)
        for pdf in batches:
            for k, data in zip(pdf["chunk"], pdf["data"], strict=True):
                c = Chunk(data, hasher, length, gram, buckets)
                rows = [(k, b, squeeze(c.g_h[a:z], low48(c.g_c[a:z]), c.g_id[a:z])) for b, a, z in c.by_bucket()]
                yield pd.DataFrame(rows, columns=["chunk", "bucket", "sent"])

    schema = "chunk long, bucket long, sent binary"
    replies = materialize(reduced(table.mapInPandas(pairs, schema), parts, work_flags), "flags")

    def rerank(batches):
        hasher = SpanHash(4_000_000, seed)
        for pdf in batches:
            for k, data, got in zip(pdf["chunk"], pdf["data"], pdf["flag"], strict=True):
                c = Chunk(data, hasher, length, gram, buckets)
                code = np.zeros(len(c.g_h), np.uint8)
                answers = {r["bucket"]: r["reply"] for r in got} if got is not None else {}
                for b, a, z in c.by_bucket():
                    code[a:z] = spread_out(answers[b], np.uint8)[0]
                flag, ids = code[c.group], c.ids[c.doc][c.order]
                at = c.order
                done = (flag == 1) | (ids > c.g_id[c.group])
                start, end = c.lo[at[done]], c.hi[at[done]]
                by = np.argsort(start, kind="stable")
                start, end = start[by], np.maximum.accumulate(end[by]) if len(by) else end
                keep = np.ones(len(start), bool)
                keep[1:] = start[1:] > end[:-1]
                heads = np.flatnonzero(keep)
                last = np.append(heads[1:] - 1, len(end) - 1) if len(heads) else heads
                open_ = np.flatnonzero(code == 2)
                number = np.full(len(code), -1, np.int64)
                number[open_] = np.arange(len(open_))
                own = (flag == 2) & ~done
                yield pd.DataFrame({"chunk": [k], "bucket": [-1], "sent": [squeeze(start[heads], end[last], number[c.group[own]], c.pos[at[own]])]})
                if not len(open_):
                    continue
                rep = at[c.first[open_]]
                p, s, e = c.pos[rep], c.starts[c.doc[rep]], c.ends[c.doc[rep]]
                wide = np.concatenate([np.zeros(side, np.uint8), c.buf, np.zeros(length, np.uint8)])
                steps = np.arange(side)
                ctx = np.concatenate([wide[p[:, None] + steps], wide[p[:, None] + side + gram + steps]], 1)
                left, right = np.minimum(p - s, side).astype(np.uint8), np.minimum(e - p - gram, side).astype(np.uint8)
                b = c.g_bucket[open_]
                cut = np.flatnonzero(np.diff(b)) + 1
                rows = [(k, int(b[i]), squeeze(c.g_h[open_[i:j]], ctx[i:j], left[i:j], right[i:j], c.g_id[open_[i:j]])) for i, j in zip([0, *cut], [*cut, len(b)], strict=True)]
                yield pd.DataFrame(rows, columns=["chunk", "bucket", "sent"])

    def work_masks(blobs: list[bytes]) -> list[bytes]:
        parts = [spread_out(x, np.uint64, np.uint8, np.uint8, np.uint8, np.int64) for x in blobs]
        h, ctx, left, right, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        got = np.packbits(masks(h, ctx.reshape(len(h), 2 * side), left, right, ids, side), axis=1)
        cut = np.cumsum([0, *(len(p[0]) for p in parts)])
        return [squeeze(got[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    dealt = table.repartition(parts, "chunk")
    met = dealt.join(gathered(replies, "flag", parts).hint("shuffle_hash"), F.col("chunk") == F.col("flag_chunk"), "left").select("chunk", "data", "flag")
    second = materialize(met.mapInPandas(rerank, schema), "rerank")
    discard(replies)
    replies2 = materialize(reduced(second.filter("bucket >= 0"), parts, work_masks), "masks")

    def finish(batches):
        for pdf in batches:
            for data, sent, got in zip(pdf["data"], pdf["sent"], pdf["mask"], strict=True):
                ids, has, sizes, buf = spread_out(data, np.int64, bool, np.int64, np.uint8)
                start, end, number, pos = spread_out(sent, np.int64, np.int64, np.int64, np.int64)
                step = np.zeros(len(buf) + 1, np.int32)
                np.add.at(step, start, 1)
                np.add.at(step, end, -1)
                if got is not None and len(got):
                    got = sorted(got, key=lambda r: r["bucket"])
                    bits = np.concatenate([spread_out(r["reply"], np.uint8)[0] for r in got]).reshape(-1, (side + 8) // 8)
                    bits = np.unpackbits(bits, axis=1)[:, : side + 1].astype(bool)
                    r, j = np.nonzero(bits[number])
                    np.add.at(step, pos[r] - j, 1)
                    np.add.at(step, pos[r] - j + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                out, at = [], 0
                for d, ok, n in zip(ids, has, sizes, strict=True):
                    g, raw = gone[at : at + n], buf[at : at + n]
                    kept = raw[~g].tobytes()
                    runs = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                    out.append((int(d) if ok else None, int(n), int(g.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
                    at += n
                frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
                yield frame.assign(doc_id=pd.array(frame["doc_id"], "Int64"))

    spans = second.filter("bucket < 0").select(F.col("chunk").alias("s_chunk"), "sent").repartition(parts, "s_chunk")
    last = dealt.join(spans.hint("shuffle_hash"), F.col("chunk") == F.col("s_chunk")).join(gathered(replies2, "mask", parts).hint("shuffle_hash"), F.col("chunk") == F.col("mask_chunk"), "left")
    return last.select("data", "sent", "mask").mapInPandas(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
