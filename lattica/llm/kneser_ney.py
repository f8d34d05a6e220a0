"""Quality classifier (operator 1): an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Text is read as its words with one space between them, three start signs and a space in front and a space at the end; every
character and the end are predicted from the four characters before them, across words too. A character is one of 4,096
signs: code points below 4,000 are their own, all others share 96 by remainder; so a 5-gram is one 60-bit number, exact.

Model: the trusted text is that of documents labelled quality 1 and not toxic. Half of them may be fitted on, at most max_train_docs
(languages take turns, so that rare ones are not crowded out; this bound limits the fit alone); all others are held out.
Counts, continuation counts, the discounts D1, D2, D3+ of each order and the context masses are tables by gram.

Scoring: the distinct 5-grams of the whole corpus meet the sharded count tables order by order, lowest first; then every
document sums its grams: the hot most frequent of them come from a broadcast, all others through a join. Three figures
of a document are each compared with margin (worst_margin for worst, an extreme that varies more) times the given quantile of the held-out trusted documents of its language:
its perplexity per character; worst, the negative log10 probability per character of its second rarest distinct word (over
the 5-grams inside the word and the spaces next to it; words of three characters or more), so that a few odd words show however
long the rest and one alone (a name, a slip) is let pass; and repeats, the share of its word 3-grams that stood in it before
(SMOOTH words are added to its length; a bound under min_repeats counts as min_repeats), as text that repeats is all too
probable. A quantile is the least value that the given share of documents do not exceed (from a sketch of bounded size, exact
below 100,000 documents). Languages with fewer than min_lang_docs of them, null among them, use the quantiles over all languages.

Defined results: a document without words (null, empty, blank) has null perplexity and is rejected; without any trusted
text there is no threshold and all documents with words are kept; labels that disagree on a doc_id make it untrusted;
repeated rows get repeated decisions; documents at a threshold are kept; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import chunks, count_floor, materialize, mix64, with_uid
from lattica.plans.rounds import discard, scratch

ORDER, BITS = 5, 12
START, SPACE, OWN, SHARED = 1, 32, 4000, 96
SMOOTH = 50


def clean(text: str | None) -> str:
    return "" if text is None else " ".join(text.split()).replace("\x01", "\x02")


class Stream:
    """The 5-grams of some texts in one go. key, doc: of each gram; row: index of its first sign."""

    def __init__(self, texts: list[str]):
        lens = np.array([len(t) + 5 if t else 0 for t in texts], np.int64)
        raw = "".join(f"\x01\x01\x01 {t} " for t in texts if t).encode("utf-32-le", "surrogatepass")
        x = np.frombuffer(raw, np.uint32).astype(np.int64)
        self.ids = np.where(x < OWN, x, OWN + x % SHARED)
        self.owner = np.repeat(np.arange(len(texts)), lens)
        n = max(0, len(self.ids) - ORDER + 1)
        key = np.zeros(n, np.int64)
        for k in range(ORDER):
            key = (key << BITS) | self.ids[k : k + n]
        self.row = np.flatnonzero(self.owner[:n] == self.owner[ORDER - 1 :][:n])
        self.key, self.doc = key[self.row], self.owner[self.row]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, hash) of each word in order, and the word of each sign (-1: none)."""
        apart = (self.ids == SPACE) | (self.ids == START)
        first = ~apart
        first[1:] &= apart[:-1]
        start = np.flatnonzero(first)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.full(len(self.ids), -1)
        at = np.cumsum(first) - 1
        place = np.arange(len(self.ids)) - start[np.maximum(at, 0)]
        h = np.where(apart, np.uint64(0), mix64((self.ids + (place + 1) * 4096).astype(np.uint64)))
        return self.owner[start], np.add.reduceat(h, start), np.where(apart, -1, at)


def counted(docs: DataFrame, size: int = 2_000_000, most: int = 1_000_000) -> DataFrame:
    """(key, n): the 5-grams of docs (text); counts meet first in each task."""

    def run(batches):
        held_k, held_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for pdf in batches:
            for part in chunks(pdf, "text", size):
                k, n = np.unique(Stream([clean(t) for t in part["text"]]).key, return_counts=True)
                both, at = np.unique(np.concatenate([held_k, k]), return_inverse=True)
                total = np.bincount(at, np.concatenate([held_n, n]), len(both)).astype(np.int64)
                held_k, held_n = both, total
                if len(both) > most:
                    yield pd.DataFrame({"key": held_k, "n": held_n})
                    held_k, held_n = held_k[:0], held_n[:0]
        yield pd.DataFrame({"key": held_k, "n": held_n})

    return docs.select("text").mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def low(c: str, k: int):
    """The last k signs of a gram."""
    return F.col(c).bitwiseAND(F.lit((1 << BITS * k) - 1))


def fit(grams: DataFrame) -> tuple[list[DataFrame], list[DataFrame], float]:
    """From trusted 5-grams (key, n): per order k the discounted shares (key, q) and the masses that contexts leave to order k - 1
    (ctx, g), lowest order first, and the probability that the last back-off reaches."""
    counts, shares, masses, left = materialize(grams, "trusted"), [], [], 1.0
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            counts = materialize(counts.groupBy(low("key", k).alias("key")).agg(F.count("*").alias("n")), f"trusted{k}")
        n = counts.agg(*[F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)], F.count("*")).first()
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        d = [max(0.05, min(i - 0.05, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else 0.5 for i in (1, 2, 3)]
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        h = F.shiftright("key", BITS)
        mass = materialize(counts.groupBy(h.alias("ctx")).agg(F.sum("n").alias("total"), F.sum(cut).alias("cut")), "masses")
        shares.append(counts.withColumn("ctx", h).join(mass, "ctx").select("key", ((F.col("n") - cut) / F.col("total")).alias("q")))
        masses.append(mass.select("ctx", (F.col("cut") / F.col("total")).alias("g")))
        if k == 1 and (row := mass.first()):
            left = (row["cut"] / row["total"]) / (n[4] + 1)
    return shares[::-1], masses[::-1], left


def scored(grams: DataFrame, shares: list[DataFrame], masses: list[DataFrame], left: float) -> DataFrame:
    """(key, n, lp): log10 of the interpolated probability of the last sign of each distinct gram (key, n)."""
    grams = materialize(grams.join(shares[-1], "key", "left"), "grams")
    kinds, at = {}, grams.select("key")
    for k in range(ORDER - 1, 0, -1):
        at = kinds[k] = materialize(at.select(low("key", k).alias("key")).distinct(), f"kinds{k}")
    below = materialize(kinds[1].join(shares[0], "key", "left").select("key", (F.coalesce("q", F.lit(0.0)) + left).alias("p")), "p1")
    for k in range(2, ORDER + 1):
        rows = kinds[k].join(shares[k - 1], "key", "left") if k < ORDER else grams
        rows = rows.withColumns({"ctx": F.shiftright("key", BITS), "low": low("key", k - 1)}).join(masses[k - 1], "ctx", "left")
        p = F.coalesce("q", F.lit(0.0)) + F.coalesce("g", F.lit(1.0)) * F.col("p")
        told = rows.join(below.select(F.col("key").alias("low"), "p"), "low")
        was, below = below, materialize(told.select("key", *(["n"] if k == ORDER else []), (F.log10(p).alias("lp") if k == ORDER else p.alias("p"))), f"p{k}")
        discard(was, kinds.get(k))
    discard(grams)
    return below


def trusted_ids(labels: DataFrame) -> DataFrame:
    one = labels.groupBy(F.col("doc_id").cast("long").alias("t_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("x"), F.count("quality").alias("a"), F.count("toxic").alias("b"), F.count("*").alias("c"))
    return one.filter("t_id is not null and q = 1 and x = 0 and a = c and b = c").select("t_id")


def fit_ids(trusted: DataFrame, plain: DataFrame, max_train_docs: int) -> DataFrame:
    """f_id: the trusted documents to fit on, those of least hash times the number of their language, about the rank in it."""
    lang = plain.select("doc_id", "lang").join(trusted, F.col("doc_id") == F.col("t_id")).groupBy("t_id").agg(F.min("lang").alias("lang"))
    h = F.xxhash64("t_id")
    half = lang.filter(F.pmod(F.xxhash64("t_id", F.lit("fold")), F.lit(2)) == 0).withColumn("h", h)
    size = half.groupBy(F.col("lang").alias("s_lang")).agg(F.count("*").alias("docs"))
    turn = (F.col("h") / F.lit(2.0**64) + 0.5) * F.col("docs")
    return half.join(size, F.col("lang").eqNullSafe(F.col("s_lang"))).orderBy(turn, "h", "t_id").limit(max_train_docs).select(F.col("t_id").alias("f_id"))


FIGURES = "uid long, w long, key long, n long, lp double, chars long, r1 double, r2 double, repeats double, doc_id long, lang string"


class Near:
    """The frequent grams for a broadcast: keys sorted, their lp, and their order by count. A worker builds once a table of SLOTS
    places in which of the grams that share a place the most frequent stands; the others are found by bisection."""

    SLOTS = 21

    def __init__(self, key: np.ndarray, lp: np.ndarray, n: np.ndarray):
        by = np.argsort(key)
        self.key, self.lp, self.order, self.slot = key[by], lp[by], np.argsort(n[by], kind="stable").astype(np.int32), None

    def __getstate__(self):
        return self.__dict__ | {"slot": None}

    def place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, lp; 0 where not known) of each gram."""
        if not len(self.key) or not len(key):
            return np.zeros(len(key), bool), np.zeros(len(key))
        if self.slot is None:
            self.slot = np.zeros(1 << self.SLOTS, np.int32)
            self.slot[self.place(self.key[self.order])] = self.order
        at = self.slot[self.place(key)].astype(np.int64)
        known = self.key[at] == key
        miss = np.flatnonzero(~known)
        again = np.minimum(np.searchsorted(self.key, key[miss]), len(self.key) - 1)
        at[miss], known[miss] = again, self.key[again] == key[miss]
        return known, np.where(known, self.lp[at], 0.0)


def first_of(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indices of one item of each distinct (owner, 64-bit hash)."""
    return np.unique(mix64(h + mix64(owner.astype(np.uint64) + np.uint64(1))), return_index=True)[1]


def document_rows(texts: list[str], near: Near) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Per text its sums over the frequent grams (and its two rarest words of those known), and per text what must be looked up:
    (i, w, key, n): grams of the text (w null), grams of one of its distinct words w, and with key null such a word's own sums."""
    m, s = len(texts), Stream(texts)
    known, lp = near.find(s.key)
    whose, h, word_at = s.words()
    base = pd.DataFrame({"i": np.arange(m), "lp": np.bincount(s.doc, lp, m), "chars": np.bincount(s.doc, minlength=m)})
    # repeated word 3-grams
    n_words = np.bincount(whose, minlength=m) if len(whose) else np.zeros(m, np.int64)
    new = np.zeros(m, np.int64)
    if len(h) > 2:
        tri = mix64(h[:-2] + mix64(h[1:-1] + mix64(h[2:])))
        ok = whose[:-2] == whose[2:]
        new = np.bincount(whose[:-2][ok][first_of(whose[:-2][ok], tri[ok])], minlength=m)
    base["repeats"] = (np.maximum(0, n_words - 2) - new) / (n_words + SMOOTH)
    # distinct words by the grams inside them
    inside = np.flatnonzero((word_at[s.row + 1] >= 0) & (word_at[s.row + 1] == word_at[s.row + 2]) & (word_at[s.row + 2] == word_at[s.row + 3])) if len(s.row) else np.zeros(0, np.int64)
    mine = word_at[s.row[inside] + 1]
    total, size, open_ = (np.bincount(mine, x, len(h)) for x in (lp[inside], None, ~known[inside]))
    words = np.flatnonzero(size)
    one = words[first_of(whose[words], h[words])]
    done, todo = one[open_[one] == 0], one[open_[one] > 0]
    rare = -total[done] / size[done]
    order = np.lexsort((-rare, whose[done]))
    d, r = whose[done][order], rare[order]
    rank = np.arange(len(d)) - np.searchsorted(d, d)
    for k in (0, 1):
        best = np.full(m, np.nan)
        best[d[rank == k]] = r[rank == k]
        base[f"r{k + 1}"] = best
    parts = [pd.DataFrame({"i": whose[todo], "w": h[todo].view(np.int64), "key": np.nan, "n": 1, "lp": total[todo], "chars": size[todo]})]
    rest = np.flatnonzero(~known)
    rest = rest[np.lexsort((s.key[rest], s.doc[rest]))]
    d, k = s.doc[rest], s.key[rest]
    start = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])])) if len(rest) else rest
    parts.append(pd.DataFrame({"i": d[start], "w": pd.NA, "key": k[start], "n": np.diff(np.append(start, len(rest)))}))
    chosen = np.zeros(len(h), bool)
    chosen[todo] = True
    hard = chosen[mine] & ~known[inside]
    parts.append(pd.DataFrame({"i": whose[mine[hard]], "w": h[mine[hard]].view(np.int64), "key": s.key[inside[hard]], "n": 1}))
    parts = [p.astype({"i": "int64", "w": "Int64", "key": "Int64", "n": "int64"}) for p in parts if len(p)]
    return base, pd.concat(parts) if parts else pd.DataFrame({"i": []})


def sums(docs: DataFrame, table: DataFrame, hot: int) -> DataFrame:
    """doc_id, lang, chars, perplexity, worst, repeats for every row of docs (uid, doc_id, text, lang)."""
    spark = docs.sparkSession
    top = table.filter(F.col("n") >= count_floor(table, hot)).select("key", "lp", "n").toArrow()
    near = spark.sparkContext.broadcast(Near(*(top.column(c).to_numpy() for c in ("key", "lp", "n"))))

    def spread(batches):
        for pdf in batches:
            for part in chunks(pdf, "text", 1_000_000):
                base, rest = document_rows([clean(t) for t in part["text"]], near.value)
                uid = part["uid"].to_numpy()
                base = base.assign(uid=uid, doc_id=part["doc_id"].astype("Int64").array, lang=part["lang"].array)
                out = base if not len(rest) else pd.concat([base, rest.assign(uid=uid[rest["i"]])])
                out = out.reindex(columns=[x.split()[0] for x in FIGURES.split(", ")])
                yield out.assign(n=out["n"].fillna(1).astype("int64"), w=out["w"].astype("Int64"), key=out["key"].astype("Int64"), chars=out["chars"].astype("Int64"), doc_id=out["doc_id"].astype("Int64"))

    sent = docs.mapInPandas(spread, FIGURES)
    # rows that ask for nothing get a key of their own below zero, so that they spread over all tasks
    asked = sent.withColumn("ask", F.coalesce("key", -1 - F.col("uid"))).join(table.select(F.col("key").alias("t_key"), F.col("lp").alias("t_lp")).hint("merge"), F.col("ask") == F.col("t_key"), "left")
    gain = F.coalesce("lp", F.lit(0.0)) + F.coalesce(F.col("t_lp") * F.col("n"), F.lit(0.0))
    keep = [F.max(c).alias(c) for c in ("repeats", "doc_id", "lang", "r1", "r2")]
    size = F.sum(F.coalesce("chars", F.when(F.col("w").isNull() & F.col("key").isNull(), 0), F.lit(0))).alias("chars")
    words = asked.select("uid", "w", "key", "chars", "repeats", "doc_id", "lang", "r1", "r2", gain.alias("gain")).groupBy("uid", "w").agg(F.sum("gain").alias("lp"), size, *keep)
    whole = F.col("w").isNull()
    each = F.when(whole, F.array_compact(F.array("r1", "r2"))).otherwise(F.array(-F.col("lp") / F.col("chars")))
    out = words.groupBy("uid").agg(
        F.sum(F.when(whole, F.col("lp"))).alias("lp"), F.sum(F.when(whole, F.col("chars"))).alias("chars"), F.max("repeats").alias("repeats"), F.max("doc_id").alias("doc_id"), F.max("lang").alias("lang"),
        F.slice(F.sort_array(F.flatten(F.collect_list(each)), False), 1, 2).alias("rare"),
    )
    has = F.col("chars") > 0
    worst = F.coalesce(F.try_element_at("rare", F.lit(-1)), F.lit(0.0))
    return out.select("doc_id", "lang", "chars", F.when(has, F.pow(F.lit(10.0), -F.col("lp") / F.col("chars"))).alias("perplexity"), F.when(has, worst).alias("worst"), "repeats")


def perplexities(docs: DataFrame, labels: DataFrame, max_train_docs: int, hot: int) -> DataFrame:
    """doc_id, lang, chars, perplexity, worst, repeats, held (trusted, not fitted on) for every row of docs."""
    trusted = materialize(trusted_ids(labels), "trusted-ids")
    trusted = F.broadcast(trusted) if trusted.count() <= 500_000 else trusted
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    fitted = F.broadcast(materialize(fit_ids(trusted, plain, max_train_docs), "fit-ids"))
    model = fit(counted(plain.join(fitted, F.col("doc_id") == F.col("f_id"), "left_semi")))
    out = sums(with_uid(plain), scored(counted(plain), *model), hot)
    marked = out.join(trusted, F.col("doc_id") == F.col("t_id"), "left").join(fitted, F.col("doc_id") == F.col("f_id"), "left")
    return marked.withColumn("held", F.expr("t_id is not null and f_id is null")).drop("t_id", "f_id")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.998, margin: float = 1.05, worst_margin: float = 1.15, min_lang_docs: int = 20, max_train_docs: int = 20_000, hot: int = 1 << 20, min_repeats: float = 0.02) -> DataFrame:
    """doc_id, lang, chars, perplexity, threshold, worst, repeats, kept for every row of docs (doc_id, text, lang)."""
    with scratch() as tables:
        scored = tables.keep(materialize(perplexities(docs, labels, max_train_docs, hot), "perplexity"))
    good = scored.filter("held and perplexity is not null")
    figures = ("perplexity", "worst", "repeats")
    cuts = [(F.expr(f"percentile_approx({x}, {quantile}, 100000)") * (worst_margin if x == "worst" else margin)).alias(f"own_{x}") for x in figures]
    by_lang = good.groupBy(F.col("lang").alias("t_lang")).agg(*cuts, F.count("*").alias("docs")).filter(F.col("docs") >= min_lang_docs).filter("t_lang is not null").drop("docs")
    every = good.agg(*cuts).first()
    by_lang = materialize(by_lang, "by-lang")
    by_lang = F.broadcast(by_lang) if by_lang.count() <= 100_000 else by_lang
    out = scored.join(by_lang, F.col("lang") == F.col("t_lang"), "left")
    bound = {x: F.coalesce(F.col(f"own_{x}"), F.lit(every[f"own_{x}"]).cast("double")) for x in figures}
    bound["repeats"] = F.greatest(bound["repeats"], F.lit(min_repeats))
    threshold = bound["perplexity"]
    within = (F.col("perplexity") <= threshold) & (F.col("worst") <= bound["worst"]) & (F.col("repeats") <= bound["repeats"])
    return out.select("doc_id", "lang", "chars", "perplexity", threshold.alias("threshold"), "worst", "repeats", (F.col("perplexity").isNotNull() & (threshold.isNull() | within)).alias("kept"))
