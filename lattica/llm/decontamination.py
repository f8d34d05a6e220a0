"""Benchmark decontamination (operator 4): a distributed positional inverted index, DataFrame operations only.

1. Test side: words of the benchmark, its windows of `window` consecutive words (a shorter item is one window), each with
   its words' document counts in the corpus; the rarest words of a window are its probes.
2. Index: postings (term, doc, position) of the test vocabulary's rarest terms, stored in the shared folder.
3. Offset-adjusted lists: a posting at p of a probe with offset o says that the window would start at p - o. The list of
   each window's rarest term gives starts, which are intersected with the lists of its next rarest terms, one after the other.
4. Candidates meet their document's words once; the window must stand there word for word (phrase), or in any
   order within a span of `window + slack` words (proximity).

Words: runs of characters other than ASCII signs, A-Z lower-cased. The index is built on fully lower-cased words, which only
merges more; the phrase test compares A-Z-lower-cased words.

Defined results: null or empty texts have no words; items without words have no window; items that repeat an item_id add to
that item; repeated document rows get repeated results; words in windows of items without an id are hit, but these items are not counted or named; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import materialize
from lattica.plans.rounds import scratch

BREAK = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
FEW = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: str) -> str:
    """Expression for the words of a column; positions may start with one empty word, which no term equals."""
    return f"split({text}, '{BREAK}')"


def word_count(words: str) -> str:
    """Number of words in a split_words array: without the empty one that a break at either end leaves."""
    return f"size({words}) - if({words}[0] = '', 1, 0) - if(size({words}) > 1 and element_at({words}, -1) = '', 1, 0)"


def folded(df: DataFrame) -> DataFrame:
    """text with A-Z lower-cased by translate, which leaves all other letters as they are."""
    return df.withColumn("text", F.translate("text", UPPER, LOWER))


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, win, words): each item's windows, A-Z-lower-cased."""
    items = folded(benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    words = items.select("item_id", F.expr(f"filter({split_words('text')}, w -> w <> '')").alias("ws")).filter("size(ws) > 0")
    cut = words.select("item_id", F.explode(F.expr(f"transform(sequence(1, greatest(1, size(ws) - {window} + 1)), i -> slice(ws, i, {window}))")).alias("words"))
    return cut.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items")).withColumn("win", F.xxhash64("words"))


def index_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.expr(split_words("lower(text)")).alias("ws"))


def sized_broadcast(small: DataFrame, limit: int) -> DataFrame:
    """small as a broadcast side if it has at most limit rows; else as it is, for a shuffled join."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def candidates(docs: DataFrame, windows: DataFrame, probes: int, limit: int) -> DataFrame:
    """(doc_id, win, start): 0-based starts in index_rows where the postings of a window's rarest terms agree.

    The rarest term's list gives the first starts; each further list is cut down to the documents still in question and
    intersected with the starts that are left. Rows that share a doc_id share candidates; each row is tested by itself afterwards."""
    terms = windows.select("win", F.posexplode(F.transform("words", F.lower)).alias("off", "term"))
    vocab = materialize(terms.select("term").distinct(), "vocab")
    tokens = index_rows(docs).select(F.explode("ws").alias("w"))
    counts = tokens.join(sized_broadcast(vocab, limit), F.col("w") == F.col("term"), "left_semi").groupBy(F.col("w").alias("c_term")).agg(F.count("*").alias("n"))
    counts = materialize(counts, "term-counts")
    rare = Window.partitionBy("win").orderBy(F.coalesce("n", F.lit(0)), "term", "off")
    ranked = terms.join(counts, F.col("term") == F.col("c_term"), "left").withColumn("rank", F.row_number().over(rare))
    keys = materialize(ranked.filter(F.col("rank") <= probes).select("win", "term", "off", "rank"), "probes")
    wanted = sized_broadcast(materialize(keys.select(F.col("term").alias("p_term")).distinct(), "probe-terms"), limit)
    places = index_rows(docs).select("doc_id", F.posexplode("ws").alias("pos", "w"))
    postings = materialize(places.join(wanted, F.col("w") == F.col("p_term")).select(F.col("w").alias("term"), "doc_id", "pos"), "postings")
    first = sized_broadcast(keys.filter("rank = 1").select("win", "term", "off"), limit)
    found = materialize(postings.join(first, "term").select("doc_id", "win", (F.col("pos") - F.col("off")).alias("start")).filter("start >= 0"), "starts")
    for k in range(2, probes + 1):
        found = materialize(intersected(found, keys.filter(F.col("rank") == k).select("win", "term", "off"), postings, limit), f"starts{k}")
    return found


def intersected(found: DataFrame, keys: DataFrame, postings: DataFrame, limit: int) -> DataFrame:
    """The rows of found (doc_id, win, start) whose window's term of keys stands at its place; windows without one stay."""
    terms = sized_broadcast(keys.select(F.col("term").alias("k_term")).distinct(), limit)
    lists = postings.join(terms, F.col("term") == F.col("k_term"), "left_semi")
    left = materialize(found.select(F.col("doc_id").alias("f_id")).distinct(), "found-docs")
    if left.count() <= FEW:  # only spares rows of the shuffle that follows
        lists = lists.join(F.broadcast(left), F.col("doc_id").eqNullSafe(F.col("f_id")), "left_semi")
    lists = lists.select(F.col("doc_id").alias("l_id"), F.col("term").alias("l_term"), F.col("pos").alias("l_pos"))
    asked = found.join(sized_broadcast(keys, limit), "win", "left")
    there = F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("term") == F.col("l_term")) & (F.col("start") + F.col("off") == F.col("l_pos"))
    met = asked.filter("term is not null").join(lists, there, "left_semi")
    return met.unionByName(asked.filter("term is null")).select("doc_id", "win", "start")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, probes: int = 3, slack: int | None = None, limit: int = 500_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items for every row of docs (doc_id, text).

    slack None: exact phrases. Else a window also hits where its words stand in any order among at most window +
    slack words that hold its rarest word; then the words of that stretch which belong to the window are hit.
    limit: rows up to which a test-side table is broadcast.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    windows = materialize(windows_of(benchmark, window), "windows")
    with scratch() as tables:
        found = tables.keep(candidates(rows, windows, probes if slack is None else 1, limit))
    per_doc = found.join(sized_broadcast(windows, limit), "win").groupBy(F.col("doc_id").alias("c_id")).agg(F.collect_list(F.struct("start", "words", "items")).alias("c"))
    met = folded(rows).join(per_doc.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("c_id")), "left").select("doc_id", F.expr(split_words("text")).alias("ws"), "c")
    if slack is None:
        good = met.withColumn("hits", F.expr("filter(c, x -> slice(ws, x.start + 1, size(x.words)) = x.words)"))
        places = "transform(hits, x -> sequence(x.start, x.start + size(x.words) - 1))"
    else:
        near = f"slice(ws, greatest(1, x.start + 1 - {slack}), size(x.words) + 2 * {slack})"
        good = met.withColumn("hits", F.expr(f"filter(c, x -> size(array_except(x.words, {near})) = 0)"))
        places = f"transform(hits, x -> filter(sequence(greatest(0, x.start - {slack}), least(size(ws) - 1, x.start + size(x.words) - 1 + {slack})), i -> array_contains(x.words, ws[i])))"
    out = good.select(
        "doc_id",
        F.expr(word_count("ws")).cast("long").alias("n_words"),
        F.expr(f"coalesce(size(array_distinct(flatten({places}))), 0)").cast("long").alias("n_hit"),
        F.expr("coalesce(array_sort(array_distinct(flatten(transform(hits, x -> x.items)))), cast(array() as array<string>))").alias("items"),
    )
    return out.select("doc_id", "n_words", F.greatest("n_hit", F.lit(0)).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")
