"""A corpus pipeline of five of the operators: reject bad text, near copies and benchmark leaks, redact personal data, mix.

STAGES are applied in order; each gets all rows that its predecessor kept, written as Parquet and read again. The first four
return the columns of documents, the last the mix per document. The rows depend on a language model and a tagger, which SQL
cannot express, so ORACLE_SQL is None and the tests hold the stages against brute force.

Defined results: rows are decided one by one, whatever their doc_id (null, repeated); null, empty and blank texts are rejected
by the first stage; rows that repeat a text are near copies, of which that of least doc_id stays (null last, then by place in
the files); an empty table gives an empty table; further columns stay up to the last stage, which gives those of `mixing.taken`.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import chosen_path, decontamination, kneser_ney, mixing, pii_tagger
from lattica.llm.common import materialize, read_table
from lattica.plans.rounds import scratch


def numbered(docs: DataFrame) -> DataFrame:
    """docs with an id per row, _row, by which the stages decide: doc_id may be null or repeat. Rows of Parquet files are known by
    file and place in it, however the files are split; other rows get their id from a written copy."""
    files = sorted(docs.inputFiles())
    try:
        placed = docs.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")})
    except AnalysisException:
        files = []
    if not files or len(files) > 1_000_000:
        return materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    known = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(files)), "_n long, _name string"))
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(F.col(c), F.lit("+"), F.lit("%2B"))), "^[a-z]+:/*", "/")  # noqa: E731  both ways of writing a path
    number = F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("unknown file "), "_file"))).otherwise(F.col("_n")).cast("long")
    return placed.join(known, plain("_file") == plain("_name"), "left").withColumn("_row", F.shiftleft(number, 40) + F.col("_at")).drop("_file", "_at", "_n", "_name")


def by_row(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("_row"))


def kept_rows(rows: DataFrame, decide) -> DataFrame:
    """The rows of rows whose _row is a kept_id of what decide gives. That table alone outlives the stage; texts are not sorted."""
    with scratch() as tables:
        ids = tables.keep(materialize(decide(), "kept"))
    return rows.join(ids.hint("shuffle_hash"), F.col("_row") == F.col("kept_id"), "left_semi").drop("_row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)

    def decide():
        labels = read_table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_id")
        told = rows.select("_row", "doc_id").join(labels, F.col("doc_id").cast("long") == F.col("l_id").cast("long"))
        found = kneser_ney.classify(by_row(rows), told.select(F.col("_row").alias("doc_id"), "quality", "toxic"))
        return found.filter("kept").select(F.col("doc_id").alias("kept_id"))

    return kept_rows(rows, decide)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row of least doc_id stays, null last, ties by row."""
    rows = numbered(docs)

    def decide():
        found = chosen_path.join(by_row(rows)).select(F.col("doc_id").alias("j_row"), "component_id")
        told = rows.select("_row", F.col("doc_id").cast("long").alias("doc_id")).join(found, F.col("_row") == F.col("j_row"))
        least = told.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("least"))
        return least.select(F.col("least._row").alias("kept_id"))

    return kept_rows(rows, decide)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)

    def decide():
        found = decontamination.decontaminate(by_row(rows), read_table(spark, sf_dir, "benchmark"))
        return found.filter("not contaminated").select(F.col("doc_id").alias("kept_id"))

    return kept_rows(rows, decide)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_tagger.redact(docs, "text", "n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("personal_data", personal_data), ("mixture", mixture)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
