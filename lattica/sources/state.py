"""What the engine has learned, in files: vocabularies, word vectors, senses, memories, strategies; and texts made from templates."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "concept string, vec array<int>"
SENTENCES = "entity string, sentence string, sense int"


def save_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """(concept, vec) as JSON lines; concepts whose name starts with an underscore are the engine's own and left out."""
    vocabulary.filter(~F.col("concept").startswith("_")).write.mode("overwrite").json(path)


def load_vocabulary(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(concept, vec); a vector of another length than dim is an error when it is read."""
    wrong = F.raise_error(F.concat(F.lit(f"not {dim} places: "), "concept")).cast("array<int>")
    return spark.read.schema(VOCABULARY).json(path).select("concept", F.when(F.size("vec") == dim, F.col("vec")).otherwise(wrong).alias("vec"))


def vocabulary(names: DataFrame, dim: int) -> DataFrame:
    """(concept, vec) of names (name): each its own vector, once."""
    from lattica.functions.vectors import named

    return names.select(F.col("name").alias("concept")).distinct().select("concept", named(F.col("concept"), dim).alias("vec"))


def added(known: DataFrame, names: DataFrame, dim: int) -> DataFrame:
    """known with the names that it lacks."""
    return known.unionByName(vocabulary(names, dim).join(known.select("concept"), "concept", "left_anti"))


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Word vectors (word, freq, ctx), clusters, glosses, memory patterns and the like, each as Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names: dict[str, str]) -> dict[str, DataFrame]:
    """The tables that were saved, by name and schema; one that is not there is empty."""
    out = {}
    for name, schema in names.items():
        try:
            out[name] = spark.read.schema(schema).parquet(f"{path}/{name}")
        except AnalysisException:
            out[name] = spark.createDataFrame([], schema)
    return out


def save_sentences(rows: DataFrame, path: str) -> None:
    """Taught sentences and their senses (entity, sentence, sense) as JSON lines."""
    rows.write.mode("overwrite").json(path)


def load_sentences(spark: SparkSession, path: str) -> DataFrame:
    """What save_sentences wrote. A missing file is no rows; lines that are no such rows are left out."""
    try:
        rows = spark.read.schema(SENTENCES + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    except AnalysisException:
        return spark.createDataFrame([], SENTENCES)
    return rows.filter("_bad is null and entity is not null and sentence is not null and sense is not null").drop("_bad")


def load_strategies(spark: SparkSession, path: str) -> DataFrame:
    """Strategies of a JSON array or JSON lines: id, title, description, tags, effectiveness (0.5 if missing), query_prototypes."""
    schema = "id string, title string, description string, tags array<string>, effectiveness double, query_prototypes array<string>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    none = F.array().cast("array<string>")
    return rows.withColumns({"effectiveness": F.coalesce("effectiveness", F.lit(0.5)), "tags": F.coalesce("tags", none), "description": F.coalesce("description", F.lit(""))})


def generated(spark: SparkSession, templates: DataFrame, words: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """(domain, sentence): distinct sentences of over 20 characters, from `rows` draws: a template of (domain, template) with each {slot} filled
    from words (domain, slot, word). Draws go by hash of row number and seed, so a rerun makes the same; templates with slots without words
    give nothing."""
    from pyspark.sql import Window

    t = templates.withColumn("t", F.row_number().over(Window.orderBy("domain", "template")) - 1)
    n = t.count()
    if not n:
        return spark.createDataFrame([], "domain string, sentence string")
    drawn = spark.range(rows).select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int").alias("t")).join(F.broadcast(t), "t").select("id", "domain", "template")
    pools = words.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("slot", "ws"))).alias("pool")) if "ws" in words.columns else words.groupBy("domain", "slot").agg(F.sort_array(F.collect_set("word")).alias("ws")).groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("slot", "ws"))).alias("pool"))
    both = drawn.join(F.broadcast(pools), "domain", "left")
    # a template is its texts and slots in turn
    pieces = F.split("template", r"[{}]")
    filled = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.try_element_at(F.try_element_at("pool", F.regexp_replace(p, "[0-9]+$", "")), (F.pmod(F.xxhash64("id", i, F.lit(seed + 1)), F.size(F.try_element_at("pool", F.regexp_replace(p, "[0-9]+$", "")))) + 1).cast("int"))))
    made = both.withColumn("parts", filled).filter(~F.exists("parts", lambda x: x.isNull()))
    return made.select("domain", F.trim(F.array_join("parts", "")).alias("sentence")).filter("length(sentence) > 20").distinct()
