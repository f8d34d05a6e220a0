"""Loading, normalising, upserting and writing facts. Every entry point trims white space and lower-cases s, r and o."""

from __future__ import annotations

import re
from urllib.parse import unquote_plus

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "http://example.org/kg/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def normal(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", ""))


def normalized(df: DataFrame) -> DataFrame:
    """(subject, relation, object) lower-cased and trimmed, rows with an empty or null part left out, duplicates merged."""
    out = df.select(*[normal(c).alias(c) for c in ("subject", "relation", "object")])
    return out.filter("length(subject) > 0 and length(relation) > 0 and length(object) > 0").dropDuplicates(["subject", "relation", "object"])


def load_tsv(spark: SparkSession, path: str, has_header: bool = False) -> DataFrame:
    """(subject, relation, object) of lines with three or more tab-separated parts; gzip by suffix; further parts are ignored."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    if has_header:
        heads = lines.groupBy("f").agg(F.min("i").alias("i"))
        lines = lines.join(heads, ["f", "i"], "left_anti")
    parts = lines.select(F.split("line", "\t").alias("p")).filter("size(p) >= 3")
    return normalized(parts.select(F.col("p")[0].alias("subject"), F.col("p")[1].alias("relation"), F.col("p")[2].alias("object")))


def pick_alias(aliases: Column, english: bool = True) -> Column:
    """The first alias of which at least 80 % of the characters are below U+0100, else the first; lower-cased."""
    clean = F.filter(F.transform(aliases, lambda a: normal(a)), lambda a: F.length(a) > 0)
    latin = F.filter(clean, lambda a: F.length(F.regexp_replace(a, "[^\\x{0}-\\x{FF}]", "")) >= F.length(a) * 0.8)
    return F.coalesce(F.try_element_at(latin, F.lit(1)), F.try_element_at(clean, F.lit(1))) if english else F.try_element_at(clean, F.lit(1))


def load_aliases(spark: SparkSession, path: str, english: bool = True) -> DataFrame:
    """(id, name) of lines id, alias, alias, ... (ragged, tab-separated)."""
    p = spark.read.text(path).select(F.split("value", "\t").alias("p")).filter("size(p) >= 2")
    return p.select(normal(F.col("p")[0]).alias("id"), pick_alias(F.expr("slice(p, 2, size(p) - 1)"), english).alias("name")).filter("name is not null").dropDuplicates(["id"])


def map_aliases(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Ids replaced by names; rows with an unknown id are skipped. Join sides are left to the optimizer's size estimates."""
    e, r = entities.select("id", "name"), relations.select("id", "name")
    out = triples.join(e.select(F.col("id").alias("subject"), F.col("name").alias("s")), "subject").join(e.select(F.col("id").alias("object"), F.col("name").alias("o")), "object")
    out = out.join(r.select(F.col("id").alias("relation"), F.col("name").alias("r")), "relation")
    return normalized(out.select(F.col("s").alias("subject"), F.col("r").alias("relation"), F.col("o").alias("object")))


def load_stats(raw: DataFrame) -> DataFrame:
    """One row: lines, facts that have all parts, distinct facts, and what was left out as short or as a repeat. Lines are
    counted per fact first, so each is normalised once and one shuffle carries a fact once per task."""
    rows = raw.select(*[normal(c).alias(c) for c in ("subject", "relation", "object")])
    good = F.coalesce(F.length("subject") * F.length("relation") * F.length("object") > 0, F.lit(False))
    key = [F.when(good, F.col(c)).alias(c) for c in ("subject", "relation", "object")]
    per = rows.select(good.alias("good"), *key).groupBy("good", "subject", "relation", "object").agg(F.count("*").alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("loaded"), F.count(F.when(F.col("good"), 1)).alias("facts"),
    ).withColumns({"skipped": F.col("lines") - F.col("loaded"), "repeats": F.col("loaded") - F.col("facts")})


def upsert(facts: DataFrame, new: DataFrame) -> DataFrame:
    """facts with new merged in by (subject, relation, object): the first row's source and proof stay, the last given
    years win. Both have the columns of schema.TRIPLE; aggregates combine before the shuffle, so a hot key is no list."""
    every = facts.unionByName(new.withColumns({c: normal(c) for c in ("subject", "relation", "object")}))
    years = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return every.groupBy("subject", "relation", "object").agg(
        F.min_by("source", "seq").alias("source"), F.min_by("proof", "seq").alias("proof"), F.min_by("confidence", "seq").alias("confidence"),
        years("t_start").alias("t_start"), years("t_end").alias("t_end"), F.min("seq").alias("seq"),
    )


def remove(facts: DataFrame, gone: DataFrame) -> DataFrame:
    return facts.join(gone.select("subject", "relation", "object"), ["subject", "relation", "object"], "left_anti")


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet under path; facts are laid out by relation, so that a relation's facts are a partition."""
    for name, df in tables.items():
        (df.write.mode("overwrite").partitionBy("relation") if name == "triples" else df.write.mode("overwrite")).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, names: tuple = ("triples", "relation_properties", "composition_rules")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def uri(c: Column | str, kind: str = "entity") -> Column:
    """The IRI of a name; kind: entity, relation or source. Percent-encoded but for - . / : @, a space as an underscore and an
    underscore as %5F, so that no two names share an IRI."""
    enc = F.replace(F.replace(F.url_encode(normal(c)), F.lit("_"), F.lit("%5F")), F.lit("+"), F.lit("_"))
    for code, sign in (("%2F", "/"), ("%3A", ":"), ("%40", "@")):
        enc = F.replace(enc, F.lit(code), F.lit(sign))
    return F.concat(F.lit(f"{BASE}{kind}/"), enc)


def from_uri(c: Column | str) -> Column:
    """The name that uri encoded, whatever its kind; rdf:type is is_a; other IRIs are names as they stand."""
    col = F.col(c) if isinstance(c, str) else c
    own = F.regexp_extract(col, f"^{re.escape(BASE)}(?:entity|relation|source)/(.*)$", 1)
    return F.when(col == RDF_TYPE, "is_a").when(own != "", F.url_decode(F.replace(own, F.lit("_"), F.lit("+")))).otherwise(col)


def name_of(iri: str) -> str:
    """from_uri for one IRI of a query text."""
    m = re.fullmatch(f"{re.escape(BASE)}(?:entity|relation|source)/(.+)", iri)
    return "is_a" if iri == RDF_TYPE else unquote_plus(m[1].replace("_", "+")) if m else iri


def query_name(c: Column | str) -> Column:
    """Only letters, digits, _, -, . and spaces of a name, for building query text from it."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, "[^A-Za-z0-9_. -]", "")


def without_article(c: Column | str) -> Column:
    """Lower-cased and trimmed; a leading the, a or an goes where two words or more are left."""
    return F.regexp_replace(normal(c), r"^(?:the|a|an) (?=\S+ )", "")


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, relation, object): a graph from the star schema; the one input of the graph queries."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edge = lambda df, s, r, o: df.select(s.alias("subject"), F.lit(r).alias("relation"), o.alias("object"))
    return (
        edge(t("customer"), name("customer", "c_custkey"), "in", name("nation", "c_nationkey"))
        .union(edge(t("supplier"), name("supplier", "s_suppkey"), "in", name("nation", "s_nationkey")))
        .union(edge(t("nation"), name("nation", "n_nationkey"), "in", name("region", "n_regionkey")))
        .union(edge(t("orders"), name("order", "o_orderkey"), "placed_by", name("customer", "o_custkey")))
        .union(edge(t("lineitem"), name("part", "l_partkey"), "supplied_by", name("supplier", "l_suppkey")).distinct())
    )


def gazetteer(facts: DataFrame) -> DataFrame:
    """(name): names of two words or more, for entity linking."""
    names = facts.select(F.explode(F.array("subject", "object")).alias("name"))
    return names.filter(F.col("name").contains(" ")).distinct()


def latest_intervals(facts: DataFrame) -> DataFrame:
    """(subject, t_start, t_end): the last written interval with a start."""
    dated = facts.filter("t_start is not null")
    return dated.groupBy("subject").agg(F.max_by(F.struct("t_start", "t_end"), "seq").alias("t")).select("subject", "t.t_start", "t.t_end")

