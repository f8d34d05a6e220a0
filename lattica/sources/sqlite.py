"""SQLite files in and out: the five tables of a stored graph. The file must lie where all tasks can open it."""

from __future__ import annotations

import sqlite3

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables and columns of a stored graph.
TABLES = {
    "triples": (("subject", "TEXT"), ("relation", "TEXT"), ("object", "TEXT"), ("source", "TEXT"), ("proof", "TEXT"), ("temporal_start", "INTEGER"), ("temporal_end", "INTEGER")),
    "relation_properties": (("relation", "TEXT"), ("properties", "TEXT")),
    "composition_rules": (("rel1", "TEXT"), ("rel2", "TEXT"), ("target", "TEXT")),
    "gazetteer": (("entity", "TEXT"),),
    "sense_inventory": (("surface_form", "TEXT"), ("sense_uri", "TEXT"), ("sense_index", "INTEGER")),
}


def read_table(spark: SparkSession, path: str, table: str, chunk: int = 100_000) -> DataFrame:
    """The rows of a table, seq (its rowid) added; each task reads one range of rowids. A missing table or column gives no rows or nulls."""
    columns = TABLES[table]
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        have = {r[1] for r in db.execute(f"PRAGMA table_info({table})")}
        top = db.execute(f"SELECT max(rowid) FROM {table}").fetchone()[0] if have else None
    names = [c for c, _ in columns]
    schema = ", ".join(f"{c} {'int' if t == 'INTEGER' else 'string'}" for c, t in columns) + ", seq long"
    if not top:
        return spark.createDataFrame([], schema)
    said = ", ".join(c if c in have else f"NULL AS {c}" for c in names)

    def run(batches):
        db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        for pdf in batches:
            for i in pdf["id"]:
                rows = db.execute(f"SELECT {said}, rowid FROM {table} WHERE rowid > ? AND rowid <= ?", (int(i) * chunk, (int(i) + 1) * chunk)).fetchall()
                yield pd.DataFrame(rows, columns=[*names, "seq"]).astype({c: "Int64" for c, t in columns if t == "INTEGER"})

    parts = -(-top // chunk)
    return spark.range(0, parts, 1, parts).mapInPandas(run, schema)


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """triples (schema.TRIPLE), relation_properties, composition_rules, gazetteer and sense_inventory of a file."""
    t = read_table(spark, path, "triples")
    confidence = F.when(F.coalesce("source", F.lit("user")) == "user", 1.0).otherwise(0.85)
    facts = t.select("subject", "relation", "object", F.coalesce("source", F.lit("user")).alias("source"), F.coalesce("proof", F.lit("")).alias("proof"), confidence.alias("confidence"), F.col("temporal_start").alias("t_start"), F.col("temporal_end").alias("t_end"), "seq")
    props = read_table(spark, path, "relation_properties").select("relation", F.explode(F.split("properties", ",")).alias("property")).select("relation", F.trim("property").alias("property")).filter("property <> ''")
    return {"triples": facts, "relation_properties": props, "composition_rules": read_table(spark, path, "composition_rules").drop("seq"), "gazetteer": read_table(spark, path, "gazetteer").drop("seq"), "sense_inventory": read_table(spark, path, "sense_inventory").drop("seq")}


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    """Write a graph's tables to one file, rows streamed through the driver a partition at a time. For exchange; large graphs belong in Parquet."""
    found = dict(tables)
    if "relation_properties" in found:
        found["relation_properties"] = found["relation_properties"].groupBy("relation").agg(F.array_join(F.sort_array(F.collect_set("property")), ",").alias("properties"))
    if "triples" in found:
        found["triples"] = found["triples"].withColumnsRenamed({"t_start": "temporal_start", "t_end": "temporal_end"}).orderBy("seq")
    with sqlite3.connect(path) as db:
        for name, columns in TABLES.items():
            db.execute(f"DROP TABLE IF EXISTS {name}")
            db.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {t}' for c, t in columns)})")
            if name in found:
                rows = found[name].select(*[c for c, _ in columns]).toLocalIterator(prefetchPartitions=True)
                db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", (tuple(r) for r in rows))
