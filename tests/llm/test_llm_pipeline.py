"""The pipeline's stages, each against a brute-force reading of what it must keep."""

import random

import pytest

import corpus_pipeline

SYL = ["the", "on", "er", "en", "de", "la", "re", "ti", "an", "st"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYL) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, sf = random.Random(11), str(tmp_path_factory.mktemp("sf"))
    mail = lambda i: f" {prose(rng, 1)}.{i}@mail.example.com" if i % 4 == 3 else ""  # noqa: E731  ordinary text has addresses too
    clean = [(i, prose(rng, 60) + mail(i)) for i in range(100)]
    leak = prose(rng, 14)
    odd = [(200, "BAD### " * 30), (201, clean[0][1]), (202, clean[1][1] + " tail"), (203, prose(rng, 30) + " " + leak + " " + prose(rng, 30)), (204, prose(rng, 40) + " joe.12@mail.example.com " + prose(rng, 40)), (205, None), (206, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in clean + odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def test_stages(spark, tables, tmp_path):
    docs, ids = spark.read.parquet(f"{tables}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tables).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "mixture":
            assert docs.columns == before.columns
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = set(range(100))
    assert ids[0] == clean | {201, 202, 203, 204}
    assert ids[1] == clean | {203, 204}
    assert ids[2] == ids[3] == ids[4] == clean | {204}
    red = spark.read.parquet(str(tmp_path / "personal_data")).filter("doc_id = 204").first()
    assert "<EMAIL>" in red["text"] and red["n_chars"] == len(red["text"])
    mix = docs.collect()
    assert sum(r["taken"] for r in mix) == pytest.approx(1.5 * sum(r["size"] for r in mix), rel=0.05)


def test_decisions_are_per_row(spark, tables):
    rng = random.Random(13)
    leak = spark.read.parquet(f"{tables}/benchmark.parquet").first()["text"]
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(None, a), (None, b), (None, "BAD### " * 30), (7, c), (7, c), (8, d), (8, "BAD### " * 30), (9, f"{prose(rng, 30)} {leak} {prose(rng, 30)}"), (9, prose(rng, 60))]
    rows += [(100 + i, prose(rng, 60)) for i in range(3)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    base = spark.read.parquet(f"{tables}/documents.parquet").filter("doc_id < 100")
    want = [rows[i] for i in (0, 1, 3, 5, 8, 9, 10, 11)]
    out = docs.unionByName(base)
    for stage in (corpus_pipeline.quality, corpus_pipeline.near_duplicates, corpus_pipeline.benchmark_leaks):
        out = stage(spark, out, tables)
    known = {r["text"] for r in base.collect()}
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect() if r["text"] not in known), key=key) == sorted(want, key=key)
