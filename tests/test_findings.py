"""Small inputs of the kinds that went wrong on large or odd tables."""

import numpy as np
from pyspark.sql import functions as F

from lattica import queries
from lattica.operators import decisions, extraction, memory, wordvec


def test_refine_with_copies_of_patterns(spark, tmp_path, monkeypatch):
    """Of equal keys the same one is the pattern, in whatever order files are read."""
    for k in range(4):
        rows = [(100 * k + i, [1.0 if (i % 3) >> b & 1 else -1.0 for b in range(64)], 0) for i in range(100 if k else 3)]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/embeddings.parquet")
    held, plain = [], memory.refine
    monkeypatch.setattr(memory, "refine", lambda q, m, **o: held.append(m) or plain(q, m, **o))
    got = queries.queries()["mem_refine"](spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["idx"], r["sim"], r["settled"]) for r in got) == [(i, i, 1.0, True) for i in [0, *range(100, 400, 20)]]
    assert sorted(r["idx"] for r in held[0].collect()) == [0, 1, 2]


def test_synonyms_in_blocks(spark):
    rng = np.random.default_rng(2)
    vec = {f"r{i}": v.tolist() for i, v in enumerate(rng.normal(size=(60, 3)))}
    rows = [*vec.items(), ("zero", [0.0] * 3), ("short", [1.0]), ("holes", [1.0, None, 1.0]), ("none", None), (None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "relation string, vec array<double>").repartition(5)
    cos = lambda a, b: np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))
    want = {(a, b) for a in vec for b in vec if a != b and a < "r3" and cos(vec[a], vec[b]) >= 0.7}
    for most in (10_000, 7):
        got = decisions.synonyms(df.filter("relation < 'r3' or relation = 'short'"), df.filter("relation <> 'zero' or relation is null"), max_asked=most).collect()
        assert {(r["relation"], r["other"]) for r in got} == want and len(got) == len(want)
        assert all(abs(r["sim"] - cos(vec[r["relation"]], vec[r["other"]])) < 1e-12 for r in got)
    assert {r["other"] for r in decisions.synonyms(df.filter("relation = 'r1'"), df).filter("isnan(sim)").collect()} == {"zero"}
    assert decisions.synonyms(df.limit(0), df).count() == 0


def test_taught_keeps_other_columns(spark):
    rows = [(1, "Ann", "lives  in", "Rome"), (2, "ann", "lives in", "rome"), (2, "ann", "lives in", "rome"), (3, "ann", "x", "rome"), (4, None, "is", "rome")]
    got = extraction.taught(spark.createDataFrame(rows, "key int, subject string, relation string, object string")).collect()
    assert sorted((r["key"], r["subject"] or "", r["relation"], r["wrong"] or "") for r in got) == [(1, "ann", "lives_in", ""), (2, "ann", "lives_in", ""), (2, "ann", "lives_in", ""), (3, "ann", "x", "relation"), (4, "", "is", "subject")]


def patterns(spark, keys):
    rows = spark.createDataFrame([(i, k.tolist(), k.tolist(), "d") for i, k in enumerate(keys)], "seq long, key array<int>, value array<int>, domain string")
    return memory.stored(spark.createDataFrame([], memory.PATTERN), rows)


def test_corrections_find_all_patterns_alike(spark):
    rng = np.random.default_rng(4)
    keys, new = rng.choice([-1, 1], (50, 16)), rng.choice([-1, 1], (9, 16))
    store = patterns(spark, keys).withColumn("active", F.col("idx") % 7 != 3)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(new)], "seq long, vec array<int>")
    want = [i for i, k in enumerate(keys) if i % 7 != 3 and (new @ k / 16 >= 0.3).any()]
    for most in (100, 2):
        assert sorted(r[0] for r in memory.alike(asked, store, 0.3, most).collect()) == want
    told = asked.select("seq", F.col("vec").alias("key"), F.col("vec").alias("value"), F.lit("new").alias("domain"))
    left = sorted(r["idx"] for r in decisions.corrected(store, told, 0.3).filter("active and domain = 'd'").collect())
    assert left == [i for i in range(50) if i % 7 != 3 and i not in want]
    assert decisions.corrected(store, told.limit(0)).filter("active").count() == store.filter("active").count()


def test_few_patterns_are_searched_like_many(spark, monkeypatch):
    rng = np.random.default_rng(5)
    store = patterns(spark, rng.choice([-1, 1], (20, 4)))  # many ties
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.choice([-1, 1], (30, 4)))], "id long, vec array<int>")
    for options in ({"top_k": 1}, {"top_k": 6, "beta": 3.0}, {"top_k": 30, "damped": False, "min_similarity": -1.0}):
        got = []
        for few in (1_024, 0):
            monkeypatch.setattr(memory, "FEW", few)
            got.append(sorted((r["id"], r["idx"], r["sim"], round(r["weight"], 9)) for r in memory.retrieve(asked, store, **options).collect()))
        assert got[0] == got[1] and got[0]
    monkeypatch.setattr(memory, "FEW", 1_024)
    none = asked.withColumn("vec", F.when(F.col("id") > 3, F.col("vec")))
    assert {r["id"] for r in memory.retrieve(none, store, min_similarity=-1.0).collect()} == set(range(4, 30))


def test_problems_by_their_texts(spark):
    """Each text is worked out once; a problem without a text gets nothing and breaks nothing."""
    said = ["arrange items by a key", None, "find the error in code", "find the error in code", "ARRANGE items by a key"]
    rows = spark.createDataFrame([(i, t, ["focus?"]) for i, t in enumerate(said)], "key long, text string, goals array<string>").repartition(3)
    got = {r["key"]: r["prototype"] for r in decisions.prototype_matches(rows, 64, 2).filter("rank = 1").collect()}
    assert got == {0: "sorting", 2: "debugging", 3: "debugging", 4: "sorting"}
    known = spark.createDataFrame([(0, "arrange items by a key", "use sort")], "seq long, text string, solution string")
    steps = {r["key"]: (r["source"], len(r["steps"])) for r in decisions.problem_steps(rows, 64, known).collect()}
    assert steps == {0: ("memory", 0), 2: ("steps", 4), 3: ("steps", 4), 4: ("memory", 0)}
    strategy = spark.createDataFrame([("a", "Boxes", "Work in boxes", ["focus"], 0.8, ["find the error"]), ("b", "Sleep", "Rest", ["rest"], 0.5, None)], "id string, title string, description string, tags array<string>, effectiveness double, query_prototypes array<string>")
    assert sorted((r["key"], r["id"], r["rank"]) for r in decisions.advised(rows, strategy, 64).collect()) == [(k, "a", 1) for k in (0, 2, 3, 4)]


def test_contexts_carry_no_sentences(spark):
    """A row per word and sentence holds one vector; clusters get their texts back, also where seq is null or repeated."""
    said = [(1, "cell guard locked bars"), (1, "cell nucleus membrane protein"), (None, "river bank water"), (2, "guard guard cell")]
    df = spark.createDataFrame(said, "seq long, text string").repartition(3)
    rows = wordvec.contexts(df, 64).collect()
    assert len(rows) == 13 and all(len(r["ctx"]) == 64 for r in rows)
    for r in rows:
        assert any(s == r["seq"] and r["word"] in t.split() and (wordvec.unpacked(r["ctx"], 64) == wordvec.vector_of([w for w in t.split() if w != r["word"]], 64)).all() for s, t in said)
    found = wordvec.clusters(df, 64).collect()
    assert {r["example"] for r in found if r["word"] == "river"} == {"river bank water"}
    assert sum(r["n"] for r in found) == 13 and all(r["word"] in r["example"].split() for r in found)
    long = wordvec.contexts(spark.createDataFrame([(0, "one " + "two " * 200)], "seq long, text string"), 64).filter("word = 'one'").first()
    assert (wordvec.unpacked(long["ctx"], 64) == 200 * wordvec.own("two", 64)).all()


def test_senses_beside_clusters_of_nothing(spark):
    """A sentence of one word over and over makes a cluster whose vector is zero, which no sentence is like; rows are answered one by one."""
    said = ["cell cell", "cell guard locked bars", "cell nucleus membrane protein", "echo echo", "bank river water"]
    df = spark.createDataFrame(list(enumerate(said)), "seq long, text string").repartition(3)
    found = wordvec.clusters(df, 64)
    order = {r["example"]: r["sense"] for r in found.filter("word = 'cell'").collect()}
    assert order["cell cell"] == 0 and {order[s] for s in said[1:3]} == {1, 2}
    asked = [(1, "cell", said[1]), (1, "cell", said[2]), (None, "cell", said[2]), (2, "cell", "cell cell cell"), (3, "cell", "the cell"), (4, "cell", None), (5, "echo", "echo guard"), (6, None, "cell guard"), (7, "bank", said[4])]
    want = [(1, order[said[1]]), (1, order[said[2]]), (None, order[said[2]]), (2, 1), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0)]
    got = wordvec.senses(spark.createDataFrame(asked, "key long, word string, text string"), found, 64).collect()
    assert sorted((r["key"] or -1, r["sense"]) for r in got) == sorted((k or -1, s) for k, s in want)


def test_senses_take_each_text_apart_once(spark, tmp_path):
    """Also where a turn has no words, and once for the clusters."""
    rows = [(0, i, t) for i, t in enumerate(["cell guard locked", "the", None, "", "river bank"])]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = queries.queries()["wordvec_senses"](spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(text") == 2
    assert sorted((r["key"], r["word"], r["sense"]) for r in df.collect()) == [(0, "cell", 0), (4, "river", 0)]
