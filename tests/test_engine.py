"""The parts that SQL cannot check, and edges: parser errors, caps, cycles, clusters and senses against plain loops, files, streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import languages, schema
from lattica.functions import encoders, intervals, text, vectors
from lattica.operators import decisions, extraction, graph, inference, memory, solver, wordvec
from lattica.plans import answer, patterns, questions, rounds
from lattica.sources import rdf, state, triples
from lattica.store import Store
from lattica.streaming import ingest

TRIPLE = "subject string, relation string, object string"


def facts(spark, rows):
    return spark.createDataFrame(rows, TRIPLE)


@pytest.fixture(scope="module")
def geo(spark):
    return facts(spark, [("paris", "capital_of", "france"), ("france", "in", "eu"), ("eu", "part_of", "europe"), ("berlin", "capital_of", "germany"), ("germany", "in", "eu")])


@pytest.mark.parametrize("bad", [
    "SELECT ?x { ?x in }", "SELECT { ?x in ?y }", "SELECT ?x WHERE { ?x in ?y", "SELECT ?x { ?x in ?y } nonsense", "DELETE { ?x in ?y }", "SELECT ?x { ?x in ?y . FILTER(NOSUCH(?x)) }",
    "SELECT ?x { ?x in ?y . FILTER(STRSTARTS(?x)) }", "SELECT ?x { ?x in ?y } LIMIT many", "ASK { ?x in ?y . OPTIONAL ?z }", "SELECT ?x { ?x in ?y ¤ }", "",
])
def test_unreadable_queries_are_errors(geo, bad):
    with pytest.raises(SyntaxError):
        patterns.run(geo, bad)


def names(df):
    return sorted(tuple(r) for r in df.collect())


def test_sparql_of_the_geography(geo):
    run = lambda q: names(patterns.run(geo, q))
    assert run("SELECT ?x WHERE { ?x in eu }") == [("france",), ("germany",)]
    assert run("ASK { paris capital_of/in eu }") == [(True,)] and run("ASK { paris in eu }") == [(False,)]
    assert run("PREFIX r: <http://example.org/kg/relation/> SELECT ?x { ?x r:capital_of ?y ; a ?t }") == []
    assert run("SELECT ?c ?e { ?c capital_of ?k . ?k in ?u . ?u part_of ?e . FILTER(?c = <http://example.org/kg/entity/paris>) }") == [("paris", "europe")]
    assert run("SELECT ?a ?b { ?a in ?u . ?b in ?u . FILTER(?a < ?b) }") == [("france", "germany")]
    assert run("SELECT ?x { { ?x in eu } UNION { ?x part_of ?y } UNION { ?x capital_of germany } }") == [("berlin",), ("eu",), ("france",), ("germany",)]
    assert run("SELECT ?x (IF(BOUND(?y), 'yes', 'no') AS ?t) { ?x in eu OPTIONAL { ?y capital_of ?x . FILTER(STRLEN(?y) > 5) } }") == [("france", "no"), ("germany", "yes")]
    assert run("SELECT (COUNT(*) AS ?n) (GROUP_CONCAT(?x; SEPARATOR='|') AS ?all) { ?x in eu }") == [(2, "france|germany")]
    assert run("SELECT ?x { ?x in|part_of ?y . FILTER(?y NOT IN (europe)) }") == [("france",), ("germany",)]
    assert run("SELECT ?x { ?x ^in eu }") == [] and run("SELECT ?x { eu ^in ?x }") == [("france",), ("germany",)]
    with pytest.raises(ValueError, match="GRAPH"):
        patterns.run(geo, "SELECT ?s { GRAPH user { ?s ?p ?o } }")


def test_a_subject_with_many_objects(spark):
    hot = facts(spark, [("a", "has", f"o{i}") for i in range(3000)])
    own = schema.properties(spark, [("has", "functional")])
    assert answer.query(hot, "a", "has", "o2999", properties=own).first()["method"] == "direct"
    assert answer.query(hot, "a", "has", "none", properties=own).first()["method"] == "contradiction"


def test_rules_run_to_the_end(spark):
    n = 60
    rows = [(f"n{i}", f"k{i}", f"n{i + 1}") for i in range(n)]
    rules = spark.createDataFrame([(f"s{i}" if i else "k0", f"k{i + 1}", f"s{i + 1}") for i in range(n - 1)], "rel1 string, rel2 string, target string")
    none = spark.createDataFrame([], "relation string, property string")
    got = inference.derive_all(facts(spark, rows), rules, none)
    assert got.filter(f"relation = 's{n - 1}'").select("subject", "object").collect() == [("n0", f"n{n}")]
    with pytest.raises(RuntimeError, match="fixpoint"):
        inference.derive_all(facts(spark, rows), rules, none, max_rounds=3)


def test_cycles_give_no_loops_unless_asked(spark):
    ring = facts(spark, [("a", "in", "b"), ("b", "in", "a")])
    got = inference.derive_all(ring, schema.rules(spark), schema.properties(spark))
    assert names(got.select("subject", "object")) == [("a", "b"), ("b", "a")]
    assert graph.closure(ring).count() == 4 and graph.closure(ring, reflexive=False).count() == 2
    assert names(graph.reachable(ring, "a")) == [("a",), ("b",)]
    assert graph.paths(ring, "a", "a").count() == 0


def test_derive_all_against_a_loop(spark):
    rng = random.Random(5)
    rels = ["in", "part_of", "capital_of", "before"]
    rows = sorted({(f"n{rng.randrange(12)}", rng.choice(rels), f"n{rng.randrange(12)}") for _ in range(30)})
    table = {(r["rel1"], r["rel2"]): r["target"] for r in schema.rules(spark).collect()}
    known = set(rows)
    while True:
        more = {(a, table[r, q], d) for a, r, b in known for c, q, d in known if b == c and a != d and (r, q) in table} - known
        moving = {(a, r, d) for a, r, b in known for c, q, d in known if r == q and b == c and a != d and r in schema.TRANSITIVE} - known
        if not more | moving:
            break
        known |= more | moving
    got = inference.derive_all(facts(spark, rows), schema.rules(spark), schema.properties(spark))
    assert {tuple(r) for r in got.select("subject", "relation", "object").collect() if r[0] != r[2]} == {k for k in known if k[0] != k[2]}


def test_scratch_tables_go(spark):
    import os

    with rounds.scratch() as s:
        gone, kept = rounds.cut(spark.range(3), "gone"), s.keep(rounds.cut(spark.range(4), "kept"))
        assert gone.count() == 3
    assert not os.path.exists(gone._cut_path) and kept.count() == 4
    rounds.discard(kept)
    assert not os.path.exists(kept._cut_path)


def plain_clusters(sentences, word, dim):
    state_ = []
    unit = lambda v: v / (np.linalg.norm(v) + 1e-10)
    for ws, said in sentences:
        if word not in ws or len(ws) < 2:
            continue
        v = wordvec.vector_of([w for w in ws if w != word], dim)
        sims = [unit(v) @ unit(c) for c, _, _ in state_]
        if sims and max(sims) >= 0.15:
            i = int(np.argmax(sims))
            c, n, e = state_[i]
            state_[i] = ((c * n + v) / (n + 1), n + 1, e)
        else:
            state_.append((v, 1, said))
    return state_


def test_clusters_and_senses_against_a_loop(spark):
    rng = random.Random(3)
    topics = [["prison", "guard", "locked", "inmate", "bars"], ["membrane", "nucleus", "organism", "protein", "tissue"]]
    said = [" ".join(["cell", *rng.sample(topics[i % 2], 4)]) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(said)), "seq long, text string").repartition(4)
    found = wordvec.clusters(df, 64, merge=2.0)
    got = sorted((r["sense"], r["n"], r["example"]) for r in found.filter("word = 'cell'").collect())
    want = plain_clusters([(t.split(), t) for t in said], "cell", 64)
    assert got == [(i, n, e) for i, (_, n, e) in enumerate(want)]
    asked = spark.createDataFrame([(0, "cell", "the cell where a guard locked bars"), (1, "cell", "a cell nucleus and membrane"), (2, "nothing", "nothing here")], "key int, word string, text string")
    sense = {r["key"]: r["sense"] for r in wordvec.senses(asked, found, 64).collect()}
    vec = [c for c, _, _ in want]
    for k, ws in ((0, ["guard", "locked", "bars"]), (1, ["nucleus", "membrane"])):
        near = [float(wordvec.vector_of([*ws, *(["where"] if k == 0 else [])], 64) @ c / np.linalg.norm(c)) for c in vec]
        assert sense[k] == int(np.argmax(near))
    assert sense[2] == 0
    alike = wordvec.clusters(spark.createDataFrame([(i, "cell guard locked bars") for i in range(5)], "seq long, text string"), 64)
    assert {r["n"] for r in alike.collect()} == {5}


def test_own_vectors_agree_in_both_languages(spark):
    for dim in (8, 64, 100):
        row = spark.createDataFrame([("größe",)], "n string").select(vectors.named(F.col("n"), dim).alias("v")).first()["v"]
        assert row == wordvec.own("größe", dim).tolist()


def test_lesk_edges(spark):
    g = wordvec.glosses(spark.createDataFrame([("cell", 0, "prison guard door"), ("cell", 1, "organism membrane"), ("bank", 0, "river")], "entity string, sense int, text string"))
    rows = [(0, "cell", "the guard at the door"), (1, "Cell", "organisms"), (2, "cell", "unrelated words only"), (3, "bank", "money"), (4, "cell", "is the"), (5, "unknown", "guard")]
    got = {r["key"]: r["sense"] for r in wordvec.resolve(spark.createDataFrame(rows, "key int, entity string, text string"), g).collect()}
    assert got == {0: 0, 1: 1, 2: -1, 3: 0, 4: 0, 5: 0}
    told = spark.createDataFrame([(0, "cell", "it is here", "membrane")], "key int, entity string, text string, obj string")
    assert wordvec.resolve(told, g).first()["sense"] == 1
    near = [f"{w} alpha beta gamma delta epsilon" for w in ("membrane", "tissue")] * 4 + ["prison guard door lock key iron"] * 4
    model = wordvec.train(spark.createDataFrame(list(enumerate(near)), "seq int, text string"), 256)
    assert wordvec.resolve(spark.createDataFrame([(0, "cell", "tissue")], "key int, entity string, text string"), g, model, 256).first()["sense"] == 1


def test_memory_blocks_order_and_large_beta(spark):
    rng = np.random.default_rng(1)
    keys = rng.choice([-1, 1], (40, 32))
    store = memory.stored(spark.createDataFrame([], memory.PATTERN), spark.createDataFrame([(i, k.tolist(), k.tolist(), "d") for i, k in enumerate(keys)], "seq long, key array<int>, value array<int>, domain string"))
    asked = spark.createDataFrame([(i, keys[i].tolist()) for i in range(0, 40, 3)], "id long, vec array<int>")
    for options in ({}, {"max_queries": 3}, {"beta": 1e6}, {"damped": False, "beta": 50.0}):
        got = memory.retrieve(asked, store, 2, min_similarity=-1.0, **options).collect()
        assert len(got) == 28
        for r in got:
            assert 0 <= r["weight"] <= 1 and not np.isnan(r["weight"])
        assert all(max((x for x in got if x["id"] == i), key=lambda x: x["weight"])["idx"] == i for i in range(0, 40, 3))
    assert memory.retrieve(asked, store.limit(0), 2).count() == 0 and memory.retrieve(asked.limit(0), store, 2).count() == 0
    moved = memory.refine(spark.createDataFrame([(1, (-keys[1]).tolist())], "id long, vec array<int>"), store.filter("idx = 1"), min_similarity=0.5)
    assert moved.first()["idx"] is None


def test_reservoir_and_encoders(spark):
    one = spark.createDataFrame([([1, 0, 1, 1],), ([],)], "b array<int>")
    a, b = [r[0] for r in one.select(vectors.reservoir(F.col("b"), 64, 8)).collect()]
    assert set(a) <= {1, -1} and len(a) == len(b) == 64 and a != b
    bits = [random.Random(1).randrange(2) for _ in range(64)]
    now = bits
    for _ in range(5):
        now = [now[i - 1] ^ now[(i + 1) % 64] for i in range(64)]
    assert spark.createDataFrame([(bits,)], "b array<int>").select(vectors.rule90(F.col("b"), 5)).first()[0] == now
    html = spark.createDataFrame([("<FORM><input type='email' required><button>x</button></form><script>var a;</script><p>Hi [1] there</p>",)], "h string")
    got = html.select(encoders.page_features(F.col("h")).alias("f"), encoders.page_text(F.col("h")).alias("t")).first()
    assert got["t"] == "x Hi there" and got["f"]["has_form"] == 1 and got["f"]["input_email"] == pytest.approx(0.2) and "has_captcha" not in got["f"]
    with pytest.raises(Exception, match="no such kind"):
        decisions.perceived(spark.createDataFrame([(1, "smell", "x")], "key int, kind string, content string"), 16).collect()
    with pytest.raises(Exception, match="no such outcome"):
        decisions.learned(spark.createDataFrame([], memory.PATTERN), spark.createDataFrame([(0, [1], [1], "d", "great")], "seq long, key array<int>, value array<int>, domain string, outcome string")).collect()


def test_questions_about_geography(spark, geo):
    all_ = geo.unionByName(facts(spark, [("einstein", "born_in", "ulm"), ("ulm", "in", "germany"), ("guido van rossum", "born_in", "haarlem"), ("haarlem", "in", "netherlands")]))
    rows = [
        (1, "Is Paris the capital of France?"), (2, "What is the capital of France"), (3, "Where is ulm?"), (4, "Is ulm in eu?"), (5, "What connects paris and eu?"), (6, "Are paris and berlin the same?"),
        (7, "Where was guido van rossum born_in?"), (8, "no names at all?"), (9, ""), (10, None), (11, "Paris won the match"),
    ]
    got = {r["key"]: (r["answer"], round(r["confidence"], 3), r["method"]) for r in questions.answers(spark.createDataFrame(rows, "key int, text string"), all_).collect()}
    assert got[1] == ("YES. paris capital_of france (direct)", 0.95, "sparql_direct")
    assert got[2] == ("Direct fact: (paris, capital_of, france)", round(0.95 * 0.85, 3), "direct_sim")
    assert got[3][2].startswith("open_query") and "ulm" in got[3][0]
    assert got[4] == ("YES. ulm → ... → eu via in+", 0.85, "sparql_transitive")
    assert got[5] == ("paris --capital_of--> france --in--> eu", 0.8, "sparql_2hop")
    assert got[6] == ("paris is not the same as berlin", 0.9, "same")
    assert got[7] == ("born_in(guido van rossum) → haarlem", 0.85, "direct")
    assert all(got[k] == (None, 0.0, "unknown") for k in (8, 9, 10, 11))


def test_text_to_facts(spark):
    def said(t):
        return [tuple(x) for x in spark.createDataFrame([(t,)], "t string").select(text.statements(F.col("t"))).first()[0]]

    assert said("Seoul is the capital of South Korea") == [("seoul", "capital_of", "south korea")]
    assert said("austria is in europe on danube") == [("austria", "in", "europe")]
    assert said("a is within b") == [("a", "inside", "b")] and said("a is inside b") == [("a", "inside", "b")]
    assert said("x is part of y") == [("x", "part_of", "y")] * 2
    assert said("dogs are enemy_of cats") == [("dogs", "enemy_of", "cats")] and said("nothing here") == []
    rows = spark.createDataFrame([(1, "Paris is the capital of France. Paris is the capital of France. Rome is in Italy, and Oslo is in Norway."), (2, None), (3, "")], "key int, text string")
    assert names(extraction.facts_of(rows)) == [(1, 0, "paris", "capital_of", "france"), (1, 2, "oslo", "in", "norway"), (1, 2, "rome", "in", "italy")]
    parts = spark.createDataFrame([("so, you know, find the cat and feed the dog, but stay; cats and dogs",)], "t string").select(text.sentences(F.col("t"))).first()[0]
    assert parts[-1] == "cats and dogs" and "feed the dog" in parts
    assert names(extraction.orderings(rows)) == []
    warned = languages.get("en")
    with pytest.warns(UserWarning, match="no language"):
        assert languages.get("zz") is warned


def test_solver_is_checked_and_formats(spark):
    with pytest.raises(ValueError, match="no constraint"):
        solver.satisfy(spark, {"a": range(2)}, [{"type": "odd", "subjects": ["a"]}])
    with pytest.raises(ValueError, match="cells"):
        solver.solve(spark, {f"v{i}": range(1000) for i in range(4)}, [])
    row = solver.satisfy(spark, {"a": range(3), "b": range(3)}, [{"type": "ordered", "subjects": ["a", "b"]}], 1).first()
    assert solver.formatted(row, {"a": 0, "b": 0}, [{"type": "ordered"}])["formatted"] == "  a: 0\n  b: 1"
    assert solver.budget(100, {"a": 10, "b": 20, "c": 60}) == {"a": 20, "b": 20, "c": 60}
    assert solver.schedule(spark, ["x", "y"], 1, 2).count() == 2


def test_turtle_and_names(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('@prefix k: <http://example.org/kg/entity/> . # c\n@prefix r: <http://example.org/kg/relation/> .\nk:paris a k:city ; r:capital%5Fof k:france , k:gaul .\nk:rome r:says "a \\"b\\" c"@en .\n')
    got = names(rdf.read_turtle(spark, str(tmp_path / "a.ttl")))
    assert got == [("paris", "capital_of", "france"), ("paris", "capital_of", "gaul"), ("paris", "is_a", "city"), ("rome", "says", 'a "b" c')]
    for bad in ("k:a k:b k:c .", "<a> <b> .", "<a> <b> [ ] ."):
        with pytest.raises(SyntaxError):
            list(rdf.Turtle(bad).triples())
    odd = ["a b", "a_b", "ü/:@", "50% + 1", "x*y", "日本"]
    df = spark.createDataFrame([(x,) for x in odd], "n string")
    back = df.select(triples.uri("n").alias("u"), "n").select("u", "n", triples.from_uri("u").alias("b")).collect()
    assert [r["b"] for r in back] == [r["n"] for r in back] and len({r["u"] for r in back}) == len(odd)
    assert all(triples.name_of(r["u"]) == r["n"] for r in back)


def test_store_changes(spark, tmp_path):
    s = Store(spark).add_fact(" Paris", "Capital_of", "France ", proof="p1").add_fact("paris", "capital_of", "france", source="bulk", proof="p2", t_start=1900)
    row = s.facts.first()
    assert s.count() == 1 and (row["source"], row["proof"], row["t_start"], row["confidence"]) == ("user", "p1", 1900, 1.0)
    assert len(s.add(facts(spark, [("", "x", "y"), ("a", None, "b")]))) == 1
    assert s.remove(facts(spark, [("PARIS", "capital_of", "france")])).count() == 0 and len(s.clear()) == 0
    s.save(str(tmp_path / "kg"))
    assert Store.load(spark, str(tmp_path / "kg")).facts.first() == row
    assert s.set_property("in", "inverse:holds").inverse_of("in") == "holds" and s.inverse_of("in") is None
    assert s.sql("SELECT count(*) AS n FROM triples WHERE object = ?", ["france"]).first()["n"] == 1


def test_state_edges(spark, tmp_path):
    state.save_vocabulary(state.vocabulary(spark.createDataFrame([("a",)], "name string"), 8), str(tmp_path / "v"))
    with pytest.raises(Exception, match="not 16 places"):
        state.load_vocabulary(spark, str(tmp_path / "v"), 16).collect()
    assert state.load_tables(spark, str(tmp_path), {"none": "a int"})["none"].count() == 0
    with pytest.raises(Exception, match="no interval"):
        spark.createDataFrame([(5, 5)], "a int, b int").select(intervals.checked(F.col("a"), F.col("b"))).collect()


def test_buckets_are_idempotent_and_cleaned(spark, tmp_path):
    b = ingest.Buckets(spark, str(tmp_path / "kg"), spark.createDataFrame([], schema.TRIPLE).schema, 4)
    rows = lambda n: spark.createDataFrame([(f"s{i}", "in", "x", "user", "", 1.0, None, None, n * 100 + i) for i in range(n * 5, n * 5 + 20)], schema.TRIPLE)
    for n in range(4):
        b.merge(rows(n), n)
        b.merge(rows(n), n)
    got = b.latest(3).collect()
    assert sorted(r["subject"] for r in got) == sorted(f"s{i}" for i in range(35))
    assert {r["subject"]: r["seq"] for r in got}["s5"] == 5
    assert len(list((tmp_path / "kg" / "data").iterdir())) < 4


def test_guarded_stream(spark, tmp_path):
    check = ingest.guarded("", str(tmp_path / "types"))
    seq = iter(range(100))
    batch = lambda *rows: spark.createDataFrame([(s, r, o, "user", "", 1.0, None, None, next(seq)) for s, r, o in rows], schema.TRIPLE)
    check(batch(("paris", "capital_of", "france")), 0)
    check(batch(("paris", "is_a", "country"), ("rome", "is_a", "city")), 1)
    check(batch(("rome", "is_a", "place")), 2)
    warned = [spark.read.parquet(str(tmp_path / f"types/warnings/{n}")).count() for n in range(3)]
    assert warned == [0, 1, 0]
