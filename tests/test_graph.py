import random
import time

import pytest
from pyspark.sql import functions as F

from lexispark.operators import graph as gr, metrics as mt, transitions as tr

TREES = [
    (1, ["She", "eats", "fish"], ["PRON", "VERB", "NOUN"], [2, 0, 2], ["nsubj", "root", "obj"]),
    (2, ["Economic", "news", "had", "little", "effect"], ["ADJ", "NOUN", "VERB", "ADJ", "NOUN"], [2, 3, 0, 5, 3], ["amod", "nsubj", "root", "amod", "obj"]),
    (3, ["A", "hearing", "is", "scheduled", "today"], ["DET", "NOUN", "AUX", "VERB", "NOUN"], [2, 4, 2, 0, 1], ["det", "nsubj", "aux", "root", "x"]),
]
SCHEMA = "id int, forms array<string>, upos array<string>, heads array<int>, labels array<string>"


@pytest.fixture(scope="module")
def trees(spark):
    return spark.createDataFrame(TREES, SCHEMA)


def crosses(heads):
    arcs = [(min(h, i), max(h, i)) for i, h in enumerate(heads, 1)]
    return any(a < c < b < d for a, b in arcs for c, d in arcs)


def test_projectivity_against_all_pairs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        n = rng.randint(1, 9)
        order = rng.sample(range(1, n + 1), n)
        heads = [0] * n
        for k, t in enumerate(order[1:], 1):
            heads[t - 1] = rng.choice(order[:k])
        rows.append((i, heads))
    got = spark.createDataFrame(rows, "id int, heads array<int>").select("id", gr.is_projective(F.col("heads")).alias("p")).collect()
    assert {r.id: r.p for r in got} == {i: not crosses(h) for i, h in rows}
    assert {r.p for r in got} == {True, False}


def test_standard_steps(trees):
    steps = tr.transition_contexts(trees, ["id"]).orderBy("id", "step").collect()
    first = [r.transition for r in steps if r.id == 1]
    assert first == ["SH", "LA-nsubj", "SH", "RA-obj", "RA-root", "SH", "STOP"]
    assert [r.previous for r in steps if r.id == 1][:2] == ["NA", "SH"]
    assert steps[0].features.startswith("ts0:ROOT tq0:PRON ts1:None tq1:VERB")


@pytest.mark.parametrize("eager", [False, True])
def test_projective_trees_are_recovered(eager):
    for _, forms, _, heads, _ in TREES[:2]:
        flat = tr.replay(heads, eager)
        steps = [flat[k : k + tr.WIDTH] for k in range(0, len(flat), tr.WIDTH)]
        arcs = {(s[3], s[1]) if s[0] == tr.LEFT else (s[1], s[3]) for s in steps if s[0] in (tr.LEFT, tr.RIGHT)}
        assert arcs == {(h, i) for i, h in enumerate(heads, 1)}


def test_non_projective_tree_is_not_fully_recovered():
    flat = tr.replay(TREES[2][3], False)
    actions = flat[:: tr.WIDTH]
    assert sum(a in (tr.LEFT, tr.RIGHT) for a in actions) < 5


def test_counts_equal_contexts(trees):
    for system in ("standard", "eager"):
        a = tr.transition_totals(trees, system).collect()
        b = tr.transition_counts(tr.transition_contexts(trees, ["id"], system)).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_span_steps(spark):
    df = spark.createDataFrame([(["B-PER", "I-PER", "O", "B-LOC"],)], "l array<string>")
    assert df.select(tr.span_transitions(F.col("l")).alias("s")).first().s == ["SH", "SH", "RE-PER", "OUT", "SH", "RE-LOC"]


def test_offsets_split_and_scores(trees):
    offsets = {r.id: r.offsets for r in gr.head_offsets(trees, ["id"]).collect()}
    assert offsets[1] == ["1", "0", "-1"]
    parts = gr.split_at_root(trees, ["id"], max_len=5).orderBy("id", "part").collect()
    assert [(r.id, r.part, r.forms[0], r.forms[-1]) for r in parts if r.id == 2] == [(2, 1, "Economic", "had"), (2, 2, "had", "effect")]
    perfect = gr.attachment_scores(trees, trees, ["id"]).first()
    assert (perfect.uas, perfect.las, perfect.tokens) == (1.0, 1.0, 13)


def test_centrality(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("a", "b", "y"), ("b", "c", "x"), ("c", "a", "x"), ("d", "a", "x")], "src string, dst string, label string")
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "node string")
    got = {r.node: r["rank"] for r in gr.pagerank(nodes, edges, iterations=60, tolerance=1e-10).collect()}
    out = {"a": ["b"], "b": ["c"], "c": ["a"], "d": ["a"], "e": []}
    want = dict.fromkeys("abcde", 0.2)
    for _ in range(60):
        hanging = sum(want[n] for n in out if not out[n])
        want = {n: 0.15 / 5 + 0.85 * (hanging / 5 + sum(want[m] / len(out[m]) for m in out if n in out[m])) for n in want}
    assert got == pytest.approx(want, abs=1e-8) and sum(got.values()) == pytest.approx(1)
    eig = {r.node: r.centrality for r in gr.eigenvector_centrality(nodes, edges, 200, 1e-9).collect()}
    assert sum(v * v for v in eig.values()) == pytest.approx(1) and eig["a"] > eig["d"]


def test_walks_follow_edges(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (2, 3)], "src_id bigint, dst_id bigint")
    rows = gr.random_walks(edges, walks=4, steps=6).orderBy("walk_id", "step").collect()
    assert len({r.walk_id for r in rows}) == 12
    allowed = {(0, 1), (0, 2), (1, 0), (2, 3)}
    for a, b in zip(rows, rows[1:]):
        if a.walk_id == b.walk_id:
            assert b.step == a.step + 1 and (a.node, b.node) in allowed


def test_chunk_scores_and_auc(spark):
    g = spark.createDataFrame([(1, 0, 1, "A"), (1, 3, 3, "B"), (2, 0, 0, "A")], "s int, start int, end int, type string")
    p = spark.createDataFrame([(1, 0, 1, "A"), (1, 3, 4, "B")], "s int, start int, end int, type string")
    got = {r.type: (r.precision, r.recall, round(r.f, 4)) for r in mt.chunk_scores(g, p, ["s"]).collect()}
    assert got == {"A": (1.0, 0.5, 0.6667), "B": (0.0, 0.0, 0.0), "ALL": (0.5, 1 / 3, 0.4)}
    rng = random.Random(5)
    rows = [(rng.randint(0, 20), rng.randint(0, 1)) for _ in range(200)]
    won = [1 if a > b else 0.5 if a == b else 0 for a, x in rows for b, y in rows if x == 1 and y == 0]
    df = spark.createDataFrame(rows, "score int, label int")
    assert mt.auc(df, "score", "label", F.floor(F.col("score") / 3)).first().auc == pytest.approx(sum(won) / len(won))


def test_rounds_leave_the_edges_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(gr, "PIECE_EDGES", 10)
    pairs = {("hub", f"n{i}") for i in range(60)} | {(f"n{i}", f"n{(i * 7 + 1) % 60}") for i in range(0, 60, 2)}
    ns = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "node string")
    es = spark.createDataFrame([(a, b, "l") for a, b in sorted(pairs)], "src string, dst string, label string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rounds = gr._Rounds(ns, es)
        state = rounds.state.withColumn("rank", F.lit(1.0))
        got = rounds.received(state, F.col("rank") / F.col("out"), ["rank"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        # The messages and their sums move, the edges do not.
        assert plan.count("Exchange hashpartitioning") == 2 and "Bucketed: true" in plan
        assert rounds.state.agg(F.max("pieces")).first()[0] == 6
        rounds.close(state)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    nodes_of = sorted({x for p in pairs for x in p})
    rank, out = dict.fromkeys(nodes_of, 1 / len(nodes_of)), {a: sum(x == a for x, _ in pairs) for a in nodes_of}
    for _ in range(100):
        m = dict.fromkeys(nodes_of, 0.0)
        for a, b in pairs:
            m[b] += rank[a] / out[a]
        even = (1 - 0.85 * sum(m.values())) / len(m)
        fresh = {x: 0.85 * m[x] + even for x in m}
        moved = sum(abs(fresh[x] - rank[x]) for x in m)
        rank = fresh
        if moved < len(m) * 1e-6:
            break
    found = {r.node: r["rank"] for r in gr.pagerank(ns, es).collect()}
    assert found.keys() == rank.keys() and all(abs(found[x] - rank[x]) < 1e-12 for x in rank)
    assert gr.pagerank(ns.limit(0), es.limit(0)).count() == 0 and gr.eigenvector_centrality(ns.limit(0), es.limit(0)).count() == 0


def test_walks_read_their_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(edge):
        read.add(1)
        return edge

    pairs = [(i, (i * 7 + k) % 20) for i in range(20) for k in range(3)]
    edges = spark.createDataFrame(spark.sparkContext.parallelize(pairs, 2).map(counted), "src_id long, dst_id long")
    assert gr.random_walks(edges, walks=2, steps=3).count() == 20 * 2 * 3
    assert read.value == len(pairs)


def test_indegree_reads_the_documents_once_after_its_nodes(spark):
    from lexispark.catalog import QUERIES

    plan = QUERIES["indegree_centrality"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_tokens_and_steps_are_compiled(spark, trees):
    """Values of a token are read after its sentence is exploded; a lambda over the arrays would be interpreted."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    named = trees.withColumnRenamed("id", "sent")
    assert "lambda" not in plan(gr.corpus_edges(named))
    assert "arrays_zip" not in plan(gr.corpus_nodes(named, ["sent"]))
    contexts = plan(tr.transition_contexts(trees, ["id"]))
    assert "namedlambdavariable" not in contexts.split("Generate explode")[0]


def test_tags_equal_their_patterns(spark, monkeypatch):
    from lexispark.catalog import graphs

    words = ["ung", "ion", "tion", "xment", "ción.", "Nation", "a", "abc", "abcd", "é", "été", " ", "a\u0085", "abc ", "5th", "...", "{a", "Éa", "motion,"]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")
    monkeypatch.setattr(graphs, "table", lambda *a: docs)
    for row in graphs.trees(spark, "").collect():
        frame = spark.createDataFrame([(w,) for w in row.forms], "w string")
        chain = None
        for pattern, name in graphs._TAGS:
            hit = F.col("w").rlike(pattern)
            chain = F.when(hit, name) if chain is None else chain.when(hit, name)
        want = {r.w: r.t for r in frame.select("w", chain.otherwise("VERB").alias("t")).collect()}
        assert row.upos == [want[w] for w in row.forms]


def test_rule_trees_of_a_batch(spark):
    """Trees are grown a batch at a time (a plan test) and equal the rule, token by token."""
    import re

    from lexispark.functions.rule_trees import grow
    import pyarrow as pa

    texts = ["Station élan 12 ... the ab   Ünion", "x", "a b  c\td e f g nation, Größe", ""]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "sentence": texts})
    rows = next(grow(iter([batch]), 3, ["id"])).to_pylist()
    for text, r in zip(texts, rows, strict=True):
        forms = re.findall(r"[^ \t\n\x0b\f\r]+", text)
        n, m = len(forms), (len(forms) + 1) // 2
        spread = min(3, 1 + n % 3)
        assert r["forms"] == forms
        for i, form in enumerate(forms, 1):
            k = len(form)
            head = 0 if i == m else i + 1 + k % min(spread, m - i) if i < m else i - 1 - k % min(spread, i - m)
            assert (r["heads"][i - 1], r["labels"][i - 1]) == (head, ("root" if i == m else "l" if i < m else "r") + str(k % 3))
    assert rows[0]["upos"] == ["PROPN", "VERB", "NUM", "PUNCT", "DET", "DET", "PUNCT", "PROPN"]
    assert rows[2]["upos"][-2:] == ["NOUN", "PROPN"]


def test_arcs_and_crossings_are_found_a_batch_at_a_time(spark, trees):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    arcs = gr.readable_arcs(trees, ["id"])
    assert "MapInArrow" in plan(arcs)
    assert {r.id: r.arcs for r in arcs.collect()}[1] == "nsubj(2-eats:VERB,1-She:PRON) root(0-ROOT,2-eats:VERB) obj(2-eats:VERB,3-fish:NOUN)"
    heads = spark.createDataFrame([(0, [2, 0, 2]), (1, None), (2, []), (3, [3, 4, 0, 3]), (4, [9, 0, 1])], "id int, heads array<int>")
    got = heads.select("id", gr.is_projective(F.col("heads")).alias("p"))
    assert "ArrowEvalPython" in plan(got)
    assert {r.id: r.p for r in got.collect()} == {0: True, 1: None, 2: True, 3: False, 4: False}


def test_rounds_leave_no_shuffle_files_and_one_state(spark, tmp_path, monkeypatch):
    """The edges by name, the states before the last one, and what was shuffled for what is stored are gone."""
    from lexispark.plans import checkpoints

    monkeypatch.setattr(checkpoints, "shared_dir", lambda _: str(tmp_path))
    pairs = [(f"n{i}", f"n{(i * 7 + k) % 50}") for i in range(50) for k in range(1, 4)]
    ns = spark.createDataFrame([(f"n{i}",) for i in range(50)], "node string")
    es = spark.createDataFrame([(a, b, "l") for a, b in pairs], "src string, dst string, label string")
    rounds = gr._Rounds(ns, es)
    state = rounds.state.withColumn("x", F.lit(1.0))
    for _ in range(3):
        got = rounds.received(state, F.col("x"), ["x"])
        state, told = rounds.keep(got.select("id", "out", "pieces", F.col("m").alias("x")), F.sum("x").alias("total"))
    names = [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()]
    assert names.count("graph-round") == 1 and "graph-src" not in names and "graph-collapsed" not in names
    assert told["total"] == state.agg(F.sum("x")).first()[0] > 50
    rounds.close(state)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if f.getName().startswith("shuffle_")}
    kept = files()
    checkpoints.write_scratch(spark.range(100).repartition(3, "id"), "x")
    deadline = time.time() + 20  # Spark removes them in the background
    while files() - kept and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - kept
