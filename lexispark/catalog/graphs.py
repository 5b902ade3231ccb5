"""Tree and graph queries.

The tables hold no parsed text, so trees are derived from the sentences of
`documents`: the middle token is the root, every other token hangs on one of
its next neighbours towards the middle, chosen by its own length.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from lexispark.catalog.dialogue import _BIO_SQL, bio
from lexispark.catalog.registry import query, table
from lexispark.catalog.sqlparts import numbered, sentences_sql, words_sql
from lexispark.functions import text as tx
from lexispark.functions.draws import draw_sql
from lexispark.functions.rule_trees import OTHER, TAGS as _TAGS, grow
from lexispark.operators import graph as gr, metrics as mt, tokens as tk, transitions as tr
from lexispark.plans.checkpoints import cut_lineage, stored

KEYS = ["doc_id", "sent_no"]

def trees(spark, sf, reach: int = 3):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = tk.split_sentences(docs).select("doc_id", F.col("sent_no").cast("bigint").alias("sent_no"), "sentence")
    keys = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in KEYS)
    return rows.mapInArrow(
        partial(grow, reach=reach, keys=KEYS), f"{keys}, forms array<string>, upos array<string>, heads array<int>, labels array<string>"
    )


_TAG_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for p, n in _TAGS) + f" ELSE '{OTHER}' END"


def trees_sql(reach: int = 3) -> str:
    rows = numbered(sentences_sql("text"), "doc_id", "documents", "sentence")
    spread = f"least({reach}, 1 + n % 3)"
    return f"""(
      SELECT doc_id, sent_no, forms, list_transform(forms, lambda t: {_TAG_SQL}) AS upos,
        list_transform(forms, lambda t, i: CASE WHEN i = m THEN 0 WHEN i < m THEN i + 1 + length(t) % least({spread}, m - i)
          ELSE i - 1 - length(t) % least({spread}, greatest(i - m, 1)) END) AS heads,
        list_transform(forms, lambda t, i: (CASE WHEN i = m THEN 'root' WHEN i < m THEN 'l' ELSE 'r' END) || CAST(length(t) % 3 AS VARCHAR)) AS labels
      FROM (SELECT *, len(forms) AS n, (len(forms) + 1) // 2 AS m FROM (
        SELECT doc_id, i - 1 AS sent_no, {words_sql('sentence')} AS forms FROM {rows})))"""


_TREES = trees_sql()
_TOKENS = f"""(
  SELECT doc_id, sent_no, i, forms[i] AS form, upos[i] AS upos, heads[i] AS head, labels[i] AS label,
         lower(forms[i]) || ':' || upos[i] AS node, lower(forms[heads[i]]) || ':' || upos[heads[i]] AS head_node
  FROM (SELECT *, unnest(range(1, len(forms) + 1)) AS i FROM {_TREES}))"""
_NODES = f"""(SELECT node, arg_min(form, (doc_id, sent_no, i)) AS first_form, arg_min(label, (doc_id, sent_no, i)) AS first_label, count(*) AS n
              FROM {_TOKENS} GROUP BY node)"""
_EDGES = f"(SELECT DISTINCT head_node AS src, node AS dst, label FROM {_TOKENS} WHERE head > 0)"
_FLAT = f"(SELECT DISTINCT head_node AS src, node AS dst FROM {_TOKENS} WHERE head > 0)"


def nodes(spark, sf):
    return gr.corpus_nodes(trees(spark, sf), KEYS)


def edges(spark, sf):
    return gr.corpus_edges(trees(spark, sf))


@query("dep_graph_nodes", f"SELECT node, first_form, first_label, n FROM {_NODES}")
def dep_graph_nodes(spark, sf):
    return nodes(spark, sf)


@query("dep_graph_edges", f"SELECT src, dst, label FROM {_EDGES}")
def dep_graph_edges(spark, sf):
    return edges(spark, sf)


@query(
    "readable_arcs",
    f"""
    SELECT doc_id, sent_no, string_agg(label || '(' || CASE WHEN head = 0 THEN '0-ROOT' ELSE head || '-' || head_form || ':' || head_upos END
             || ',' || i || '-' || form || ':' || upos || ')', ' ' ORDER BY i) AS arcs
    FROM (SELECT doc_id, sent_no, i, forms[i] AS form, upos[i] AS upos, heads[i] AS head, labels[i] AS label, forms[heads[i]] AS head_form, upos[heads[i]] AS head_upos
          FROM (SELECT *, unnest(range(1, len(forms) + 1)) AS i FROM {_TREES})) GROUP BY doc_id, sent_no
    """,
)
def readable_arcs(spark, sf):
    return gr.readable_arcs(trees(spark, sf), KEYS)


@query("graph_neighbors", f"SELECT DISTINCT dst FROM {_EDGES} WHERE src = 'the:DET'")
def graph_neighbors(spark, sf):
    return gr.neighbors(edges(spark, sf), "the:DET")


@query(
    "indegree_centrality",
    f"""
    SELECT node, round(coalesce(c, 0) / ((SELECT count(*) FROM {_NODES}) - 1), 10) AS centrality
    FROM {_NODES} LEFT JOIN (SELECT dst AS node, count(*) AS c FROM {_FLAT} GROUP BY dst) USING (node)
    """,
)
def indegree_centrality(spark, sf):
    # Read for their number and for their names: stored once.
    ns = cut_lineage(nodes(spark, sf))
    return gr.in_degree(ns, edges(spark, sf), ns.count()).withColumn("centrality", F.round("centrality", 10))


# Rounds that the oracles unroll; both iterations stop long before.
_ROUNDS = 40
_GRAPH_CTES = f"""
    t AS MATERIALIZED (SELECT * FROM {_TOKENS}),
    e AS MATERIALIZED (SELECT DISTINCT head_node AS src, node AS dst FROM t WHERE head > 0),
    d AS MATERIALIZED (SELECT src AS node, count(*) AS o FROM e GROUP BY src),
    v AS MATERIALIZED (SELECT node, coalesce(o, 0) AS o FROM (SELECT DISTINCT node FROM t) LEFT JOIN d USING (node)),
    c AS MATERIALIZED (SELECT count(*) AS n FROM v)"""


def _stopped(steps: list[str], value: str) -> str:
    """The state of the first round that moved less than a millionth per node."""
    moved = " UNION ALL ".join(
        f"SELECT {k} AS k, (SELECT sum(abs(a.x - b.x)) FROM r{k} a JOIN r{k - 1} b USING (node)) AS moved"
        for k in range(1, _ROUNDS + 1)
    )
    states = " UNION ALL ".join(f"SELECT {k} AS k, node, x FROM r{k}" for k in range(1, _ROUNDS + 1))
    return f"""
      WITH {_GRAPH_CTES}, {', '.join(steps)},
      moves AS MATERIALIZED ({moved}), stop AS MATERIALIZED (SELECT min(k) AS k FROM moves, c WHERE moved < n * 1e-6)
      SELECT node, {value} FROM ({states}), c WHERE k = (SELECT k FROM stop)"""


def _pagerank_sql() -> str:
    steps = ["r0 AS MATERIALIZED (SELECT node, o, 1.0::DOUBLE / n AS x FROM v, c)"]
    for k in range(1, _ROUNDS + 1):
        steps.append(
            f"m{k} AS MATERIALIZED (SELECT dst AS node, sum(x / o) AS m FROM e JOIN r{k - 1} ON src = node GROUP BY dst)"
        )
        steps.append(
            f"r{k} AS MATERIALIZED (SELECT node, o, coalesce(m, 0) * 0.85::DOUBLE + (1 - 0.85::DOUBLE * (SELECT sum(m) FROM m{k})) / n AS x FROM r{k - 1} LEFT JOIN m{k} USING (node), c)"
        )
    return _stopped(steps, "round(x * n, 6) AS rank")


@query("pagerank", _pagerank_sql())
def pagerank(spark, sf):
    parsed = stored(trees(spark, sf), "trees")
    out = gr.pagerank(gr.corpus_nodes(parsed, KEYS), gr.corpus_edges(parsed), scaled=True)
    return out.select("node", F.round("rank", 6).alias("rank"))


def _eigenvector_sql() -> str:
    steps = ["r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS x FROM v, c)"]
    for k in range(1, _ROUNDS + 1):
        steps.append(
            f"y{k} AS MATERIALIZED (SELECT node, x + coalesce(m, 0) AS y FROM r{k - 1} LEFT JOIN "
            f"(SELECT dst AS node, sum(x) AS m FROM e JOIN r{k - 1} ON src = node GROUP BY dst) USING (node))"
        )
        steps.append(f"r{k} AS MATERIALIZED (SELECT node, y / sqrt((SELECT sum(y * y) FROM y{k})) AS x FROM y{k})")
    return _stopped(steps, "round(x, 8) AS centrality")


@query("eigenvector_centrality", _eigenvector_sql())
def eigenvector_centrality(spark, sf):
    parsed = stored(trees(spark, sf), "trees")
    out = gr.eigenvector_centrality(gr.corpus_nodes(parsed, KEYS), gr.corpus_edges(parsed))
    return out.withColumn("centrality", F.round("centrality", 8))


_IDS = f"(SELECT node, row_number() OVER (ORDER BY md5(node), node) - 1 AS id FROM (SELECT DISTINCT node FROM {_TOKENS}))"


@query(
    "graph_integer_ids",
    f"""
    WITH t AS MATERIALIZED (SELECT * FROM {_TOKENS}),
    e AS MATERIALIZED (SELECT DISTINCT head_node AS src, node AS dst FROM t WHERE head > 0),
    ids AS MATERIALIZED (
      SELECT node, row_number() OVER (ORDER BY md5(node), node) - 1 AS id FROM (SELECT DISTINCT node FROM t))
    SELECT a.id AS src_id, b.id AS dst_id FROM e f JOIN ids a ON a.node = f.src JOIN ids b ON b.node = f.dst
    """,
)
def graph_integer_ids(spark, sf):
    return gr.integer_graph(nodes(spark, sf), edges(spark, sf))


_LABEL_IDS = f"""(SELECT label, row_number() OVER (ORDER BY md5(label), label) - 1 AS label_id
    FROM (SELECT DISTINCT first_label AS label FROM {_NODES}))"""


@query(
    "graph_node_labels",
    f"""SELECT id, label_id, first_label AS label FROM {_NODES} n JOIN {_IDS} i ON i.node = n.node
    JOIN {_LABEL_IDS} l ON l.label = n.first_label""",
)
def graph_node_labels(spark, sf):
    told, labels = gr.integer_labels(cut_lineage(nodes(spark, sf)))
    return told.join(labels, "label_id")


@query(
    "merge_node_features",
    f"""
    SELECT node, CAST(n AS DOUBLE) AS frequency, CAST(coalesce(i, 0) AS DOUBLE) AS in_degree, CAST(coalesce(o, 0) AS DOUBLE) AS out_degree
    FROM {_NODES} LEFT JOIN (SELECT dst AS node, count(*) AS i FROM {_FLAT} GROUP BY dst) USING (node)
    LEFT JOIN (SELECT src AS node, count(*) AS o FROM {_FLAT} GROUP BY src) USING (node)
    """,
)
def merge_node_features(spark, sf):
    flat = gr.collapse(edges(spark, sf))
    return gr.merge_node_features(
        {
            "frequency": nodes(spark, sf).select("node", "n"),
            "in_degree": flat.groupBy("dst").count(),
            "out_degree": flat.groupBy("src").count(),
        }
    )


def _walks_sql(walks: int, steps: int) -> str:
    parts = [
        f"t AS MATERIALIZED (SELECT * FROM {_TOKENS})",
        "e AS MATERIALIZED (SELECT DISTINCT head_node AS src, node AS dst FROM t WHERE head > 0)",
        "ids AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY md5(node), node) - 1 AS id FROM (SELECT DISTINCT node FROM t))",
        "f AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM e f JOIN ids a ON a.node = f.src JOIN ids b ON b.node = f.dst)",
        "deg AS MATERIALIZED (SELECT src, count(*) AS d FROM f GROUP BY src)",
        "h AS MATERIALIZED (SELECT f.src, dst, row_number() OVER (PARTITION BY f.src ORDER BY dst) - 1 AS k, coalesce(g.d, 0) AS nd FROM f LEFT JOIN deg g ON g.src = f.dst)",
        f"w0 AS MATERIALIZED (SELECT src * {walks} + k AS walk_id, src AS node, d FROM deg, range({walks}) AS r(k))",
    ]
    for s in range(1, steps):
        parts.append(
            f"w{s} AS MATERIALIZED (SELECT walk_id, h.dst AS node, h.nd AS d FROM w{s - 1} w JOIN h ON h.src = w.node AND w.d > 0 "
            f"AND h.k = ({draw_sql(3, 'walk_id', str(s))}) % greatest(w.d, 1))"
        )
    union = " UNION ALL ".join(f"SELECT walk_id, {s} AS step, node FROM w{s}" for s in range(steps))
    return f"""
      WITH {', '.join(parts)}
      SELECT walk_id, string_agg(CAST(node AS VARCHAR), ' ' ORDER BY step) AS path FROM ({union}) GROUP BY walk_id"""


@query("random_walks", _walks_sql(10, 20))
def random_walks(spark, sf):
    steps = gr.random_walks(gr.integer_graph(nodes(spark, sf), edges(spark, sf)))
    path = F.sort_array(F.collect_list(F.struct("step", "node")))["node"].cast("array<string>")
    return steps.groupBy("walk_id").agg(F.array_join(path, " ").alias("path"))


@query(
    "head_offsets",
    f"""
    SELECT doc_id, sent_no, array_to_string(list_transform(forms, lambda w: lower(w)), ' ') AS words,
           array_to_string(list_transform(heads, lambda h, i: CASE WHEN h = 0 THEN '0' WHEN abs(h - i) > len(heads) + 1 THEN '1' ELSE CAST(h - i AS VARCHAR) END || ':' || labels[i]), ' ') AS offsets
    FROM {_TREES}
    """,
)
def head_offsets(spark, sf):
    out = gr.head_offsets(trees(spark, sf), KEYS, with_label=True)
    return out.select(*KEYS, F.array_join("words", " ").alias("words"), F.array_join("offsets", " ").alias("offsets"))


@query(
    "split_at_root",
    f"""
    WITH s AS (SELECT *, len(forms) AS n, list_position(heads, 0) AS r FROM {_TREES} WHERE len(forms) + 1 >= 5),
    p AS (SELECT *, 0 AS part, 1 AS a, n AS b FROM s WHERE n + 1 <= 12
          UNION ALL SELECT *, 1, 1, r FROM s WHERE n + 1 > 12 UNION ALL SELECT *, 2, r, n FROM s WHERE n + 1 > 12)
    SELECT doc_id, sent_no, CAST(part AS INT) AS part, array_to_string(forms[a:b], ' ') AS forms, array_to_string(heads[a:b], ' ') AS heads
    FROM p WHERE b - a + 2 <= 12
    """,
)
def split_at_root(spark, sf):
    out = gr.split_at_root(trees(spark, sf), KEYS, max_len=12)
    return out.select(
        *KEYS, "part", F.array_join("forms", " ").alias("forms"), F.array_join(F.col("heads").cast("array<string>"), " ").alias("heads")
    )


@query(
    "projectivity",
    f"""
    WITH a AS MATERIALIZED (SELECT doc_id, sent_no, least(i, head) AS l, greatest(i, head) AS r FROM {_TOKENS}),
    bad AS (SELECT DISTINCT a.doc_id, a.sent_no FROM a JOIN a b ON a.doc_id = b.doc_id AND a.sent_no = b.sent_no AND a.l < b.l AND b.l < a.r AND a.r < b.r)
    SELECT s.doc_id, s.sent_no, CASE WHEN bad.doc_id IS NULL THEN 1 ELSE 0 END AS projective
    FROM (SELECT DISTINCT doc_id, sent_no FROM a) s LEFT JOIN bad ON s.doc_id = bad.doc_id AND s.sent_no = bad.sent_no
    """,
)
def projectivity(spark, sf):
    return trees(spark, sf).select(*KEYS, gr.is_projective(F.col("heads")).cast("int").alias("projective"))


_PRED = trees_sql(1)


@query(
    "attachment_scores",
    f"""
    WITH t AS (SELECT g.upos[i] AS u, g.heads[i] = p.heads[i] AS h, g.heads[i] = p.heads[i] AND g.labels[i] = p.labels[i] AS b
      FROM (SELECT *, unnest(range(1, len(forms) + 1)) AS i FROM {_TREES}) g JOIN {_PRED} p ON g.doc_id = p.doc_id AND g.sent_no = p.sent_no)
    SELECT count(*) AS tokens, round(avg(CAST(h AS INT)), 6) AS uas, round(avg(CAST(b AS INT)), 6) AS las FROM t WHERE u <> 'PUNCT'
    """,
)
def attachment_scores(spark, sf):
    out = gr.attachment_scores(trees(spark, sf), trees(spark, sf, reach=1), KEYS)
    return out.select("tokens", F.round("uas", 6).alias("uas"), F.round("las", 6).alias("las"))


def _joint_sql(source: str) -> str:
    offsets = "list_transform(heads, lambda h, i: 1000000 + h - i)"
    names = "list_transform(labels, lambda x: CAST(ascii(x) * 10 + length(x) AS BIGINT))"
    return f"(SELECT doc_id, sent_no, {offsets} AS o, {names} AS l FROM {source})"


@query(
    "joint_scores",
    f"""
    SELECT count(*) AS tokens, round(avg(CASE WHEN o = po AND l = pl THEN 1 ELSE 0 END), 6) AS joint FROM (
        SELECT unnest(g.o) AS o, unnest(g.l) AS l, unnest(p.o) AS po, unnest(p.l) AS pl
        FROM {_joint_sql(_TREES)} g JOIN {_joint_sql(_PRED)} p ON g.doc_id = p.doc_id AND g.sent_no = p.sent_no)
    """,
)
def joint_scores(spark, sf):
    """Offsets of heads (from 1000000, so that 0 is padding) and labels as numbers, in one sequence a sentence."""
    offsets = F.transform("heads", lambda h, i: F.lit(1000000) + h - (i + 1))
    names = F.transform("labels", lambda x: F.ascii(x) * 10 + F.length(x))
    sequences = lambda reach, name: trees(spark, sf, reach=reach).select(*KEYS, F.concat(offsets, names).alias(name))
    both = sequences(3, "gold").join(sequences(1, "pred"), KEYS)
    return mt.joint_scores(both, "gold", "pred").withColumn("joint", F.round("joint", 6))


@query("transition_contexts")
def transition_contexts(spark, sf):
    return tr.transition_contexts(trees(spark, sf), KEYS, "standard")


@query("transition_contexts_eager")
def transition_contexts_eager(spark, sf):
    return tr.transition_contexts(trees(spark, sf), KEYS, "eager")


@query("transition_counts")
def transition_counts(spark, sf):
    return tr.transition_totals(trees(spark, sf))


@query(
    "span_transitions",
    f"""
    SELECT conv_id, turn, array_to_string(flatten(list_transform(labels, lambda l, i: CASE WHEN l = 'O' THEN ['OUT']
      WHEN starts_with(coalesce(labels[i + 1], 'O'), 'I-') THEN ['SH'] ELSE ['SH', 'RE-' || substr(l, 3)] END)), ' ') AS steps
    FROM {_BIO_SQL}
    """,
)
def span_transitions(spark, sf):
    return bio(spark, sf).select("conv_id", "turn", F.array_join(tr.span_transitions(F.col("labels")), " ").alias("steps"))
