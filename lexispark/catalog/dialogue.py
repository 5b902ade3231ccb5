"""Dialogue, act, run and span queries over `conversations` and `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.catalog.registry import query, table
from lexispark.catalog.sqlparts import numbered, sentences_sql, trim_sql, words_sql
from lexispark.catalog.textual import ROUTE_SQL, dictionary
from lexispark.functions import text as tx
from lexispark.functions.pieces import WORD
from lexispark.operators import dialog as dg, tokens as tk

# Acts of a turn: buckets of the first letters of its words.
_BUCKETS = [("[a-e]", "inform"), ("[f-m]", "request"), ("[n-s]", "select"), ("[t-z]", "thank")]


def bucket(word):
    chain = None
    for letters, name in _BUCKETS:
        test = word.rlike("^" + letters)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise("other")


_BUCKET = "CASE " + " ".join(f"WHEN regexp_matches(w, '^{p}') THEN '{n}'" for p, n in _BUCKETS) + " ELSE 'other' END"
_NAMES = f"list_transform({words_sql('lower(text)')}, lambda w: {_BUCKET})"
ACTS_SQL = f"(SELECT conv_id, turn, text, list_sort(list_distinct(list_transform({_NAMES}, lambda n: upper(n)))) AS acts FROM conversations)"


def turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def acts(spark, sf):
    names = F.transform(tx.words(F.lower("text")), bucket)
    return turns(spark, sf).withColumn("acts", dg.normalize_acts(names))


@query("normalize_acts", f"SELECT conv_id, turn, array_to_string(acts, ' ') AS acts FROM {ACTS_SQL}")
def normalize_acts(spark, sf):
    return acts(spark, sf).select("conv_id", "turn", F.array_join("acts", " ").alias("acts"))


@query(
    "join_turn_acts",
    f"""
    SELECT c.conv_id, c.turn, c.role, array_to_string(a.acts, ' ') AS acts FROM conversations c
    JOIN {ACTS_SQL} a ON a.conv_id = c.conv_id AND a.turn = c.turn ORDER BY c.conv_id, c.turn
    """,
)
def join_turn_acts(spark, sf):
    act_rows = acts(spark, sf).select("conv_id", "turn", F.array_join("acts", " ").alias("acts"))
    return (
        turns(spark, sf)
        .select("conv_id", "turn", "role")
        .join(act_rows, ["conv_id", "turn"])
        .orderBy("conv_id", F.col("turn").cast("int"))
    )


@query(
    "prev_context",
    f"""
    SELECT conv_id, turn, concat_ws(' ',
             array_to_string(lag(acts, 3) OVER w, ' '), array_to_string(lag(acts, 2) OVER w, ' '),
             array_to_string(lag(acts, 1) OVER w, ' ')) AS prev_acts
    FROM {ACTS_SQL} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
    """,
)
def prev_context(spark, sf):
    rows = acts(spark, sf).select("conv_id", "turn", "acts")
    return dg.previous_context(rows, "conv_id", "turn", "acts").select("conv_id", "turn", "prev_acts")


EDGES_SQL = f"""(
  SELECT src, dst, count(*) AS n FROM (
    SELECT src, unnest(acts) AS dst FROM (
      SELECT unnest(before) AS src, acts FROM (
        SELECT acts, lag(acts) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {ACTS_SQL}) WHERE before IS NOT NULL))
  GROUP BY src, dst)"""


def edges(spark, sf):
    return dg.act_graph(acts(spark, sf), "conv_id", "turn", "acts")


@query("act_graph_edges", f"SELECT src, dst, n FROM {EDGES_SQL}")
def act_graph_edges(spark, sf):
    return edges(spark, sf)


@query(
    "act_graph_degrees",
    f"""
    SELECT node, CAST(sum(o) AS BIGINT) AS out_fan, CAST(sum(i) AS BIGINT) AS in_fan FROM (
      SELECT src AS node, 1 AS o, 0 AS i FROM {EDGES_SQL} UNION ALL SELECT dst, 0, 1 FROM {EDGES_SQL}) GROUP BY node
    """,
)
def act_graph_degrees(spark, sf):
    return dg.act_degrees(edges(spark, sf))


@query("act_graph_top_edges", f"SELECT src, dst, n FROM {EDGES_SQL} ORDER BY n DESC, src, dst LIMIT 5")
def act_graph_top_edges(spark, sf):
    return edges(spark, sf).orderBy(F.desc("n"), "src", "dst").limit(5)


@query(
    "merge_runs",
    """
    WITH f AS (
      SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS change
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    ), r AS (
      SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_no FROM f
    )
    SELECT user_id, CAST(run_no AS BIGINT) AS run_no, event_type, min(event_id) AS start, max(event_id) AS "end", count(*) AS n,
           string_agg(trim(props), '|' ORDER BY ts, event_id) AS text
    FROM r GROUP BY user_id, run_no, event_type
    """,
)
def merge_runs(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "props")
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    return dg.merge_runs(events, ["user_id"], ["ts", "event_id"], day, "event_type", "event_id", "event_id", "props")


@query(
    "speaker_text",
    """
    SELECT conv_id, string_agg(trim(text), '|' ORDER BY turn) AS text,
           CASE WHEN contains(string_agg(trim(text), '|' ORDER BY turn), 'tion') THEN 0 ELSE 1 END AS label
    FROM conversations WHERE role = 'assistant' AND trim(text) <> '' GROUP BY conv_id
    """,
)
def speaker_text(spark, sf):
    said = dg.speaker_text(turns(spark, sf), "conv_id", "turn", "role", "assistant", "text")
    return said.withColumn("label", F.when(F.contains("text", F.lit("tion")), 0).otherwise(1))


def _match_sql(pattern: str) -> str:
    """Match rows of turns: match_no (from 1), match, start."""
    return f"""(
      SELECT conv_id, turn, i AS match_no, m AS word,
             sum(length(gap) + length(m)) OVER (PARTITION BY conv_id, turn ORDER BY i) - length(m) AS start
      FROM (SELECT conv_id, turn, unnest(ms) AS m, unnest(gaps) AS gap, unnest(range(1, len(ms) + 1)) AS i
            FROM (SELECT conv_id, turn, ms, string_split_regex(text, '{pattern}')[1:len(ms)] AS gaps
                  FROM (SELECT conv_id, turn, text, regexp_extract_all(text, '{pattern}') AS ms FROM conversations))))"""


@query(
    "merge_spans",
    f"""
    WITH s AS (SELECT conv_id, turn, {ROUTE_SQL} AS label, start, start + length(word) AS stop FROM {_match_sql(WORD)}),
    f AS (SELECT *, CASE WHEN label = lag(label) OVER w AND start - lag(stop) OVER w BETWEEN 0 AND 1 THEN 0 ELSE 1 END AS opens
          FROM s WINDOW w AS (PARTITION BY conv_id, turn ORDER BY start, stop)),
    n AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id, turn ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS span_no FROM f)
    SELECT conv_id, turn, label, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS "end"
    FROM n GROUP BY conv_id, turn, span_no, label
    """,
)
def merge_spans(spark, sf):
    found = tk.match_rows(turns(spark, sf), ["conv_id", "turn"], "text", WORD)
    words = found.withColumnsRenamed({"match": "word", "match_no": "word_no"})
    routed = tk.route_words(words, dictionary(spark, sf), "conv_id")
    spans = routed.select("conv_id", "turn", F.col("language").alias("label"), "start", "end")
    return dg.merge_spans(spans, ["conv_id", "turn"]).drop("span_no")


_PAIR = "[a-z]{5,} [a-z]{5,}"
_TOKEN = dg.TOKEN
_BIO_SQL = f"""(
  SELECT conv_id, turn, list(word ORDER BY match_no) AS tokens, list(label ORDER BY match_no) AS labels FROM (
    SELECT t.conv_id, t.turn, t.match_no, t.word,
           CASE WHEN s.start IS NULL THEN 'O' WHEN t.prev < s.start THEN 'B-PAIR' ELSE 'I-PAIR' END AS label
    FROM (SELECT *, coalesce(lag(start) OVER (PARTITION BY conv_id, turn ORDER BY match_no), -1) AS prev FROM {_match_sql(_TOKEN)}) t
    LEFT JOIN {_match_sql(_PAIR)} s ON s.conv_id = t.conv_id AND s.turn = t.turn
      AND t.start >= s.start AND t.start < s.start + length(s.word))
  GROUP BY conv_id, turn)"""


def bio(spark, sf):
    keys = ["conv_id", "turn"]
    utterances = turns(spark, sf).select(*keys, "text")
    found = tk.match_rows(utterances, keys, "text", _PAIR)
    spans = found.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", F.lit("pair").alias("slot")))).alias("spans")
    )
    return dg.bio_from_spans(utterances.join(spans, keys, "left"), keys, "text", "spans")


@query(
    "bio_from_spans",
    f"SELECT conv_id, turn, array_to_string(tokens, ' ') AS tokens, array_to_string(labels, ' ') AS labels FROM {_BIO_SQL}",
)
def bio_from_spans(spark, sf):
    return bio(spark, sf).select(
        "conv_id", "turn", F.array_join("tokens", " ").alias("tokens"), F.array_join("labels", " ").alias("labels")
    )


@query(
    "spans_from_bio",
    f"""
    WITH r AS (SELECT conv_id, turn, i - 1 AS pos, label FROM {numbered('labels', 'conv_id, turn', _BIO_SQL, 'label')}),
    g AS (SELECT *, sum(CASE WHEN starts_with(label, 'I-') THEN 0 ELSE 1 END)
                      OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM r)
    SELECT conv_id, turn, CAST(min(pos) AS INT) AS start, CAST(max(pos) AS INT) AS "end", substr(arg_min(label, pos), 3) AS type
    FROM g GROUP BY conv_id, turn, run HAVING starts_with(arg_min(label, pos), 'B-')
    """,
)
def spans_from_bio(spark, sf):
    return dg.spans_from_bio(bio(spark, sf), ["conv_id", "turn"])


@query(
    "group_slots",
    f"""
    SELECT conv_id, turn, w[1] AS slot, string_agg(w, ' ' ORDER BY i) AS slot_values
    FROM {numbered(words_sql("replace(lower(text), ':', '')"), 'conv_id, turn', 'conversations', 'w')}
    GROUP BY conv_id, turn, w[1]
    """,
)
def group_slots(spark, sf):
    clean = tx.words(F.replace(F.lower("text"), F.lit(":"), F.lit("")))
    items = F.transform(clean, lambda w: F.concat(F.substring(w, 1, 1), F.lit(":"), w))
    return turns(spark, sf).select("conv_id", "turn", F.explode(dg.group_slots(items)).alias("slot", "v")).select(
        "conv_id", "turn", "slot", F.array_join("v", " ").alias("slot_values")
    )


@query(
    "conversation_entities",
    f"""
    SELECT DISTINCT lower({trim_sql("substr(text, 3, strpos(text, ' the') - 3)")}) AS entity FROM conversations
    WHERE role = 'user' AND starts_with(text, 'Th') AND strpos(text, ' the') > 2
    """,
)
def conversation_entities(spark, sf):
    return dg.between_markers(turns(spark, sf).filter(F.col("role") == "user"), "text", "Th", " the")


@query("distinct_entities", f"SELECT DISTINCT unnest(acts) AS entity FROM {ACTS_SQL}")
def distinct_entities(spark, sf):
    return acts(spark, sf).select(F.explode("acts").alias("entity")).distinct()


@query(
    "majority_vote",
    """
    SELECT user_id, event_type, votes, n_votes FROM (
      SELECT user_id, event_type, count(*) AS votes, CAST(sum(count(*)) OVER (PARTITION BY user_id) AS BIGINT) AS n_votes,
             row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn
      FROM events GROUP BY user_id, event_type) WHERE rn = 1
    """,
)
def majority_vote(spark, sf):
    return dg.majority_vote(table(spark, sf, "events"), "user_id", "event_type")


_MAJORITY = f"""(
  SELECT conv_id, turn, arg_min(name, (-c, name)) AS mood FROM (
    SELECT conv_id, turn, name, count(*) AS c FROM (SELECT conv_id, turn, unnest({_NAMES}) AS name FROM conversations)
    GROUP BY conv_id, turn, name) GROUP BY conv_id, turn)"""


@query(
    "majority_annotation",
    f"""
    WITH m AS (SELECT c.conv_id, c.turn, text, coalesce(mood, 'NA') AS mood FROM conversations c LEFT JOIN {_MAJORITY} USING (conv_id, turn))
    SELECT p.conv_id, c.turn, p.mood AS post_mood, c.mood AS comment_mood, p.text || ' ' || c.text AS text
    FROM m p JOIN m c ON p.conv_id = c.conv_id AND p.turn = 0 AND c.turn > 0
    """,
)
def majority_annotation(spark, sf):
    marks = F.transform(tx.words(F.lower("text")), bucket)
    rated = turns(spark, sf).select("conv_id", "turn", "text", dg.majority(marks).alias("mood"))
    posts = rated.filter("turn = 0").select("conv_id", F.col("mood").alias("post_mood"), F.col("text").alias("post"))
    return (
        rated.filter("turn > 0")
        .join(posts, "conv_id")
        .select("conv_id", "turn", "post_mood", F.col("mood").alias("comment_mood"), F.concat_ws(" ", "post", "text").alias("text"))
    )


_SAFE = "translate(text, chr(39) || chr(34) || chr(92), '')"


@query(
    "explode_premises",
    f"""
    SELECT conv_id, turn, {trim_sql('ss[1]')} AS claim, CAST(i - 1 AS BIGINT) AS pos, premise
    FROM (SELECT conv_id, turn, ss, unnest(ss) AS premise, unnest(range(1, len(ss) + 1)) AS i
          FROM (SELECT conv_id, turn, {sentences_sql(_SAFE)} AS ss FROM conversations))
    """,
)
def explode_premises(spark, sf):
    safe = tx.sentences(F.translate("text", "'\"\\", ""))
    raw = turns(spark, sf).withColumn("ss", safe).select(
        "conv_id",
        "turn",
        F.concat_ws(": ", "role", F.get("ss", F.lit(0))).alias("claim_text"),
        F.concat(F.lit("['"), F.array_join("ss", "', '"), F.lit("']")).alias("premise_texts"),
    )
    return raw.select(
        "conv_id",
        "turn",
        dg.after_colon(F.col("claim_text")).alias("claim"),
        F.posexplode(dg.quoted_list(F.col("premise_texts"))).alias("pos", "premise"),
    ).withColumn("pos", F.col("pos").cast("bigint"))


_KEYWORDS = ["the", "tion", "que", "ung", "Th", "de"]
_CODES = {"en": 0, "fr": 1, "de": 2, "es": 3}


@query(
    "keyword_indicators",
    "SELECT doc_id, "
    + " || ' ' || ".join(f"CASE WHEN contains(text, '{k}') THEN '1' ELSE '0' END" for k in _KEYWORDS)
    + " AS indicators, CASE lang "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _CODES.items())
    + " END AS code FROM documents",
)
def keyword_indicators(spark, sf):
    vector = dg.keyword_vector(F.col("text"), _KEYWORDS).cast("array<string>")
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(vector, " ").alias("indicators"), dg.code_of(F.col("lang"), _CODES).alias("code")
    )
