"""Series, vector and metric queries."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from lexispark.catalog.dialogue import _BIO_SQL, bio, turns
from lexispark.catalog.encoding import _TERMS, talk, terms
from lexispark.catalog.registry import query, table
from lexispark.catalog.sqlparts import WSC, numbered, words_sql
from lexispark.functions import text as tx
from lexispark.operators import dialog as dg, metrics as mt, series as sr, similarity, vectors as vc


# ---- series ---------------------------------------------------------------------------------

_DAILY_SQL = """(SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS y
                 FROM orders GROUP BY 1, 2)"""


def daily(spark, sf):
    """Order value per priority and day: five series with gaps."""
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("date"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("y"))
    )


@query(
    "date_features",
    """
    SELECT o_orderkey, CAST(make_date(year(o_orderdate), month(o_orderdate), day(o_orderdate)) AS VARCHAR) AS date,
           year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day_of_month, dayofyear(o_orderdate) AS day_of_year
    FROM orders
    """,
)
def date_features(spark, sf):
    d = F.col("o_orderdate")
    parts = table(spark, sf, "orders").select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d")
    )
    dated = parts.select("o_orderkey", F.make_date("y", "m", "d").alias("date"))
    return sr.date_parts(dated).withColumn("date", F.col("date").cast("string"))


@query(
    "clean_measurements",
    r"""
    SELECT event_id, coalesce(try_cast(regexp_replace(trim(raw), '[*.]+$', '') AS DOUBLE), 0) AS y FROM (
      SELECT event_id, CASE event_type WHEN 'error' THEN CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) || '*' WHEN 'signup' THEN '---' WHEN 'view' THEN ' ' || CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) || '. '
        WHEN 'click' THEN '####' ELSE CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) END AS raw FROM events)
    """,
)
def clean_measurements(spark, sf):
    v = F.col("value").cast("decimal(18,2)").cast("string")
    kind = F.col("event_type")
    raw = (
        F.when(kind == "error", F.concat(v, F.lit("*")))
        .when(kind == "signup", "---")
        .when(kind == "view", F.concat(F.lit(" "), v, F.lit(". ")))
        .when(kind == "click", "####")
        .otherwise(v)
    )
    return table(spark, sf, "events").select("event_id", sr.clean_number(raw).alias("y"))


_FILLED_SQL = f"""(
  SELECT series, CAST(day AS DATE) AS date, y, CASE WHEN CAST(day AS DATE) <> date THEN 1 ELSE 0 END AS filled FROM (
    SELECT *, unnest(generate_series(CAST(date AS TIMESTAMP), CAST(coalesce(lead(date) OVER (PARTITION BY series ORDER BY date) - 1, date) AS TIMESTAMP), INTERVAL 1 DAY)) AS day
    FROM {_DAILY_SQL}))"""


@query("series_gap_fill", f"SELECT series, CAST(date AS VARCHAR) AS date, y, filled FROM {_FILLED_SQL}")
def series_gap_fill(spark, sf):
    return sr.fill_gaps(daily(spark, sf), "series").withColumn("date", F.col("date").cast("string"))


@query(
    "roll_features",
    """
    SELECT series, CAST(date AS VARCHAR) AS date, y, lag(month, 2) OVER w AS month_m2, lag(month, 1) OVER w AS month_m1,
           lag(y, 2) OVER w AS y_m2, lag(y, 1) OVER w AS y_m1, lead(y, 1) OVER w AS y_p1, lead(y, 2) OVER w AS y_p2, lead(y, 3) OVER w AS y_p3
    FROM (SELECT *, CAST(month(date) AS DOUBLE) AS month FROM """
    + _DAILY_SQL
    + ") WINDOW w AS (PARTITION BY series ORDER BY date)",
)
def roll_features(spark, sf):
    rows = daily(spark, sf).withColumn("month", F.month("date").cast("double"))
    out = sr.roll(rows, "series", look_back=3, horizon=3, features=["month"])
    wanted = [c for c in out.columns if c.startswith(("month_", "y_"))]
    return out.select("series", F.col("date").cast("string").alias("date"), "y", *wanted)


@query(
    "extreme_percentile",
    f"""
    SELECT series, CAST(date AS VARCHAR) AS date, round(r, 8) AS pct_rank, CASE WHEN r >= 0.9 THEN 1 ELSE 0 END AS extreme FROM (
      SELECT *, (rank() OVER (PARTITION BY series ORDER BY y) + (count(*) OVER (PARTITION BY series, y) - 1) / 2)
                / count(*) OVER (PARTITION BY series) AS r FROM {_DAILY_SQL})
    """,
)
def extreme_percentile(spark, sf):
    out = sr.extreme_by_rank(daily(spark, sf), "series", "y", bucket=50_000.0)
    return out.select("series", F.col("date").cast("string").alias("date"), F.round("pct_rank", 8).alias("pct_rank"), "extreme")


@query("extreme_threshold", "SELECT event_id, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS extreme FROM events")
def extreme_threshold(spark, sf):
    return table(spark, sf, "events").select("event_id", sr.extreme_by_threshold(F.col("value")).alias("extreme"))


@query(
    "grid_lookup",
    """
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(floor((90 - (user_id % 180 - 90)) / 2.5) AS BIGINT) AS lat_id,
           CAST(floor((user_id * 7 % 360) / 2.5) AS BIGINT) AS lon_id,
           round(sum(CASE WHEN event_type = 'click' THEN value END), 4) AS click,
           round(sum(CASE WHEN event_type = 'view' THEN value END), 4) AS view
    FROM events WHERE hour(ts) IN (0, 2, 5) GROUP BY 1, 2, 3
    """,
)
def grid_lookup(spark, sf):
    u = F.col("user_id")
    lat_id, lon_id = sr.grid_cell(F.pmod(u, F.lit(180)) - 90, F.pmod(u * 7, F.lit(360)))
    long = table(spark, sf, "events").select(
        F.col("ts").cast("date").cast("string").alias("date"),
        F.hour("ts").alias("level"),
        lat_id.alias("lat_id"),
        lon_id.alias("lon_id"),
        F.col("event_type").alias("variable"),
        "value",
    )
    out = sr.grid_variables(long, [0, 2, 5], ["click", "view"])
    return out.select("date", "lat_id", "lon_id", *[F.round(c, 4).alias(c) for c in ("click", "view")])


@query(
    "residue_tokens",
    f"""
    SELECT conv_id, turn, array_to_string(list_transform(range(64 - len(k)), lambda x: 0) || list_transform(k, lambda c: strpos('{sr.RESIDUES}', c)), ' ') AS ids
    FROM (SELECT conv_id, turn, list_filter(string_split(upper(replace(text, 'ß', '')), ''), lambda c: c <> '')[1:64] AS k FROM conversations)
    """,
)
def residue_tokens(spark, sf):
    ids = sr.residue_ids(F.upper(F.replace("text", F.lit("ß"), F.lit(""))), 64).cast("array<string>")
    return turns(spark, sf).select("conv_id", "turn", F.array_join(ids, " ").alias("ids"))


_STATS_SQL = f"(SELECT series, avg(y) AS m, stddev_samp(y) AS s FROM {_DAILY_SQL} WHERE year(date) <= 1999 GROUP BY series)"


@query(
    "standard_scale",
    f"SELECT d.series, CAST(date AS VARCHAR) AS date, round((y - m) / s, 6) AS y_scaled FROM {_DAILY_SQL} d JOIN {_STATS_SQL} t ON d.series = t.series",
)
def standard_scale(spark, sf):
    rows = daily(spark, sf)
    stats = sr.scale_stats(rows.filter(F.year("date") <= 1999), "series", ["y"])
    out = sr.standard_scale(rows, stats, "series", ["y"], with_mean=True)
    return out.select("series", F.col("date").cast("string").alias("date"), F.round("y_scaled", 6).alias("y_scaled"))


@query(
    "unscale_predictions",
    f"""
    SELECT d.series, CAST(date AS VARCHAR) AS date, y, round(((y - m) / s * 0.9) * s + m, 4) AS estimate
    FROM {_DAILY_SQL} d JOIN {_STATS_SQL} t ON d.series = t.series
    """,
)
def unscale_predictions(spark, sf):
    rows = daily(spark, sf)
    stats = sr.scale_stats(rows.filter(F.year("date") <= 1999), "series", ["y"])
    scaled = sr.standard_scale(rows, stats, "series", ["y"], with_mean=True)
    guess = scaled.withColumn("guess", F.col("y_scaled") * 0.9)
    out = sr.unscale(guess, stats, "series", "guess", "y", "estimate")
    return out.select("series", F.col("date").cast("string").alias("date"), "y", F.round("estimate", 4).alias("estimate"))


# ---- vectors --------------------------------------------------------------------------------


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


_V = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


@query(
    "normalize_vectors",
    f"""
    SELECT vec_id, array_to_string(list_transform(v, lambda x:
             CAST(CAST(round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))) * 1000000) AS BIGINT) AS VARCHAR)), ' ') AS unit
    FROM {_V}
    """,
)
def normalize_vectors(spark, sf):
    unit = F.transform(vc.l2_normalized(F.col("v")), lambda x: F.round(x * 1000000).cast("bigint").cast("string"))
    return vectors(spark, sf).select("vec_id", F.array_join(unit, " ").alias("unit"))



def _query_vector(spark, sf):
    """The vector asked for: the first of the table."""
    return vectors(spark, sf).orderBy("vec_id").select("v").first()["v"]


_Q = f"(SELECT v FROM {_V} ORDER BY vec_id LIMIT 1)"


@query(
    "topk_similar",
    f"SELECT vec_id, round(list_cosine_similarity(v, {_Q}), 6) AS similarity FROM {_V} ORDER BY list_cosine_similarity(v, {_Q}) DESC, vec_id LIMIT 20",
)
def topk_similar(spark, sf):
    top = vc.topk_similar(vectors(spark, sf), "vec_id", "v", _query_vector(spark, sf), 20)
    return top.withColumn("similarity", F.round("similarity", 6))


@query(
    "retrieve_topk",
    f"""
    WITH top AS (SELECT vec_id, round(list_cosine_similarity(v, {_Q}), 6) AS similarity FROM {_V}
                 ORDER BY list_cosine_similarity(v, {_Q}) DESC, vec_id LIMIT 5)
    SELECT vec_id AS doc_id, similarity, CAST(i - 1 AS BIGINT) AS segment_no, segment
    FROM {numbered("string_split_regex(text, chr(10) || '+')", 'doc_id', 'documents', 'segment')} d JOIN top ON top.vec_id = d.doc_id
    """,
)
def retrieve_topk(spark, sf):
    top = vc.topk_similar(vectors(spark, sf), "vec_id", "v", _query_vector(spark, sf), 5)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return (
        docs.join(top.withColumnRenamed("vec_id", "doc_id"), "doc_id")
        .select("doc_id", F.round("similarity", 6).alias("similarity"), F.posexplode(F.split("text", "\n+")).alias("segment_no", "segment"))
        .withColumn("segment_no", F.col("segment_no").cast("bigint"))
    )


_ASKED = f"""(
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, similarity + 0.0 AS similarity FROM (
        SELECT query_id, vec_id, similarity,
            row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank
        FROM (SELECT q.vec_id AS query_id, r.vec_id, round(list_cosine_similarity(r.v, q.v), 6) AS similarity
              FROM {_V} r CROSS JOIN (SELECT * FROM {_V} WHERE vec_id % 50 = 0) q))
    WHERE rank <= 20)"""


def _nearest(spark, sf, k):
    """The ``k`` nearest rows of every row whose id is divisible by 50."""
    rows = vectors(spark, sf)
    return similarity.topk_for_queries(rows.filter("vec_id % 50 = 0"), rows, "vec_id", "v", k)


@query("topk_similar_set", f"SELECT * FROM {_ASKED}")
def topk_similar_set(spark, sf):
    return _nearest(spark, sf, 20)


@query(
    "retrieve_topk_set",
    f"""
    SELECT query_id, rank, vec_id AS doc_id, similarity, CAST(i - 1 AS BIGINT) AS segment_no, segment
    FROM {numbered("string_split_regex(text, chr(10) || '+')", 'doc_id', 'documents', 'segment')} d
    JOIN {_ASKED} top ON top.vec_id = d.doc_id WHERE rank <= 5
    """,
)
def retrieve_topk_set(spark, sf):
    """The retrieval step for a set of questions: the texts of their five nearest documents, by segments."""
    top = _nearest(spark, sf, 5).withColumnRenamed("vec_id", "doc_id")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    # A document that many questions find is joined once and cut once.
    wanted = docs.join(top.select("doc_id").distinct(), "doc_id", "left_semi")
    segments = wanted.select("doc_id", F.posexplode(F.split("text", "\n+")).alias("segment_no", "segment"))
    return top.join(segments, "doc_id").withColumn("segment_no", F.col("segment_no").cast("bigint"))


def _text(c):
    return F.array_join(c.cast("array<string>"), " ")


_RANKED = "list_sort(list_transform(range(len(v)), lambda i: {'s': -v[i + 1], 'i': i}))[1:3]"


@query(
    "select_topk",
    f"""
    SELECT vec_id, array_to_string(list_transform(CASE WHEN len(p) > 0 THEN p ELSE r[1:1] END, lambda x: x.i), ' ') AS chosen
    FROM (SELECT vec_id, r, list_filter(r, lambda x: -x.s >= 0.25) AS p FROM (SELECT vec_id, {_RANKED} AS r FROM {_V}))
    """,
)
def select_topk(spark, sf):
    return vectors(spark, sf).select("vec_id", _text(vc.select_topk(F.col("v"), 3, 0.25)).alias("chosen"))


_PASSING = "list_filter(range(len(v)), lambda i: v[i + 1] >= 0.25)"
_ARGMAX = "(list_position(v, list_max(v)) - 1)"


@query(
    "select_threshold",
    f"SELECT vec_id, array_to_string(CASE WHEN len({_PASSING}) > 0 THEN {_PASSING} ELSE [{_ARGMAX}] END, ' ') AS chosen FROM {_V}",
)
def select_threshold(spark, sf):
    return vectors(spark, sf).select("vec_id", _text(vc.select_threshold(F.col("v"), 0.25)).alias("chosen"))


@query("select_argmax", f"SELECT vec_id, CAST({_ARGMAX} AS INT) AS best FROM {_V}")
def select_argmax(spark, sf):
    return vectors(spark, sf).select("vec_id", vc.argmax(F.col("v")).alias("best"))


_LABELS = f"CASE WHEN len({_PASSING}) > 0 THEN {_PASSING} ELSE [0] END"


@query(
    "multilabel_binarize",
    f"""
    SELECT vec_id, label, array_to_string(ls, ' ') AS labels,
           array_to_string(list_transform(range(32), lambda i: CASE WHEN list_contains(ls, i) THEN '1' ELSE '0' END), ',') AS flags
    FROM (SELECT vec_id, label, {_LABELS} AS ls FROM {_V})
    """,
)
def multilabel_binarize(spark, sf):
    rows = vectors(spark, sf)
    found = rows.select("vec_id", vc.labels_at_least(F.col("v"), 0.25).alias("ls"))
    source = table(spark, sf, "embeddings").select("vec_id", "label")
    return source.join(found, "vec_id").select(
        "vec_id", "label", _text(F.col("ls")).alias("labels"), vc.binary_flags(F.col("ls"), 32).alias("flags")
    )


@query(
    "combine_vectors",
    f"""
    SELECT vec_id, CAST(i - 1 AS INT) AS position, round((v[i] + list_reverse(v)[i] + list_sort(v)[i] + abs(v[i])) / 4, 6) AS mean, 4 * len(v) AS joined_size
    FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM {_V})
    """,
)
def combine_vectors(spark, sf):
    v = F.col("v")
    four = [v, F.reverse(v), F.array_sort(v), F.transform(v, F.abs)]
    return (
        vectors(spark, sf)
        .select("vec_id", F.posexplode(vc.mean_of(four)).alias("position", "mean"), F.size(F.concat(*four)).cast("bigint").alias("joined_size"))
        .withColumn("mean", F.round("mean", 6))
    )


@query(
    "vector_errors",
    f"""
    SELECT CAST(i - 1 AS INT) AS position, round(avg(abs(v[i] - (v[i] * 0.9 + 0.01))), 6) AS mae,
           round(avg((v[i] - (v[i] * 0.9 + 0.01)) * (v[i] - (v[i] * 0.9 + 0.01))), 6) AS mse
    FROM (SELECT v, unnest(range(1, len(v) + 1)) AS i FROM {_V}) GROUP BY i
    """,
)
def vector_errors(spark, sf):
    rows = vectors(spark, sf).withColumn("guess", F.transform("v", lambda x: x * 0.9 + 0.01))
    return vc.vector_errors(rows, "v", "guess").select("position", F.round("mae", 6).alias("mae"), F.round("mse", 6).alias("mse"))


@query(
    "vector_summary",
    f"""
    SELECT label, CAST(i - 1 AS INT) AS position, round(avg(v[i]), 6) AS mean, round(stddev_samp(v[i]), 6) AS std
    FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM {_V}) GROUP BY label, i
    """,
)
def vector_summary(spark, sf):
    out = vc.vector_summary(vectors(spark, sf), "v", ["label"])
    return out.select("label", "position", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


# The vector of a term is the table row with the term's number.
_TOKEN_ROWS = numbered(words_sql("lower(text)"), "conv_id, turn", "conversations", "token")
_TOKEN_VECTORS = f"""(SELECT r.conv_id, r.turn, r.i, e.v FROM {_TOKEN_ROWS} r LEFT JOIN {_TERMS} t USING (token) LEFT JOIN {_V} e ON e.vec_id = t.id)"""


def _term_vectors(spark, sf):
    return terms(spark, sf).join(vectors(spark, sf), F.col("id") == F.col("vec_id")).select("token", "v")


def _width(spark, sf):
    return len(_query_vector(spark, sf))


@query(
    "mean_vectors",
    f"""
    SELECT conv_id, turn, CAST(k - 1 AS INT) AS position, round(sum(coalesce(v[k], 0)) / count(*), 5) AS mean
    FROM (SELECT *, unnest(range(1, (SELECT max(len(v)) FROM {_V}) + 1)) AS k FROM {_TOKEN_VECTORS}) GROUP BY conv_id, turn, k
    """,
)
def mean_vectors(spark, sf):
    tokens = talk(spark, sf).select("conv_id", "turn", F.explode("words").alias("token"))
    means = vc.mean_vectors(tokens, _term_vectors(spark, sf), ["conv_id", "turn"], "token", "v", _width(spark, sf))
    return means.select("conv_id", "turn", F.posexplode("mean").alias("position", "mean")).withColumn("mean", F.round("mean", 5))


_SEGMENTS = numbered("string_split_regex(text, chr(10) || '+')", "doc_id", "documents", "segment")


@query(
    "retrieve_segments",
    f"""
    WITH s AS MATERIALIZED (SELECT doc_id, i - 1 AS segment_no, segment FROM {_SEGMENTS}),
    w AS (SELECT doc_id, segment_no, unnest({words_sql('lower(segment)')}) AS token FROM s),
    c AS (SELECT doc_id, segment_no, token, count(*) AS n FROM w GROUP BY ALL),
    v AS (SELECT doc_id, segment_no, n, unnest(coalesce(e.v, list_transform(range(len({_Q})), lambda x: 0.0))) AS x,
                 unnest(range(len({_Q}))) AS k
          FROM c LEFT JOIN {_TERMS} t USING (token) LEFT JOIN {_V} e ON e.vec_id = t.id),
    m AS (SELECT doc_id, segment_no, k, sum(n * x) / sum(n) AS x FROM v GROUP BY ALL),
    l AS (SELECT doc_id, segment_no, list(x ORDER BY k) AS mean FROM m GROUP BY ALL),
    top AS (SELECT doc_id, segment_no, round(list_cosine_similarity(mean, {_Q}), 6) AS similarity FROM l
            WHERE list_sum(list_transform(mean, lambda x: abs(x))) > 0
            ORDER BY round(list_cosine_similarity(mean, {_Q}), 6) DESC, doc_id, segment_no LIMIT 20)
    SELECT doc_id, CAST(segment_no AS BIGINT) AS segment_no, segment, similarity FROM s JOIN top USING (doc_id, segment_no)
    """,
)
def retrieve_segments(spark, sf):
    cut = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n+")).alias("segment_no", "segment"))
    segments = cut.withColumn("segment_no", F.col("segment_no").cast("bigint"))
    keys = ["doc_id", "segment_no"]
    tokens = segments.select(*keys, F.explode(tx.words(F.lower("segment"))).alias("token"))
    query_vector = _query_vector(spark, sf)
    means = vc.mean_vectors(tokens, _term_vectors(spark, sf), keys, "token", "v", len(query_vector))
    return vc.retrieve_segments(segments, means, keys, "mean", query_vector, 20)


@query(
    "embed_sequences",
    f"""
    SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, round(coalesce(list_sum(v), 0), 6) AS total
    FROM (SELECT conv_id, turn, i - 1 AS pos, v FROM {_TOKEN_VECTORS} WHERE i <= 10
          UNION ALL SELECT conv_id, turn, p, NULL FROM conversations, range(10) AS r(p) WHERE p >= len({words_sql('lower(text)')}))
    """,
)
def embed_sequences(spark, sf):
    size, width = 10, _width(spark, sf)
    zero = F.array_repeat(F.lit(0.0), width)
    padded = F.slice(F.concat("words", F.array_repeat(F.lit(""), size)), 1, size)
    rows = talk(spark, sf).select("conv_id", "turn", F.posexplode(padded).alias("pos", "token"))
    flat = (
        rows.join(_term_vectors(spark, sf), "token", "left")
        .groupBy("conv_id", "turn")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("v", zero).alias("v")))).alias("x"))
        .select("conv_id", "turn", F.flatten(F.col("x.v")).alias("flat"))
    )
    part = F.slice("flat", F.col("pos") * width + 1, F.lit(width))
    return flat.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).select(
        "conv_id", "turn", F.col("pos").cast("bigint").alias("pos"),
        F.round(F.aggregate(part, F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


# ---- statistics and metrics -----------------------------------------------------------------

_N = f"len({words_sql('text')})"


@query("length_histogram", f"SELECT CAST({_N} AS BIGINT) AS length, count(*) AS n FROM documents GROUP BY 1")
def length_histogram(spark, sf):
    return mt.length_histogram(table(spark, sf, "documents"), F.size(tx.words(F.col("text"))))


@query(
    "length_coverage",
    f"""
    SELECT length, CAST(up_to AS BIGINT) AS up_to, round(up_to / (SELECT count(*) FROM documents), 8) AS share FROM (
      SELECT length, sum(n) OVER (ORDER BY length) AS up_to FROM (SELECT CAST({_N} AS BIGINT) AS length, count(*) AS n FROM documents GROUP BY 1))
    """,
)
def length_coverage(spark, sf):
    histogram = mt.length_histogram(table(spark, sf, "documents"), F.size(tx.words(F.col("text"))))
    return mt.length_coverage(histogram).withColumn("share", F.round("share", 8))


@query(
    "dataset_stats",
    f"""
    SELECT lang, count(*) AS n_documents, round(avg({_N}), 6) AS mean_length, CAST(max(v.n) AS BIGINT) AS vocabulary
    FROM documents JOIN (SELECT lang, count(DISTINCT w) AS n FROM (SELECT lang, unnest({words_sql('text')}) AS w FROM documents) GROUP BY lang) v USING (lang)
    GROUP BY lang
    """,
)
def dataset_stats(spark, sf):
    docs = table(spark, sf, "documents").select("lang", tx.words(F.col("text")).alias("ws"))
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n_documents"), F.round(F.avg(F.size("ws")), 6).alias("mean_length"))
    vocabulary = docs.select("lang", F.explode("ws").alias("w")).distinct().groupBy("lang").agg(F.count("*").alias("vocabulary"))
    return sizes.join(vocabulary, "lang")


@query("label_counts", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def label_counts(spark, sf):
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query(
    "length_quartiles",
    f"""
    SELECT lang, CAST(min(n) AS BIGINT) AS shortest, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS q2, quantile_cont(n, 0.75) AS q3, CAST(max(n) AS BIGINT) AS longest
    FROM (SELECT lang, {_N} AS n FROM documents) GROUP BY lang
    """,
)
def length_quartiles(spark, sf):
    return mt.length_quartiles(table(spark, sf, "documents"), "lang", F.size(tx.words(F.col("text"))).cast("bigint"))


@query(
    "class_weights",
    """
    SELECT lang, n, round(10.0 / n, 8) AS w_ten, round(sum(n) OVER () / (count(*) OVER () * n), 8) AS w_balanced, round(sum(n) OVER () / n, 8) AS w_inverse
    FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
    """,
)
def class_weights(spark, sf):
    out = mt.class_weights(table(spark, sf, "documents"), "lang")
    return out.select("lang", "n", *[F.round(c, 8).alias(c) for c in ("w_ten", "w_balanced", "w_inverse")])


# A rule-of-thumb language guess serves as the prediction.
_GUESS_RULES = [("[ñ]", "es"), ("[äöüß]", "de"), ("[éèêàç]", "fr")]
_GUESS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for p, n in _GUESS_RULES) + " ELSE 'en' END"
_MATRIX_SQL = f"(SELECT lang AS gold, {_GUESS_SQL} AS pred, count(*) AS n FROM documents GROUP BY 1, 2)"


def guess(c):
    chain = None
    for pattern, name in _GUESS_RULES:
        chain = F.when(c.rlike(pattern), name) if chain is None else chain.when(c.rlike(pattern), name)
    return chain.otherwise("en")


def matrix(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("lang").alias("gold"), guess(F.col("text")).alias("pred"))
    return mt.confusion(rows, "gold", "pred")


@query("confusion_matrix", f"SELECT gold, pred, n FROM {_MATRIX_SQL}")
def confusion_matrix(spark, sf):
    return matrix(spark, sf)


def _prf(beta2: float) -> str:
    return f"""round(coalesce(tp / nullif(p, 0), 0), 6) AS precision, round(coalesce(tp / nullif(g, 0), 0), 6) AS recall,
      round(coalesce((1 + {beta2}) * (tp / nullif(p, 0)) * (tp / nullif(g, 0)) / nullif({beta2} * (tp / nullif(p, 0)) + (tp / nullif(g, 0)), 0), 0), 6) AS f"""


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


@query(
    "class_metrics",
    f"""
    SELECT label, {_prf(0.25)} FROM (
      SELECT label, sum(tp) AS tp, sum(g) AS g, sum(p) AS p FROM (
        SELECT gold AS label, CASE WHEN gold = pred THEN n ELSE 0 END AS tp, n AS g, 0 AS p FROM {_MATRIX_SQL}
        UNION ALL SELECT pred, 0, 0, n FROM {_MATRIX_SQL}) GROUP BY label)
    """,
)
def class_metrics(spark, sf):
    return _rounded(mt.class_metrics(matrix(spark, sf), "gold", "pred", beta=0.5), "label")


@query(
    "class_accuracy",
    f"""
    SELECT round(sum(CASE WHEN gold = pred THEN n ELSE 0 END) / sum(n), 6) AS accuracy,
           round(sum(CASE WHEN gold = pred AND gold <> 'en' THEN n ELSE 0 END) / sum(CASE WHEN gold <> 'en' THEN n END), 6) AS accuracy_kept
    FROM {_MATRIX_SQL}
    """,
)
def class_accuracy(spark, sf):
    out = mt.accuracy(matrix(spark, sf), "gold", "pred", skip="en")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_SET_WORDS = ["the", "que", "der", "la", "and", "de"]
_GOLD_SET = "list_filter({0}, lambda k: list_contains({1}, k))".format(_SET_WORDS, words_sql("lower(text)"))
_PRED_SET = "list_filter({0}, lambda k: contains(text, k))".format(_SET_WORDS)
_SETS = f"(SELECT doc_id, {_GOLD_SET} AS gold, {_PRED_SET} AS pred FROM documents)"


def label_sets(spark, sf):
    """Gold: which marker words a document holds; prediction: which occur as substrings."""
    marks = F.array(*[F.lit(w) for w in _SET_WORDS])
    ws = tx.words(F.lower("text"))
    return table(spark, sf, "documents").select(
        "doc_id",
        F.filter(marks, lambda k: F.array_contains(ws, k)).alias("gold"),
        F.filter(marks, lambda k: F.contains(F.col("text"), k)).alias("pred"),
    )


@query(
    "multilabel_metrics",
    f"""
    WITH s AS (SELECT len(list_intersect(gold, pred)) AS b, len(list_distinct(gold || pred)) AS e, len(gold) AS g, len(pred) AS p FROM {_SETS})
    SELECT round(avg(coalesce(b / nullif(e, 0), 0)), 6) AS accuracy, round(avg(coalesce(2 * b / nullif(g + p, 0), 0)), 6) AS document_f1,
           round(sum(b) / sum(p), 6) AS micro_precision, round(sum(b) / sum(g), 6) AS micro_recall, round(2 * sum(b) / (sum(p) + sum(g)), 6) AS micro_f1
    FROM s
    """,
)
def multilabel_metrics(spark, sf):
    out = mt.multilabel_overall(label_sets(spark, sf), "gold", "pred")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "regression_scores",
    """
    WITH t AS (SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS y, 1500.0::DOUBLE * l_quantity AS p FROM lineitem)
    SELECT l_returnflag, count(*) AS n, round(avg(abs(y - p)), 3) AS mae, round(avg((y - p) * (y - p)) / 1000, 3) AS mse,
        round(sqrt(avg((y - p) * (y - p))), 3) AS rmse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2
    FROM t GROUP BY l_returnflag
    """,
)
def regression_scores(spark, sf):
    """Prices predicted from quantities alone."""
    rows = table(spark, sf, "lineitem").withColumn("guess", 1500.0 * F.col("l_quantity"))
    out = mt.regression_scores(rows, "l_extendedprice", "guess", ["l_returnflag"])
    return out.select(
        "l_returnflag", "n", F.round("mae", 3).alias("mae"), F.round(F.col("mse") / 1000, 3).alias("mse"),
        F.round("rmse", 3).alias("rmse"), F.round("r2", 6).alias("r2"),
    )


@query(
    "multilabel_label_metrics",
    f"""
    SELECT label, {_prf(1)} FROM (
      SELECT label, sum(CASE WHEN list_contains(gold, label) AND list_contains(pred, label) THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN list_contains(gold, label) THEN 1 ELSE 0 END) AS g, sum(CASE WHEN list_contains(pred, label) THEN 1 ELSE 0 END) AS p
      FROM (SELECT gold, pred, unnest(list_distinct(gold || pred)) AS label FROM {_SETS}) GROUP BY label)
    """,
)
def multilabel_label_metrics(spark, sf):
    return _rounded(mt.multilabel_by_label(label_sets(spark, sf), "gold", "pred"), "label")


@query(
    "masked_topk_accuracy",
    f"""
    SELECT count(*) AS masked_tokens, round(avg(CASE WHEN r[1] = gold THEN 1 ELSE 0 END), 6) AS top1,
           round(avg(CASE WHEN list_contains(r, gold) THEN 1 ELSE 0 END), 6) AS topk
    FROM (SELECT CASE WHEN v[1] > 0 THEN label ELSE -100 END AS gold, list_transform(list_sort(list_transform(range(len(v)), lambda i: {{'s': -v[i + 1], 'i': i}}))[1:5], lambda x: x.i) AS r FROM {_V})
    WHERE gold <> -100
    """,
)
def masked_topk_accuracy(spark, sf):
    rows = vectors(spark, sf).select(
        F.when(F.col("v")[0] > 0, F.col("label")).otherwise(-100).alias("gold"),
        vc.select_topk(F.col("v"), 5, float("-inf")).alias("ranked"),
    )
    out = mt.masked_topk(rows, "gold", "ranked")
    return out.select("masked_tokens", F.round("top1", 6).alias("top1"), F.round("topk", 6).alias("topk"))


@query(
    "auc_rank_sum",
    """
    WITH r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS rk
               FROM labels JOIN documents USING (doc_id))
    SELECT round((sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2)
                 / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS auc FROM r
    """,
)
def auc_rank_sum(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return mt.auc(rows, "n_chars", "quality", F.floor(F.col("n_chars") / 1000)).withColumn("auc", F.round("auc", 6))


# Prediction: gold labels with every I- that follows another I- turned to O.
_PRED_LABELS = "list_transform(range(1, len(labels) + 1), lambda i: CASE WHEN i > 2 AND starts_with(labels[i], 'I-') AND starts_with(labels[i - 1], 'I-') OR tokens[i] = upper(tokens[i]) THEN 'O' ELSE labels[i] END)"


def weaker(tokens, labels):
    def one(label, i):
        before = F.get(labels, i - 1)
        lost = (i > 1) & F.startswith(label, F.lit("I-")) & F.startswith(before, F.lit("I-"))
        t = F.get(tokens, i)
        return F.when(lost | (t == F.upper(t)), "O").otherwise(label)

    return F.transform(labels, one)


def _spans_sql(labels: str) -> str:
    rows = numbered(labels, "conv_id, turn", _BIO_SQL, "label")
    return f"""(
      SELECT conv_id, turn, min(i) AS s, max(i) AS e, substr(arg_min(label, i), 3) AS type FROM (
        SELECT *, sum(CASE WHEN starts_with(label, 'I-') THEN 0 ELSE 1 END)
                    OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM {rows})
      GROUP BY conv_id, turn, run HAVING starts_with(arg_min(label, i), 'B-'))"""


@query(
    "chunk_f1",
    f"""
    WITH g AS (SELECT * FROM {_spans_sql('labels')}), p AS (SELECT * FROM {_spans_sql(_PRED_LABELS)}),
    c AS (SELECT type, sum(tp) AS tp, sum(g) AS g, sum(p) AS p FROM (
      SELECT type, 0 AS tp, 1 AS g, 0 AS p FROM g UNION ALL SELECT type, 0, 0, 1 FROM p
      UNION ALL SELECT g.type, 1, 0, 0 FROM g JOIN p ON g.conv_id = p.conv_id AND g.turn = p.turn AND g.s = p.s AND g.e = p.e AND g.type = p.type) GROUP BY type)
    SELECT type, {_prf(1)} FROM (SELECT * FROM c UNION ALL SELECT 'ALL', sum(tp), sum(g), sum(p) FROM c)
    """,
)
def chunk_f1(spark, sf):
    keys = ["conv_id", "turn"]
    gold = bio(spark, sf)
    pred = gold.withColumn("labels", weaker(F.col("tokens"), F.col("labels")))
    out = mt.chunk_scores(dg.spans_from_bio(gold, keys), dg.spans_from_bio(pred, keys), keys)
    return _rounded(out, "type")


@query(
    "token_pairs",
    f"""
    SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INT) AS pos, gold, pred
    FROM (SELECT conv_id, turn, i, labels[i] AS gold, pr[i] AS pred FROM (
      SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM (SELECT *, {_PRED_LABELS} AS pr FROM {_BIO_SQL})))
    """,
)
def token_pairs(spark, sf):
    rows = bio(spark, sf)
    rows = rows.withColumn("pred", weaker(F.col("tokens"), F.col("labels")))
    padded = rows.select(
        "conv_id", "turn", F.concat("labels", F.array_repeat(F.lit("-1"), 5)).alias("gold"), "pred"
    )
    return mt.token_pairs(padded, ["conv_id", "turn"], "gold", "pred", "-1")


@query(
    "score_summary",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS runs, round(avg(l_discount), 4) AS l_discount_mean, round(stddev_samp(l_discount), 4) AS l_discount_std,
           round(avg(l_quantity), 4) AS l_quantity_mean, round(stddev_samp(l_quantity), 4) AS l_quantity_std
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def score_summary(spark, sf):
    return mt.score_summary(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_discount", "l_quantity"])


@query(
    "best_config",
    """
    SELECT l_returnflag, l_linenumber, l_linestatus, mean FROM (
      SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY mean DESC, l_linenumber, l_linestatus) AS rn FROM (
        SELECT l_returnflag, l_linenumber, l_linestatus, round(avg(l_extendedprice), 6) AS mean FROM lineitem GROUP BY ALL)) WHERE rn = 1
    """,
)
def best_config(spark, sf):
    return mt.best_config(table(spark, sf, "lineitem"), "l_returnflag", ["l_linenumber", "l_linestatus"], "l_extendedprice")


@query(
    "horizon_means",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 6) AS h1, round(avg(l_tax), 6) AS h2, round(avg(l_discount * l_quantity), 4) AS h3
    FROM lineitem GROUP BY 1, 2
    """,
)
def horizon_means(spark, sf):
    runs = table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", F.array("l_discount", "l_tax", F.col("l_discount") * F.col("l_quantity")).alias("errors")
    )
    out = mt.horizon_means(runs, ["l_returnflag", "l_linestatus"], "errors", 3)
    return out.select(
        "l_returnflag", "l_linestatus", "n", F.round("h1", 6).alias("h1"), F.round("h2", 6).alias("h2"), F.round("h3", 4).alias("h3")
    )


@query(
    "join_multilingual",
    """
    SELECT source, max(CASE WHEN lang = 'en' THEN n END) AS n_en, max(CASE WHEN lang = 'fr' THEN n END) AS n_fr,
           max(CASE WHEN lang = 'de' THEN n END) AS n_de, max(CASE WHEN lang = 'es' THEN n END) AS n_es
    FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IN ('en', 'fr', 'de', 'es') GROUP BY 1, 2) GROUP BY source HAVING count(*) = 4
    """,
)
def join_multilingual(spark, sf):
    docs = table(spark, sf, "documents").select("source", "lang")
    by_language = [
        docs.filter(F.col("lang") == lang).groupBy("source").agg(F.count("*").alias(f"n_{lang}")) for lang in ("en", "fr", "de", "es")
    ]
    return functools.reduce(lambda a, b: a.join(b, "source"), by_language)


@query(
    "join_by_position",
    """
    SELECT a.pos, a.lang, b.item FROM (SELECT row_number() OVER (ORDER BY doc_id) AS pos, lang FROM documents) a
    JOIN (SELECT row_number() OVER (ORDER BY vec_id) AS pos, label AS item FROM embeddings) b ON a.pos = b.pos
    """,
)
def join_by_position(spark, sf):
    from lexispark.plans.numbering import number_rows

    texts = table(spark, sf, "documents").select("doc_id", "lang")
    labels = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("item"))
    a = number_rows(texts, [], ["doc_id"], "pos").drop("doc_id")
    b = number_rows(labels, [], ["vec_id"], "pos").drop("vec_id")
    return a.join(b, "pos")


@query(
    "join_claim_premise",
    f"""
    SELECT conv_id, turn, length(text) AS claim_length, len({words_sql('text')}) AS premise_words FROM conversations
    """,
)
def join_claim_premise(spark, sf):
    keys = ["conv_id", "turn"]
    claims = turns(spark, sf).select(*keys, F.length("text").cast("bigint").alias("claim_length"))
    premises = turns(spark, sf).select(*keys, F.size(tx.words(F.col("text"))).cast("bigint").alias("premise_words"))
    return claims.join(premises, keys)
