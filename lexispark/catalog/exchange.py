"""Round trips through files, page queries and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.catalog.dialogue import ACTS_SQL, _BIO_SQL, acts, bio, turns
from lexispark.catalog.graphs import _TREES, trees
from lexispark.catalog.numeric import _PRED_LABELS, weaker
from lexispark.catalog.registry import query, table
from lexispark.catalog.sqlparts import WSC, numbered, sentences_sql, trim_sql, words_sql
from lexispark.functions import text as tx
from lexispark.operators import corpus, crawl
from lexispark.plans.checkpoints import scratch_path
from lexispark.sources import files
from lexispark.streaming import articles

ONE_LINE = trim_sql(f"regexp_replace(text, '{WSC}+', ' ', 'g')")


def docs(spark, sf, *columns):
    return table(spark, sf, "documents").select("doc_id", *columns)


@query("src_jsonl", "SELECT doc_id, lang, text FROM documents")
def src_jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    docs(spark, sf, "lang", "source", "text").write.json(path)
    return files.read_jsonl(spark, path, "doc_id bigint, lang string, text string", glob="*.json")


@query(
    "tokenize_job",
    f"""SELECT doc_id, lang, array_to_string(list_transform({sentences_sql('text')},
        lambda s: array_to_string({words_sql('s')}, ' ')), chr(10)) AS tokens FROM documents""",
)
def tokenize_job(spark, sf):
    """From JSON files to JSON files: read, cut into sentences and words, write, and read what was written."""
    source, out = scratch_path(spark, "raw-json"), scratch_path(spark, "tokenized-json")
    docs(spark, sf, "lang", "text").write.json(source)
    raw = files.read_jsonl(spark, source, "doc_id bigint, lang string, text string")
    files.tokenize_to_json(raw, out, "text", ["doc_id", "lang"])
    return files.read_jsonl(spark, out, "doc_id bigint, lang string, tokens string")


@query("src_text_lines", rf"SELECT {ONE_LINE} AS line FROM documents")
def src_text_lines(spark, sf):
    path = scratch_path(spark, "lines")
    docs(spark, sf, "text").select(tx.one_line(F.col("text")).alias("value")).write.text(path)
    return files.read_lines(spark, path).select(F.col("value").alias("line"))


_TRIMMED = r"regexp_replace(regexp_replace(text, '\n\n+', chr(10), 'g'), '^\n+|\n+$', '', 'g')"


@query("src_blank_line_documents", f"SELECT {_TRIMMED} AS text FROM documents WHERE {_TRIMMED} <> ''")
def src_blank_line_documents(spark, sf):
    path = scratch_path(spark, "blocks")
    body = F.regexp_replace(F.regexp_replace("text", "\n\n+", "\n"), r"^\n+|\n+$", "")
    docs(spark, sf, "text").select(F.concat(body, F.lit("\n")).alias("value")).write.text(path)
    return files.read_blank_line_documents(spark, path)


@query("src_category_tsv", f"SELECT lang AS category, {ONE_LINE} AS content FROM documents")
def src_category_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    docs(spark, sf, "lang", "text").select(F.concat_ws("\t", "lang", tx.one_line(F.col("text"))).alias("value")).write.text(path)
    return files.read_category_lines(spark, path)


@query("src_json_multiline", "SELECT doc_id, lang, text FROM documents")
def src_json_multiline(spark, sf):
    # A multi-line file is one JSON value, so documents go into arrays of at most 500.
    path = scratch_path(spark, "multiline")
    rows = F.collect_list(F.struct("doc_id", "lang", "text"))
    (
        docs(spark, sf, "lang", "text")
        .groupBy(F.floor(F.col("doc_id") / 500).alias("bundle"))
        .agg(F.to_json(rows, {"pretty": "true"}).alias("value"))
        .write.partitionBy("bundle")
        .text(path)
    )
    return files.read_json_documents(spark, path, "doc_id bigint, lang string, text string")


@query(
    "src_csv_dropna",
    "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal >= 0",
)
def src_csv_dropna(spark, sf):
    path = scratch_path(spark, "csv")
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", balance.alias("c_acctbal"), "c_mktsegment")
    rows.write.csv(path, sep=";", header=True)
    return files.read_delimited(spark, path, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


@query("src_parquet", "SELECT doc_id, source, n_chars FROM documents WHERE n_chars >= 500")
def src_parquet(spark, sf):
    path = scratch_path(spark, "parquet")
    docs(spark, sf, "source", "n_chars", "text").write.parquet(path)
    return spark.read.parquet(path).filter("n_chars >= 500").select("doc_id", "source", "n_chars")


@query("sink_gzip_json", "SELECT doc_id, text FROM documents")
def sink_gzip_json(spark, sf):
    path = scratch_path(spark, "gzip")
    files.write_gzip_json(docs(spark, sf, "text"), path, files=8)
    return files.read_jsonl(spark, path, "doc_id bigint, text string", glob="*.json.gz")


_CASED = f"list_transform({words_sql('text')}, lambda w: CASE WHEN regexp_matches(w, '^\\p{{Lu}}') THEN 'CAP' ELSE 'LOW' END)"


@query(
    "conll_blocks",
    f"SELECT array_to_string({words_sql('text')}, ' ') AS words, array_to_string({_CASED}, ' ') AS labels FROM conversations",
)
def conll_blocks(spark, sf):
    path = scratch_path(spark, "conll")
    w = tx.words(F.col("text"))
    labels = F.transform(w, lambda x: F.when(x.rlike(r"^\p{Lu}"), "CAP").otherwise("LOW"))
    turns(spark, sf).select(F.concat(files.token_lines(w, labels), F.lit("\n")).alias("value")).write.text(path)
    back = files.read_token_blocks(spark, path, ["words", "labels"])
    return back.select(F.array_join("words", " ").alias("words"), F.array_join("labels", " ").alias("labels"))


@query(
    "conllu_sentences",
    f"""
    SELECT 'ROOT ' || array_to_string(forms, ' ') AS forms, '-1 ' || array_to_string(heads, ' ') AS heads,
           'NA ' || array_to_string(labels, ' ') AS labels FROM {_TREES}
    """,
)
def conllu_sentences(spark, sf):
    path = scratch_path(spark, "conllu")

    def line(form, i):
        blank = F.lit("_")
        cells = [(i + 1).cast("string"), form, blank, F.get("upos", i), blank, blank,
                 F.get("heads", i).cast("string"), F.get("labels", i), blank, blank]
        return F.concat_ws("\t", *cells)

    body = F.array_join(F.transform("forms", line), "\n")
    comment = F.concat(F.lit("# sent_id = "), F.col("doc_id"), F.lit("-"), F.col("sent_no"))
    extra = F.lit("0.1\t_\t_\t_\t_\t_\t_\t_\t_\t_")
    trees(spark, sf).select(F.concat_ws("\n", comment, body, extra, F.lit("")).alias("value")).write.text(path)
    back = files.read_trees(spark, path)
    return back.select(
        F.array_join("form", " ").alias("forms"), F.array_join("head", " ").alias("heads"), F.array_join("deprel", " ").alias("labels")
    )


_FLAGS = "list_filter(range(22), lambda i: (n_chars >> i) & 1 = 1)"


@query(
    "fixed_tail_multilabel",
    f"SELECT CAST(doc_id AS VARCHAR) AS id, replace({ONE_LINE}, '\"', '') AS text, array_to_string({_FLAGS}, ' ') AS labels FROM documents",
)
def fixed_tail_multilabel(spark, sf):
    path = scratch_path(spark, "fixed")
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(21)), lambda i: F.call_function("shiftright", F.col("n_chars"), i).bitwiseAND(F.lit(1)).cast("string")
    )
    text = F.replace(tx.one_line(F.col("text")), F.lit('"'), F.lit(""))
    line = F.concat(F.col("doc_id").cast("string"), F.lit(',"'), text, F.lit('",'), F.array_join(bits, ","))
    docs(spark, sf, "n_chars", "text").select(line.alias("value")).write.text(path)
    out = files.parse_fixed_tail(files.read_lines(spark, path))
    return out.withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), " "))


def _nested(spark, sf):
    """Dialogues as nested JSON files, in parts of at most 512 turns."""
    path = scratch_path(spark, "dialogues")

    def turn(x):
        word = F.get(tx.words(x["text"]), F.lit(0))
        frame = F.struct(x["role"].alias("service"), F.create_map(x["role"], F.array(word)).alias("slot_values"))
        return F.struct(
            x["turn"].cast("string").alias("turn_id"), x["role"].alias("speaker"), x["text"].alias("utterance"), F.array(frame).alias("frames")
        )

    (
        turns(spark, sf)
        .groupBy(F.col("conv_id").cast("string").alias("dialogue_id"), F.floor(F.col("turn") / 512).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
        .select("dialogue_id", "part", F.array(F.lit("user"), F.lit("assistant")).alias("services"), F.transform("x", turn).alias("turns"))
        .write.json(path)
    )
    return files.read_jsonl(spark, path, files.DIALOGUE_SCHEMA)


@query(
    "dialog_turns",
    "SELECT CAST(conv_id AS VARCHAR) AS dialogue_id, CAST(turn AS VARCHAR) AS turn_id, text AS utterance FROM conversations",
)
def dialog_turns(spark, sf):
    return files.dialogue_turns(_nested(spark, sf))


@query(
    "dialog_states",
    f"""
    SELECT CAST(conv_id AS VARCHAR) AS dialogue_id, CAST(turn AS VARCHAR) AS turn_id, role AS speaker,
           CASE WHEN role = 'system' THEN 0 ELSE 1 END AS n_frames, CASE WHEN role = 'system' THEN '' ELSE coalesce({words_sql('text')}[1], '') END AS slot_value
    FROM conversations
    """,
)
def dialog_states(spark, sf):
    frame = F.get("frames", F.lit(0))
    value = F.get(F.element_at(frame["slot_values"], frame["service"]), F.lit(0))
    return files.dialogue_states(_nested(spark, sf)).select(
        "dialogue_id", "turn_id", "speaker", F.size("frames").alias("n_frames"), F.coalesce(value, F.lit("")).alias("slot_value")
    )


@query(
    "filter_domain",
    """
    SELECT CAST(conv_id AS VARCHAR) AS dialogue_id, CAST(turn AS VARCHAR) AS turn_id, role AS service FROM conversations
    WHERE starts_with(CAST(conv_id AS VARCHAR), '1') AND contains(role, 'assist')
    """,
)
def filter_domain(spark, sf):
    found = _nested(spark, sf).filter(
        F.startswith("dialogue_id", F.lit("1")) & F.exists("services", lambda s: F.contains(s, F.lit("assist")))
    )
    return (
        found.select("dialogue_id", F.explode("turns").alias("t"))
        .select("dialogue_id", F.col("t.turn_id").alias("turn_id"), F.explode("t.frames").alias("f"))
        .select("dialogue_id", "turn_id", F.col("f.service").alias("service"))
        .filter(F.contains("service", F.lit("assist")))
    )


@query(
    "dialog_acts",
    f"""
    SELECT CAST(conv_id AS VARCHAR) AS dialogue_id, CAST(turn AS INT) AS turn_id, upper(role) || '-INFORM' AS act, w AS value,
           CASE WHEN role = 'user' THEN 0 ELSE -1 END AS start, CAST(length(w) AS INT) AS "end"
    FROM (SELECT *, coalesce({words_sql('text')}[1], '') AS w FROM conversations)
    """,
)
def dialog_acts(spark, sf):
    path = scratch_path(spark, "acts")
    word = F.coalesce(F.get(tx.words(F.col("text")), F.lit(0)), F.lit(""))
    act = F.concat(F.upper("role"), F.lit("-INFORM"))
    start = F.when(F.col("role") == "user", "0").otherwise("none")
    span = F.array(act, F.lit("word"), word, start, F.length(word).cast("string"))
    entry = F.struct(
        F.create_map(act, F.array(F.array(F.lit("word"), word))).alias("dialog_act"), F.array(span).alias("span_info")
    )
    (
        turns(spark, sf)
        .groupBy(F.col("conv_id").cast("string").alias("d"), F.floor(F.col("turn") / 512).alias("part"))
        .agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), entry))).alias("t"))
        .select(F.to_json(F.create_map("d", "t")).alias("value"))
        .write.text(path)
    )
    rows = files.dialogue_acts(files.read_lines(spark, path))
    s = F.get("spans", F.lit(0))
    return rows.select(
        "dialogue_id", "turn_id", F.get("acts", F.lit(0)).alias("act"), s["value"].alias("value"),
        F.coalesce(s["start"], F.lit(-1)).alias("start"), s["end"].alias("end"),
    )


@query(
    "src_xml_utterances",
    f"""
    SELECT conv_id || '-' || turn AS turn_id, {ONE_LINE} AS utterance, array_to_string(acts, ' ') AS acts FROM {ACTS_SQL}
    """,
)
def src_xml_utterances(spark, sf):
    path = scratch_path(spark, "xml")
    rows = acts(spark, sf).select(
        F.concat_ws("-", "conv_id", "turn").alias("turn_id"),
        tx.one_line(F.col("text")).alias("txt"),
        F.transform("acts", lambda a: F.struct(F.lit("talk").alias("domain"), a.alias("communicativeFunction"))).alias("act"),
    )
    rows.write.format("xml").option("rowTag", "utterance").option("rootTag", "utterances").save(path)
    back = files.read_xml_records(
        spark, path, "utterance", "turn_id string, txt string, act array<struct<domain: string, communicativeFunction: string>>"
    )
    return back.select("turn_id", F.col("txt").alias("utterance"), F.array_join("act.communicativeFunction", " ").alias("acts"))


_FORMAT_ROWS = f"""
    WITH r AS (SELECT conv_id, turn, text, acts, tokens, labels, {_PRED_LABELS} AS pred FROM {ACTS_SQL} a JOIN {_BIO_SQL} b USING (conv_id, turn)),
    f AS (
      SELECT 'tsv' AS format, array_to_string((acts || ['NA', 'NA'])[1:2], chr(9)) || chr(9) || {ONE_LINE} AS line FROM r
      UNION ALL SELECT 'prefix', array_to_string(list_transform(acts, lambda a: '__' || a || '__'), ' ') || ' ' || {ONE_LINE} FROM r
      UNION ALL SELECT 'conll', unnest(list_transform(range(1, len(tokens) + 1), lambda i: tokens[i] || ' ' || labels[i])) FROM r
      UNION ALL SELECT 'joint', unnest(list_transform(range(1, len(tokens) + 1), lambda i: tokens[i] || ' ' || labels[i])
                                       || list_transform(CASE WHEN len(acts) = 0 THEN ['NA'] ELSE acts[1:2] END, lambda a: 'EOS ' || a)) FROM r
      UNION ALL SELECT 'compare', unnest(list_transform(range(1, len(tokens) + 1), lambda i: labels[i] || ' ' || CASE WHEN i <= 20 THEN pred[i] ELSE 'O' END)) FROM r)
    SELECT format, line, count(*) AS n FROM f GROUP BY format, line
"""


@query("sink_text_formats", _FORMAT_ROWS)
def sink_text_formats(spark, sf):
    keys = ["conv_id", "turn"]
    said = acts(spark, sf).join(bio(spark, sf), keys)
    tokens, labels, names, text = F.col("tokens"), F.col("labels"), F.col("acts"), F.col("text")
    # A model of 20 positions: later tokens get the default label.
    pred = files.aligned_predictions(tokens, F.slice(weaker(tokens, labels), 1, 20), "O")
    lines = {
        "tsv": files.labelled_line(names, text),
        "prefix": files.prefixed_line(names, text),
        "conll": F.concat(files.token_lines(tokens, labels), F.lit("\n")),
        "joint": F.concat(files.joint_token_lines(tokens, labels, names), F.lit("\n")),
        "compare": F.concat(files.token_lines(labels, pred), F.lit("\n")),
    }
    path = scratch_path(spark, "formats")
    rows = said.select(F.inline(F.array(*[F.struct(F.lit(k).alias("format"), v.alias("value")) for k, v in lines.items()])))
    rows.write.partitionBy("format").text(path)
    back = spark.read.text(path).filter("value <> ''")
    return back.groupBy("format", F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(
    "metrics_append",
    """
    SELECT run, lang, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM documents, (VALUES (1), (2)) AS r(run) GROUP BY run, lang
    """,
)
def metrics_append(spark, sf):
    path = scratch_path(spark, "metrics")
    scores = docs(spark, sf, "lang", "n_chars").groupBy("lang").agg(
        F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars")
    )
    for run in (1, 2):
        files.append_rows(scores.withColumn("run", F.lit(run)), path)
    return files.read_jsonl(spark, path, "run int, lang string, n bigint, mean_chars double")


# ---- pages ----------------------------------------------------------------------------------

_SITE = "regexp_extract(url, '^[a-z]+://[^/?#]+', 0)"


@query(
    "extract_links",
    f"""
    SELECT DISTINCT link FROM (
      SELECT {_SITE} || unnest(regexp_extract_all(html, '/[\\p{{L}}][^\\s\"''<>]*')) AS link FROM pages)
    WHERE NOT contains(link, '/the') AND NOT contains(link, ',')
    """,
)
def extract_links(spark, sf):
    pages = table(spark, sf, "pages").select("url", "html")
    sites = pages.select(crawl.site_of(F.col("url")).alias("site")).distinct().select(
        "site",
        F.lit(r"""/[\p{L}][^\s"'<>]*""").alias("pattern"),
        F.array(F.lit("/the"), F.lit(",")).alias("exclude"),
    )
    return crawl.extract_links(pages, sites)


def _plain(x: str) -> str:
    return trim_sql(f"regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '{WSC}+', ' ', 'g')")


_BLOCKS = f"string_split_regex(regexp_replace(html, '{crawl._SILENT}', ' ', 'g'), '{crawl._BLOCK}')"
_LINKED = "array_to_string(regexp_extract_all(b, '(?is)<a\\b[^>]*>(.*?)</a>', 1), ' ')"
MAIN_SQL = f"""array_to_string(list_filter(list_transform({_BLOCKS}, lambda b:
    CASE WHEN len({words_sql(_plain('b'))}) >= 10 AND len({words_sql(_plain(_LINKED))}) <= len({words_sql(_plain('b'))}) * 0.33 THEN {_plain('b')} END),
    lambda t: t IS NOT NULL), chr(10))"""


def contents(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", crawl.main_text(F.col("html")).alias("content"))


@query("extract_main_text", f"SELECT page_id, url, {MAIN_SQL} AS content FROM pages")
def extract_main_text(spark, sf):
    return contents(spark, sf)


_C = f"(SELECT page_id, url, {MAIN_SQL} AS content FROM pages)"


@query(
    "index_feed",
    f"""
    SELECT page_id, url, CAST((row_number() OVER (ORDER BY page_id) - 1) // 40 AS BIGINT) AS batch, length(content) AS n_chars FROM {_C}
    WHERE length({trim_sql('content')}) >= 200 AND NOT contains(content, '<div') AND NOT contains(content, '<table') AND NOT contains(content, '</p>')
      AND url NOT IN (SELECT url FROM pages WHERE starts_with(url, 'http://'))
    """,
)
def index_feed(spark, sf):
    # The index already holds what was fetched over plain http.
    indexed = table(spark, sf, "pages").filter(F.startswith("url", F.lit("http://"))).select("url")
    out = crawl.index_feed(contents(spark, sf), indexed, "page_id", batch=40, ids_per_block=64)
    return out.select("page_id", "url", "batch", F.length("content").cast("bigint").alias("n_chars"))


# ---- streams --------------------------------------------------------------------------------


def _feed(spark, sf):
    """Pages as an article feed, one minute apart, and once more an hour later."""
    path = scratch_path(spark, "feed")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60 + F.col("again") * 3600)
    (
        contents(spark, sf)
        .withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
        .select("url", "content", at.alias("date"))
        .write.parquet(path)
    )
    return articles.from_files(spark, path)


def _streamed(spark, stream, name):
    out = scratch_path(spark, name)
    articles.run_to_parquet(stream, out, scratch_path(spark, f"{name}-checkpoint"))
    return spark.read.schema(articles.SCHEMA).parquet(out)


_GOOD = f"""(SELECT url, content FROM {_C} WHERE length(content) >= 500 AND NOT contains(content, 'div') AND NOT contains(content, 'class=')
             AND NOT contains(content, 'script') AND NOT contains(content, chr(0)))"""


@query("stream_articles", f"SELECT url, length(content) AS n_chars, 2 AS n FROM {_GOOD}")
def stream_articles(spark, sf):
    out = _streamed(spark, articles.good_articles(_feed(spark, sf)), "articles")
    return out.groupBy("url", F.length("content").cast("bigint").alias("n_chars")).agg(F.count("*").cast("int").alias("n"))


@query("stream_novelty", f"SELECT url, length(content) AS n_chars FROM {_GOOD}")
def stream_novelty(spark, sf):
    stream = articles.novel_articles(articles.good_articles(_feed(spark, sf)))
    return _streamed(spark, stream, "novel").select("url", F.length("content").cast("bigint").alias("n_chars"))
