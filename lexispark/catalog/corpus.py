"""Corpus queries over `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.catalog.registry import query, table
from lexispark.catalog.sqlparts import CLEAN_LINES, PARTS, WSC, charset_ok, numbered, trim_sql
from lexispark.functions import text as tx
from lexispark.functions.alphabets import WEST_EUROPEAN_MARKED as MARKED
from lexispark.functions.draws import MODULUS, draw_sql
from lexispark.operators import corpus

_TOKENS = rf"len(string_split_regex(regexp_replace(text, '{WSC}+$', ''), '{WSC}'))"


@query(
    "filter_bad_rows",
    "SELECT doc_id, length(text) AS n_chars FROM documents "
    "WHERE length(text) >= 80 AND NOT contains(text, chr(0))",
)
def filter_bad_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return corpus.filter_bad_rows(docs).select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


@query(
    "filter_min_tokens",
    f"SELECT doc_id, CAST({_TOKENS} AS BIGINT) AS n_tokens FROM documents WHERE {_TOKENS} >= 80",
)
def filter_min_tokens(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return corpus.filter_min_tokens(docs).select(
        "doc_id", F.size(tx.single_space_tokens(F.col("text"))).cast("bigint").alias("n_tokens")
    )


@query(
    "filter_charset_window",
    f"SELECT doc_id, lang FROM documents WHERE {charset_ok('text', MARKED, 80)}",
)
def filter_charset_window(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return corpus.filter_charset(docs, MARKED).select("doc_id", "lang")


@query("clean_lines", f"SELECT doc_id, {CLEAN_LINES} AS text FROM documents")
def clean_lines(spark, sf):
    return corpus.clean_lines(table(spark, sf, "documents").select("doc_id", "text"), MARKED)


@query(
    "web_corpus_clean",
    f"""
    WITH good AS (
      SELECT doc_id, text FROM documents
      WHERE length(text) >= 80 AND NOT contains(text, chr(0)) AND {_TOKENS} >= 80
    ), once AS (
      SELECT min(doc_id) AS doc_id, text FROM good GROUP BY text
    )
    SELECT doc_id, {CLEAN_LINES} AS text FROM once WHERE {charset_ok('text', MARKED, 80)}
    """,
)
def web_corpus_clean(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return corpus.clean_web_corpus(docs, MARKED)


@query(
    "wiki_lines",
    f"""
    SELECT doc_id, line FROM (
      SELECT doc_id, {trim_sql("unnest(string_split_regex(text, chr(10) || '+'))")} AS line FROM documents
    ) WHERE length(line) >= 20 AND NOT starts_with(line, '|') AND NOT starts_with(line, '{{|')
      AND NOT contains(line, 'wikitable')
    """,
)
def wiki_lines(spark, sf):
    return corpus.wiki_lines(table(spark, sf, "documents").select("doc_id", "text"))


@query(
    "dedup_documents",
    "SELECT doc_id, lang, source, text FROM documents "
    "QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
)
def dedup_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return corpus.dedup_documents(docs)


_DEDUPED = f"""
    kept AS (
      SELECT doc_id, line_id, part FROM {PARTS} WHERE part <> ''
      QUALIFY row_number() OVER (PARTITION BY part ORDER BY doc_id, line_id) = 1
    ), rebuilt AS (
      SELECT doc_id, string_agg(part, chr(10) ORDER BY line_id) AS text FROM kept GROUP BY doc_id
    )
"""


@query(
    "dedup_paragraphs",
    f"WITH src AS (SELECT doc_id, text FROM documents), {_DEDUPED} SELECT doc_id, text FROM rebuilt",
)
def dedup_paragraphs(spark, sf):
    return corpus.dedup_paragraphs(table(spark, sf, "documents").select("doc_id", "text"))


@query(
    "dedup_union",
    "SELECT text FROM documents UNION SELECT text FROM conversations UNION SELECT text FROM benchmark",
)
def dedup_union(spark, sf):
    return corpus.distinct_texts(
        *[table(spark, sf, t) for t in ("documents", "conversations", "benchmark")]
    )


@query(
    "dedup_funnel",
    f"""
    WITH src AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text), {_DEDUPED}
    SELECT 'input_documents' AS stage, count(*) AS n FROM documents
    UNION ALL SELECT 'unique_documents', count(*) FROM src
    UNION ALL SELECT 'input_paragraphs', count(*) FROM {PARTS} WHERE part <> ''
    UNION ALL SELECT 'output_paragraphs', count(*) FROM kept
    UNION ALL SELECT 'output_documents', count(*) FROM rebuilt
    UNION ALL SELECT 'good_documents', count(*) FROM rebuilt
      WHERE length(text) >= 80 AND NOT contains(text, chr(0))
    """,
)
def dedup_funnel(spark, sf):
    return corpus.dedup_funnel(table(spark, sf, "documents"))


@query(
    "lines_to_documents",
    f"""
    WITH lines AS (
      SELECT source AS file, doc_id * 1000000 + i - 1 AS line_no, line
      FROM {numbered("string_split(text || chr(10), chr(10))", "source, doc_id", "documents", "line")}
    ), numbered AS (
      SELECT *, sum(CASE WHEN {trim_sql('line')} = '' THEN 1 ELSE 0 END)
                  OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS doc_no FROM lines
    )
    SELECT file, CAST(doc_no AS BIGINT) AS doc_no, string_agg(line, chr(10) ORDER BY line_no) AS text
    FROM numbered WHERE {trim_sql('line')} <> '' GROUP BY file, doc_no
    """,
)
def lines_to_documents(spark, sf):
    docs = table(spark, sf, "documents")
    lines = docs.select(
        F.col("source").alias("file"),
        "doc_id",
        F.posexplode(F.split(F.concat("text", F.lit("\n")), "\n")).alias("pos", "line"),
    ).select("file", (F.col("doc_id") * 1000000 + F.col("pos")).alias("line_no"), "line")
    return corpus.lines_to_documents(lines, block_lines=50_000_000)


@query(
    "paired_lines",
    """
    WITH lines AS (
      SELECT doc_id, i - 1 AS line_no, parts[i] AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS parts,
                   unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
    )
    SELECT a.doc_id, CAST(a.line_no // 2 AS BIGINT) AS pair_no, a.line AS y, b.line AS x
    FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.line_no = a.line_no + 1 WHERE a.line_no % 2 = 0
    """,
)
def paired_lines(spark, sf):
    lines = table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    return corpus.pair_lines(lines, "doc_id")


@query(
    "paragraph_explode",
    """
    SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, parts[i] AS paragraph
    FROM (SELECT doc_id, string_split_regex(text, chr(10) || '+') AS parts,
                 unnest(range(1, len(string_split_regex(text, chr(10) || '+')) + 1)) AS i FROM documents)
    """,
)
def paragraph_explode(spark, sf):
    return (
        table(spark, sf, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n+")).alias("pos", "paragraph"))
        .withColumn("pos", F.col("pos").cast("bigint"))
    )


_ARTICLES = """
    SELECT 'document' AS kind, doc_id AS id, text AS content FROM documents
    UNION ALL SELECT 'page', page_id, html FROM pages
"""


@query(
    "filter_articles",
    f"""
    SELECT kind, id, length(content) AS n_chars FROM ({_ARTICLES})
    WHERE length(content) >= 500 AND NOT contains(content, 'div') AND NOT contains(content, 'class=')
      AND NOT contains(content, 'script') AND NOT contains(content, chr(0))
    """,
)
def filter_articles(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("content")
    )
    pages = table(spark, sf, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("content")
    )
    return corpus.filter_articles(docs.unionByName(pages)).select(
        "kind", "id", F.length("content").cast("bigint").alias("n_chars")
    )


_LINE_WORDS = f"""
    (SELECT doc_id, i - 1 AS line_no,
            list_filter(string_split_regex(parts[i], '{WSC}+'), lambda w: w <> '') AS tokens
     FROM (SELECT doc_id, string_split(text, chr(10)) AS parts,
                  unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
"""


def _line_words(spark, sf):
    return (
        table(spark, sf, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), tx.words(F.col("line")).alias("tokens"))
    )


@query(
    "filter_length_range",
    f"SELECT doc_id, line_no, CAST(len(tokens) AS BIGINT) AS n FROM {_LINE_WORDS} WHERE len(tokens) BETWEEN 5 AND 40",
)
def filter_length_range(spark, sf):
    return corpus.filter_length_range(_line_words(spark, sf), "tokens", 5, 40).select(
        "doc_id", "line_no", F.size("tokens").cast("bigint").alias("n")
    )


_KEYWORDS = ["with", "from", "pour", "nicht", "para"]


@query(
    "filter_keyword_sentences",
    f"""
    SELECT doc_id, line_no, array_to_string(tokens, ' ') AS sentence FROM {_LINE_WORDS}
    WHERE len(tokens) BETWEEN 5 AND 60 AND list_has_any(tokens, {_KEYWORDS})
    """,
)
def filter_keyword_sentences(spark, sf):
    return corpus.filter_keywords(_line_words(spark, sf), "tokens", _KEYWORDS, 5, 60).select(
        "doc_id", "line_no", F.array_join("tokens", " ").alias("sentence")
    )


@query(
    "filter_labels",
    "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'signup')",
)
def filter_labels(spark, sf):
    return table(spark, sf, "events").filter(~F.col("event_type").isin("error", "signup")).select(
        "event_id", "event_type"
    )


@query(
    "split_temporal",
    """
    SELECT CASE WHEN year(o_orderdate) <= 1999 THEN 'train' ELSE 'valid' END AS split,
           count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders WHERE year(o_orderdate) < 2001 GROUP BY 1
    """,
)
def split_temporal(spark, sf):
    year = F.year("o_orderdate")
    return (
        table(spark, sf, "orders")
        .filter(year < 2001)
        .groupBy(F.when(year <= 1999, "train").otherwise("valid").alias("split"))
        .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@query(
    "split_hash",
    f"SELECT doc_id, CASE WHEN {draw_sql(7, 'doc_id')} < {int(0.1 * MODULUS)} THEN 'test' ELSE 'train' END AS split "
    "FROM documents",
)
def split_hash(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return corpus.hash_split(docs, "doc_id", 0.1, seed=7)


@query(
    "filter_syllables",
    f"""
    SELECT DISTINCT w AS word FROM (
      SELECT unnest(string_split_regex(lower(text), '{WSC}+')) AS w FROM documents
    ) WHERE length(w) BETWEEN 1 AND 7 AND NOT regexp_matches(w, '[fjwz]')
      AND NOT regexp_matches(w, '[àáảãạâầấẩẫậăằắẳẵặèéẻẽẹêềếểễệòóỏõọìíỉĩịôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ]')
    """,
)
def filter_syllables(spark, sf):
    lexicon = (
        table(spark, sf, "documents")
        .select(F.explode(F.split(F.lower("text"), tx.WS + "+")).alias("word"))
        .transform(corpus.filter_lexicon_syllables)
    )
    return lexicon.distinct()


@query(
    "corpus_stats",
    f"SELECT count(*) AS n_documents, CAST(sum({_TOKENS}) AS BIGINT) AS n_tokens FROM documents",
)
def corpus_stats(spark, sf):
    return corpus.corpus_stats(table(spark, sf, "documents").select("text"))
