"""Line dedup by site: lines that many pages of their host hold are boilerplate and are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexispark.llm.registry import let, query, table
from lexispark.plans.checkpoints import scratch_path

#: A line is boilerplate if more than this share of its host's pages hold it, and at least so many pages.
MAX_RATIO, LEAST_PAGES = 0.2, 4

_BLANK = "^[\\x20\\x09-\\x0D]*$"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _digest(line: Column) -> Column:
    """128 bits that stand for a line: two hashes of different seeds."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _least_shingles(text: Column) -> tuple[Column, Column]:
    """Two min-hashes of the text's runs of three words; fewer words make one run. Near copies have nearly always one in common.

    Runs are made of hashes of words, so no run is ever a text.
    """
    words = F.transform(
        F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)
    )

    def least(w: Column) -> Column:
        n = F.size(w) - 2

        def lowest(seed: int) -> Column:
            run = lambda i: F.xxhash64(F.lit(seed), F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            return F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), run))

        return F.struct(lowest(0).alias("a"), lowest(1).alias("b"))

    found = let(words, least)
    return found["a"], found["b"]


def _contents(rows: DataFrame, *keys: str) -> DataFrame:
    """Number of different contents by ``keys``: texts that share one of both min-hashes count once."""
    first = rows.groupBy(*keys, "a").agg(F.min("b").alias("b"))
    return first.select(*keys, "b").distinct().groupBy(*keys).agg(F.count("*").alias("count"))


def boilerplate(
    pages: DataFrame,
    host: Column,
    text: str,
    max_ratio: float = MAX_RATIO,
    least_pages: int = LEAST_PAGES,
    by_content: bool = False,
) -> DataFrame:
    """``host``, ``digest``, ``n_pages``, ``ratio`` of every boilerplate line.

    Rows of one page count a line once. With ``by_content`` copies and near
    copies of a page count as one page, for the line and for the host: what is
    repeated because its text is copied is no boilerplate. Only digests and
    counts are shuffled, added up before and after, so neither a hot host nor a
    hot line meets in one task.
    """
    if by_content:
        return _boilerplate_by_content(pages, host, text, max_ratio, least_pages)
    rows = pages.select(host.alias("host"), F.col(text).alias("t"))
    sizes = rows.groupBy("host").agg(F.count("*").alias("host_pages"))
    distinct = F.array_distinct(F.filter(_lines(F.col("t")), lambda x: ~x.rlike(_BLANK)))
    counts = (
        rows.select("host", F.explode(distinct).alias("line"))
        .groupBy("host", _digest(F.col("line")).alias("digest"))
        .agg(F.count("*").alias("n_pages"))
        .filter(F.col("n_pages") >= least_pages)
    )
    ratio = F.col("n_pages") / F.col("host_pages")
    return counts.join(sizes, "host").withColumn("ratio", ratio).filter(F.col("ratio") > max_ratio).drop("host_pages")


def _boilerplate_by_content(
    pages: DataFrame, host: Column, text: str, max_ratio: float, least_pages: int
) -> DataFrame:
    a, b = _least_shingles(F.col(text))
    rows = pages.select(host.alias("host"), F.col(text).alias("t"), a.alias("a"), b.alias("b"))
    sizes = _contents(rows.select("host", "a", "b"), "host").withColumnRenamed("count", "host_pages")
    distinct = F.array_distinct(F.filter(_lines(F.col("t")), lambda x: ~x.rlike(_BLANK)))
    lines = rows.select("host", "a", "b", F.explode(distinct).alias("line"))
    counts = (
        _contents(lines.select("host", _digest(F.col("line")).alias("digest"), "a", "b"), "host", "digest")
        .withColumnRenamed("count", "n_pages")
        .filter(F.col("n_pages") >= least_pages)
    )
    ratio = F.col("n_pages") / F.col("host_pages")
    return counts.join(sizes, "host").withColumn("ratio", ratio).filter(F.col("ratio") > max_ratio).drop("host_pages")


def drop_boilerplate(
    pages: DataFrame,
    host: Column,
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    least_pages: int = LEAST_PAGES,
    by_content: bool = False,
) -> DataFrame:
    """``pages`` without boilerplate lines in ``text``, with ``n_lines`` and ``n_dropped``; all rows and columns stay.

    Lines are split at newlines and compared as they are. Blank lines are kept.
    Rows with a null host form one host. A null text has no line and stays null;
    a text of which all lines go becomes empty. Repeated rows are pages of their
    own unless ``by_content`` counts near copies once. Input columns named ``n_lines`` or ``n_dropped`` are replaced.
    """
    kept = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    site = F.coalesce(host, F.lit(""))
    told = boilerplate(pages, site, text, max_ratio, least_pages, by_content)
    # Lines of a text are the same wherever it stands, so hits are found and kept by host and content.
    lines = pages.select(
        site.alias("host"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("content"), F.posexplode(_lines(F.col(text)))
    ).select("host", "content", F.col("pos").alias("at"), _digest(F.col("col")).alias("digest"))
    hits = (
        lines.join(told.select("host", "digest"), ["host", "digest"])
        .groupBy("host", "content")
        .agg(F.sort_array(F.collect_set("at")).alias("__at"))
        .select(F.col("host").alias("__host"), F.col("content").alias("__content"), "__at")
    )
    keyed = pages.select(
        *kept, site.alias("__host"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("__content")
    )
    joined = keyed.join(hits, ["__host", "__content"], "left")
    lines_of = _lines(F.col(text))
    cleaned = F.when(F.col("__at").isNull(), F.col(text)).otherwise(
        let(lines_of, lambda x: F.array_join(_without(x, F.col("__at")), "\n"))
    )
    return joined.select(
        *[cleaned.alias(c) if c == text else F.col(c) for c in kept],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines_of)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__at"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _without(items: Column, at: Column) -> Column:
    """``items`` without the sorted positions ``at``: the slices between them, in linear time."""
    ends = F.concat(at, F.array(F.size(items)))
    begins = F.concat(F.array(F.lit(0)), F.transform(at, lambda i: i + 1))
    return F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice(items, b + 1, e - b)))


def visible_lines(html: Column) -> Column:
    """Lines of a page: scripts, styles and comments go, tags end lines, blanks around lines and blank lines go."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    lines = F.split(F.regexp_replace(bare, r"<[^>]*>", "\n"), "\n")
    trimmed = F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")))
    return F.array_join(F.array_remove(trimmed, ""), "\n")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z]+://([^/:?#]+)", 1))


@query(
    "op2_site_lines",
    r"""
    WITH page AS (
        SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z]+://([^/:?#]+)', 1)) AS host,
            regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
                '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'),
                '<[^>]*>', chr(10), 'g'),
                '[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*', chr(10), 'g'), '^\n|\n$', '', 'g') AS text
        FROM pages),
    cut AS (SELECT *, string_split(text, chr(10)) AS lines, count(*) OVER (PARTITION BY host) AS host_pages FROM page),
    line AS (SELECT page_id, host, host_pages, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM cut),
    told AS (
        SELECT host, line FROM line WHERE NOT regexp_matches(line, '^[\x20\x09-\x0D]*$')
        GROUP BY host, host_pages, line
        HAVING count(DISTINCT page_id) >= 4 AND count(DISTINCT page_id) * 1.0 / host_pages > 0.2),
    clean AS (
        SELECT page_id, count(*) AS n_lines, count(told.line) AS n_dropped,
            coalesce(string_agg(line.line, chr(10) ORDER BY pos) FILTER (WHERE told.line IS NULL), '') AS text
        FROM line LEFT JOIN told ON line.host = told.host AND line.line = told.line
        GROUP BY page_id)
    SELECT page_id, cut.host, clean.n_lines, n_dropped, clean.text FROM clean JOIN cut USING (page_id)
    """,
)
def site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        "page_id", host_of(F.col("url")).alias("host"), visible_lines(F.col("html")).alias("text")
    )
    # The lines are read three times; they are taken out of the pages once.
    path = scratch_path(spark, "visible-lines")
    pages.write.parquet(path)
    pages = spark.read.parquet(path)
    return drop_boilerplate(pages, F.col("host")).select("page_id", "host", "n_lines", "n_dropped", "text")
