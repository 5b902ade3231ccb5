"""Dialogue turns, acts, runs and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexispark.functions import text as tx
from lexispark.operators.tokens import match_rows
from lexispark.plans.blocked import neighbours, running_sum

# Tokens are what stands between these marks and white space.
TOKEN = r"[^?.,! \t\n\x0B\f\r]+"


def turn_block(turn: str, turns_per_block: int = 512) -> Column:
    return F.floor(F.col(turn) / turns_per_block)


def normalize_acts(names: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(names, F.upper)))


def previous_context(df: DataFrame, dialog: str, turn: str, acts: str, depth: int = 3) -> DataFrame:
    """``prev_acts``: the acts of the ``depth`` turns before, oldest first, as one string."""
    wanted = {f"__back{k}": (acts, k) for k in range(depth, 0, -1)}
    out = neighbours(df, [dialog], [turn], turn_block(turn), wanted)
    return out.withColumn("prev_acts", F.concat_ws(" ", *wanted)).drop(*wanted)


def act_graph(df: DataFrame, dialog: str, turn: str, acts: str) -> DataFrame:
    """``src, dst, n``: how often an act follows another in the next turn."""
    pairs = neighbours(df.select(dialog, turn, acts), [dialog], [turn], turn_block(turn), {"before": (acts, 1)})
    return (
        pairs.select(F.explode("before").alias("src"), acts)
        .select("src", F.explode(acts).alias("dst"))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def act_degrees(edges: DataFrame) -> DataFrame:
    """Out-fan and in-fan of every node."""
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    return edges.select(F.inline(ends)).groupBy("node").agg(F.sum("o").alias("out_fan"), F.sum("i").alias("in_fan"))


def number_runs(df: DataFrame, keys: list[str], order: list[str], block: Column, label: str) -> DataFrame:
    """Add ``run_no``: consecutive rows with one label share a number."""
    marked = neighbours(df.withColumn("__b", block), keys, order, "__b", {"__before": (label, 1)})
    change = (~F.col("__before").eqNullSafe(F.col(label))).cast("bigint")
    return running_sum(marked, keys, order, "__b", change, "run_no").drop("__before", "__b")


def merge_runs(
    df: DataFrame, keys: list[str], order: list[str], block: Column, label: str, start: str, end: str, text: str
) -> DataFrame:
    """Consecutive turns of one speaker as one: first start, last end, texts joined by a bar."""
    runs = number_runs(df, keys, order, block, label)
    rows = F.array_sort(F.collect_list(F.struct(*order, F.trim(text).alias("__text"))))
    said = F.filter(F.col("rows.__text"), lambda t: t != "")
    return (
        runs.groupBy(*keys, "run_no", label)
        .agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"), rows.alias("rows"))
        .withColumn("text", F.array_join(said, "|"))
        .drop("rows")
    )


def speaker_text(df: DataFrame, dialog: str, order: str, speaker: str, who: str, text: str) -> DataFrame:
    """Everything one speaker says in a dialogue, joined by bars."""
    said = F.trim(text)
    return (
        df.filter((F.col(speaker) == who) & (said != ""))
        .groupBy(dialog)
        .agg(F.array_sort(F.collect_list(F.struct(order, said.alias("t")))).alias("rows"))
        .select(dialog, F.array_join(F.col("rows.t"), "|").alias("text"))
    )


def merge_spans(df: DataFrame, keys: list[str], label: str = "label", max_gap: int = 1) -> DataFrame:
    """Join neighbouring spans of one label that lie at most ``max_gap`` characters apart."""
    in_doc = W.partitionBy(*keys).orderBy("start", "end")
    joins = (F.col(label) == F.lag(label).over(in_doc)) & (
        F.col("start") - F.lag("end").over(in_doc)
    ).between(0, max_gap)
    opens = F.when(joins, 0).otherwise(1)
    return (
        df.withColumn("__opens", opens)
        .withColumn("span_no", F.sum("__opens").over(in_doc.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "span_no", label)
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )


def bio_from_spans(df: DataFrame, keys: list[str], utterance: str, spans: str) -> DataFrame:
    """``tokens`` and ``labels`` of every utterance.

    ``spans`` is an array of (start, end, slot) per utterance. A token whose
    start lies in a span gets B- when it is the first one there, else I-.
    """
    in_row = W.partitionBy(*keys).orderBy("match_no")
    tokens = (
        match_rows(df, keys, utterance, TOKEN)
        .withColumn("prev", F.coalesce(F.lag("start").over(in_row), F.lit(-1)))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("start", "prev", "match"))).alias("toks"))
    )

    def label(t: Column) -> Column:
        hit = F.get(F.filter(F.col(spans), lambda s: (t["start"] >= s["start"]) & (t["start"] < s["end"])), F.lit(0))
        mark = F.when(t["prev"] < hit["start"], "B-").otherwise("I-")
        return F.coalesce(F.concat(mark, F.upper(hit["slot"])), F.lit("O"))

    return tokens.join(df.select(*keys, spans), keys).select(
        *keys, F.col("toks.match").alias("tokens"), F.transform("toks", label).alias("labels")
    )


def spans_from_bio(df: DataFrame, keys: list[str], labels: str = "labels") -> DataFrame:
    """``keys, start, end, type`` in token positions; an I- without a B- before it is no span."""
    in_row = W.partitionBy(*keys).orderBy("pos")
    rows = df.select(*keys, F.posexplode(labels).alias("pos", "label"))
    return (
        rows.withColumn(
            "run", F.sum((~F.startswith("label", F.lit("I-"))).cast("int")).over(in_row.rowsBetween(W.unboundedPreceding, 0))
        )
        .groupBy(*keys, "run")
        .agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.min(F.struct("pos", "label")).alias("first"))
        .filter(F.startswith(F.col("first.label"), F.lit("B-")))
        .select(*keys, "start", "end", F.expr("substring(first.label, 3)").alias("type"))
    )


def group_slots(items: Column) -> Column:
    """`key:value` strings to a map of value lists, in order."""
    pairs = F.transform(items, lambda s: F.struct(
        F.trim(F.get(F.split(s, ":"), F.lit(0))).alias("k"),
        F.trim(F.coalesce(F.get(F.split(s, ":"), F.lit(1)), F.lit(""))).alias("v"),
    ))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(
        F.transform(
            keys,
            lambda k: F.struct(k, F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])),
        )
    )


def between_markers(df: DataFrame, col: str, start: str, stop: str, name: str = "entity") -> DataFrame:
    """Distinct lower-cased text between a leading marker and the next one."""
    c = F.col(col)
    at = F.locate(stop, c)
    rows = df.filter(F.startswith(c, F.lit(start)) & (at > len(start)))
    inner = F.substring(c, F.lit(len(start) + 1), F.locate(stop, c) - len(start) - 1)
    return rows.select(F.lower(tx.trim_ws(inner)).alias(name)).distinct()


def majority(values: Column, empty: str = "NA") -> Column:
    """The most frequent element of an array; on ties the smallest."""
    counted = F.transform(
        F.array_distinct(values),
        lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("c"), v.alias("v")),
    )
    return F.coalesce(F.array_min(counted)["v"], F.lit(empty))


def majority_vote(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group; on ties the smallest."""
    return (
        df.groupBy(group, value)
        .agg(F.count("*").alias("c"))
        .groupBy(group)
        .agg(F.min(F.struct((-F.col("c")).alias("c"), F.col(value))).alias("best"), F.sum("c").alias("n_votes"))
        .select(group, F.col(f"best.{value}").alias(value), (-F.col("best.c")).alias("votes"), "n_votes")
    )


def after_colon(c: Column) -> Column:
    """Drop a leading `prefix:`."""
    at = F.locate(":", c)
    return F.when(at > 0, tx.trim_ws(F.substring(c, at + 1, F.length(c)))).otherwise(c)


def quoted_list(c: Column) -> Column:
    """`['a', 'b']` to an array of strings."""
    body = c
    for old, new in (("', ", '", '), (", '", ', "'), ("['", '["'), ("']", '"]')):
        body = F.replace(body, F.lit(old), F.lit(new))
    return F.from_json(body, "array<string>")


def keyword_vector(c: Column, keywords: list[str]) -> Column:
    return F.array(*[F.contains(c, F.lit(k)).cast("int") for k in keywords])


def code_of(c: Column, codes: dict[str, int]) -> Column:
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.element_at(F.create_map(*pairs), c)
