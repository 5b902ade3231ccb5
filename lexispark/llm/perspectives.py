"""Chat formatting with every participant as the assistant in turn, and masks for what that speaker says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexispark.llm.registry import query, table
from lexispark.plans.blocked import row_numbers

#: Turns in one output row; longer conversations continue in the next part.
PART_TURNS = 256
#: Roles that instruct and never are the speaker to be learnt.
FIXED_ROLES = ("system",)

_END = "<|end|>\n"


def _header(role: Column, perspective: Column, fixed: tuple[str, ...]) -> Column:
    return (
        F.when(role == perspective, F.lit("<|assistant|>\n"))
        .when(role.isin(*fixed), F.concat(F.lit("<|"), role, F.lit("|>\n")))
        .otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    )


def rotate(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    part_turns: int = PART_TURNS,
    fixed_roles: tuple[str, ...] = FIXED_ROLES,
) -> DataFrame:
    """One row per conversation, participant and part: the dialogue as that participant's training text.

    Columns: ``conv``, ``perspective``, ``part``, ``n_turns``, ``n_own`` (turns
    of the assistant), ``rendered`` and ``mask``, the spans of ``rendered``
    (begin, end, in characters) that are learnt: what the assistant says, with
    its end mark. Parts hold ``part_turns`` turns each, so a conversation of any
    length never meets in one row; their texts follow one another.

    Turns are ordered by number, role and text; equal rows count once. A null
    number comes first, a null role is "unknown", a null text is empty. Rows
    with a null conversation id form one conversation. Conversations of fixed
    roles only give no row. Other input columns are not used.
    """
    rows = turns.select(
        F.struct(F.col(conv)).alias("key"),
        F.coalesce(F.col(turn).cast("long"), F.lit(-(2**62))).alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).distinct()
    numbered = row_numbers(
        rows, ["key"], ["turn", "role", "text"], F.floor(F.col("turn") / part_turns), "number", start=0
    )
    said = F.struct("number", "role", "text")
    parts = numbered.groupBy("key", F.floor(F.col("number") / part_turns).alias("part")).agg(
        F.sort_array(F.collect_list(said)).alias("said")
    )
    people = rows.filter(~F.col("role").isin(*fixed_roles)).select("key", F.col("role").alias("perspective")).distinct()
    me = F.col("perspective")
    pieces = F.transform(
        F.col("said"),
        lambda x: F.struct(
            (x["role"] == me).alias("own"),
            F.char_length(_header(x["role"], me, fixed_roles)).alias("head"),
            F.concat(_header(x["role"], me, fixed_roles), x["text"], F.lit(_END)).alias("piece"),
        ),
    )
    rendered = parts.join(people, "key").withColumn("pieces", pieces)
    no_span = F.array().cast("array<struct<begin:int,end:int>>")

    def step(state: Column, x: Column) -> Column:
        end = state["at"] + F.char_length(x["piece"])
        span = F.struct((state["at"] + x["head"]).alias("begin"), end.alias("end"))
        return F.struct(
            end.alias("at"),
            F.when(x["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    start = F.struct(F.lit(0).alias("at"), no_span.alias("spans"))
    return rendered.select(
        F.col("key")[conv].alias(conv),
        "perspective",
        F.col("part").cast("long").alias("part"),
        F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda x: x["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("rendered"),
        F.aggregate("pieces", start, step, lambda s: s["spans"]).alias("mask"),
    )


@query(
    "op10_perspectives",
    """
    WITH said AS (
        SELECT DISTINCT conv_id, coalesce(turn, -4611686018427387904) AS turn, coalesce(role, 'unknown') AS role,
            coalesce(text, '') AS text FROM conversations),
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS number FROM said),
    seen AS (
        SELECT n.*, p.role AS perspective, number // 256 AS part,
            CASE WHEN n.role = p.role THEN '<|assistant|>' WHEN n.role = 'system' THEN '<|system|>'
                ELSE '<|user name=' || n.role || '|>' END || chr(10) AS head
        FROM numbered n JOIN (SELECT DISTINCT conv_id, role FROM said WHERE role <> 'system') p USING (conv_id)),
    placed AS (
        SELECT *, head || text || '<|end|>' || chr(10) AS piece,
            sum(length(head || text || '<|end|>' || chr(10))) OVER (
                PARTITION BY conv_id, perspective, part ORDER BY number) AS ends FROM seen)
    SELECT conv_id, perspective, part, count(*) AS n_turns,
        count(*) FILTER (WHERE role = perspective) AS n_own,
        string_agg(piece, '' ORDER BY number) AS rendered,
        coalesce(string_agg((ends - length(piece) + length(head)) || '-' || ends, ',' ORDER BY number)
            FILTER (WHERE role = perspective), '') AS mask
    FROM placed GROUP BY conv_id, perspective, part
    """,
)
def perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string")))
    return out.withColumn("mask", F.array_join(spans, ","))
