"""File readers and writers. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexispark.functions import text as tx


def read_jsonl(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """JSON Lines of a folder and its subfolders, optionally by file-name pattern."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.json(path)
    return df.select(*columns) if columns else df


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON value each, over many lines; broken records become nulls."""
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True)
        .json(path)
    )


def tokenize_to_json(
    df: DataFrame, out: str, column: str = "text", keep: list[str] | None = None, output: str = "tokens", files: int = 8
) -> None:
    """The corpus tokenization job: JSON files with one row per text, its sentences as lines of words between blanks.

    ``keep`` names the columns that go along. Null texts stay null. Rows are dealt
    over ``files`` files; an earlier result in ``out`` is replaced.
    """
    lines = F.transform(tx.sentences(F.col(column)), lambda s: F.array_join(tx.words(s), " "))
    told = df.select(*(keep or []), F.array_join(lines, "\n").alias(output))
    told.repartition(files).write.mode("overwrite").option("ignoreNullFields", False).json(out)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(path)


def read_blank_line_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per block of lines; blocks are separated by blank lines."""
    blocks = spark.read.option("lineSep", "\n\n").option("recursiveFileLookup", True).text(path)
    body = F.regexp_replace("value", r"^\n+|\n+$", "")
    return blocks.select(body.alias("text")).filter("text <> ''")


def read_paragraph_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per paragraph of every file, cut at runs of line ends."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .text(path)
        .select(F.col("value").alias("paragraph"))
        .filter("paragraph <> ''")
    )


def read_category_lines(spark: SparkSession, path: str) -> DataFrame:
    """`category<TAB>content` lines, cut at the first tab."""
    parts = F.split("value", "\t", 2)
    return read_lines(spark, path).select(F.get(parts, F.lit(0)).alias("category"), F.get(parts, F.lit(1)).alias("content"))


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ";", header: bool = True) -> DataFrame:
    """Delimited text without the rows that miss a value."""
    return spark.read.schema(schema).csv(path, sep=sep, header=header, escape='"', multiLine=False).na.drop()


def read_token_blocks(spark: SparkSession, path: str, columns: list[str], sep: str = r"[\t ]+") -> DataFrame:
    """Blocks of token lines to one array per column: word and label, four columns, or words alone."""
    lines = F.filter(F.split("text", "\n"), lambda s: s != "")
    cells = F.transform(lines, lambda s: F.split(s, sep))
    return read_blank_line_documents(spark, path).select(
        *[F.transform(cells, lambda c: F.get(c, F.lit(i))).alias(name) for i, name in enumerate(columns)]
    )


# The columns of the ten-column tree format.
TREE_COLUMNS = ["id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Ten-column trees: comments and tokens without a head are skipped, blanks in words become `_`.

    A ROOT token stands first in every array.
    """
    lines = F.filter(F.split("text", "\n"), lambda s: (s != "") & ~F.startswith(s, F.lit("#")))
    cells = F.filter(
        F.transform(lines, lambda s: F.split(s, r"\t+")), lambda c: F.get(c, F.lit(TREE_COLUMNS.index("head"))) != "_"
    )

    def column(name: str, root: str) -> Column:
        i = TREE_COLUMNS.index(name)
        value = lambda c: F.replace(F.get(c, F.lit(i)), F.lit(" "), F.lit("_")) if name == "form" else F.get(c, F.lit(i))
        return F.concat(F.array(F.lit(root)), F.transform(cells, value)).alias(name)

    return read_blank_line_documents(spark, path).select(
        column("id", "0"), column("form", "ROOT"), column("upos", "ROOT"), column("head", "-1"), column("deprel", "NA")
    )


def parse_fixed_tail(df: DataFrame, line: str = "value", flags: int = 22) -> DataFrame:
    """`id,"text",f1,...,fn` lines: id up to the first comma, flags in the last 2n-1 characters, text between."""
    c = F.col(line)
    tail = 2 * flags - 1
    comma = F.locate(",", c)
    text = F.substring(c, comma + 1, F.length(c) - comma - tail - 1)
    marks = F.split(F.right(c, F.lit(tail)), ",")
    on = F.filter(F.transform(marks, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda m: m["x"] == "1")
    return df.select(
        F.substring(c, F.lit(1), comma - 1).alias("id"),
        F.regexp_replace(text, '^"|"$', "").alias("text"),
        F.transform(on, lambda m: m["i"]).alias("labels"),
    ).filter("id <> 'id'")


def read_xml_records(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def write_gzip_json(df: DataFrame, path: str, files: int) -> None:
    """A fixed number of compressed files; never one file for a large table."""
    df.repartition(files).write.mode("overwrite").option("compression", "gzip").json(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


# ---- line formats: one string column each, written with write.text --------------------------


def labelled_line(labels: Column, text: Column, width: int = 2) -> Column:
    """`label<TAB>...<TAB>text` with NA for missing labels."""
    filled = F.slice(F.concat(labels, F.array_repeat(F.lit("NA"), width)), 1, width)
    return F.concat_ws("\t", filled, tx.one_line(text))


def prefixed_line(labels: Column, text: Column) -> Column:
    """`__label__ ... text`."""
    marks = F.transform(labels, lambda a: F.concat(F.lit("__"), a, F.lit("__")))
    return F.concat(F.array_join(marks, " "), F.lit(" "), tx.one_line(text))


def token_lines(tokens: Column, labels: Column) -> Column:
    """`token label` lines of one sentence."""
    return F.array_join(F.zip_with(tokens, labels, lambda t, l: F.concat_ws(" ", t, l)), "\n")


def joint_token_lines(tokens: Column, labels: Column, acts: Column) -> Column:
    """Token lines followed by `EOS act` lines, two at most, NA when there is none."""
    kept = F.when(F.size(acts) == 0, F.array(F.lit("NA"))).otherwise(F.slice(acts, 1, 2))
    ends = F.array_join(F.transform(kept, lambda a: F.concat(F.lit("EOS "), a)), "\n")
    return F.concat_ws("\n", token_lines(tokens, labels), ends)


def aligned_predictions(tokens: Column, pred: Column, default: str) -> Column:
    """Predictions cut or filled with the default label to the number of tokens."""
    return F.slice(F.concat(pred, F.array_repeat(F.lit(default), F.size(tokens))), F.lit(1), F.size(tokens))


# ---- nested dialogues -----------------------------------------------------------------------

DIALOGUE_SCHEMA = (
    "dialogue_id string, part bigint, services array<string>, turns array<struct<turn_id: string, speaker: string, "
    "utterance: string, frames: array<struct<service: string, slot_values: map<string, array<string>>>>>>"
)
ACT_SCHEMA = (
    "map<string, map<string, struct<dialog_act: map<string, array<array<string>>>, span_info: array<array<string>>>>>"
)


def dialogue_turns(dialogues: DataFrame) -> DataFrame:
    return dialogues.select("dialogue_id", F.explode("turns").alias("t")).select(
        "dialogue_id", F.col("t.turn_id").alias("turn_id"), F.col("t.utterance").alias("utterance")
    )


def dialogue_states(dialogues: DataFrame) -> DataFrame:
    """Turns with the frames of the dialogue's own services."""
    kept = lambda t: F.filter(t["frames"], lambda f: F.array_contains("services", f["service"]))
    rows = F.transform(
        "turns",
        lambda t: F.struct(t["turn_id"].alias("turn_id"), t["speaker"].alias("speaker"), kept(t).alias("frames")),
    )
    return dialogues.select("dialogue_id", F.inline(rows))


def dialogue_acts(lines: DataFrame, col: str = "value") -> DataFrame:
    """Nested act maps to rows; offsets that are no numbers become null."""
    parsed = F.from_json(col, ACT_SCHEMA)
    acts = lines.select(F.explode(parsed).alias("dialogue_id", "turns")).select(
        "dialogue_id", F.explode("turns").alias("turn_id", "a")
    )
    span = lambda s: F.struct(
        F.get(s, F.lit(0)).alias("act"),
        F.get(s, F.lit(1)).alias("slot"),
        F.get(s, F.lit(2)).alias("value"),
        F.get(s, F.lit(3)).try_cast("int").alias("start"),
        F.get(s, F.lit(4)).try_cast("int").alias("end"),
    )
    return acts.select(
        "dialogue_id",
        F.col("turn_id").cast("int").alias("turn_id"),
        F.map_keys("a.dialog_act").alias("acts"),
        F.transform("a.span_info", span).alias("spans"),
    )
