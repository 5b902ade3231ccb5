"""SQL text shared by the oracles. The engine that runs them reads no escapes in string literals."""

from __future__ import annotations

from lexispark.functions.alphabets import SENTENCE_START, WEST_EUROPEAN_MARKED

WSC = r"[ \t\n\x0B\f\r]"


def trim_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def charset_ok(x: str, charset: str, window: int) -> str:
    return (
        f"(NOT regexp_matches(lower({x}), '(?s)[^{charset}]{{{window}}}') AND (length({x}) >= {window} "
        f"OR regexp_matches(lower({x}), '[{charset}]') OR length({x}) = 0))"
    )


CLEAN_LINES = (
    "array_to_string(list_filter(string_split_regex(text, chr(10) || '+'), lambda l: length(l) BETWEEN 40 AND 2048 "
    f"AND {trim_sql('l')} <> '' AND {charset_ok('l', WEST_EUROPEAN_MARKED, 40)}), chr(10))"
)

# Paragraphs of a relation `src(doc_id, text)`.
PARTS = f"""(
  SELECT doc_id, i AS line_id, {trim_sql('ps[i]')} AS part
  FROM (SELECT doc_id, string_split_regex(text, chr(10) || '+') AS ps,
               unnest(range(1, len(string_split_regex(text, chr(10) || '+')) + 1)) AS i FROM src))"""


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WSC}+'), lambda w: w <> '')"


def sentences_sql(x: str) -> str:
    flat = f"regexp_replace(replace({x}, chr(160), ' '), '{WSC}+', ' ', 'g')"
    marked = (
        rf"regexp_replace({flat}, '((?:[.?!…;:+-]+|[abcdef]\)) +[\"“]?)([{SENTENCE_START}])', "
        r"'\1' || chr(10) || '\2', 'g')"
    ).replace('\\"', '"')
    return (
        f"list_filter(list_transform(string_split({marked}, chr(10)), lambda s: {trim_sql('s')}), "
        "lambda s: s <> '')"
    )


def numbered(inner_list: str, columns: str, source: str, item: str, index: str = "i") -> str:
    """Rows (columns, index starting at 1, item) of a list column."""
    return f"""(
      SELECT {columns}, {index}, ls[{index}] AS {item}
      FROM (SELECT {columns}, ls, unnest(range(1, len(ls) + 1)) AS {index}
            FROM (SELECT {columns}, {inner_list} AS ls FROM {source})))"""
