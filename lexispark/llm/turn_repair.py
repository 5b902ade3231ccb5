"""Repair of conversation structure by cheapest edits, with block tables in the manner of the Four Russians.

A conversation shall be empty, or read ``system? (user assistant)+``. Edits are
Keep, Rerole, Delete and Insert, at the costs below. The state after an edit is
one of four: nothing yet, after system, after user, after assistant. In every
state only one role may be inserted or taken on by a rerole, so the letters of
the edits determine the result.

* **Symbols.** For the costs a turn is one of nine symbols: its role (system,
  user, assistant, other) with or without a truncated text, or "must go".
* **Vectors.** What the rest of a conversation costs from each state is a vector
  of four numbers. States are a few edits apart, so the vector less its least
  entry takes few values. All that can occur are enumerated once.
* **Blocks.** For every vector after a block and every block of ``BLOCK`` symbols
  a table holds the vector before it and what was taken off. A conversation is
  read from its end, a lookup per block.
* **Tracing.** From the front, each block is expanded again backward from the
  vector after it, and of the edits that keep to the least cost the one with the
  least letter is taken. What is left always costs the same from the same state,
  so the first letters that differ decide, and ties are settled right.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexispark.llm.registry import query, table
from lexispark.plans.checkpoints import cut_lineage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Symbols of a block: 9 ** BLOCK columns in the tables.
BLOCK = 4

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: State after a turn of a role in each state; -1 where the role may not follow.
_AFTER = {"s": [_SYSTEM, -1, -1, -1], "u": [_USER, _USER, -1, _USER], "a": [-1, -1, _ASSISTANT, -1], "o": [-1] * 4}
#: The one role that may be put in, and the state after it.
_WANTED, _NEXT = ["user", "user", "assistant", "user"], [_USER, _USER, _ASSISTANT, _USER]
_SYMBOLS = [(role, cut) for role in "suao" for cut in (False, True)] + [("", None)]
_GONE = len(_SYMBOLS) - 1
#: Codes of a turn as stored: role (two bits) and fault (two bits).
_ROLES, _FAULTS = "suao", ("none", "blank", "duplicate", "truncated")
_OTHER = 10**6


def _insertions(costs: list[int]) -> list[int]:
    """Least costs when turns may be put in first."""
    out = list(costs)
    for _ in range(4):
        out = [min(c, INSERT + out[_NEXT[q]]) for q, c in enumerate(out)]
    return out


def _choices(symbol: int, after: list[int]) -> list[list[tuple[str, int, int]]]:
    """For each state what may be done with the turn: letter, cost with all that follows, state."""
    role, cut = _SYMBOLS[symbol]
    out = []
    for q in range(4):
        found = [("D", DELETE + after[q], q)]
        if symbol != _GONE:
            more = TRUNCATED if cut else 0
            if _AFTER[role][q] >= 0:
                found.append(("K", KEEP + more + after[_AFTER[role][q]], _AFTER[role][q]))
            found.append(("R", REROLE + more + after[_NEXT[q]], _NEXT[q]))
        out.append(found)
    return out


def _before(symbol: int, after: list[int]) -> list[int]:
    return _insertions([min(c for _, c, _ in x) for x in _choices(symbol, after)])


@dataclass(frozen=True)
class Tables:
    vectors: list[tuple[int, ...]]  # normalised costs; the first is that of the end
    single: np.ndarray  # vector before a symbol, by vector and symbol
    single_off: np.ndarray
    block: np.ndarray  # the same for blocks, the first symbol being the highest digit
    block_off: np.ndarray
    steps: list  # by vector after, symbol, state: letters, state
    tail: list[str]  # letters at the end by state


@lru_cache(maxsize=1)
def tables() -> Tables:
    end = _insertions([0, _OTHER, _OTHER, 0])
    tail = []
    for q in range(4):
        letters = ""
        while end[q] and INSERT + end[_NEXT[q]] == end[q]:
            letters, q = letters + "I", _NEXT[q]
        tail.append(letters)
    vectors, number, single, off, k = [tuple(end)], {tuple(end): 0}, [], [], 0
    while k < len(vectors):
        row, row_off = [], []
        for s in range(len(_SYMBOLS)):
            costs = _before(s, list(vectors[k]))
            least = min(costs)
            key = tuple(c - least for c in costs)
            if key not in number:
                number[key] = len(vectors)
                vectors.append(key)
            row.append(number[key])
            row_off.append(least)
        single.append(row)
        off.append(row_off)
        k += 1
    one, one_off = np.array(single), np.array(off)
    block, block_off = one, one_off
    for _ in range(BLOCK - 1):  # one more symbol in front: the highest digit
        before = one[block].transpose(0, 2, 1).reshape(len(vectors), -1)
        more = one_off[block].transpose(0, 2, 1) + block_off[:, None, :]
        block, block_off = before, more.reshape(len(vectors), -1)
    steps = [[[_step(s, list(v), q) for q in range(4)] for s in range(len(_SYMBOLS))] for v in vectors]
    return Tables(vectors, one, one_off, block, block_off, steps, tail)


def _step(symbol: int, after: list[int], q: int) -> tuple[str, int]:
    """Least letters among the cheapest for one turn from state ``q``, with the turns put in before it."""
    choices, least, letters = _choices(symbol, after), _before(symbol, after), ""
    while True:
        fits = {letter: to for letter, c, to in choices[q] if c == least[q]}
        if "D" in fits:
            return letters + "D", fits["D"]
        if INSERT + least[_NEXT[q]] == least[q]:
            letters, q = letters + "I", _NEXT[q]
            continue
        letter = min(fits)
        return letters + letter, fits[letter]


@lru_cache(maxsize=200_000)
def _expanded(after: int, block: tuple[int, ...], q: int) -> tuple[str, int]:
    """Letters of a block from state ``q``, given the vector after it, and the state after it."""
    t = tables()
    behind = [after]
    for s in reversed(block[1:]):
        behind.append(int(t.single[behind[-1], s]))
    letters = []
    for s, v in zip(block, reversed(behind), strict=True):
        x, q = t.steps[v][s][q]
        letters.append(x)
    return "".join(letters), q


def cheapest_edits(symbols: bytes) -> tuple[int, str]:
    """Cost and letters of the cheapest edits, the least letters among equals."""
    t = tables()
    lead = len(symbols) % BLOCK
    digits = np.frombuffer(symbols, np.uint8).astype(np.int64)
    codes = digits[lead:].reshape(-1, BLOCK) @ (len(_SYMBOLS) ** np.arange(BLOCK - 1, -1, -1))
    v, cost, behind = 0, 0, np.zeros(len(codes), np.int32)
    for i in range(len(codes) - 1, -1, -1):
        behind[i] = v
        cost += int(t.block_off[v, codes[i]])
        v = int(t.block[v, codes[i]])
    first = [v]
    for s in reversed(symbols[:lead]):
        cost += int(t.single_off[first[-1], s])
        first.append(int(t.single[first[-1], s]))
    cost += t.vectors[first[-1]][_START]
    q, letters = _START, []
    for s, after in zip(symbols[:lead], reversed(first[:-1]), strict=True):
        x, q = t.steps[after][s][q]
        letters.append(x)
    for i, after in enumerate(behind.tolist()):
        x, q = _expanded(after, tuple(symbols[lead + i * BLOCK : lead + (i + 1) * BLOCK]), q)
        letters.append(x)
    return cost, "".join(letters) + t.tail[q]


_CODE_TO_SYMBOL = bytes(
    _GONE if fault in (1, 2) else 2 * role + (fault == 3) for role in range(4) for fault in range(4)
) + bytes(240)


def _report(codes: bytes) -> tuple[int, ...]:
    """Counts of blank, duplicate, truncated turns and of neighbours that may not follow one another."""
    x = np.frombuffer(codes, np.uint8)
    faults = np.bincount(x & 3, minlength=4)
    pair = (x[:-1] >> 2) * 4 + (x[1:] >> 2)
    fine = [_ROLES.index(a) * 4 + _ROLES.index(b) for a, b in ("su", "ua", "au")]
    return int(faults[1]), int(faults[2]), int(faults[3]), int((~np.isin(pair, fine)).sum())


_BLANKS = r"[\x20\x09-\x0D]"


def _fault(text: Column) -> Column:
    """0 none, 1 blank, 3 truncated: the last character that is no blank ends no sentence."""
    bare = F.rtrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", 1).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(3)


def _initial(role: Column) -> Column:
    found = F.substring(role, 1, 1)
    return F.when(found == "s", 0).when(found == "u", 1).when(found == "a", 2).otherwise(3)


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Equal turns as one row with their number; ``place`` orders turns of one number by role and digest of the text."""
    said, who = F.coalesce(F.col(text), F.lit(" ")), F.coalesce(F.col(role), F.lit(" "))
    return conversations.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), who.alias("role"),
        F.md5(said).alias("digest"), said.alias("text"),
    )


def audit(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost and the letters of the cheapest edits.

    Turns are taken by number (nulls first), then by role and the md5 of the
    text. A null role or text is one space, a null id is a conversation of its own;
    a role other than system, user, assistant by its first letter must be
    reroled or deleted. Other columns are not used.

    The texts are read once and not shuffled: digests and flags are. Equal turns
    are counted before the shuffle, the first of equal texts is found by an
    aggregate, and each turn meets it under its own key, so no hot text or
    conversation is a hot key there. The turns of a conversation then stream through
    one task in order; a byte is held for each, as for each letter of the result.
    """
    rows = _turns(conversations, conv, turn, role, text)
    narrow = rows.groupBy("conv", "turn", "role", "digest").agg(
        F.count("*").alias("n"), F.first(_fault(F.col("text"))).alias("fault")
    )
    # A struct with null orders first, as a null turn does.
    first = narrow.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    first = first.select(*[F.col(c).alias(f"f_{c}") for c in ("conv", "role", "digest")], F.col("first.turn").alias("f_turn"))
    same = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in ("conv", "turn", "role", "digest")]
    marked = narrow.join(first, same[0] & same[1] & same[2] & same[3], "left").select(
        "conv", "turn", "role", "digest", "n",
        (_initial(F.col("role")) * 4).cast("int").alias("who"), "fault", F.col("f_role").isNotNull().alias("is_first"),
    )
    ordered = marked.repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest")

    def run(batches):
        for convs in _grouped(batches, _append_codes):
            out = []
            for key, (codes, gaps, _) in convs:
                cost, letters = cheapest_edits(bytes(codes).translate(_CODE_TO_SYMBOL))
                out.append((key, gaps, *_report(bytes(codes)), cost, letters))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), _AUDIT_TYPES, strict=True)], names=_AUDIT_NAMES
            )

    found = ordered.select("conv", "turn", "n", "who", "fault", "is_first").mapInArrow(
        run, "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    )
    return found.withColumnRenamed("conv", conv)


_AUDIT_NAMES = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_AUDIT_TYPES = [pa.int64()] * 7 + [pa.string()]


def _append_codes(state, turn, n, who, fault, is_first):
    """Add the codes of ``n`` equal turns and the gap before them."""
    codes, gaps, last = state or (bytearray(), 0, None)
    if fault == 1:
        codes.extend(bytes([who + 1]) * n)
    else:
        codes.extend(bytes([who + fault]) if is_first else bytes([who + 2]))
        codes.extend(bytes([who + 2]) * (n - 1))
    if turn is not None:
        if last is not None and turn > last:
            gaps += turn - last - 1
        last = turn
    return codes, gaps, last


def _grouped(batches, add):
    """Lists of finished (key, state) from rows in order of their first column."""
    missing = object()
    key, state = missing, None
    for batch in batches:
        done = []
        for k, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if k != key:
                if key is not missing:
                    done.append((key, state))
                key, state = k, None
            state = add(state, *rest)
        if done:
            yield done
    if key is not missing:
        yield [(key, state)]


def repaired(
    conversations: DataFrame, audits: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The repaired turns: ``conv``, ``position`` (from 0), ``role``, ``text``, ``edit``; those put in have empty texts.

    ``audits`` is what ``audit`` gives for the same conversations. The letters of
    a conversation go ahead of its turns, and both stream through one task in
    order of the conversation: rows come out sorted by conversation and position.
    """
    rows = _turns(conversations, conv, turn, role, text).withColumn("head", F.lit(1))
    heads = audits.select(
        F.col(conv).alias("conv"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.lit("").alias("digest"), F.col("audit").alias("text"), F.lit(0).alias("head"),
    )
    both = rows.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "head", "turn", "role", "digest")
    found = both.select("conv", "head", "role", "text").mapInArrow(
        _apply_letters, "conv long, position long, role string, text string, edit string"
    )
    return found.withColumnRenamed("conv", conv)


def _apply_letters(batches):
    key, letters, at, q, position = None, "", 0, _START, 0
    out: list[tuple] = []

    def put(who, said, edit):
        nonlocal position
        out.append((key, position, who, said, edit))
        position += 1

    def put_in():
        nonlocal at, q
        while at < len(letters) and letters[at] == "I":
            put(_WANTED[q], "", "I")
            q, at = _NEXT[q], at + 1

    for batch in batches:
        # Texts are read one by one: a batch may hold many long ones.
        narrow = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        texts, held = batch.column(3), 0
        for i, (k, head, who) in enumerate(narrow):
            said = texts[i].as_py()
            if head == 0:
                key, letters, at, q, position = k, said, 0, _START, 0
                continue
            put_in()
            if letters[at] == "R":
                put(_WANTED[q], said, "R")
                q = _NEXT[q]
            elif letters[at] == "K":
                put(who, said, "K")
                q = _AFTER[who[0]][q]
            at += 1
            if len(letters) - at <= 2 and set(letters[at:]) == {"I"}:  # no turn is left
                put_in()
            held += len(said)
            if held > 4_000_000:
                yield _arrow(out)
                out.clear()
                held = 0
        if out:
            yield _arrow(out)
            out.clear()


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["conv", "position", "role", "text", "edit"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types, strict=True)], names=names)


def line_digests(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``conv``, ``repaired_sha256``: sha256 of the lines ``role:text`` of every conversation, joined by newlines.

    ``turns`` come as ``repaired`` gives them, in order inside their partition.
    A digest runs over a conversation from its begin to its end, in one task that holds a line at a time.
    """
    def add(state, line):
        if state is None:
            return hashlib.sha256(line.encode())
        state.update(b"\n")
        state.update(line.encode())
        return state

    def run(batches):
        for done in _grouped(batches, add):
            keys, states = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([x.hexdigest() for x in states])], names=["conv", "sha"]
            )

    lines = turns.select(F.col(conv), F.concat("role", F.lit(":"), "text"))
    found = lines.mapInArrow(run, "conv long, sha string")
    return found.select(F.col("conv").alias(conv), F.col("sha").alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of id and turn: see the cases; nulls are one space."""
    blank = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        F.pmod(F.crc32(name.cast("binary")), F.lit(20)).alias("case"),
    )
    case = F.col("case")
    return rows.filter("case <> 0").select(
        "conv_id", "turn", F.when(case == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(case == 1, "").when(case == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(case == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


@query("op11_turn_repair")
def turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    damaged = damage(conversations)
    audits = cut_lineage(audit(damaged))
    digests = line_digests(repaired(damaged, audits))
    said = audits.join(digests.withColumnRenamed("conv_id", "d"), F.col("conv_id").eqNullSafe(F.col("d")), "left")
    said = said.withColumnRenamed("conv_id", "c")
    all_ids = conversations.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_ids.join(said, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
