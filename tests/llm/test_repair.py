"""Conversation repair against a search over all edits, turn by turn."""

import random
import re
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import pytest

from lexispark.llm import turn_repair
from lexispark.llm.turn_repair import audit, cheapest_edits, repaired, tables

BLANKS = " \t\n\x0b\f\r"


def brute_edits(rows):
    """Least (cost, letters, result) over edits of (role, text, fault); inserts are tried wherever they may help."""
    def follows(last, role):
        return role in {"": "su", "s": "u", "u": "a", "a": "u"}[last]

    @lru_cache(maxsize=None)
    def best(i, last, put_in):
        out = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if i < len(rows):
            role, text, fault = rows[i]
            c, x, r = best(i + 1, last, 0)
            out.append((c + 4, "D" + x, r))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] in ("s", "u", "a") and follows(last, role[0]):
                    c, x, r = best(i + 1, role[0], 0)
                    out.append((c + more, "K" + x, (f"{role}:{text}", *r)))
                for new in ("user", "assistant"):
                    if follows(last, new[0]):
                        c, x, r = best(i + 1, new[0], 0)
                        out.append((c + more + 3, "R" + x, (f"{new}:{text}", *r)))
        for new in ("user", "assistant"):  # three in a row never help: two of them make a whole pair
            if follows(last, new[0]) and put_in < 3:
                c, x, r = best(i, new[0], put_in + 1)
                out.append((c + 3, "I" + x, (f"{new}:", *r)))
        return min(out, key=lambda o: o[:2], default=(10**6, "~", ()))

    return best(0, "", 0)


def brute_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(BLANKS)
        if not bare.strip(BLANKS):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "none" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        case = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case == 1:
            text = ""
        elif case == 2:
            text = re.sub("[.!?]", "", text)
        elif case == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def brute_query(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for r in brute_damage(rows):
        convs[r[0]].append(r)
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        numbers = [r[1] for r in turns if r[1] is not None]
        told = brute_faults([(r[2], r[3]) for r in turns])
        count = lambda f: sum(x[2] == f for x in told)  # noqa: E731,B023
        initials = [r[2][:1] for r in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, letters, result = brute_edits(tuple(told))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        digest = sha256("\n".join(result).encode()).hexdigest()
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, letters, digest))
    return out


def test_block_tables_are_finite_and_normalised():
    t = tables()
    assert len(t.vectors) < 200 and all(min(v) == 0 for v in t.vectors)
    assert t.block.shape == (len(t.vectors), 9**turn_repair.BLOCK)
    rng = random.Random(1)
    for _ in range(200):
        v, block = rng.randrange(len(t.vectors)), [rng.randrange(9) for _ in range(turn_repair.BLOCK)]
        code, want, off = 0, v, 0
        for s in block:
            code = code * 9 + s
        for s in reversed(block):
            off += t.single_off[want, s]
            want = t.single[want, s]
        assert (t.block[v, code], t.block_off[v, code]) == (want, off)


def test_edits_equal_search():
    rng = random.Random(2)
    roles = ["system", "user", "assistant", "other"]
    for n in [*range(7), *[rng.randrange(3, 12) for _ in range(300)]]:
        symbols = [rng.randrange(9) for _ in range(n)]
        rows = tuple(
            ("x", "x", "blank") if s == 8 else (roles[s // 2], f"t{i}", "truncated" if s % 2 else "none")
            for i, s in enumerate(symbols)
        )
        cost, letters, _ = brute_edits(rows)
        assert cheapest_edits(bytes(symbols)) == (cost, letters), symbols


def test_long_conversation_costs_what_its_parts_cost():
    rng = random.Random(3)
    symbols = bytes(rng.randrange(9) for _ in range(100_003))
    cost, letters = cheapest_edits(symbols)
    assert len(letters) - letters.count("I") == len(symbols)
    told = {"D": 4, "I": 3, "K": 0, "R": 3}
    kept = [(x, s) for x, s in zip((x for x in letters if x != "I"), symbols, strict=True) if x != "D"]
    assert cost == sum(told[x] for x in letters) + 3 * sum(s % 2 for _, s in kept)


@pytest.fixture(scope="module")
def some_rows():
    rng = random.Random(4)
    texts = ["Yes.", "No!", "Why?", "cut", "more \n", " ", "", "\t", "Done. ", "é", None, "x." * 50_000]
    roles = ["system", "user", "assistant", "user", "assistant", "agent", "tool", "", None]
    rows = []
    for conv in [None, *range(-3, 90)]:
        n = rng.choice([1, 2, 5, 9, 12])
        numbers = rng.sample([None, *range(20)], n)
        rows += [(conv, t, rng.choice(roles), rng.choice(texts)) for t in numbers]
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(600)]
    return rows


def test_query_equals_search(spark, tmp_path, some_rows):
    df = spark.createDataFrame(some_rows, "conv_id long, turn long, role string, text string").repartition(6)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = turn_repair.turn_repair(spark, str(tmp_path))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.columns == names
    key = lambda r: str(r[0])
    short = [r for r in some_rows if r[0] != 500]
    found = sorted(map(tuple, got.collect()), key=key)
    assert [r for r in found if r[0] != 500] == sorted(brute_query(short), key=key)
    assert sum(r[0] == 500 for r in found) == 1


def test_given_tables(spark, sample):
    rows = [tuple(r) for r in spark.read.parquet(f"{sample}/conversations.parquet").collect()]
    got = turn_repair.turn_repair(spark, sample).collect()
    assert sorted(map(tuple, got)) == sorted(brute_query(rows))


def test_ties_repeats_and_clashing_columns(spark):
    schema = "conv_id long, turn long, role string, text string, digest string, head long, position long, n long"
    rows = [
        (1, 0, "user", "Hi.", "d", 1, 1, 1), (1, 0, "user", "Hi.", "d", 1, 1, 1), (1, 0, "assistant", "Yo.", "d", 1, 1, 1),
        (1, None, "system", "Be.", "d", 1, 1, 1), (2, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    told = audit(df)
    found = {r.conv_id: r for r in told.collect()}
    # By role: system (null turn), assistant, user, user again.
    assert (found[1].audit, found[1].cost, found[1].duplicate, found[1].gaps) == ("KIKKDI", 10, 1, 0)
    assert (found[2].audit, found[2].blank) == ("D", 1)
    out = repaired(df, told).orderBy("conv_id", "position").collect()
    assert [tuple(r) for r in out] == [
        (1, 0, "system", "Be.", "K"), (1, 1, "user", "", "I"), (1, 2, "assistant", "Yo.", "K"),
        (1, 3, "user", "Hi.", "K"), (1, 4, "assistant", "", "I"),
    ]
    assert audit(df.limit(0)).count() == 0 and repaired(df.limit(0), told.limit(0)).count() == 0
