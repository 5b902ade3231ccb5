"""Exact substring dedup: bytes inside a string of 100 bytes that starts earlier too are removed.

* **Anchors.** Of every 100 bytes the piece of 32 bytes with the smallest hash is
  their anchor. It depends on those bytes alone, so equal strings have equal
  anchors at equal places, and about one position in 35 is an anchor.
* **Groups.** Anchors meet by the hash of their piece. Those whose surroundings
  (all bytes that strings with this anchor can reach) equal those of an earlier
  one are covered whole; where both are in one batch of texts, this is settled
  before the shuffle, so that copies and common passages are no hot keys. What is
  left of a group, one anchor for each kind of surroundings, gets its bytes.
* **Suffix arrays.** In a task, the suffixes that start at anchors and the
  reversed prefixes that end there are sorted (deep-shallow). Two strings of 100
  bytes with their anchor at the same place are equal if both sides lie in the
  same interval of common prefixes, so intervals, not strings, are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexispark.llm.pieces import groups_of
from lexispark.llm.registry import query, table
from lexispark.llm.suffix_sort import deep_shallow
from lexispark.plans.checkpoints import cut_lineage

LENGTH, PIECE = 100, 32
BEFORE = LENGTH - PIECE  # bytes before an anchor that its strings can reach
#: Anchors that are sorted together; groups above it are settled by digests of their strings instead.
BATCH = 40_000
_CHUNK = 4_000_000

_RANDOM = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _piece_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the PIECE bytes from every position, by doubling."""
    h, width, factor = _RANDOM[x], 1, 0x9E3779B97F4A7C15
    while width < PIECE:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor % 2**64
        width *= 2
        if width == 8:
            h = _mix(h)
    return _mix(h)


def anchors(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text number, position, piece hash, surroundings hash and size on both sides of the anchors of some texts."""
    lengths = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    x = np.frombuffer(b"".join(raw), np.uint8)
    none = np.zeros(0, np.int64)
    if len(x) < LENGTH:
        return none, none, none.view(np.uint64), none.view(np.uint64), none, none
    with np.errstate(over="ignore"):
        h = _piece_hashes(x)
        # Only windows inside one text count.
        step = np.zeros(len(x) + 1, np.int32)
        np.add.at(step, np.maximum(begins, ends - LENGTH + 1), 1)
        np.add.at(step, ends, -1)
        inside = np.cumsum(step[: len(x) - LENGTH + 1]) == 0
        found = np.zeros(len(x), bool)
        for at in range(0, len(inside), _CHUNK):  # positions within a chunk fit into 24 bits
            part = h[at : at + _CHUNK + BEFORE]
            m = (part & ~np.uint64(0xFFFFFF)) | np.arange(len(part), dtype=np.uint64)
            width = 1
            while width * 2 <= BEFORE + 1:
                m = np.minimum(m[:-width], m[width:])
                width *= 2
            rest = BEFORE + 1 - width
            m = np.minimum(m[:-rest], m[rest:]) if rest else m
            m = m[inside[at : at + len(m)]]
            found[at + (m & np.uint64(0xFFFFFF)).astype(np.int64)] = True
        place = np.flatnonzero(found)
        text = np.searchsorted(ends, place, "right")
        left = np.minimum(place - begins[text], BEFORE)
        right = np.minimum(ends[text] - place, LENGTH)
        around = _mix((left * 1000 + right).astype(np.uint64))
        # Pieces at most PIECE apart tell all bytes of the surroundings.
        for shift in range(-BEFORE, LENGTH - PIECE + 1, PIECE):
            p = np.clip(place + shift, begins[text], ends[text] - PIECE)
            around = _mix(around * np.uint64(31) + h[p])
        around = _mix(around * np.uint64(31) + h[place + right - PIECE])
    return text, place - begins[text], h[place], around, left, right


def _settled_here(doc: np.ndarray, at: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors of a batch are the first with their surroundings, and which repeat an earlier one of the batch."""
    order = np.lexsort((at, doc, around))
    new = np.append(True, np.diff(around[order].view(np.int64)) != 0)[: len(order)]
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    first, again = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    first[order[new]] = True
    # A row that repeats id and text isn't earlier than itself.
    again[order] = (doc[lead] != doc[order]) | (at[lead] != at[order])
    return first, again


def _merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping spans of a document as one; spans come by document and place."""
    if not len(doc):
        return doc, begin, end
    new = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (begin[1:] > end[:-1])))
    return doc[new], begin[new], np.maximum.reduceat(end, new)


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            sub = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in groups_of(texts, _CHUNK):
                text, pos, h, around, left, right = anchors([t.encode() for t in texts[a:b]])
                own, at = doc[a:b][text], (sub[a:b][text] << 32) + pos
                first, again = _settled_here(own, at, around)
                spans = _merged(text[again], (at - left)[again], (at + right)[again])
                n = len(spans[0])
                span_doc = doc[a:b][spans[0]]
                with np.errstate(over="ignore"):
                    anywhere = _mix(span_doc.view(np.uint64) * np.uint64(31) + spans[1].view(np.uint64))
                # 48 bits find groups as well; the bytes of pieces are compared later.
                key = np.concatenate([h[first], anywhere]) >> np.uint64(16)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)),
                        pa.array(np.concatenate([around[first].view(np.int64), np.zeros(n, np.int64)])),
                        pa.array(np.concatenate([own[first], span_doc])),
                        pa.array(np.concatenate([at[first], spans[1]])),
                        pa.array(np.concatenate([np.zeros(int(first.sum()), np.int64), spans[2] - spans[1]])),
                    ],
                    names=["h", "around", "doc", "at", "size"],
                )

    return docs.select("doc", "sub", "text").mapInArrow(
        run, "h long, around long, doc long, at long, size long"
    )


def _settle(rows: DataFrame) -> DataFrame:
    """From anchors sorted by piece, surroundings and place: what needs its bytes (size 0), and covered spans.

    Only the last row is carried from batch to batch, so a group may have any
    size. Spans that are settled already pass through.
    """
    def run(batches):
        last, waiting = None, None  # last row; the first row of its surroundings if it may still need bytes
        for batch in batches:
            h, around, doc, at, size = (c.to_numpy() for c in batch.columns)
            yield _rows(h[size > 0], doc[size > 0], at[size > 0], size[size > 0])
            h, around, doc, at = (x[size == 0] for x in (h, around, doc, at))
            n = len(h)
            if n == 0:
                continue
            before = [np.append(x[:1] if last is None else last[i], x[:-1]) for i, x in enumerate((h, around, doc, at))]
            same_h = h == before[0]
            same_a = same_h & (around == before[1])
            repeat = same_a & (doc == before[2]) & (at == before[3])
            if last is None:
                same_h[0] = same_a[0] = repeat[0] = False
            whole = same_a & ~repeat
            first = np.flatnonzero(~same_a)
            if waiting is not None and len(first) and same_h[first[0]]:
                yield _rows(*([x] for x in waiting), [0])
            # A first row needs bytes if other surroundings of its piece come before or after it.
            next_same = np.append(same_h[first[1:]], False) if len(first) else np.zeros(0, bool)
            needs = first[same_h[first] | next_same]
            left = np.minimum(at[whole] & 0xFFFFFFFF, BEFORE)
            yield _rows(h[whole], doc[whole], at[whole] - left, left + LENGTH)
            yield _rows(h[needs], doc[needs], at[needs], np.zeros(len(needs), np.int64))
            if len(first):
                f = first[-1]
                waiting = None if same_h[f] else (h[f], doc[f], at[f])
            last = [x[n - 1] for x in (h, around, doc, at)]

    ordered = rows.repartition("h").sortWithinPartitions("h", "around", "doc", "at")
    return ordered.mapInArrow(run, "h long, doc long, at long, size long")


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h", "doc", "at", "size"])


def _surroundings(docs: DataFrame, needs: DataFrame) -> DataFrame:
    """Bytes on both sides of the anchors that need them."""
    sub, pos = F.shiftright("at", 32).alias("sub"), F.col("at").bitwiseAND(0xFFFFFFFF).alias("pos")
    wanted = needs.select("doc", sub, "h", pos).groupBy("doc", "sub").agg(
        F.collect_list("h").alias("h"), F.collect_list("pos").alias("pos")
    )

    def run(batches):
        for batch in batches:
            for doc, sub, text, hs, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hs, pa.int64()),
                        pa.array([doc] * len(hs), pa.int64()),
                        pa.array([(sub << 32) + p for p in places], pa.int64()),
                        pa.array([raw[max(0, p - BEFORE) : p] for p in places], pa.binary()),
                        pa.array([raw[p : p + LENGTH] for p in places], pa.binary()),
                    ],
                    names=["h", "doc", "at", "left", "right"],
                )

    rows = docs.join(wanted, ["doc", "sub"]).select("doc", "sub", "text", "h", "pos")
    return rows.mapInArrow(run, "h long, doc long, at long, left binary, right binary")


def _matrix(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)


def covered(left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before and after each anchor that repeat earlier ones; anchors are given in text order.

    For a string that starts d bytes before its anchor, equality is equality of d
    bytes on the left and 100 - d on the right: two rows are in the same interval
    of both suffix arrays. All but the first of such rows are repeats. Strings of
    one anchor overlap, so the smallest and the largest d tell what is covered;
    -1 before and 0 after: nothing.
    """
    n = len(left)
    back, fore = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    n_left, n_right = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    order_l, lcp_l = deep_shallow(_matrix([x[::-1] for x in left], BEFORE))
    order_r, lcp_r = deep_shallow(_matrix(right, LENGTH))
    for d in range(BEFORE + 1):
        able = np.flatnonzero((n_left >= d) & (n_right >= LENGTH - d))
        if len(able) < 2:
            continue
        interval_l, interval_r = np.empty(n, np.int64), np.empty(n, np.int64)
        interval_l[order_l] = np.cumsum(lcp_l < d) if d else 0
        interval_r[order_r] = np.cumsum(lcp_r < LENGTH - d)
        key = interval_l[able] * (n + 1) + interval_r[able]
        by = np.argsort(key, kind="stable")
        again = able[by[1:][key[by[1:]] == key[by[:-1]]]]
        back[again] = d
        fore[again] = np.maximum(fore[again], LENGTH - d)
    return back, fore


def _repeats(rows: DataFrame) -> DataFrame:
    """Covered bytes of the anchors of whole groups, from their suffix arrays."""
    def run(batches):
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= BATCH:
                rest = pa.Table.from_batches(held).combine_chunks()
                h = rest.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1])) if h[0] <= h[-1] else 0
                if cut:
                    yield from work(rest.slice(0, cut))
                    rest = rest.slice(cut)
                held, count = rest.to_batches(), rest.num_rows
        if held:
            yield from work(pa.Table.from_batches(held))

    def work(part: pa.Table):
        for a in _group_cuts(part.column("h").to_numpy()):
            own = part.slice(*a)
            doc, at = own.column("doc").to_numpy(), own.column("at").to_numpy()
            order = np.lexsort((at, doc))
            keep = np.append(True, (np.diff(doc[order]) != 0) | (np.diff(at[order]) != 0))
            order = order[keep]
            left, right = (own.column(c).take(pa.array(order)).to_pylist() for c in ("left", "right"))
            back, fore = covered(left, right)
            hit = back >= 0
            place = at[order][hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[order][hit]), pa.array(place), pa.array(back[hit]), pa.array(fore[hit])],
                names=["doc", "at", "back", "fore"],
            )

    ordered = rows.repartition("h").sortWithinPartitions("h")
    return ordered.mapInArrow(run, "doc long, at long, back long, fore long")


def _group_cuts(h: np.ndarray) -> list[tuple[int, int]]:
    """Slices (begin, length) of about BATCH rows that end where groups end."""
    ends = np.append(np.flatnonzero(np.diff(h) != 0) + 1, len(h))
    out, begin = [], 0
    for k, e in enumerate(ends.tolist()):
        if k + 1 == len(ends) or ends[k + 1] - begin > BATCH:
            out.append((begin, e - begin))
            begin = e
    return out


def _repeats_by_digest(rows: DataFrame) -> DataFrame:
    """The same for groups too large for a task: every string of an anchor by its digest, the first of each is none."""
    strings = rows.select(
        "doc", "at", F.concat("left", "right").alias("b"), F.length("left").alias("l"), F.length("right").alias("r"),
        F.explode(F.sequence(F.lit(0), F.lit(BEFORE))).alias("d"),
    ).filter("d <= l AND 100 - d <= r")
    keyed = strings.select(
        "doc", "at", "d", F.concat(F.md5(F.substring("b", F.col("l") - F.col("d") + 1, F.lit(LENGTH))), F.col("d")).alias("key")
    )
    first = keyed.groupBy("key").agg(F.min(F.struct("doc", "at")).alias("first"))
    again = keyed.join(first, "key").filter(F.struct("doc", "at") != F.col("first"))
    return again.groupBy("doc", "at").agg(
        F.max("d").cast("long").alias("back"), (LENGTH - F.min("d")).cast("long").alias("fore")
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc``, ``sub``, ``spans`` (begin, end; not merged) of rows of ``docs`` with repeated bytes."""
    told = cut_lineage(_settle(_anchor_rows(docs)))
    needs = told.filter("size = 0")
    heavy = needs.groupBy("h").count().filter(F.col("count") > BATCH).select("h")
    if heavy.limit(1).count():
        rest = _surroundings(docs, needs.join(heavy, "h", "left_semi"))
        light = needs.join(heavy, "h", "left_anti")
        found = _repeats(_surroundings(docs, light)).union(_repeats_by_digest(rest))
    else:
        found = _repeats(_surroundings(docs, needs))
    pos = F.col("at").bitwiseAND(0xFFFFFFFF)
    span = lambda begin, end: F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end")).alias("span")
    sub = F.shiftright("at", 32).alias("sub")
    spans = told.filter("size > 0").select("doc", sub, span(pos, pos + F.col("size"))).union(
        found.select("doc", sub, span(pos - F.col("back"), pos + F.col("fore")))
    )
    return spans.groupBy("doc", "sub").agg(F.collect_list("span").alias("spans"))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``doc``, ``sub``, ``text``: rows named by id and, where an id is missing or repeated, by content."""
    t = F.coalesce(F.col(text), F.lit(""))
    repeated = docs.groupBy(doc_id).count().filter(F.col(doc_id).isNotNull() & (F.col("count") > 1)).limit(1).count()
    sub = F.xxhash64(F.lit("sub"), t).bitwiseAND(0x7FFFFFFF) if repeated else F.lit(0).cast("long")
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(t).bitwiseOR(F.lit(-(2**63)))).alias("doc"),
        sub.alias("sub"),
        t.alias("text"),
    )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_bytes: bool = True) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if wanted, ``kept`` for every row.

    ``kept`` holds the bytes that stay, which may cut a character. Earlier means
    a smaller id, then an earlier start. Null texts are empty and have nothing to
    remove; texts below 100 bytes stay whole. Rows without id come before all
    others, ordered by a hash of their texts; so are rows that repeat an id among
    themselves. Rows that repeat id and text are one document and get the same
    result. Other columns are not used.
    """
    rows = keyed(docs, doc_id, text)
    spans = repeated_spans(rows)

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                kept, at, removed, runs, end = [], 0, 0, 0, -1
                for s in sorted((s["begin"], min(s["end"], len(raw))) for s in spans or ()):
                    if s[0] > end:
                        runs += 1
                        if end >= 0:
                            removed += end - start
                            kept.append(raw[at:start])
                            at = end
                        start, end = s
                    else:
                        end = max(end, s[1])
                if end >= 0:
                    removed += end - start
                    kept.append(raw[at:start])
                    at = end
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((doc, len(raw), removed, runs, hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            wanted = 6 if with_bytes else 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns[:wanted], kinds[:wanted], strict=True)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:wanted],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    joined = rows.join(spans, ["doc", "sub"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, schema + (", kept binary" if with_bytes else ""))


@query("op6_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)
