"""Token ids in binary shards with a minimal perfect hash index from document key to position.

A shard is two files. ``NAME.ids`` holds raw ids, little-endian unsigned 16-bit
if the vocabulary allows it and 32-bit otherwise, document after document.
``NAME.idx`` holds, in ``numpy`` format one after another: the keys in order,
the offsets of documents in ids (one more than documents), for each slot of the
hash a fingerprint and the first document of its key, and the hash itself. The
manifest, a Parquet table, has one row per shard.
"""

from __future__ import annotations

import io
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lexispark.llm.bpe_trie import default_tokenizer
from lexispark.llm.pieces import PieceEncoder, Vocabulary, groups_of
from lexispark.llm.registry import query, table
from lexispark.plans.checkpoints import scratch_path

#: Bits of a level per key that is still without a place; 2 settles about 60 % of the keys in a level.
BITS_PER_KEY = 2
#: Ids read from a shard at once.
READ_IDS = 4_000_000


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing function (splitmix finaliser) of keys and a seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class PerfectHash:
    """Levels of bit arrays: a key sits in the first level in which no other key shares its bit.

    Its slot is the rank of that bit over all levels, so slots are 0 .. n-1.
    """

    sizes: np.ndarray  # bits of each level
    words: np.ndarray  # 64-bit words, all levels one after another
    ranks: np.ndarray  # set bits before each word

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        left, sizes, levels = keys.astype("<i8").view("<u8"), [], []
        while len(left):
            size = max(64, BITS_PER_KEY * len(left))
            place = _mix(left, len(sizes)) % np.uint64(size)
            taken = np.bincount(place.astype(np.int64), minlength=size)
            levels.append(taken == 1)
            sizes.append(size)
            left = left[taken[place.astype(np.int64)] > 1]
        flags = np.concatenate([*levels, np.zeros(1, bool)])
        flags = np.append(flags, np.zeros(-len(flags) % 64, bool))
        words = np.packbits(flags, bitorder="little").view("<u8")
        ranks = np.append(0, np.cumsum(np.bitwise_count(words).astype(np.int64)))[:-1]
        return PerfectHash(np.array(sizes, "<i8"), words, ranks.astype("<i8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for those that have no place (a foreign key may also get a slot: check its fingerprint)."""
        raw = keys.astype("<i8").view("<u8")
        found = np.full(len(raw), -1, np.int64)
        todo, base = np.arange(len(raw)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(todo):
                break
            at = base + (_mix(raw[todo], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            lower = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found[todo[hit]] = (self.ranks[at >> 6] + lower)[hit]
            todo, base = todo[~hit], base + size
        return found


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.astype("<i8").view("<u8"), 1_000_003) >> np.uint64(32)).astype("<u4")


@dataclass(frozen=True)
class ShardIndex:
    """Keys in order (null keys first, marked in ``nulls``), offsets, and the hash from key to first document."""

    keys: np.ndarray
    nulls: int
    offsets: np.ndarray
    prints: np.ndarray
    first: np.ndarray
    hash: PerfectHash

    @staticmethod
    def build(keys: np.ndarray, nulls: int, lengths: np.ndarray) -> ShardIndex:
        offsets = np.append(0, np.cumsum(lengths)).astype("<i8")
        distinct, first = np.unique(keys[nulls:], return_index=True)
        ph = PerfectHash.build(distinct)
        slot = ph.slots(distinct)
        prints, at = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<i8")
        prints[slot], at[slot] = fingerprints(distinct), first + nulls
        return ShardIndex(keys.astype("<i8"), nulls, offsets, prints, at, ph)

    def locate(self, keys: np.ndarray) -> np.ndarray:
        """Number of the first document of each key in the shard, -1 for keys that are not there.

        Constant time for a key: one slot, one comparison of fingerprints. A
        foreign key passes the comparison once in 2^32 cases.
        """
        slot = self.hash.slots(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprints(keys[ok])
        return np.where(ok, self.first[np.maximum(slot, 0)] if len(self.first) else -1, -1)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        parts = (np.array([self.nulls]), self.keys, self.offsets, self.prints, self.first)
        for x in (*parts, self.hash.sizes, self.hash.words, self.hash.ranks):
            np.save(out, x, allow_pickle=False)
        return out.getvalue()

    @staticmethod
    def from_bytes(raw: bytes) -> ShardIndex:
        f = io.BytesIO(raw)
        nulls, keys, offsets, prints, first, sizes, words, ranks = (np.load(f) for _ in range(8))
        return ShardIndex(keys, int(nulls[0]), offsets, prints, first, PerfectHash(sizes, words, ranks))


_coders: dict[str, PieceEncoder] = {}


def library_coder(path: str) -> PieceEncoder:
    """Encodes unseen words with the tokenizers library."""
    if path not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task per core
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()

        def encode_words(words: list[str]) -> list[bytes]:
            found = tok.encode_batch_fast(words, add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in found]

        _coders[path] = PieceEncoder(Vocabulary(path), encode_words)
    return _coders[path]


def _split(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write shards in ascending key order below ``folder`` (shared) and return the manifest.

    Null keys come first; they are stored but have no index entry. Rows with
    equal keys follow one another by their texts, and the index points to the
    first of a shard. A null text is empty: only the end id. A task that is run
    again writes files of other names; the manifest names those of the attempt
    that counted. Columns beside key and text are not stored.
    """
    size = max(Vocabulary(tokenizer_path).size, end_id + 1)
    width = 2 if size <= 1 << 16 else 4
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        filesystem, base = _split(folder)
        coder = library_coder(tokenizer_path)
        keys, lengths, nulls = [], [], 0
        with filesystem.open_output_stream(f"{base}/{name}.ids") as out:
            for batch in batches:
                ids = batch.column(0)
                nulls += ids.null_count
                keys.append(ids.fill_null(0).to_numpy(zero_copy_only=False))
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for a, b in groups_of(texts):
                    coded = coder.encode(texts[a:b])
                    lengths.extend(len(x) // 4 + 1 for x in coded)
                    raw = np.frombuffer(end.join([*coded, b""]), "<u4")
                    out.write(raw if width == 4 else raw.astype("<u2"))
        if not lengths:
            filesystem.delete_file(f"{base}/{name}.ids")
            return
        index = ShardIndex.build(np.concatenate(keys), nulls, np.array(lengths))
        with filesystem.open_output_stream(f"{base}/{name}.idx") as out:
            out.write(index.to_bytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([task.partitionId()], pa.int32()),
                pa.array([name]),
                pa.array([width], pa.int32()),
                pa.array([len(lengths)], pa.int64()),
                pa.array([int(index.offsets[-1])], pa.int64()),
                pa.array([int(index.keys[-1]) if nulls < len(lengths) else None], pa.int64()),
            ],
            names=["part", "name", "width", "n_docs", "n_ids", "last_key"],
        )

    _make_folder(docs.sparkSession, folder)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    # The hash keeps even a key with very many rows from one shard.
    ordered = rows.repartitionByRange("k", F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"), "t")
    manifest = ordered.mapInArrow(run, "part int, name string, width int, n_docs long, n_ids long, last_key long")
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the ids of all shards before; one row per shard, so one task is enough."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of every shard, found through the index: key, start, n_tokens, crc32 of its 32-bit ids."""

    def run(batches):
        filesystem, base = _split(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                with filesystem.open_input_stream(f"{base}/{shard['name']}.idx") as f:
                    index = ShardIndex.from_bytes(f.read())
                yield from _read_shard(filesystem, f"{base}/{shard['name']}.ids", shard, index)

    shards = starts(manifest)
    return shards.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "name").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _read_shard(filesystem, path: str, shard: dict, index: ShardIndex):
    n, width = len(index.keys), shard["width"]
    # The place of each document: from its key, plus its number among rows of the same key.
    numbers = np.arange(n)
    own = index.keys[index.nulls :]
    found = index.locate(own)
    if (found < 0).any() or (index.keys[found] != own).any():
        raise ValueError(f"the index of {path} does not know its own keys")
    place = numbers.copy()
    new = np.append(True, own[1:] != own[:-1]) if len(own) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(new, numbers[index.nulls :], 0)) if len(own) else numbers[:0]
    place[index.nulls :] = found + (numbers[index.nulls :] - begin)
    length = np.diff(index.offsets)
    with filesystem.open_input_file(path) as f:
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(index.offsets, index.offsets[at] + READ_IDS, "right")) - 1)
            low, high = int(index.offsets[at]), int(index.offsets[to])
            f.seek(low * width)
            raw = np.frombuffer(f.read((high - low) * width), f"<u{width}").astype("<u4")
            docs = place[at:to]
            cuts = (index.offsets[docs] - low).tolist()
            crc = [zlib.crc32(raw[c : c + m].tobytes()) for c, m in zip(cuts, length[docs].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(index.keys[docs], pa.int64(), mask=docs < index.nulls),
                    pa.array(index.offsets[docs] + shard["start"], pa.int64()),
                    pa.array(length[docs], pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )
            at = to


class Store:
    """Keyed access to single documents; holds one manifest row per shard and opens shards on demand."""

    def __init__(self, manifest: DataFrame, folder: str):
        self.filesystem, self.base = _split(folder)
        self.shards = [r.asDict() for r in manifest.filter("last_key is not null").orderBy("part").collect()]
        self.last = np.array([s["last_key"] for s in self.shards], "<i8")

    def get(self, key: int) -> list[int] | None:
        """The ids of a key, its first row if it has several; None for a key that is not stored."""
        at = int(np.searchsorted(self.last, key))
        if at == len(self.shards):
            return None
        shard = self.shards[at]
        index = shard.get("index")
        if index is None:
            with self.filesystem.open_input_stream(f"{self.base}/{shard['name']}.idx") as f:
                index = shard["index"] = ShardIndex.from_bytes(f.read())
        doc = int(index.locate(np.array([key]))[0])
        if doc < 0 or index.keys[doc] != key:
            return None
        low, high = (int(x) for x in index.offsets[doc : doc + 2])
        with self.filesystem.open_input_file(f"{self.base}/{shard['name']}.ids") as f:
            f.seek(low * shard["width"])
            return np.frombuffer(f.read((high - low) * shard["width"]), f"<u{shard['width']}").tolist()


@query("op9_token_store")
def token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-shards")
    manifest = write(table(spark, sf_dir, "documents"), folder, default_tokenizer(), end_id=2)
    return read(manifest, folder)
