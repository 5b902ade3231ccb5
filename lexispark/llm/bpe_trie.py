"""BPE encoding and decoding by prefix-sharing traversal of a trie of distinct words."""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexispark.llm.pieces import PieceEncoder, Vocabulary, text_runs
from lexispark.llm.registry import query, table


#: Bounds of what a worker holds beside the tables of the vocabulary, some 130 MB in all.
TRIE_PIECES, TRIE_WORDS, LASTING_PAIRS = 250_000, 300_000, 250_000


class TrieEncoder:
    """Encodings of distinct words, with the work for a shared prefix done once.

    Every prefix of a word has one encoding, and that encoding ends in one last
    token. It is the encoding of a shorter prefix plus one token, the one that
    forms a lasting pair with the last token there. So the state of a trie node
    is its last token, and a depth-first walk hands states from parents to
    children. The walk goes over the sorted words: the path of the trie is held
    as a stack, and the next word goes on from the node where it branches off.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.ids = vocabulary.ids
        self.prefixes = {t[:n] for t in self.ids for n in range(1, len(t) + 1)}
        self.pack = {i: struct.pack("<I", i) for i in self.ids.values()}
        self.rank = {pair: r for r, pair in enumerate(vocabulary.merges)}
        never = len(vocabulary.merges)
        bytes_of = vocabulary.bytes_of
        made = {}  # token -> the pair that makes it and its rank
        for r, (a, b) in enumerate(vocabulary.merges):
            made.setdefault(self.ids[bytes_of[a] + bytes_of[b]], (a, b, r))
        # Tokens at the right (left) border of a token while it is being made, with the rank at which each goes.
        self.right_border, self.left_border = {}, {}
        for t in self.ids.values():
            for border, side in ((self.right_border, 1), (self.left_border, 0)):
                at, until, steps = t, never, []
                while True:
                    steps.append((at, until))
                    if at not in made:
                        break
                    at, until = made[at][side], made[at][2]
                border[t] = steps
        self.lasting: dict[int, bool] = {}

    def lasts(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are merged together.

        They do not if some merge spans the border while both of its parts stand
        there. Equal merges go from left to right, hence the two comparisons.
        """
        pair = left << 32 | right
        known = self.lasting.get(pair)
        if known is None:
            known = not any(
                (r := self.rank.get((a, b))) is not None and r < a_until and r <= b_until
                for a, a_until in self.right_border[left]
                for b, b_until in self.left_border[right]
            )
            if len(self.lasting) > LASTING_PAIRS:
                self.lasting.clear()
            self.lasting[pair] = known
        return known

    def encode_words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        token_of, pack, lasts, prefixes = self.ids.get, self.pack, self.lasts, self.prefixes
        out: dict[bytes, bytes] = {}
        # The path of trie nodes: last token, encoding, and where the longest suffix starts that begins a token.
        last, encoded, reach, before = [-1], [b""], [0], b""
        for word in sorted(raw):
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del last[depth + 1 :], encoded[depth + 1 :], reach[depth + 1 :]
            low = reach[depth]
            for end in range(depth + 1, len(word) + 1):
                while word[low:end] not in prefixes:
                    low += 1
                for start in range(low, end):
                    token = token_of(word[start:end])
                    if token is not None:
                        parent = last[start]
                        if parent < 0 or lasts(parent, token):
                            break
                last.append(token)
                encoded.append(encoded[start] + pack[token])
                reach.append(low)
            out[word] = encoded[-1]
            before = word
        return [out[w] for w in raw]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder: its tables and cache serve all tasks that the worker runs."""
    if path not in _encoders:
        vocabulary = Vocabulary(path)
        _encoders[path] = PieceEncoder(vocabulary, TrieEncoder(vocabulary).encode_words, TRIE_PIECES, TRIE_WORDS)
    return _encoders[path]


def encode_decode(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` to every row.

    ``tokenizer_path`` is a byte-level BPE file that every executor can read. A
    null text is encoded as the empty text: no ids, decoded to "". Special
    tokens in a text become their ids. All input columns are kept; columns
    named ``ids`` or ``decoded`` are replaced. Equal rows give equal results.
    """
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    fields = [docs.schema[c] for c in kept]
    plain = docs.select(*kept)

    def run(batches):
        coder = encoder(tokenizer_path)
        for batch in batches:
            for begin, texts in text_runs(batch.column(kept.index(text))):
                ids = coder.encode(texts)
                decoded = [coder.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(begin, len(texts)).columns, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    names=[*kept, "ids", "decoded"],
                )
        coder.forget()  # the worker may go on with tasks of other stages

    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["ids binary", "decoded string"]
    )
    return plain.mapInArrow(run, schema)


def digest_codes(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per document with the token count and digests of ids and decoded text.

    The same encoding as ``encode_decode``, digested in the task, so that only
    the digests leave the worker.
    """

    def run(batches):
        coder = encoder(tokenizer_path)
        for batch in batches:
            for begin, texts in text_runs(batch.column(1)):
                ids = coder.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, len(texts)),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                        pa.array(
                            [hashlib.sha256(coder.decode(i).encode()).hexdigest() for i in ids], pa.string()
                        ),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op3_bpe_codes")
def bpe_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_codes(table(spark, sf_dir, "documents"), default_tokenizer())
