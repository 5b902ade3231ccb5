"""Toxicity by maximum-scoring segments of token log-odds, with extreme-value calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexispark.llm.pieces import groups_of
from lexispark.llm.registry import fold_of, query, table

#: Most labelled rows that a model is learnt from, chosen by a hash of their ids.
SAMPLE_ROWS = 20_000
#: Strengths that are tried for the two Dirichlet priors: of tokens that say nothing, and of tokens that tell.
DULL_PRIORS, TELLING_PRIORS = (50.0, 100.0, 200.0, 400.0, 1000.0, 3000.0), (0.5, 1.0, 2.0, 4.0, 8.0)
#: Scores are counted for the calibration in bins of this width.
BIN = 1e-4
#: Share of telling tokens assumed inside a toxic passage; sets how fast a segment's score falls between them.
SHARE_INSIDE = 0.08

#: Parts of the sample; a text is judged by the log-odds of the other parts when the calibration is fitted.
FOLDS = 4

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def token_id(token: str) -> int:
    """Signed 64-bit hash of a token."""
    h = xxhash.xxh3_64_intdigest(token)
    return h - (1 << 64) if h >> 63 else h


def segments(hits: list[int], values: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score) in linear time.

    ``hits`` are positions with their ``values``; every other token scores
    ``-gap``, so runs of them need one step. Each candidate keeps the running totals before and after it. A new one joins the nearest
    earlier candidate that starts lower, if that one also ended lower.
    """
    total, at = 0.0, -1
    found: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total after, nearest lower one
    for position, value in zip(hits, values, strict=True):
        total -= gap * (position - at - 1)
        first, before = position, total
        total += value
        at = position
        if value <= 0:
            continue
        lower = len(found) - 1
        while True:
            while lower >= 0 and found[lower][2] >= before:
                lower = found[lower][4]
            if lower < 0 or found[lower][3] >= total:
                found.append((first, position, before, total, lower))
                break
            first, before = found[lower][0], found[lower][2]
            del found[lower:]
            lower = len(found) - 1
    return [(a, b, after - before) for a, b, before, after, _ in found]


@dataclass(frozen=True)
class ToxicModel:
    tokens: np.ndarray = field(compare=False)  # sorted ids
    log_odds: np.ndarray = field(compare=False)
    gap: float
    decay: float  # lambda of the extreme-value distribution
    factor: float  # its K
    weights: tuple[float, float, float]  # of the evidence, of having any, and the constant
    seen: dict[str, float] = field(default_factory=dict, compare=False)

    def value(self, word: str) -> float:
        """The log-odds of a word, less the gap; an unknown word has 0."""
        known = self.seen.get(word)
        if known is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            name = token_id(word)
            at = int(np.searchsorted(self.tokens, name))
            found = at < len(self.tokens) and self.tokens[at] == name
            known = self.seen[word] = (float(self.log_odds[at]) if found else 0.0) - self.gap
        return known

    def values(self, words: list[str]) -> list[float]:
        seen, value = self.seen.get, self.value
        return [v if (v := seen(w)) is not None else value(w) for w in words]

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        return segments(range(len(words)), self.values(words), 0.0)

    def chance(self, n_words: int, score: float) -> float:
        """Log of the number of segments of at least this score that a harmless text of this length holds by chance."""
        return math.log(self.factor * max(1, n_words)) - self.decay * score

    def significant(self, n_words: int, found: list[tuple[int, int, float]], expect: float = 0.05):
        return [s for s in found if self.chance(n_words, s[2]) <= math.log(expect)]

    def evidence(self, n_words: int, scores: list[float]) -> tuple[float, float]:
        """What the segments say together, and 1 if there are any.

        The best segment gives log(1 + 1/E) with its chance expectation E; every
        further one that is rarer than E = 1 gives log(1/E).
        """
        if not scores:
            return 0.0, 0.0
        best, *rest = sorted((-self.chance(n_words, s) for s in scores), reverse=True)
        return min(50.0, math.log1p(math.exp(min(best, 300.0))) + sum(max(0.0, x) for x in rest)), 1.0

    def score(self, n_words: int, scores: list[float]) -> float:
        a, b = self.evidence(n_words, scores)
        z = self.weights[0] * a + self.weights[1] * b + self.weights[2]
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _decay(value: np.ndarray, chance: np.ndarray) -> float:
    """The positive root of  sum p(s) exp(lambda s) = 1  (the mean score is negative)."""
    low, high = 1e-6, 1.0
    f = lambda x: float((chance * np.exp(np.minimum(x * value, 500))).sum() - 1.0)
    while f(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _log_beta(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _lgamma(x) + _lgamma(y) - _lgamma(x + y)


def shrunk_log_odds(toxic: np.ndarray, other: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected log-odds of tokens by how many toxic and other texts hold them; ``times`` tokens have the same counts.

    A token's toxic share follows one of two Dirichlet priors around the share
    of all: a narrow one, whose tokens say nothing, or a wide one. Their
    strengths and weights are those of the largest likelihood over all tokens.
    The log-odds under the wide prior count with the probability of that prior,
    so rare tokens get little and none is left out.
    """
    held = float(((toxic + other) * times).sum())
    share = float((toxic * times).sum()) / held if held else 0.0
    if not 0 < share < 1:
        return np.zeros(len(toxic))
    likelihood = lambda m: (
        _log_beta(toxic + m * share, other + m * (1 - share)) - math.lgamma(m * share) - math.lgamma(m * (1 - share)) + math.lgamma(m)
    )
    dull, telling = ({m: likelihood(m) for m in ms} for ms in (DULL_PRIORS, TELLING_PRIORS))
    best = None
    for a in dull.values():
        for m, b in telling.items():
            weight = 0.01
            for _ in range(40):
                tells = 1 / (1 + np.exp((a + math.log(1 - weight) - b - math.log(weight)).clip(-500, 500)))
                weight = min(0.5, max(1e-6, float((times * tells).sum() / times.sum())))
            fit = float((times * np.logaddexp(a + math.log(1 - weight), b + math.log(weight))).sum())
            if best is None or fit > best[0]:
                best = fit, m, tells
    _, m, tells = best
    return tells * (np.log(toxic / (m * share) + 1) - np.log(other / (m * (1 - share)) + 1))


def _odds_of(counts: np.ndarray) -> np.ndarray:
    """Log-odds of tokens from their rows of toxic and other texts; equal counts are worked out once."""
    pairs, which, times = np.unique(counts, axis=1, return_inverse=True, return_counts=True)
    return shrunk_log_odds(*pairs, times)[which.ravel()]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton steps for P(y=1) = sigmoid(w x + c), with a weak prior on w and a start at the base rate."""
    z = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([0.05] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(60):
        p = 1 / (1 + np.exp(-(z @ w).clip(-40, 40)))
        grad = z.T @ (p - y) + ridge @ w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, grad)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return tuple(map(float, w))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> ToxicModel:
    """Learn from at most ``sample_rows`` rows of ``labels`` (``id_col``, ``toxic``); null ids and labels are left out.

    A token counts once per text, and a text once however often it is copied:
    word counts of looping or copied texts would drown what is rare. The
    log-odds come from all texts. The calibration sees every text through the
    log-odds of the texts outside its fold (by a hash), so it is never shown a
    text that its tokens were learnt from. Without any toxic text nothing is
    toxic. An id that stands for several texts labels each of them.
    """
    known = labels.select(id_col, F.col("toxic").cast("int").alias("toxic")).dropna()
    chosen = (
        known.groupBy(id_col)
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(sample_rows)
    )
    # At most sample_rows ids: a proven bound for the broadcast.
    texts = (
        docs.select(id_col, text)
        .join(F.broadcast(chosen), id_col)
        .groupBy(F.md5(F.coalesce(text, F.lit(""))).alias("digest"))
        .agg(F.max("toxic").alias("toxic"), F.first(text).alias(text))
        .withColumn("fold", F.pmod(F.crc32("digest"), F.lit(FOLDS)).cast("int"))
        .select(text, "toxic", "fold")
    )
    sides = [(f, y) for f in range(FOLDS) for y in (1, 0)]

    def count(batches):
        counts = {side: Counter() for side in sides}
        for batch in batches:
            for t, y, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[f, int(y > 0)].update(map(token_id, set(words_of(t))))
        found = list(set().union(*counts.values()))
        columns = [pa.array([counts[side][w] for w in found], pa.int64()) for side in sides]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *columns], names=["token", *names])

    # All tokens of the sample, in fixed width: they are in proportion to the sample, which is bounded.
    names = [f"{'toxic' if y else 'other'}_{f}" for f, y in sides]
    counts = (
        texts.mapInArrow(count, ", ".join(["token long", *(f"{c} long" for c in names)]))
        .groupBy("token")
        .agg(*[F.sum(c).alias(c) for c in names])
        .toArrow()
    )
    token = counts["token"].to_numpy()
    order = np.argsort(token)
    token = token[order].copy()
    by_fold = np.array([counts[c].to_numpy()[order] for c in names], float).reshape(FOLDS, 2, -1)
    total = by_fold.sum(0)
    if not total[0].sum():
        return ToxicModel(np.zeros(0, np.int64), np.zeros(0), 0.1, 1.0, 1.0, (0.0, 0.0, -6.0))
    odds = _odds_of(total)
    gap = -math.log(1 - SHARE_INSIDE)
    drafts = [ToxicModel(token, _odds_of(total - x), gap, 1.0, 1.0, (0.0, 0.0, 0.0)) for x in by_fold]

    def parse(batches):
        for batch in batches:
            rows, bins = [], Counter()
            for t, y, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, draft = words_of(t), drafts[f]
                if not y:
                    bins.update(round(v / BIN) for v in draft.values(words))
                rows.append((y, len(words), [s[2] for s in draft.segments(words)], [], []))
            if rows:  # how often harmless texts of the batch hold each score
                rows[0] = (*rows[0][:3], list(bins.keys()), list(bins.values()))
            columns = zip(*rows) if rows else [[]] * 5
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                names=["toxic", "n", "found", "bins", "times"],
            )

    rows = texts.mapInArrow(
        parse, "toxic int, n long, found array<double>, bins array<long>, times array<long>"
    ).collect()
    harmless = [r for r in rows if not r.toxic and r.n]
    n = sum(r.n for r in harmless)
    bins = Counter()
    for r in rows:
        bins.update(dict(zip(r.bins, r.times, strict=True)))
    if bins and max(bins) > 0:
        value, often = (np.array(list(x), float) for x in (bins.keys(), bins.values()))
        decay = _decay(value * BIN, often / n)
        factor = len(harmless) / sum(r.n * math.exp(-decay * max(r.found, default=0.0)) for r in harmless)
    else:
        decay, factor = 1.0, 1.0 / max(1, n)
    plain = ToxicModel(token, odds, gap, decay, factor, (0.0, 0.0, 0.0))
    x = np.array([plain.evidence(r.n, r.found) for r in rows]).reshape(-1, 2)
    weights = _logistic(x, np.array([float(r.toxic) for r in rows])) if rows else (1.0, 0.0, -3.0)
    return ToxicModel(token, odds, gap, decay, factor, weights)


def score(docs: DataFrame, model: ToxicModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Add ``score``, ``predicted`` and ``passages`` (first token, last token, score) to every row.

    Null and empty texts have no passage and the score of no evidence. Columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted", "passages")]
    span = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            texts = batch.column(kept.index(text)).to_pylist()
            for a, b in groups_of(texts):
                scores, spans = [], []
                for t in texts[a:b]:
                    words = words_of(t)
                    found = model.segments(words)
                    scores.append(model.score(len(words), [s[2] for s in found]))
                    told = model.significant(len(words), found)
                    spans.append([{"first": f, "last": e, "score": s} for f, e, s in told])
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(a, b - a).columns,
                        pa.array(scores, pa.float64()),
                        pa.array([int(s >= threshold) for s in scores], pa.int32()),
                        pa.array(spans, pa.list_(span)),
                    ],
                    names=[*kept, "score", "predicted", "passages"],
                )

    schema = ", ".join(
        [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
        + ["score double", "predicted int", "passages array<struct<first: bigint, last: bigint, score: double>>"]
    )
    return docs.select(*kept).mapInArrow(run, schema)


@query("op7_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = table(spark, sf_dir, "labels").filter(fold_of("doc_id", 4) != 2)
    model = fit(docs, learn)
    narrow = docs.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "text")
    return score(narrow, model).select("doc_id", "held_out", "score", "predicted", "passages")
