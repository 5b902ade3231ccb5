"""Quality classifier learnt from trusted positives and unlabelled text (non-negative PU risk)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexispark.llm.pieces import text_runs
from lexispark.llm.registry import fold_of, query, table

#: Most rows of each sample (positives, unlabelled) that a model is fitted on.
SAMPLE_ROWS = 20_000

_SYMBOLS = "#*$%&|<>{}[]\\^~=_+@"
_N_FEATURES = 13


def features(text: str) -> list[float]:
    """Shares and counts over the whole text that do not depend on its language."""
    words = text.split()
    n = len(words)
    if n == 0:
        return [0.0] * _N_FEATURES
    chars = len(text)
    distinct = len(set(words))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return [
        math.log1p(n),
        min((chars - n) / n, 40.0),
        min(sum(map(text.count, _SYMBOLS)) / n, 1.0),
        sum(map(str.isupper, words)) / n,
        min((text.count("!") + text.count("?")) / n, 1.0),
        min(text.count("|") / n, 1.0),
        sum(map(eq, words, words[1:])) / n,
        1.0 - math.log1p(distinct) / math.log1p(n),
        1.0 - len(set(zip(words, words[1:]))) / max(1, n - 1) if n > 1 else 0.0,
        1.0 - len(set(lines)) / len(lines),
        min(sum(map(text.count, "0123456789")) / chars, 1.0),
        min(sum(map(text.count, ".,;:")) / n, 1.0),
        min(len(lines) / n, 1.0),
    ]


@dataclass(frozen=True)
class PuModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        g = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-g.clip(-40, 40)))


def _descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int, decay: float) -> tuple[np.ndarray, float]:
    """Minimise the non-negative risk  prior*E_p[l(g)] + max(0, E_u[l(-g)] - prior*E_p[l(-g)])  with logistic loss l."""
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-z.clip(-40, 40)))
    for t in range(1, steps + 1):
        gp, gu = p @ w + b, u @ w + b
        sp, su = sigmoid(gp), sigmoid(gu)
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        # Derivatives by g: l(g) -> s - 1, l(-g) -> s. A negative rest is overfitting: step back up on that part.
        dp, du = prior * (sp - 1.0) / len(p), np.zeros(len(u))
        if rest >= 0:
            dp -= prior * sp / len(p)
            du += su / len(u)
        else:
            dp = prior * sp / len(p)
            du = -su / len(u)
        grad = np.append(p.T @ dp + u.T @ du + decay * w, dp.sum() + du.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def estimate_prior(score_p: np.ndarray, score_u: np.ndarray) -> float:
    """The largest share of positives that the unlabelled scores allow.

    Above every threshold t the unlabelled texts hold at least the positives'
    share:  P_u(score >= t) >= prior * P_p(score >= t).  So the smallest ratio
    bounds the prior from above; thresholds that cut off a tenth of the
    positives or more have noisy ratios and are left out.
    """
    cuts = np.quantile(score_p, np.linspace(0.0, 0.1, 21))
    ratios = [(score_u >= c).mean() / (score_p >= c).mean() for c in cuts]
    return float(np.clip(min(ratios), 0.05, 0.99))


def fit_arrays(p: np.ndarray, u: np.ndarray, steps: int = 400) -> PuModel:
    """Fit on feature rows of positives and of unlabelled texts; without positives every score is 0.5."""
    if len(p) == 0 or len(u) == 0:
        return PuModel(np.zeros(_N_FEATURES), np.ones(_N_FEATURES), np.zeros(_N_FEATURES), 0.0, 0.5)
    mean, scale = p.mean(0), p.std(0) + 0.02 + 0.05 * u.std(0)
    zp, zu = ((x - mean).__truediv__(scale).clip(-8, 8) for x in (p, u))
    w, b = _descend(zp, zu, 0.5, steps // 2, 1e-3)
    prior = estimate_prior(zp @ w + b, zu @ w + b)
    w, b = _descend(zp, zu, prior, steps, 1e-4)
    return PuModel(mean, scale, w, b, prior)


def score_column(text: Column, model: PuModel) -> Column:
    """The score of a text; only the texts go to Python, and only scores come back."""
    def run(texts: pa.Array) -> pa.Array:
        runs = [model.score(np.array([features(t) for t in part])) for _, part in text_runs(texts)]
        return pa.array(np.concatenate([*runs, np.zeros(0)]))

    return F.arrow_udf(run, "double")(text)


def _feature_rows(docs: DataFrame, extra: list[str], text: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [features(t) for _, part in text_runs(batch.column(0)) for t in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), *batch.columns[1:]], names=["x", *extra]
            )

    types = ", ".join(f"`{c}` boolean" for c in extra)
    return docs.select(text, *extra).mapInArrow(run, f"x array<double>, {types}")


def fit(
    docs: DataFrame,
    positives: DataFrame,
    unlabelled: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> PuModel:
    """Fit on at most ``sample_rows`` positives and as many unlabelled rows, chosen by a hash of their ids.

    ``positives`` and ``unlabelled`` hold ids (column ``id_col``). Ids that are
    null or not in ``docs`` are left out; repeated ids count once.
    """
    def sample(ids: DataFrame, flag: str) -> DataFrame:
        named = ids.select(id_col).filter(F.col(id_col).isNotNull()).distinct()
        return named.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).withColumn(flag, F.lit(True))

    chosen = sample(positives, "is_p").join(sample(unlabelled, "is_u"), id_col, "full")
    # At most 2 * sample_rows ids: a proven bound for the broadcast.
    picked = docs.select(id_col, text).join(F.broadcast(chosen), id_col)
    rows = _feature_rows(picked, ["is_p", "is_u"], text).collect()
    take = lambda flag: np.array([r.x for r in rows if r[flag]]).reshape(-1, _N_FEATURES)
    return fit_arrays(take("is_p"), take("is_u"))


def score(docs: DataFrame, model: PuModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold) to every row, also to null and empty texts.

    A text without words has all features 0. Columns of these two names are
    replaced; ``score_column`` leaves all columns as they are. Repeated rows are
    scored each, a table without rows has no scores.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*kept, score_column(F.col(text), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fit_on_labels(docs: DataFrame, labels: DataFrame, folds: int = 5) -> PuModel:
    """Positives: rows labelled good outside fold 0. Unlabelled: documents outside fold 0, whatever their label."""
    learn = fold_of("doc_id", folds) != 0
    return fit(docs, labels.filter(learn & (F.col("quality") == 1)), docs.filter(learn))


@query("op8_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_on_labels(docs, table(spark, sf_dir, "labels"))
    narrow = docs.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "text")
    return score(narrow, model).select("doc_id", "held_out", "score", "predicted")
