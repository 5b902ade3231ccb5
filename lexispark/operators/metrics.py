"""Dataset statistics and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexispark.plans.blocked import running_sum


def length_histogram(df: DataFrame, length: Column) -> DataFrame:
    return df.groupBy(length.cast("bigint").alias("length")).agg(F.count("*").alias("n"))


def length_coverage(histogram: DataFrame, lengths_per_block: int = 1 << 12) -> DataFrame:
    """Share of rows at most as long as each length."""
    block = F.floor(F.col("length") / lengths_per_block)
    up_to = running_sum(histogram, [], ["length"], block, F.col("n"), "up_to")
    # One row per distinct length: a small table by nature.
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    return up_to.select("length", "up_to", (F.col("up_to") / total).alias("share"))


def length_quartiles(df: DataFrame, label: str, length: Column) -> DataFrame:
    """Exact quartiles from counted lengths, so that repeated lengths travel once."""
    counted = df.groupBy(label, length.alias("len")).agg(F.count("*").alias("n"))
    p = F.percentile("len", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    return counted.groupBy(label).agg(p.alias("p"), F.min("len").alias("shortest"), F.max("len").alias("longest")).select(
        label, "shortest", *[F.col("p")[i].alias(f"q{i + 1}") for i in range(3)], "longest"
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per label: 10/count, total/(classes*count) and total/count."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    # One row per label: a small table by nature of the task.
    everything = W.partitionBy(F.lit(1))
    total, classes = F.sum("n").over(everything), F.count("*").over(everything)
    return counts.select(
        label,
        "n",
        (F.lit(10.0) / F.col("n")).alias("w_ten"),
        (total / (classes * F.col("n"))).alias("w_balanced"),
        (total / F.col("n")).alias("w_inverse"),
    )


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.groupBy(gold, pred).agg(F.count("*").alias("n"))


def class_metrics(matrix: DataFrame, gold: str, pred: str, beta: float = 1.0) -> DataFrame:
    """Precision, recall and F-beta per label from a confusion table; absent cases count as 0."""
    hit = F.when(F.col(gold) == F.col(pred), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col(gold).alias("label"), hit.alias("tp"), F.col("n").alias("g"), F.lit(0).cast("bigint").alias("p")),
        F.struct(F.col(pred).alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("g"), F.col("n").alias("p")),
    )
    sums = matrix.select(F.inline(sides)).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("g").alias("g"), F.sum("p").alias("p"))
    return scores(sums, "label", beta)


def scores(sums: DataFrame, key: str, beta: float = 1.0) -> DataFrame:
    """Precision, recall and F-beta from counts ``tp``, ``g`` (gold) and ``p`` (predicted)."""
    b2 = beta * beta
    precision = F.coalesce(F.try_divide("tp", "p"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "g"), F.lit(0.0))
    return sums.withColumn("precision", precision).withColumn("recall", recall).select(
        key,
        "precision",
        "recall",
        F.coalesce(
            F.try_divide((1 + b2) * F.col("precision") * F.col("recall"), b2 * F.col("precision") + F.col("recall")), F.lit(0.0)
        ).alias("f"),
    )


def accuracy(matrix: DataFrame, gold: str, pred: str, skip: str | None = None) -> DataFrame:
    """Overall accuracy, and accuracy without one gold label."""
    right = F.when(F.col(gold) == F.col(pred), F.col("n")).otherwise(0)
    kept = F.lit(True) if skip is None else F.col(gold) != skip
    return matrix.agg(
        (F.sum(right) / F.sum("n")).alias("accuracy"),
        F.try_divide(F.sum(F.when(kept, right)), F.sum(F.when(kept, F.col("n")))).alias("accuracy_kept"),
    )


def multilabel_overall(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Overlap accuracy, mean document F1 and micro precision, recall, F1 of label sets."""
    both = F.size(F.array_intersect(gold, pred))
    sizes = df.select(
        both.alias("both"),
        F.size(F.array_union(gold, pred)).alias("either"),
        F.size(gold).alias("g"),
        F.size(pred).alias("p"),
    )
    micro_p, micro_r = F.sum("both") / F.sum("p"), F.sum("both") / F.sum("g")
    return sizes.agg(
        F.avg(F.coalesce(F.try_divide("both", "either"), F.lit(0.0))).alias("accuracy"),
        F.avg(F.coalesce(F.try_divide(2 * F.col("both"), F.col("g") + F.col("p")), F.lit(0.0))).alias("document_f1"),
        micro_p.alias("micro_precision"),
        micro_r.alias("micro_recall"),
        (2 * F.sum("both") / (F.sum("p") + F.sum("g"))).alias("micro_f1"),
    )


def multilabel_by_label(df: DataFrame, gold: str, pred: str) -> DataFrame:
    rows = df.select(F.explode(F.array_union(gold, pred)).alias("label"), gold, pred)
    g, p = F.array_contains(gold, F.col("label")), F.array_contains(pred, F.col("label"))
    sums = rows.groupBy("label").agg(
        F.count_if(g & p).alias("tp"), F.count_if(g).alias("g"), F.count_if(p).alias("p")
    )
    return scores(sums, "label")


def masked_topk(df: DataFrame, gold: str, ranked: str, ignored=-100) -> DataFrame:
    """Top-1 and top-k accuracy over the positions that were asked."""
    asked = df.filter(F.col(gold) != ignored)
    return asked.agg(
        F.count("*").alias("masked_tokens"),
        F.avg((F.get(ranked, F.lit(0)) == F.col(gold)).cast("int")).alias("top1"),
        F.avg(F.array_contains(ranked, F.col(gold)).cast("int")).alias("topk"),
    )


def auc(df: DataFrame, score: str, label: str, block: Column) -> DataFrame:
    """Area under the ROC curve by rank sum, ties at half; ranks come from the histogram of scores."""
    counts = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    below = running_sum(counts, [], [score], block, F.col("neg"), "neg_below", inclusive=False)
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return below.agg((won / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auc"))


def chunk_scores(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Entity precision, recall and F1 per type and overall; a hit needs equal start, end and type."""
    same = [*keys, "start", "end", "type"]
    marks = gold.select(*same, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(
        pred.select(*same, F.lit(0).alias("g"), F.lit(1).alias("p"))
    )
    spans = marks.groupBy(*same).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    by_type = spans.groupBy("type").agg(
        F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum("g").alias("g"), F.sum("p").alias("p")
    )
    whole = by_type.groupBy(F.lit("ALL").alias("type")).agg(*[F.sum(c).alias(c) for c in ("tp", "g", "p")])
    return scores(by_type.unionByName(whole), "type")


def token_pairs(df: DataFrame, keys: list[str], gold: str, pred: str, pad) -> DataFrame:
    """One row per position that is not padding, prediction beside gold."""
    zipped = F.filter(F.zip_with(gold, pred, lambda g, p: F.struct(g.alias("gold"), p.alias("pred"))), lambda x: x["gold"] != pad)
    return df.select(*keys, F.posexplode(zipped).alias("pos", "x")).select(*keys, "pos", "x.gold", "x.pred")


def score_summary(df: DataFrame, config: list[str], metrics: list[str], digits: int = 4) -> DataFrame:
    """Mean and deviation of every metric per configuration."""
    out = []
    for m in metrics:
        out += [F.round(F.avg(m), digits).alias(f"{m}_mean"), F.round(F.stddev_samp(m), digits).alias(f"{m}_std")]
    return df.groupBy(*config).agg(F.count("*").alias("runs"), *out)


def best_config(df: DataFrame, group: str, config: list[str], metric: str) -> DataFrame:
    """The configuration with the best mean of each group; ties go to the smallest configuration."""
    means = df.groupBy(group, *config).agg(F.round(F.avg(metric), 6).alias("mean"))
    best = F.min(F.struct((-F.col("mean")).alias("m"), *config)).alias("b")
    return means.groupBy(group).agg(best).select(group, *[F.col(f"b.{c}").alias(c) for c in config], (-F.col("b.m")).alias("mean"))


def horizon_means(df: DataFrame, config: list[str], errors: str, horizon: int) -> DataFrame:
    """Mean error per horizon step, one column per step."""
    return df.groupBy(*config).agg(
        F.count("*").alias("n"), *[F.avg(F.get(errors, F.lit(j))).alias(f"h{j + 1}") for j in range(horizon)]
    )


def regression_scores(df: DataFrame, label: str, prediction: str, keys: list[str] | None = None) -> DataFrame:
    """``n``, ``mae``, ``mse``, ``rmse``, ``r2`` over all rows or by ``keys``, in one aggregate.

    Rows in which either value is null do not count. R² is null where all labels
    are equal. The variance is Spark's own, which adds up deviations and not squares.
    """
    y, gap = F.col(label).cast("double"), F.col(label).cast("double") - F.col(prediction).cast("double")
    rows = df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    mse = F.avg(gap * gap)
    return rows.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
        (1 - F.try_divide(mse, F.var_pop(y))).alias("r2"),
    )


def joint_scores(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """``tokens``, ``joint``: how many offsets and labels are both right.

    A sequence holds its offsets in the first half and its labels in the second;
    0 is padding in ``gold`` and does not count. Null sequences are left out, and
    what ``pred`` lacks is wrong.
    """
    half = F.floor(F.size(gold) / 2).cast("int")
    rows = df.filter(F.col(gold).isNotNull()).withColumn("__half", half)
    told = F.transform(
        F.sequence(F.lit(1), F.col("__half")),
        lambda i: F.struct(
            (F.get(gold, i - 1) > 0).alias("real"),
            (
                (F.get(gold, i - 1) == F.coalesce(F.get(pred, i - 1), F.lit(-1)))
                & (F.get(gold, i - 1 + F.col("__half")) == F.coalesce(F.get(pred, i - 1 + F.col("__half")), F.lit(-1)))
            ).alias("right"),
        ),
    )
    tokens = rows.filter("__half > 0").select(F.inline(told)).filter("real")
    return tokens.agg(F.count("*").alias("tokens"), F.avg(F.col("right").cast("int")).alias("joint"))
