"""Fixed-length training sequences, padding, masks and masked-token examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexispark.functions.draws import MODULUS, draw_from, draw_state, draws_along
from lexispark.operators.vocab import BOS, EOS, MASK, PAD
from lexispark.plans.blocked import running_sum
from lexispark.plans.checkpoints import stored


def pack_sequences(
    df: DataFrame,
    length: int,
    shard: Column,
    drop_last: bool = True,
    doc_id: str = "doc_id",
    ids: str = "ids",
    docs_per_block: int = 1 << 12,
) -> DataFrame:
    """``shard, seq_no, input_ids``: the ids of each shard in document order, cut every ``length`` ids.

    The encoded documents are stored once in the scratch folder. Documents get
    their offset by block-wise running sums; then every document is sliced at the
    cuts, so the shuffle moves one row per document and cut instead of one per
    token, and a group never holds more than ``length`` ids.
    """
    sized = df.select(shard.alias("shard"), doc_id, ids, F.size(ids).cast("bigint").alias("n")).filter("n > 0")
    sized = stored(sized, "encoded")
    placed = running_sum(
        sized, ["shard"], [doc_id], F.floor(F.col(doc_id) / docs_per_block), F.col("n"), "off", inclusive=False
    )
    cuts = F.sequence(
        F.floor(F.col("off") / length), F.floor((F.col("off") + F.col("n") - 1) / length)
    )
    begin = F.col("seq_no") * length
    skip = F.greatest(begin - F.col("off"), F.lit(0))
    take = F.least(F.col("n"), begin + length - F.col("off")) - skip
    fragments = placed.withColumn("seq_no", F.explode(cuts)).select(
        "shard",
        "seq_no",
        F.greatest(F.col("off") - begin, F.lit(0)).alias("at"),
        F.slice(ids, (skip + 1).cast("int"), take.cast("int")).alias("part"),
    )
    packed = (
        fragments.groupBy("shard", "seq_no")
        .agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("x"))
        .select("shard", "seq_no", F.flatten(F.col("x.part")).alias("body"))
    )
    if drop_last:
        packed = packed.filter(F.size("body") == length)
    else:
        packed = packed.withColumn("body", pad_right(F.col("body"), length, PAD))
    return packed.select("shard", "seq_no", with_specials(F.col("body")).alias("input_ids"))


def with_specials(ids: Column) -> Column:
    return F.concat(F.array(F.lit(BOS).cast("bigint")), ids, F.array(F.lit(EOS).cast("bigint")))


def pad_right(ids: Column, size: int, pad) -> Column:
    """Cut or fill to ``size`` at the end."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), size)), 1, size)


def pad_left(ids: Column, size: int, pad) -> Column:
    """Cut at the end, fill at the front."""
    kept = F.slice(ids, 1, size)
    return F.concat(F.array_repeat(F.lit(pad), F.lit(size) - F.size(kept)), kept)


def encoder_block(ids: Column, size: int, pad=-1) -> Column:
    """ids, segments, positions and mask of one sentence, each ``size`` long, one after another."""
    n = F.least(F.size(ids), F.lit(size))
    positions = F.transform(ids, lambda x, i: i.cast("bigint"))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), size)
    mask = F.concat(F.array_repeat(F.lit(1).cast("bigint"), n), zeros)
    return F.concat(
        pad_right(ids, size, pad), zeros, pad_right(positions, size, pad), F.slice(mask, 1, size)
    )


def encoder_block_of_padded(ids: Column) -> Column:
    """The same from a zero-padded vector: trailing zeros are padding and get mask 0."""
    size = F.size(ids)
    last = F.array_max(F.transform(ids, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    index = F.transform(ids, lambda x, i: i.cast("bigint"))
    return F.concat(
        ids,
        F.array_repeat(F.lit(0).cast("bigint"), size),
        index,
        F.transform(index, lambda i: F.when(i < last, 1).otherwise(0).cast("bigint")),
    )


def shift_labels(ids: Column, offset: int, pad=-1) -> Column:
    return F.transform(ids, lambda x: F.when(x != pad, x + offset).otherwise(x))


def attention_masks(df: DataFrame, batch: list[str], ids: str = "ids") -> DataFrame:
    """Pad every sequence to the longest of its batch; add attention and special-token masks."""
    body = df.withColumn(ids, with_specials(F.col(ids)))
    longest = body.groupBy(*batch).agg(F.max(F.size(ids)).alias("longest"))
    n, fill = F.size(ids), F.col("longest") - F.size(ids)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    padded = F.concat(ids, F.array_repeat(F.lit(PAD).cast("bigint"), fill))
    return (
        body.join(longest, batch)
        .withColumn("attention_mask", F.concat(F.array_repeat(one, n), F.array_repeat(zero, fill)))
        .withColumn(ids, padded)
        .withColumn("special_mask", F.transform(ids, lambda x: x.isin(BOS, EOS, PAD).cast("bigint")))
        .drop("longest")
    )


def mask_tokens(
    df: DataFrame, key: list[str], vocab_size: int, ids: str = "input_ids", share: float = 0.15, seed: int = 17
) -> DataFrame:
    """Masked-token examples: ``masked_ids`` and ``labels`` (-100 where nothing is asked).

    A position is chosen with probability ``share``, never on a special; of the
    chosen, 80 % become MASK, 10 % a random normal token, 10 % stay.
    """
    normal = vocab_size - 4  # every id but PAD, BOS, EOS and MASK
    keys = [F.col(k) for k in key]

    def one(c: Column, x: Column, i: Column) -> Column:
        chosen = (F.get(c["draws"], i) < int(share * MODULUS)) & ~x.isin(PAD, BOS, EOS)
        kind = draw_from(c["kind"], i)
        pick = draw_from(c["pick"], i) % F.lit(normal)
        random_id = F.when(pick == 0, F.lit(1).cast("bigint")).otherwise(pick + 4)
        hidden = (
            F.when(kind < int(0.8 * MODULUS), F.lit(MASK).cast("bigint"))
            .when(kind < int(0.9 * MODULUS), random_id)
            .otherwise(x)
        )
        pair = lambda shown, label: F.struct(shown.alias("id"), label.alias("label"))
        return F.when(chosen, pair(hidden, x)).otherwise(pair(x, F.lit(-100).cast("bigint")))

    # What a sequence's draws share is the variable of an outer lambda: worked out once, not once per token.
    states = F.struct(*[draw_state(seed + k, *keys).alias(name) for k, name in enumerate(("chosen", "kind", "pick"))])
    shared = F.transform(F.array(states), lambda s: F.struct(draws_along(F.col(ids), s["chosen"]).alias("draws"), s["kind"], s["pick"]))
    masked = F.transform(shared, lambda c: F.transform(F.col(ids), lambda x, i: one(c, x, i)))[0]

    return (
        df.withColumn("__m", masked)
        .withColumn("masked_ids", F.col("__m.id"))
        .withColumn("labels", F.col("__m.label"))
        .withColumn("attention_mask", F.transform("masked_ids", lambda x: (x != PAD).cast("bigint")))
        .drop("__m")
    )


def keep_labels(labels: Column, key: list[Column], share: float, seed: int = 5) -> Column:
    """Keep each label with probability ``share``, else -1."""
    kept = lambda s: F.zip_with(
        labels, draws_along(labels, s), lambda x, d: F.when(d <= int(share * MODULUS), x).otherwise(F.lit(-1))
    )
    return F.transform(F.array(draw_state(seed, *key)), kept)[0]
