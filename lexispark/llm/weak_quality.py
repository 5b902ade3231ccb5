"""Quality rules as weak supervision: rules vote or abstain, EM finds their accuracies, posteriors decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexispark.llm.registry import let, query, table
from lexispark.plans.checkpoints import cut_lineage

_BLANKS = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]"
_CAPITAL = r"^\P{L}*\p{Lu}\P{Ll}+$"
_PLAIN = r"^[\"'(]?[\p{L}\p{N}'-]+[.,;:!?)\"']?$"
_WINDOW = 5

#: Rounds of expectation-maximisation, the pseudo-counts of each accuracy, and the posterior that a text needs.
ROUNDS, RIGHT, WRONG, LEAST_POSTERIOR = 40, 4.0, 1.0, 0.5


def words_of(text: Column) -> Column:
    """Words between blanks; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BLANKS), "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that the text holds twice or more.

    Hashes of windows settle most texts: if none repeats, no window does. For
    the others the windows themselves are sorted, so equal ones are neighbours,
    and the lengths of the parts that they cover are added up.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - _WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(_WINDOW)]))
    any_repeat = let(hashes, lambda h: F.size(h) > F.size(F.array_distinct(h)))
    return (
        F.when(n <= _WINDOW, F.lit(0))
        .when(~any_repeat, F.lit(0))
        .otherwise(_covered(_repeated_starts(words, starts)))
        .cast("long")
    )


def _repeated_starts(words: Column, starts: Column) -> Column:
    windows = F.transform(starts, lambda i: F.struct(F.slice(words, i + 1, _WINDOW).alias("w"), i.alias("at")))

    def repeated(found: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            return F.coalesce(F.get(found, i)["w"] == F.get(found, j)["w"], F.lit(False))

        places = F.sequence(F.lit(0), F.size(found) - 1)
        told = F.filter(places, lambda i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(told, lambda i: F.get(found, i)["at"]))

    return let(F.sort_array(windows), repeated)


def _covered(starts: Column) -> Column:
    """Positions covered by windows that begin at the sorted ``starts``."""
    step = lambda state, at: F.struct(
        (state["n"] + F.least(F.lit(_WINDOW), at - state["last"])).alias("n"), at.alias("last")
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(-_WINDOW).alias("last"))
    return F.aggregate(starts, start, step, lambda s: s["n"])


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts on which rules vote. Null and empty texts have zero of everything.

    Input columns with the names of the counts are replaced.
    """
    t = F.col(text)

    def counts(words: Column) -> Column:
        glued = F.array_join(words, "")
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(glued).cast("long").alias("word_chars"),
            F.size(F.filter(words, lambda w: w.rlike(_CAPITAL))).cast("long").alias("n_capital"),
            F.size(F.filter(words, lambda w: w.rlike(_PLAIN))).cast("long").alias("n_plain"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            repeated_words(words).alias("n_repeat_words"),
        )

    counted = docs.withColumn("__counts", let(words_of(t), counts))
    names = ["n_words", "word_chars", "n_capital", "n_plain", "n_distinct", "n_repeat_words"]
    kept = [c for c in docs.columns if c not in {*names, "n_symbols", "n_dup_lines", "n_calls"}]
    return counted.select(
        *kept,
        *[F.col("__counts")[n].alias(n) for n in names],
        F.regexp_count(F.coalesce(t, F.lit("")), F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        repeated_lines(t).alias("n_dup_lines"),
        F.regexp_count(F.coalesce(t, F.lit("")), F.lit("[!?]")).cast("long").alias("n_calls"),
    )


def rules() -> dict[str, Column]:
    """Votes on a text: 1 good, -1 bad, 0 abstains.

    Each rule speaks only where its count tells something; texts of few words
    are left to the base rule.
    """
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c: F.col(c) / n

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "symbols": vote(share("n_symbols") > 0.2, share("n_symbols") < 0.05),
        "capitals": vote(share("n_capital") > 0.5, share("n_capital") < 0.2),
        "plain_words": vote(share("n_plain") < 0.6, share("n_plain") > 0.85),
        "calls": vote(share("n_calls") > 0.4, share("n_calls") < 0.1),
        "repeats": vote(share("n_repeat_words") > 0.2, share("n_repeat_words") < 0.05),
        "lines": vote(F.col("n_dup_lines") * 10 > n, F.col("n_dup_lines") == 0),
        "variety": vote(
            (F.col("n_words") >= 30) & (F.log1p("n_distinct") < 0.6 * F.log1p(n)),
            F.log1p("n_distinct") > 0.8 * F.log1p(n),
        ),
        "word_length": vote(
            (F.col("word_chars") > 20 * n) | (F.col("word_chars") < 2 * n),
            F.col("word_chars").between(3 * n, 12 * n),
        ),
    }


def fit_accuracies(votes: DataFrame, names: list[str]) -> DataFrame:
    """One row: the share of good texts and, per rule, how often its votes are right on good and on bad texts.

    Texts are counted by their pattern of votes, at most 3 ** len(names) of
    them, so EM runs on a table whose size does not depend on the corpus. The
    start takes a text for bad if any rule says so; every round weighs the
    patterns by their posterior and counts anew. A rule with no votes keeps its
    pseudo-counts.
    """
    patterns = votes.groupBy(*names).agg(F.count("*").cast("double").alias("rows"))
    v = F.array(*[F.col(n).cast("double") for n in names])
    any_bad = F.array_min(v) < 0
    gathered = patterns.select(
        F.col("rows"), v.alias("v"), F.when(any_bad, 0.2).otherwise(0.95).alias("p")
    ).agg(F.sort_array(F.collect_list(F.struct("v", "rows", "p"))).alias("table"))
    k = len(names)

    def maximise(weighted: Column) -> Column:
        """Accuracies from patterns with fields v, rows, p."""
        def total(of: Column) -> Column:
            return F.aggregate(weighted, F.lit(0.0), lambda s, x: s + of(x))

        def right(j: int, sign: int) -> Column:
            weight = (lambda x: x["rows"] * x["p"]) if sign > 0 else (lambda x: x["rows"] * (1 - x["p"]))
            agree = total(lambda x: F.when(F.get(x["v"], F.lit(j)) == sign, weight(x)).otherwise(0.0))
            spoke = total(lambda x: F.when(F.get(x["v"], F.lit(j)) != 0, weight(x)).otherwise(0.0))
            return (agree + RIGHT) / (spoke + RIGHT + WRONG)

        return F.struct(
            ((total(lambda x: x["rows"] * x["p"]) + 1.0) / (total(lambda x: x["rows"]) + 2.0)).alias("share"),
            F.array(*[right(j, 1) for j in range(k)]).alias("on_good"),
            F.array(*[right(j, -1) for j in range(k)]).alias("on_bad"),
        )

    def weigh(model: Column) -> Column:
        return F.transform(
            F.col("table"),
            lambda x: F.struct(x["v"].alias("v"), x["rows"].alias("rows"), posterior(x["v"], model, k).alias("p")),
        )

    fitted = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), maximise(F.col("table")), lambda model, _: let(weigh(model), maximise)
    )
    return gathered.select(fitted.alias("model"))


def posterior(votes: Column, model: Column, k: int) -> Column:
    """P(good | votes) with rules independent given the class; abstaining says nothing."""
    def step(s: Column, j: Column) -> Column:
        v, g, b = F.get(votes, j), F.get(model["on_good"], j), F.get(model["on_bad"], j)
        return s + F.when(v > 0, F.log(g / (1 - b))).when(v < 0, F.log((1 - g) / b)).otherwise(0.0)

    odds = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.log(model["share"] / (1 - model["share"])), step)
    return 1.0 / (1.0 + F.exp(-odds))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts, votes, ``base_failed``, ``posterior`` and ``kept`` for every row of ``docs`` but its text.

    ``base_failed``: fewer than ten words, or over a fifth of the words lie in
    repeated windows. Such texts are not kept and take no part in learning.
    The measured rows, without texts, are checkpointed, as they are read twice.
    """
    votes = rules()
    names = list(votes)
    n = F.col("n_words")
    measured = measure(docs, text).drop(text)
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    taken = [c for c in measured.columns if c not in {*names, "base_failed", "posterior", "kept", "rule_votes"}]
    voted = cut_lineage(
        measured.select(
            *taken, failed.alias("base_failed"), F.array(*[votes[x].cast("double") for x in names]).alias("rule_votes")
        )
    )
    single = voted.filter(~F.col("base_failed")).select(
        *[F.get("rule_votes", F.lit(i)).cast("int").alias(x) for i, x in enumerate(names)]
    )
    model = fit_accuracies(single, names).first()["model"]
    known = F.struct(
        F.lit(float(model["share"])).alias("share"),
        F.array(*[F.lit(float(x)) for x in model["on_good"]]).alias("on_good"),
        F.array(*[F.lit(float(x)) for x in model["on_bad"]]).alias("on_bad"),
    )
    scored = voted.withColumn("posterior", posterior(F.col("rule_votes"), known, len(names)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= LEAST_POSTERIOR))


@query("op1_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("posterior", 6).alias("posterior"),
    )
