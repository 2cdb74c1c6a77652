"""Scores of predictions and clusterings, corpus counts and gate predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventide.functions import vector as V
from eventide.operators.positions import meet


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(gt: Column | str = "gt", pred: Column | str = "pred") -> list[Column]:
    """Aggregates tp, fp, fn; they combine map-side."""
    g = F.col(gt) if isinstance(gt, str) else gt
    p = F.col(pred) if isinstance(pred, str) else pred
    return [
        F.count_if(g & p).alias("tp"),
        F.count_if(~g & p).alias("fp"),
        F.count_if(g & ~p).alias("fn"),
    ]


def with_f1(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 from pooled counts; zero denominators give 0."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    scored = counts.withColumn("precision", _ratio(tp, tp + fp)).withColumn(
        "recall", _ratio(tp, tp + fn)
    )
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", _ratio(2.0 * p * r, p + r))


def f1_score(predictions: DataFrame, *by: str) -> DataFrame:
    """Micro-averaged shift F1 over all sequences (or one row per ``by``)."""
    return with_f1(predictions.groupBy(*by).agg(*confusion()))


def corpus_counts(shifts_per_turn: DataFrame) -> DataFrame:
    """Conversations, turns, transitions, shifts and the shift rate.

    Input has one row per turn with ``shift`` (false on first turns). Counting per sequence
    first makes the distinct count exact without a second shuffle of the rows.
    """
    per_seq = shifts_per_turn.groupBy("seq_id").agg(
        F.count("*").alias("turns"), F.count_if(F.col("shift")).alias("shifts")
    )
    out = per_seq.agg(
        F.count("*").alias("conversations"),
        F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"),
        F.coalesce(F.sum("shifts"), F.lit(0)).alias("shifts"),
    )
    transitions = F.col("turns") - F.col("conversations")
    return out.withColumn("transitions", transitions).withColumn(
        "shift_rate", _ratio(F.col("shifts").cast("double"), F.col("transitions"))
    )


def sequence_profile(turns: DataFrame, *by: str) -> DataFrame:
    """Turns per sequence (mean, min, max, exact median), labels and shifts per sequence.

    Needs ``label`` and ``shift`` per turn. The exact median runs over sequence lengths, of
    which only the distinct values are kept.
    """
    per_label = turns.groupBy(*by, "seq_id", "label").agg(
        F.count("*").alias("n"), F.count_if(F.col("shift")).alias("shifts")
    )
    per_seq = per_label.groupBy(*by, "seq_id").agg(
        F.sum("n").alias("turns"),
        F.count("*").alias("labels"),
        F.sum("shifts").alias("shifts"),
    )
    return per_seq.groupBy(*by).agg(
        F.count("*").alias("sequences"),
        F.avg("turns").alias("mean_turns"),
        F.min("turns").alias("min_turns"),
        F.max("turns").alias("max_turns"),
        F.percentile("turns", 0.5).alias("median_turns"),
        F.avg("labels").alias("mean_labels"),
        F.avg("shifts").alias("mean_shifts"),
    )


def text_profile(turns: DataFrame, tokens: str, entities: str, text: str) -> DataFrame:
    """Mean tokens, entities and characters per turn."""
    return turns.agg(
        F.count("*").alias("turns"),
        F.avg(F.size(tokens)).alias("mean_tokens"),
        F.avg(F.size(entities)).alias("mean_entities"),
        F.avg(F.length(text)).alias("mean_chars"),
    )


def contingency(pairs: DataFrame, true: str, pred: str, *by: str) -> DataFrame:
    return pairs.groupBy(*by, F.col(true).alias("t"), F.col(pred).alias("p")).agg(
        F.count("*").alias("n")
    )


def _choose2(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1.0) / 2.0


def adjusted_rand(pairs: DataFrame, true: str, pred: str, *by: str) -> DataFrame:
    """Adjusted Rand index in closed form over the contingency counts."""
    cells = contingency(pairs, true, pred, *by)
    keys = list(by)

    def margin(column: str, name: str) -> DataFrame:
        sums = cells.groupBy(*by, column).agg(F.sum("n").alias("n"))
        return sums.groupBy(*by).agg(F.sum(_choose2(F.col("n"))).alias(name))

    both = cells.groupBy(*by).agg(
        F.sum(_choose2(F.col("n"))).alias("both"), F.sum("n").alias("rows")
    )
    parts = [both, margin("t", "a"), margin("p", "b")]
    if keys:
        joined = meet(meet(parts[0], parts[1], keys), parts[2], keys)
    else:
        # One-row tables: read the margins as scalar subqueries.
        joined = both.select(
            "*", parts[1].scalar().alias("a"), parts[2].scalar().alias("b")
        )
    expected = F.when(_choose2(F.col("rows")) > 0, F.col("a") * F.col("b") / _choose2(F.col("rows")))
    top = (F.col("a") + F.col("b")) / 2.0
    ari = F.when(
        top == F.coalesce(expected, F.lit(0.0)), F.lit(1.0)
    ).otherwise((F.col("both") - expected) / (top - expected))
    return joined.select(*by, "rows", ari.alias("ari"))


def purity(pairs: DataFrame, true: str, pred: str, *by: str) -> DataFrame:
    """Share of rows in the majority label of their cluster."""
    cells = contingency(pairs, true, pred, *by)
    tops = cells.groupBy(*by, "p").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return tops.groupBy(*by).agg(
        F.count("*").alias("clusters"),
        (F.sum("top").cast("double") / F.sum("n")).alias("purity"),
        F.min(F.col("top").cast("double") / F.col("n")).alias("min_purity"),
    )


def logsumexp(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Log-sum-exp of a long-form column; the rows are read once.

    Values are counted by their whole part, and a whole part's sum is scaled by it, so exp never
    overflows. These few sums per group are then put on the scale of the largest. NULL groups are groups; NULL values are
    left out; minus infinity adds nothing.
    """
    whole = F.when(F.col(value) > float("-inf"), F.floor(value))
    sums = rows.where(F.col(value).isNotNull()).withColumn("_k", whole).groupBy(*by, "_k").agg(
        F.sum(F.exp(F.col(value) - F.col("_k"))).alias("_s")
    )
    packed = sums.groupBy(*by).agg(F.max("_k").alias("_m"), F.collect_list(F.struct("_k", "_s")).alias("_c"))
    mass = F.aggregate(
        F.filter("_c", lambda c: c["_k"].isNotNull()), F.lit(0.0),
        lambda acc, c: acc + c["_s"] * F.exp((c["_k"] - F.col("_m")).cast("double")),
    )
    return packed.select(*by, F.when(F.col("_m").isNull(), F.lit(float("-inf"))).otherwise(F.col("_m") + F.log(mass)).alias("logsumexp"))


def passes(f1: Column, baseline: Column, floor: float = 0.4) -> Column:
    """The quality part of the gate."""
    return (f1 > baseline) & (f1 > F.lit(float(floor)))


def gate(metrics: DataFrame, method: str, baseline: str, floor: float = 0.4,
         time: str | None = None, limit_ms: float = 200.0) -> DataFrame:
    """Gate per benchmark: beats the baseline, beats the floor, stays in the time limit.

    ``metrics`` has ``benchmark, method, f1`` and, under the name ``time``, the measured milliseconds
    per turn. A missing method or time gives NULL.
    """
    f1_of = lambda m: F.max(F.when(F.col("method") == m, F.col("f1")))
    taken = F.max(F.when(F.col("method") == method, F.col(time))) if time else F.lit(None).cast("double")
    wide = metrics.groupBy("benchmark").agg(
        f1_of(method).alias("f1"), f1_of(baseline).alias("baseline_f1"), taken.alias("_ms")
    )
    in_time = F.col("_ms") <= F.lit(limit_ms)
    return (
        wide.withColumn("beats_baseline", F.col("f1") > F.col("baseline_f1"))
        .withColumn("beats_floor", F.col("f1") > F.lit(float(floor)))
        .withColumn("in_time", in_time)
        .withColumn("passed", F.col("beats_baseline") & F.col("beats_floor") & F.col("in_time"))
        .drop("_ms")
    )


def combined_gate(gates: DataFrame, expected: list[str]) -> DataFrame:
    """AND over the expected benchmarks in three-valued logic: unknown if one is missing."""
    wanted = [F.max(F.when(F.col("benchmark") == b, F.col("passed"))) for b in expected]
    verdict = wanted[0]
    for w in wanted[1:]:
        verdict = verdict & w
    return gates.agg(verdict.alias("passed"))


def sample_agreement(samples: DataFrame) -> DataFrame:
    """Mean label agreement: per sample first, then over samples."""
    per_sample = samples.groupBy("sample_id").agg(
        F.avg((F.col("e") == F.col("e_true")).cast("double")).alias("agreement")
    )
    return per_sample.agg(F.count("*").alias("samples"), F.avg("agreement").alias("agreement"))


def pearson(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Pearson correlation of two array columns, element against element."""
    cells = pairs.select(*by, F.explode(F.arrays_zip(V.as_double(F.col(a)).alias("x"), V.as_double(F.col(b)).alias("y"))).alias("c"))
    return cells.groupBy(*by).agg(F.corr("c.x", "c.y").alias("r"))


def v_measure(pairs: DataFrame, true: str, pred: str, *by: str) -> DataFrame:
    """Homogeneity, completeness and their harmonic mean from the contingency counts.

    All three sums of ``n log n`` come from one pass with grouping sets over the counts. A side without
    entropy counts as fully explained.
    """
    # NULL labels are labels: they travel as structs, which are never NULL themselves.
    cells = contingency(pairs, true, pred, *by).select(*by, F.struct("t").alias("t"), F.struct("p").alias("p"), "n")
    sets = [[*by, "t", "p"], [*by, "t"], [*by, "p"], list(by)]
    margins = cells.groupingSets([[F.col(c) for c in s] for s in sets], *by, "t", "p").agg(
        F.sum("n").cast("double").alias("n"), F.grouping("t").alias("gt"), F.grouping("p").alias("gp")
    )
    plogp = lambda gt, gp: F.sum(F.when((F.col("gt") == gt) & (F.col("gp") == gp), F.col("n") * F.log("n")))
    sums = margins.groupBy(*by).agg(
        plogp(0, 0).alias("_b"), plogp(0, 1).alias("_t"), plogp(1, 0).alias("_p"),
        F.max(F.when((F.col("gt") == 1) & (F.col("gp") == 1), F.col("n"))).alias("_n"),
    )
    whole = F.col("_n") * F.log("_n")
    explained = lambda own, other: F.when(whole - F.col(own) < 1e-9, F.lit(1.0)).otherwise(1.0 - (F.col(other) - F.col("_b")) / (whole - F.col(own)))
    scored = sums.select(*by, F.col("_n").cast("bigint").alias("rows"), explained("_t", "_p").alias("homogeneity"), explained("_p", "_t").alias("completeness"))
    h, c = F.col("homogeneity"), F.col("completeness")
    return scored.withColumn("v_measure", _ratio(2.0 * h * c, h + c))
