"""Time-binned responses of people against boundaries of a model.

Presses are ``subj, movie, ms``. Bins are numbered from 0 and right-closed (bin ``i`` holds
``i*b < t <= (i+1)*b`` seconds, bin 0 also holds 0); frames of a model fall into left-closed
bins. ``durations`` is a small table ``movie, seconds``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventide.functions import hashed as H, vector as V
from eventide.operators.positions import BLOCK_ROWS, meet, with_lag
from eventide.session import shuffle_partitions


def press_bin(ms: Column, bin_s: float) -> Column:
    return F.greatest(F.ceil(ms / (1000.0 * bin_s)) - 1, F.lit(0)).cast("int")


def n_bins(seconds: Column, bin_s: float) -> Column:
    return F.ceil(seconds / float(bin_s)).cast("int")


def spine(durations: DataFrame, bin_s: float) -> DataFrame:
    """One row per (movie, bin); its size depends on the movies, not on the presses."""
    last = n_bins(F.col("seconds"), bin_s) - 1
    return durations.select("movie", F.explode(F.sequence(F.lit(0), last)).alias("bin"))


def _on_spine(counts: DataFrame, durations: DataFrame, bin_s: float, value: str) -> DataFrame:
    """Left join onto the spine: empty bins give 0, presses past the end drop out."""
    joined = spine(durations, bin_s).join(counts, ["movie", "bin"], "left")
    return joined.select("movie", "bin", F.coalesce(value, F.lit(0)).alias(value))


def binned_counts(presses: DataFrame, durations: DataFrame, bin_s: float) -> DataFrame:
    counts = presses.groupBy("movie", press_bin(F.col("ms"), bin_s).alias("bin")).agg(
        F.count("*").alias("n")
    )
    return _on_spine(counts, durations, bin_s, "n")


def group_rate(presses: DataFrame, durations: DataFrame, bin_s: float) -> DataFrame:
    """``movie, bin, rate``: distinct press times of a movie per bin, over the number of subjects."""
    times = presses.select("movie", "ms").distinct()
    counts = binned_counts(times, durations, bin_s)
    subjects = presses.select("subj").distinct().agg(F.count("*").alias("n"))
    return counts.select(
        "movie", "bin", (F.col("n") / F.lit(subjects.scalar())).alias("rate")
    )


def _r_pb(m1: Column, m0: Column, s: Column, n1: Column, n0: Column) -> Column:
    """Point-biserial correlation; NULL where a side or the spread is empty."""
    n = n1 + n0
    ok = (n1 > 0) & (n0 > 0) & (s > 0)
    return F.when(ok, (m1 - m0) / s * F.sqrt(n1.cast("double") * n0 / (n.cast("double") * n)))


def point_biserial(rows: DataFrame, flag: str, value: str, *by: str) -> DataFrame:
    """Correlation of a 0/1 flag with a value in one aggregation pass.

    A flag that is neither 0 nor 1 counts for the spread only.
    """
    f, v = F.col(flag).cast("int"), F.col(value)
    stats = rows.groupBy(*by).agg(
        F.count_if(f == 1).alias("n1"),
        F.count_if(f == 0).alias("n0"),
        F.avg(F.when(f == 1, v)).alias("m1"),
        F.avg(F.when(f == 0, v)).alias("m0"),
        F.stddev_pop(v).alias("s"),
    )
    r = _r_pb(*(F.col(c) for c in ("m1", "m0", "s", "n1", "n0")))
    return stats.select(*by, "n1", "n0", r.alias("r_pb"))


def subject_point_biserial(presses: DataFrame, durations: DataFrame, bin_s: float) -> DataFrame:
    """Each subject against the group, over all bins of all movies.

    A subject presses in few bins, so only those are joined; the empty bins follow from
    totals. Nothing of the size subjects x bins is built.
    """
    group = group_rate(presses, durations, bin_s)
    totals = group.agg(
        F.struct(
            F.count("*").alias("n"), F.sum("rate").alias("sum"), F.stddev_pop("rate").alias("s")
        ).alias("t")
    )
    mine = presses.groupBy("subj", "movie", press_bin(F.col("ms"), bin_s).alias("bin")).agg(
        F.count("*").alias("c")
    )
    joined = mine.join(group, ["movie", "bin"], "left")
    inside = F.col("rate").isNotNull()
    one = inside & (F.col("c") == 1)
    sums = joined.groupBy("subj").agg(
        F.count_if(one).alias("n1"),
        F.coalesce(F.sum(F.when(one, F.col("rate"))), F.lit(0.0)).alias("sum1"),
        F.count_if(inside).alias("filled"),
        F.coalesce(F.sum(F.when(inside, F.col("rate"))), F.lit(0.0)).alias("sum_filled"),
    ).withColumn("t", totals.scalar())
    n0 = F.col("t.n") - F.col("filled")
    r = _r_pb(
        F.col("sum1") / F.col("n1"), (F.col("t.sum") - F.col("sum_filled")) / n0, F.col("t.s"),
        F.col("n1"), n0,
    )
    return sums.select("subj", "n1", n0.alias("n0"), r.alias("r_pb"))


def binned_boundaries(flags: DataFrame, hz: float, bin_s: float) -> DataFrame:
    """``seq_id, bin, boundary``: does any boundary fall into a bin of model time?

    Frame ``i`` is at ``(i+1)/hz`` seconds; a frame exactly on the end of the last bin is
    dropped, as bins start strictly before the last frame time.
    """
    t = (F.col("pos") + 1) / F.lit(float(hz))
    rows = flags.select(
        "seq_id", t.alias("t"), F.floor(t / bin_s).cast("int").alias("bin"), "is_boundary"
    )
    per_bin = rows.groupBy("seq_id", "bin").agg(
        F.max("t").alias("t"), F.bool_or("is_boundary").alias("boundary")
    )
    ends = per_bin.groupBy("seq_id").agg((F.ceil(F.max("t") / bin_s) - 1).cast("int").alias("last"))
    bins = ends.select("seq_id", F.explode(F.sequence(F.lit(0), "last")).alias("bin"))
    joined = bins.join(per_bin.select("seq_id", "bin", "boundary"), ["seq_id", "bin"], "left")
    return joined.select("seq_id", "bin", F.coalesce("boundary", F.lit(False)).alias("boundary"))


def boundary_log_probability(results: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Per scene the log posterior of leaving the previous scene's label; 0 for the first.

    ``results`` has the array ``log_post`` over candidates. NULL stands for probability zero.
    """
    named = results.select("seq_id", "pos", "log_post", V.first_argmax(F.col("log_post")).alias("e_hat"))
    lagged = with_lag(named, {"_prev": "e_hat"}, rows)
    others = F.filter("log_post", lambda _, i: i != F.col("_prev"))
    leave = V.let(
        others,
        lambda o: F.when(F.size(o) > 0, V.array_logsumexp(o) - V.array_logsumexp(F.col("log_post"))),
    )
    return lagged.select(
        "seq_id", "pos", F.when(F.col("pos") == 0, F.lit(0.0)).otherwise(leave).alias("log_p")
    )


def binned_boundary_probability(log_p: DataFrame, hz: float, bin_s: float) -> DataFrame:
    """Log of the mean boundary probability per bin (empty probability gives NULL)."""
    t = (F.col("pos") + 1) / F.lit(float(hz))
    rows = log_p.select("seq_id", F.floor(t / bin_s).cast("int").alias("bin"), t.alias("t"), "log_p")
    # A bin holds at most hz * bin_s frames, so this window is small.
    top = F.max("log_p").over(Window.partitionBy("seq_id", "bin"))
    shifted = rows.withColumn("_top", top)
    per_bin = shifted.groupBy("seq_id", "bin").agg(
        F.max("t").alias("t"),
        (F.first("_top") + F.log(F.sum(F.exp(F.col("log_p") - F.col("_top"))))
         - F.log(F.lit(float(bin_s * hz)))).alias("log_p"),
    )
    ends = per_bin.groupBy("seq_id").agg((F.ceil(F.max("t") / bin_s) - 1).cast("int").alias("last"))
    return per_bin.join(ends, "seq_id").where(F.col("bin") <= F.col("last")).select("seq_id", "bin", "log_p")


def regression_line(rows: DataFrame, x: str, y: str, t_quantile: float, *by: str) -> DataFrame:
    """Least-squares line per group with the confidence band of the mean.

    ``t_quantile`` is the quantile of Student's t for n-2 degrees of freedom.
    """
    fit = rows.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
        F.regr_avgx(y, x).alias("mean_x"),
        F.regr_count(y, x).alias("n"),
    )
    joined = rows.join(fit, list(by)) if by else rows.withColumn("_f", fit.select(F.struct("*")).scalar()).select(*rows.columns, "_f.*")
    n = F.col("n")
    residual = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    band = F.lit(float(t_quantile)) * F.sqrt(
        residual / (n - 2) * (1.0 / n + (F.col(x) - F.col("mean_x")) * (F.col(x) - F.col("mean_x")) / F.col("sxx"))
    )
    fitted = F.col("intercept") + F.col("slope") * F.col(x)
    return joined.select(
        *rows.columns, fitted.alias("fitted"), (fitted - band).alias("lower"), (fitted + band).alias("upper")
    )


def permutation_null(bins: DataFrame, n_permutations: int, digits: int = 2) -> DataFrame:
    """``movie, p, r_pb``: the correlation after shuffling the flags over the bins.

    A shuffle marks the bins with the smallest hashes. Which bins those are is found without
    sorting a whole permutation in one task: sums per hash prefix show the prefix in which
    the wanted number is reached, and only that prefix is ranked.
    """
    stats = bins.groupBy("movie").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("flag")).alias("n1"),
        F.sum("value").alias("total"),
        F.stddev_pop("value").alias("s"),
    )
    # Few rows become many, so they are spread before they are repeated.
    spread = bins.repartition(shuffle_partitions(bins.sparkSession), "movie", "bin")
    drawn = spread.select(
        "movie", "bin", "value", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))).alias("p")
    ).withColumn("h", F.md5(H.key(F.col("p"), F.coalesce(F.col("movie").cast("string"), F.lit("null")), F.col("bin"))))
    drawn = drawn.withColumn("prefix", F.substring("h", 1, digits))
    sums = drawn.groupBy("movie", "p", "prefix").agg(
        F.count("*").alias("c"), F.sum("value").alias("v")
    )
    w = Window.partitionBy("movie", "p").orderBy("prefix")
    reached = (
        sums.withColumn("through", F.sum("c").over(w))
        .withColumn("before", F.col("through") - F.col("c"))
    )
    reached = meet(reached, stats, ["movie"])
    whole = reached.where(F.col("through") <= F.col("n1")).select("movie", "p", "v")
    split = reached.where((F.col("before") < F.col("n1")) & (F.col("n1") < F.col("through"))).select(
        "movie", "p", "prefix", (F.col("n1") - F.col("before")).alias("wanted")
    )
    rank = F.row_number().over(Window.partitionBy("movie", "p", "prefix").orderBy("h", "bin"))
    part = (
        meet(drawn, split, ["movie", "p", "prefix"])
        .withColumn("rank", rank)
        .where(F.col("rank") <= F.col("wanted"))
        .select("movie", "p", F.col("value").alias("v"))
    )
    marked = meet(whole.unionByName(part).groupBy("movie", "p").agg(F.sum("v").alias("sum1")), stats, ["movie"])
    # A movie without flagged bins has no marked bins, and its correlations are NULL.
    every = stats.where(F.col("n1") == 0).select(
        "movie", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))).alias("p")
    )
    marked = marked.unionByName(meet(every, stats, ["movie"]), allowMissingColumns=True)
    n0 = F.col("n") - F.col("n1")
    r = _r_pb(
        F.col("sum1") / F.col("n1"), (F.col("total") - F.col("sum1")) / n0, F.col("s"), F.col("n1"), n0
    )
    return marked.select("movie", "p", r.alias("r_pb"))


def best_attainable(rates: DataFrame, most: int | None = None) -> DataFrame:
    """Highest correlation that flags on the top-m bins can reach, over m = 1..``most`` (all by default).

    The window runs over the bins of a movie, whose number is fixed by its duration.
    """
    w = Window.partitionBy("movie").orderBy(F.desc("rate"), "bin")
    whole = Window.partitionBy("movie")
    run = rates.select(
        "movie",
        F.row_number().over(w).alias("m"),
        F.sum("rate").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("top"),
        F.count("*").over(whole).alias("n"),
        F.sum("rate").over(whole).alias("total"),
        F.stddev_pop("rate").over(whole).alias("s"),
    ).where((F.col("m") < F.col("n")) & (F.col("m") <= most if most is not None else F.lit(True)))
    n0 = F.col("n") - F.col("m")
    r = _r_pb(F.col("top") / F.col("m"), (F.col("total") - F.col("top")) / n0, F.col("s"), F.col("m"), n0)
    return run.groupBy("movie").agg(F.max(r).alias("r_pb"))


def top_bins(rates: DataFrame, k: int) -> DataFrame:
    return rates.orderBy(F.desc("rate"), "movie", "bin").limit(k)
