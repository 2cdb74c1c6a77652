"""Quality rules with robust multivariate outliers: the minimum covariance determinant per language and source.

Each document becomes a vector of transformed text statistics. For every (language, source) the
estimator looks for the half of the documents whose covariance has the smallest determinant: starting from medians and
median deviations, each concentration step takes mean and covariance of the documents that are nearest by the last
estimate, which never raises the determinant. All documents near that half then make the final, reweighted estimate. Documents of a group are rejected by their Mahalanobis distance to it.

The groups' estimates are written tables: joins broadcast them while they are small, and shuffle and split hot groups otherwise.
A step is one aggregation over a narrow table of vectors: moments and approximate quantiles, both combined before
the shuffle, so a source with a third of all rows costs its tasks no more than the others. The covariance is inverted by
its Cholesky factor, written out as column expressions.

Defined cases: a null or empty text has no words, fails the base rule and never enters an estimate. A null language or
source is a group of its own. Groups of fewer than ``LEAST_GROUP`` documents that pass the base rules are judged by the estimate
of all documents of their language, and languages with fewer by the estimate of the whole table; only in a table with fewer of them
nothing is rejected by distance. An empty table gives an empty result. Repeated rows count as often as they occur. Texts of any length are taken
whole; columns besides ``doc_id``, ``lang``, ``source`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import safe_join, table, words, written

#: Documents of a group without which it has no covariance of its own.
LEAST_GROUP = 30
#: The share of a group that the estimate is fitted to: it stands while less than the rest is junk.
HALF = 0.5
STEPS = 6
#: Squared distances count in units of their median in the group, which is set to the median of a
#: chi-square law with as many degrees as there are statistics; beyond this value a document is an outlier.
CUT = 220.0
#: Variance added to each statistic, so that one that is constant in a group doesn't make the covariance singular.
RIDGE = 0.02
BLANK_LINE = r"[\x20\x09-\x0D]*"


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of the base rules: words, characters, symbols, repeated lines and repeated three-word windows."""
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("__words", words(value))
    windows = F.when(
        F.size("__words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("__words") - 3),
            lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(value, "\n"), lambda line: ~line.rlike(f"^{BLANK_LINE}$"))
    counted = rows.select(
        *docs.columns,
        F.size("__words").cast("long").alias("n_words"),
        F.aggregate("__words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        (F.length(value) - F.length(F.translate(value, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        windows.alias("__windows"),
    ).select(
        *docs.columns, "n_words", "word_chars", "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        "__windows",
        (F.size("__windows") > F.size(F.array_distinct("__windows"))).alias("__twice"),
    )
    # Only texts with a repeated window sort their windows with places; equal windows are then neighbours.
    placed = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_rows = counted.withColumn("__sorted", F.when(F.col("__twice"), placed)).drop("__windows", "__twice")
    repeated = F.array_sort(
        F.transform(
            F.filter("__sorted", lambda x, j: (x["h"] == F.get("__sorted", j - 1)["h"]) | (x["h"] == F.get("__sorted", j + 1)["h"])),
            lambda x: x["i"],
        )
    )
    starts = sorted_rows.withColumn("__starts", repeated).drop("__sorted")
    covered = F.aggregate(
        F.transform("__starts", lambda s, j: F.least(F.lit(3), F.coalesce(F.get("__starts", j + 1) - s, F.lit(3)))),
        F.lit(0).cast("long"), lambda n, w: n + w,
    )
    return starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__starts")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def vector() -> list[Column]:
    """Statistics on scales on which clean text is roughly symmetric."""
    n = F.col("n_words").cast("double")
    return [
        F.sqrt(50 / n),
        F.log(F.col("word_chars") / n),
        F.log(F.col("n_symbols") / n + 0.01) / 2,
        F.log1p(F.col("n_dup_lines").cast("double")) / 2,
        F.sqrt(F.col("n_repeat_words") / n),
    ]


#: Medians of the chi-square law with 1 to 8 degrees of freedom (fixed values).
CHI_MEDIANS = (0.4549, 1.3863, 2.3660, 3.3567, 4.3515, 5.3481, 6.3458, 7.3441)
#: Their 97.5 % points (fixed values): rows within them make the reweighted estimate.
CHI_NEAR = (5.0239, 7.3778, 9.3484, 11.1433, 12.8325, 14.4494, 16.0128, 17.5345)


def _distance(x: list[str], mean: Column, cov: list[list[Column]]) -> list[list[Column]]:
    """Columns, level by level, of ``L z = x - mean`` for the Cholesky factor ``L`` of the covariance."""
    d = len(x)
    levels = []
    for j in range(d):
        diagonal = cov[j][j] - reduce(lambda a, b: a + b, [F.col(f"__l{j}{k}") * F.col(f"__l{j}{k}") for k in range(j)], F.lit(0.0))
        levels.append([F.sqrt(F.greatest(diagonal, F.lit(RIDGE / 4))).alias(f"__l{j}{j}")])
        below = []
        for i in range(j + 1, d):
            rest = cov[i][j] - reduce(lambda a, b: a + b, [F.col(f"__l{i}{k}") * F.col(f"__l{j}{k}") for k in range(j)], F.lit(0.0))
            below.append((rest / F.col(f"__l{j}{j}")).alias(f"__l{i}{j}"))
        if below:
            levels.append(below)
    return levels


def _factor(moments: DataFrame, x: list[str]) -> DataFrame:
    """Cholesky factors of the groups' covariances, one row per group."""
    d = len(x)
    mean = [F.col(f"__s{i}") / F.col("__n") for i in range(d)]
    cov = [
        [F.col(f"__p{i}{j}" if i >= j else f"__p{j}{i}") / F.col("__n") - mean[i] * mean[j] + (RIDGE if i == j else 0.0) for j in range(d)]
        for i in range(d)
    ]
    rows = moments
    for level in _distance(x, mean, cov):
        rows = rows.select("*", *level)
    return rows.select("__group", *[m.alias(f"__m{i}") for i, m in enumerate(mean)], *[f"__l{i}{j}" for i in range(d) for j in range(i + 1)])


def _squared(vectors: DataFrame, factors: DataFrame, x: list[str]) -> DataFrame:
    """Squared Mahalanobis distance of every row to its group, by forward substitution."""
    rows = safe_join(vectors, factors, ["__group"], "inner")
    for i in range(len(x)):
        rest = reduce(lambda a, b: a + b, [F.col(f"__l{i}{k}") * F.col(f"__z{k}") for k in range(i)], F.lit(0.0))
        rows = rows.select("*", ((F.col(x[i]) - F.col(f"__m{i}") - rest) / F.col(f"__l{i}{i}")).alias(f"__z{i}"))
    return rows.select(*vectors.columns, sum((F.col(f"__z{i}") * F.col(f"__z{i}") for i in range(len(x))), F.lit(0.0)).alias("__d2"))


def robust_distances(vectors: DataFrame, x: list[str], half: float = HALF, steps: int = STEPS) -> DataFrame:
    """``vectors`` (``__group`` and the columns ``x``) with ``__d2``, scaled as described at ``CUT``."""
    d = len(x)
    moments = [F.count("*").alias("__n"), *[F.sum(c).alias(f"__s{i}") for i, c in enumerate(x)]]
    moments += [F.sum(F.col(x[i]) * F.col(x[j])).alias(f"__p{i}{j}") for i in range(d) for j in range(i + 1)]
    middles = vectors.groupBy("__group").agg(*[F.percentile_approx(c, 0.5).alias(f"__m{i}") for i, c in enumerate(x)])
    off = safe_join(vectors, written(middles, "mcd-middles"), ["__group"], "inner")
    spreads = off.groupBy("__group").agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"__m{i}")), 0.5).alias(f"__w{i}") for i, c in enumerate(x)])
    first = safe_join(off, written(spreads, "mcd-spreads"), ["__group"], "inner")
    scaled = [(F.col(c) - F.col(f"__m{i}")) * (F.col(c) - F.col(f"__m{i}")) / (F.col(f"__w{i}") * F.col(f"__w{i}") * 2.2 + RIDGE) for i, c in enumerate(x)]
    rows = first.select(*vectors.columns, sum(scaled, F.lit(0.0)).alias("__d2"))
    def fitted(rows: DataFrame, near: DataFrame) -> DataFrame:
        """Distances by mean and covariance of the rows ``near``."""
        factors = written(_factor(near.groupBy("__group").agg(*moments), x), "mcd-factors")
        return _squared(rows.drop("__d2"), factors, x)

    def in_units(rows: DataFrame) -> DataFrame:
        scale = rows.groupBy("__group").agg(F.greatest(F.percentile_approx("__d2", 0.5), F.lit(CHI_MEDIANS[d - 1] / 10)).alias("__median"))
        scaled_rows = safe_join(rows, written(scale, "mcd-scales"), ["__group"], "inner")
        return scaled_rows.withColumn("__d2", F.col("__d2") / F.col("__median") * CHI_MEDIANS[d - 1]).drop("__median")

    for _ in range(steps):
        rows = written(rows, "mcd-distances")
        limits = rows.groupBy("__group").agg(F.percentile_approx("__d2", half).alias("__limit"))
        rows = fitted(rows, safe_join(rows, written(limits, "mcd-limits"), ["__group"], "inner").where("__d2 <= __limit"))
    # The half alone is a small sample: all rows near it make the last estimate.
    rows = written(in_units(written(rows, "mcd-distances")), "mcd-distances")
    rows = fitted(rows, rows.where(F.col("__d2") <= CHI_NEAR[d - 1]))
    return in_units(written(rows, "mcd-distances"))


#: The group that an estimate is of: its level (0 language and source, 1 language, 2 all), language and source.
LEVELS = 3


def _group(level: Column) -> Column:
    return F.struct(level.alias("level"), F.when(level <= 1, F.col("lang")).alias("lang"), F.when(level == 0, F.col("source")).alias("source"))


def levels(passed: DataFrame) -> DataFrame:
    """``lang, source, __level, __needed``: the finest level of a group whose estimate has enough documents (none: ``LEVELS``),
    and the levels for which its documents count."""
    groups = written(passed.groupBy("lang", "source").agg(F.count("*").alias("__size")), "mcd-groups")
    langs = groups.groupBy("lang").agg(F.sum("__size").alias("__of_lang"), (F.min("__size") < LEAST_GROUP).alias("__small"))
    everything = groups.agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("n")).first()["n"]
    enough = lambda n: n >= LEAST_GROUP
    level = F.when(enough(F.col("__size")), 0).when(enough(F.col("__of_lang")), 1).when(enough(F.lit(everything)), 2).otherwise(LEVELS)
    rows = written(safe_join(groups, langs, ["lang"], "inner").withColumn("__level", level), "mcd-levels")
    pooled = not rows.where("__level = 2").isEmpty()
    needed = F.filter(
        F.array(
            F.when(F.col("__level") == 0, 0), F.when(F.col("__small") & enough(F.col("__of_lang")), 1), F.lit(2 if pooled else None).cast("int")
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select("lang", "source", "__level", needed.alias("__needed"))


def judged(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """Statistics of every document with ``base_failed``, ``distance2`` (null without estimate) and ``kept``."""
    rows = written(statistics(docs.select("doc_id", "lang", "source", "text")).drop("text"), "mcd-statistics")
    rows = rows.select("*", base_failed().alias("base_failed"))
    x = [f"__x{i}" for i in range(len(vector()))]
    keys = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    passed = rows.where(~F.col("base_failed"))
    known = written(levels(passed), "mcd-needed")
    # Rows of a group with equal statistics have one vector, so the distances need no row identity.
    own = safe_join(passed, known, ["lang", "source"], "inner").select("*", F.explode("__needed").alias("__at"))
    vectors = written(
        own.select(_group(F.col("__at")).alias("__group"), "lang", "source", (F.col("__at") == F.col("__level")).alias("__own"), *keys, *[v.alias(n) for v, n in zip(vector(), x)]),
        "mcd-vectors",
    )
    far = robust_distances(vectors, x).where("__own").select("lang", "source", *keys, F.col("__d2").alias("distance2"))
    out = safe_join(rows, far.dropDuplicates(["lang", "source", *keys]), ["lang", "source", *keys])
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= cut))


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2"
    )
