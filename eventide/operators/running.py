"""Running state when labels are given: what a topic had learned before each turn."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from eventide.functions import vector as V
from eventide.operators.ordered import field_types, in_order, matrix, stream
from eventide.operators.positions import (
    BLOCK, BLOCK_ROWS, block_of, halo_window, join_small, with_carry, with_halo, with_lag,
)
from eventide.operators.segment import WARM_COUNT

def _running(
    scenes: DataFrame, by_label: bool, finish, out: dict[str, str], rows: int, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Running count, sum and sum of squares, handed to ``finish`` a batch at a time.

    ``finish(x, n, s1, s2, base, batch)`` gets the scenes and the totals up to and including
    each row and returns one column per name in ``out``. Sums are taken of ``x - base``, where
    ``base`` is a scene (or block mean) of the same group, so that a large common offset cancels
    before anything is squared. Rows are ordered inside (sequence, label, block), and each such group is
    summed on its own: no group's values enter another's. What earlier blocks added up to travels
    as one extra row in front of a block, so it is not repeated on every row, and
    one-block sequences have none.
    """
    label = ["label"] if by_label else []
    keys = ["seq_id", *label]
    v = array_to_vector(V.as_double("scene"))
    blocked = scenes.withColumn(BLOCK, block_of(rows))
    # Only sequences of several blocks carry anything, and those are few.
    long = scenes.where(F.col("pos") >= rows).select("seq_id").distinct()
    per_block = blocked.join(long, "seq_id", "left_semi").groupBy(*keys, BLOCK).agg(
        F.count("*").alias("_n"), Summarizer.metrics("mean", "variance").summary(v).alias("_s")
    ).select(
        *keys, BLOCK, "_n", vector_to_array("_s.mean").alias("_mu"),
        F.transform(vector_to_array("_s.variance"), lambda x: x * (F.col("_n") - 1)).alias("_m2"),
    )
    first_mean = F.first("_mu").over(Window.partitionBy(*keys).orderBy(BLOCK))
    based = per_block.withColumn("_base", first_mean).withColumn(
        "_off", F.zip_with("_mu", "_base", lambda a, b: a - b)
    )
    parts = based.select(
        *keys, BLOCK, "_n", "_base",
        array_to_vector(F.transform("_off", lambda x: x * F.col("_n"))).alias("_v1"),
        array_to_vector(F.zip_with("_m2", "_off", lambda q, x: q + x * x * F.col("_n"))).alias("_v2"),
    )
    through = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(BLOCK)

    def so_far(column):
        summed = Summarizer.metrics("sum").summary(F.col(column)).over(through)
        return vector_to_array(summed.getField("sum"))

    totals = parts.select(
        *keys, F.lead(BLOCK).over(later).alias(BLOCK), F.sum("_n").over(through).cast("double").alias("_n"),
        so_far("_v1").alias("_s1"), so_far("_v2").alias("_s2"), "_base",
    ).where(F.col(BLOCK).isNotNull())
    types = dict(blocked.dtypes)
    none = lambda t: F.lit(None).cast(t)
    extra = {"_n": "double", "_s1": "array<double>", "_s2": "array<double>", "_base": "array<double>"}
    passed = list(dict.fromkeys(["seq_id", "pos", *(["label"] if "label" in scenes.columns else []), *keep]))
    inputs = list(dict.fromkeys([*passed, "scene", BLOCK]))
    body = blocked.select(*inputs, *[none(t).alias(c) for c, t in extra.items()])
    heads = totals.select(
        *[F.lit(-1).cast(types["pos"]).alias(c) if c == "pos" else F.col(c) if c in (*keys, BLOCK)
          else none(types[c]).alias(c) for c in inputs],
        *extra,
    )
    names = [*passed, *out]

    def run(batches):
        last_key, carried = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.num_rows
            n = batch.column("_n").to_numpy(zero_copy_only=False)
            head = ~np.isnan(n)
            real = np.flatnonzero(~head)
            scene = batch.column("scene").drop_null()
            x = matrix(scene) if len(scene) else None
            d = x.shape[1] if x is not None else len(batch.column("_s1")[0])
            c1, c2, base = np.zeros((size, d)), np.zeros((size, d)), np.zeros((size, d))
            scenes_at = np.zeros((size, d))
            if x is not None:
                scenes_at[real] = x
            if head.any():
                c1[head] = matrix(batch.column("_s1").drop_null())
                c2[head] = matrix(batch.column("_s2").drop_null())
                base[head] = matrix(batch.column("_base").drop_null())
            cn = np.where(head, n, 1.0)
            key = list(zip(*(batch.column(c).to_pylist() for c in (*keys, BLOCK))))
            starts = [i for i in range(size) if i == 0 or key[i] != key[i - 1]]
            for a, b in zip(starts, starts[1:] + [size]):
                goes_on = a == 0 and carried is not None and key[0] == last_key
                body = a + 1 if head[a] else a
                base[a:b] = carried[3] if goes_on else base[a] if head[a] else scenes_at[a]
                off = scenes_at[body:b] - base[body:b]
                c1[body:b], c2[body:b] = off, off * off
                if goes_on:
                    cn[a] += carried[0]
                    c1[a] += carried[1]
                    c2[a] += carried[2]
                for values in (cn, c1, c2):
                    np.cumsum(values[a:b], axis=0, out=values[a:b])
            last_key, carried = key[-1], (cn[-1], c1[-1].copy(), c2[-1].copy(), base[-1].copy())
            if not len(real):
                continue
            rows_only = batch.take(pa.array(real))
            made = finish(x, cn[real], c1[real], c2[real], base[real], rows_only)
            columns = [rows_only.column(c) for c in passed] + [made[c] for c in out]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = field_types(scenes, passed) + [f"{c} {t}" for c, t in out.items()]
    return stream(in_order(body.unionByName(heads), salt=(*label, BLOCK)), run, ", ".join(fields))


def _vectors(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))


def _moments(n, s1, s2, base):
    """Mean and squared deviations from sums of ``x - base``; callers mask empty topics."""
    some = np.maximum(n, 1.0)[:, None]
    return base + s1 / some, np.maximum(s2 - s1 * s1 / some, 0.0)


def _variance(n, m2, sigma0_sq, floor=1e-6):
    warm = np.maximum(m2 / np.maximum(n, 1.0)[:, None], floor)
    return np.where(n[:, None] < WARM_COUNT, sigma0_sq, warm)


def running_mean(scenes: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """``mean``: the mean of the sequence up to and including the scene."""

    def finish(x, n, s1, s2, base, batch):
        return {"mean": _vectors(base + s1 / n[:, None])}

    return _running(scenes, False, finish, {"mean": "array<double>"}, rows)


def running_topic_state(scenes: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """``n_before, mu_before, m2_before``: the scene's own topic before the turn."""

    def finish(x, n, s1, s2, base, batch):
        off = x - base
        mu, m2 = _moments(n - 1, s1 - off, s2 - off * off, base)
        return {
            "n_before": pa.array(np.rint(n - 1).astype(np.int64)),
            "mu_before": _vectors(np.where(n[:, None] > 1, mu, 0.0)),
            "m2_before": _vectors(np.where(n[:, None] > 1, m2, 0.0)),
        }

    out = {"n_before": "bigint", "mu_before": "array<double>", "m2_before": "array<double>"}
    return _running(scenes, True, finish, out, rows)


def running_scores(scenes: DataFrame, sigma0_sq: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """``loglik`` and ``prediction_error`` of each scene under its own topic before the turn;
    a topic without scenes is a Gaussian at the origin."""

    def finish(x, n, s1, s2, base, batch):
        before = n - 1
        off = x - base
        mu, m2 = _moments(before, s1 - off, s2 - off * off, base)
        mu = np.where(before[:, None] > 0.5, mu, 0.0)
        var = _variance(before, m2, sigma0_sq)
        error = ((x - mu) ** 2 / var).sum(axis=1)
        return {
            "n_before": pa.array(np.rint(before).astype(np.int64)),
            "loglik": pa.array(-0.5 * (error + np.log(var).sum(axis=1) + x.shape[1] * V.LOG_2PI)),
            "prediction_error": pa.array(error),
        }

    out = {"n_before": "bigint", "loglik": "double", "prediction_error": "double"}
    return _running(scenes, True, finish, out, rows)


def boundary_scores(scenes: DataFrame, sigma0_sq: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """Error of each scene under the topic that was active at the previous turn.

    The scene is moved to the previous row, where the state of that topic is at hand.
    """
    haloed, own = with_halo(scenes.select("seq_id", "pos", "label", "scene"), 0, rows, after=1)
    ahead = haloed.select("*", F.lead("scene").over(halo_window()).alias("_next")).where(own).drop(BLOCK)

    def finish(x, n, s1, s2, base, batch):
        mu, m2 = _moments(n, s1, s2, base)
        var = _variance(n, m2, sigma0_sq)
        following = batch.column("_next")
        known = np.flatnonzero(np.array(following.is_valid()))
        error = np.zeros(len(x))
        if len(known):
            y = matrix(following.drop_null())
            error[known] = ((y - mu[known]) ** 2 / var[known]).sum(axis=1)
        return {"score": pa.array(error, mask=~np.array(following.is_valid()))}

    scored = _running(ahead, True, finish, {"score": "double"}, rows, keep=("_next",))
    return scored.where(F.col("_next").isNotNull()).select(
        "seq_id", (F.col("pos") + 1).alias("pos"), "score"
    )


def running_counts(turns: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``c`` (earlier turns with the same label) and ``repeats`` (same label as before)."""
    lagged = with_lag(turns, {"_prev": "label"}, rows)
    joined, w = with_carry(
        lagged,
        ["seq_id", "label"],
        {"_bn": F.count("*")},
        lambda before, _: {"_earlier": F.coalesce(F.sum("_bn").over(before), F.lit(0))},
        rows,
    )
    c = F.col("_earlier") + F.row_number().over(w) - 1
    repeats = F.coalesce(F.col("label") == F.col("_prev"), F.lit(False))
    return joined.select(*turns.columns, c.alias("c"), repeats.alias("repeats"))


def label_logprob(turns: DataFrame, alpha: float, lmda: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """Log probability of each label sequence under the sticky prior.

    As published, the normaliser gets ``lmda`` only on a repeat.
    """
    counted = running_counts(turns, rows)
    sticky = F.when(F.col("repeats"), F.lit(float(lmda))).otherwise(F.lit(0.0))
    top = F.when(F.col("c") == 0, F.log(F.lit(float(alpha)))).otherwise(F.log(F.col("c") + sticky))
    bottom = F.log(F.col("pos") + F.lit(float(alpha)) + sticky)
    return counted.groupBy("seq_id").agg(
        F.count("*").alias("turns"), F.sum(top - bottom).alias("log_prob")
    )


def previous_in_topic(scenes: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``last_scene``: the previous scene with the same label, NULL for the first."""
    joined, w = with_carry(
        scenes,
        ["seq_id", "label"],
        {"_block_last": F.max_by("scene", "pos")},
        lambda _, ordered: {"_carried": F.lag("_block_last").over(ordered)},
        rows,
    )
    last = F.coalesce(F.lag("scene").over(w), F.col("_carried"))
    return joined.select(*scenes.columns, last.alias("last_scene"))


def trailing_variance(errors: DataFrame, window: int, value: str = "scene", rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``trailing_var``: population variance per dimension of the last ``window`` errors
    of the same label, including the current one."""
    ranked = running_counts(errors, rows).withColumnRenamed("pos", "_pos").withColumnRenamed("c", "pos")
    blocks, own = with_halo(ranked, window - 1, rows)
    w = Window.partitionBy("seq_id", "label", "_block").orderBy("pos").rowsBetween(-(window - 1), 0)
    v = array_to_vector(V.as_double(value))
    framed = blocks.withColumn("_s", Summarizer.metrics("variance", "count").summary(v).over(w)).where(own)
    n = F.col("_s.count")
    var = F.transform(vector_to_array("_s.variance"), lambda x: x * (n - 1) / n)
    return framed.select(
        *[F.col("_pos").alias("pos") if c == "pos" else F.col(c) for c in errors.columns],
        var.alias("trailing_var"),
    )


def accumulated_tokens(turns: DataFrame, tokens: str = "tokens", rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``known``: the tokens of earlier turns with the same label."""
    union = lambda lists: F.array_distinct(F.flatten(lists))
    joined, w = with_carry(
        turns,
        ["seq_id", "label"],
        {"_block_set": union(F.collect_list(tokens))},
        lambda before, _: {"_carried": union(F.collect_list("_block_set").over(before))},
        rows,
    )
    inside = F.collect_list(tokens).over(w.rowsBetween(Window.unboundedPreceding, -1))
    known = joined.select(*turns.columns, "_carried", inside.alias("_inside"))
    both = F.array_union(F.coalesce("_carried", F.array().cast("array<string>")), F.flatten("_inside"))
    return known.select(*turns.columns, both.alias("known"))


def known_token_counts(turns: DataFrame, tokens: str = "tokens", rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``n_known`` (tokens of earlier turns with the same label) and ``overlap`` (Jaccard of the turn's tokens with them).

    A token counts as known after its first position under the label, so no set of tokens is ever carried: the work
    is linear in the number of tokens. A side without tokens gives 0.
    """
    keys = ["seq_id", "label", "token"]
    each = turns.select("seq_id", "pos", "label", F.explode(tokens).alias("token")).distinct()
    firsts = each.groupBy(*keys).agg(F.min("pos").alias("_first"))
    per_turn = join_small(each, firsts, keys).groupBy("seq_id", "pos").agg(
        F.count("*").alias("_own"), F.count_if(F.col("_first") < F.col("pos")).alias("_hits")
    )
    counted = join_small(turns, per_turn, ["seq_id", "pos"]).fillna(0, ["_own", "_hits"])
    fresh = F.col("_own") - F.col("_hits")
    joined, w = with_carry(
        counted, ["seq_id", "label"], {"_fresh": F.sum(fresh)},
        lambda before, _: {"_earlier": F.coalesce(F.sum("_fresh").over(before), F.lit(0))}, rows,
    )
    inside = F.coalesce(F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = joined.withColumn("n_known", F.col("_earlier") + inside)
    either = F.col("_own") + F.col("n_known") - F.col("_hits")
    overlap = F.when((F.col("_own") > 0) & (F.col("n_known") > 0), F.col("_hits") / either).otherwise(F.lit(0.0))
    return known.select(*turns.columns, F.col("n_known").cast("int").alias("n_known"), overlap.alias("overlap"))


def moving_anchor(scenes: DataFrame, beta: float, keep: tuple[str, ...] = (), rows: int = BLOCK_ROWS) -> DataFrame:
    """Cosine of each scene with the exponential moving anchor of its label before the turn; NULL for a label's first scene.

    A block of a label maps the anchor it receives to ``decay * anchor + vector``. Those maps compose, so blocks are
    summarised apart, a scan over the (few) block rows gives each block the anchor it starts from, and the rows of
    a label are spread over as many tasks as it has blocks. NULL labels are a label of their own.
    """
    names = ["seq_id", "pos", "label", *keep]
    keyed = scenes.select(*names, V.as_double("scene").alias("scene"), block_of(rows).alias(BLOCK))
    types = dict(keyed.dtypes)
    key_fields = ", ".join(field_types(keyed, ["seq_id", "label", BLOCK]))

    def keys_of(batch, columns):
        return list(zip(*[batch.column(c).to_pylist() for c in columns]))

    def emitted(rows_out, schema, vectors):
        arrays = [pa.array([r[0][i] for r in rows_out], schema.field(c).type) for i, c in enumerate(("seq_id", "label", BLOCK))]
        arrays += [pa.array([r[1 + i] for r in rows_out], t) for i, t in enumerate(vectors)]
        return arrays

    floats = pa.list_(pa.float64())

    def summarise(batches):
        """One row per block of a label: its first scene, its decay and its vector."""
        current, state, schema = None, None, None
        for batch in batches:
            x, schema, done = matrix(batch.column("scene")), batch.schema, []
            for i, key in enumerate(keys_of(batch, ("seq_id", "label", BLOCK))):
                if key != current:
                    if current is not None:
                        done.append((current, state[0].tolist(), state[1], state[2].tolist()))
                    current, state = key, [x[i], 1.0, np.zeros(x.shape[1])]
                state[1] *= 1.0 - beta
                state[2] = (1.0 - beta) * state[2] + beta * x[i]
            if done:
                yield pa.RecordBatch.from_arrays(emitted(done, schema, (floats, pa.float64(), floats)), names=["seq_id", "label", BLOCK, "first", "decay", "vector"])
        if current is not None:
            done = [(current, state[0].tolist(), state[1], state[2].tolist())]
            yield pa.RecordBatch.from_arrays(emitted(done, schema, (floats, pa.float64(), floats)), names=["seq_id", "label", BLOCK, "first", "decay", "vector"])

    def scan(batches):
        """The anchor with which each block starts; a label's first scene is its first anchor."""
        current, anchor = None, None
        for batch in batches:
            first, vector, out, begins = matrix(batch.column("first")), matrix(batch.column("vector")), [], []
            decay = batch.column("decay").to_pylist()
            for i, key in enumerate(keys_of(batch, ("seq_id", "label"))):
                begins.append(key != current)
                if key != current:
                    current, anchor = key, first[i]
                out.append(anchor.tolist())
                anchor = decay[i] * anchor + vector[i]
            arrays = [batch.column(c) for c in ("seq_id", "label", BLOCK)] + [pa.array(out, floats), pa.array(begins, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["seq_id", "label", BLOCK, "scene", "_begins"])

    parts = stream(in_order(keyed, salt=("label", BLOCK)), summarise, f"{key_fields}, first array<double>, decay double, vector array<double>")
    starts = stream(in_order(parts, BLOCK, salt=("label",)), scan, f"{key_fields}, scene array<double>, _begins boolean")
    heads = starts.select(*[F.col(c) if c in starts.columns else F.lit(None).cast(types[c]).alias(c) for c in (*names, "scene", BLOCK, "_begins")])

    def finish(batches):
        anchor, fresh = None, False
        for batch in batches:
            x, heading = matrix(batch.column("scene")), batch.column("_begins").to_pylist()
            cos, none, real = [], [], []
            for i, begins in enumerate(heading):
                if begins is not None:
                    anchor, fresh = x[i], begins
                    continue
                norms = np.sqrt(anchor @ anchor) * np.sqrt(x[i] @ x[i])
                cos.append(anchor @ x[i] / norms if norms >= 1e-18 else 0.0)
                none.append(fresh)
                real.append(i)
                anchor, fresh = beta * x[i] + (1.0 - beta) * anchor, False
            passed = batch.take(pa.array(real, pa.int64()))
            out = [passed.column(c) for c in names] + [pa.array(cos, pa.float64(), mask=np.array(none, dtype=bool))]
            yield pa.RecordBatch.from_arrays(out, names=names + ["anchor_cos"])

    merged = keyed.withColumn("_begins", F.lit(None).cast("boolean")).unionByName(heads).withColumn("_late", F.isnull("_begins"))
    fields = field_types(scenes, names) + ["anchor_cos double"]
    return stream(in_order(merged, "_late", "pos", salt=("label", BLOCK)), finish, ", ".join(fields))
