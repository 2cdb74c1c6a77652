"""General event segmentation: restart against repeat, label posteriors, boundary probability.

Like topic assignment this is a recursion per sequence, streamed in order with a state of
one model per event type. The built-in mean/variance model scores all event types in one
array operation; other models plug in through :class:`EventModel`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from eventide.functions import vector as V
from eventide.functions.prior import prior_mode, prior_scale
from eventide.functions.vector import LOG_2PI
from eventide.operators.ordered import field_types, in_order, matrix, stream
from eventide.operators.positions import BLOCK_ROWS, with_lag
from eventide.session import bounded_rows


def _lse(v: np.ndarray) -> float:
    m = v.max()
    return float(m + np.log(np.exp(v - m).sum()))


# -- models --------------------------------------------------------------------


class EventModel:
    """What an event model must offer; subclass it to plug in another one.

    Variances follow the prediction errors under a scaled-inverse-chi-squared prior.
    """

    def __init__(self, d: int, nu0: float, var0: float, prior_log_prob: float | None = None):
        self.d, self.nu0, self.var0 = d, nu0, var0
        self.prior_log_prob = prior_log_prob
        self.trained = False
        self.starts, self.f0 = 0, np.zeros(d)
        self.errors, self.error_mean, self.error_m2 = 0, np.zeros(d), np.zeros(d)

    def get_variance(self) -> np.ndarray:
        if self.errors > 1:
            return (self.nu0 * self.var0 + self.error_m2) / (self.nu0 + self.errors + 2.0)
        return np.full(self.d, prior_mode(self.nu0, self.var0))

    def predict_f0(self) -> np.ndarray:
        return self.f0

    def predict_next(self, x_prev: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def predict_next_generative(self, history: np.ndarray) -> np.ndarray:
        return self.predict_next(history[-1])

    def _log_density(self, x: np.ndarray, predicted: np.ndarray) -> float:
        if not self.trained:
            return untrained_loglik(x, prior_mode(self.nu0, self.var0), self.prior_log_prob)
        v = self.get_variance()
        e = x - predicted
        return float(-0.5 * (e * e / v + np.log(v)).sum() - 0.5 * self.d * LOG_2PI)

    def log_likelihood_f0(self, x: np.ndarray) -> float:
        return self._log_density(x, self.predict_f0())

    def log_likelihood_next(self, x_prev: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
        predicted = self.predict_next(x_prev)
        return predicted, self._log_density(x, predicted)

    def log_likelihood_sequence(self, history: np.ndarray, x: np.ndarray) -> float:
        return self._log_density(x, self.predict_next_generative(history))

    def _add_error(self, e: np.ndarray) -> None:
        self.errors += 1
        step = e - self.error_mean
        self.error_mean = self.error_mean + step / self.errors
        self.error_m2 = self.error_m2 + step * (e - self.error_mean)

    def learn(self, x_prev: np.ndarray, x: np.ndarray) -> None:
        """Adapt the prediction; called after the error was recorded."""

    def update(self, x_prev: np.ndarray, x: np.ndarray) -> None:
        self._add_error(x - self.predict_next(x_prev))
        self.learn(x_prev, x)
        self.trained = True

    def update_f0(self, x: np.ndarray) -> None:
        if self.starts:
            self._add_error(x - self.f0)
        self.starts += 1
        self.f0 = self.f0 + (x - self.f0) / self.starts
        self.trained = True

    def new_token(self) -> None:
        """A new event of this type begins."""


class LastSceneModel(EventModel):
    """Predicts that the scene stays as it is."""

    def predict_next(self, x_prev):
        return x_prev


class LinearModel(EventModel):
    """``A x + b`` with fitted coefficients (see the dynamics operator)."""

    def __init__(self, d, nu0, var0, prior_log_prob=None, a=None, b=None):
        super().__init__(d, nu0, var0, prior_log_prob)
        self.a = np.eye(d) if a is None else np.asarray(a)
        self.b = np.zeros(d) if b is None else np.asarray(b)

    def predict_next(self, x_prev):
        return self.a @ x_prev + self.b


def untrained_loglik(x: np.ndarray, mode: float, prior_log_prob: float | None) -> float:
    """A Gaussian at the origin, or the given value; 0 counts as not given."""
    if prior_log_prob:
        return float(prior_log_prob)
    return float(-0.5 * (x @ x / mode + len(x) * (LOG_2PI + np.log(mode))))


# -- parameters and banks of models ------------------------------------------------


@dataclass(frozen=True)
class EventConfig:
    alfa: float = 10.0
    lmda: float = 1.0
    k_max: int = 256
    var_df0: float = 1.0
    var_scale0: float | None = None
    variance_prior_mode: float | None = None
    prior_log_prob: float | None = None
    #: ``(d, nu0, var0, prior_log_prob) -> EventModel``; None selects the mean/variance model.
    factory: Callable[..., EventModel] | None = None

    def __post_init__(self):
        if self.alfa <= 0:
            raise ValueError("alfa must be positive")

    def scale(self, d: int) -> float:
        if self.var_scale0 is not None:
            return self.var_scale0
        mode = 1.0 / d if self.variance_prior_mode is None else self.variance_prior_mode
        return prior_scale(self.var_df0, mode)


class MeanVarianceBank:
    """Mean/variance models of all event types as arrays; next scene and first scene of an
    event are predicted alike."""

    def __init__(self, config: EventConfig, d: int):
        self.nu0, self.var0, self.d = config.var_df0, config.scale(d), d
        self.mode, self.given = prior_mode(self.nu0, self.var0), config.prior_log_prob
        self.n = np.zeros(4)
        self.mu, self.m2 = np.zeros((4, d)), np.zeros((4, d))
        self.inv, self.log_det = np.zeros((4, d)), np.zeros(4)

    def _ensure(self, k: int) -> None:
        while k >= len(self.n):
            for name in ("n", "mu", "m2", "inv", "log_det"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))

    def _refresh(self, k: int) -> None:
        if self.n[k] > 1:
            var = (self.nu0 * self.var0 + self.m2[k]) / (self.nu0 + self.n[k] + 2.0)
        else:
            var = np.full(self.d, self.mode)
        self.inv[k], self.log_det[k] = 1.0 / var, np.log(var).sum()

    def logliks(self, x: np.ndarray, used: int) -> np.ndarray:
        e = x - self.mu[:used]
        return -0.5 * (np.einsum("kd,kd->k", e * e, self.inv[:used]) + self.log_det[:used] + self.d * LOG_2PI)

    def fresh(self, x: np.ndarray) -> float:
        return untrained_loglik(x, self.mode, self.given)

    def score(self, x, x_prev, prev, used):
        """First-scene likelihoods, next-scene likelihood and prediction of the current event."""
        lik = self.logliks(x, used)
        if prev is None or x_prev is None:
            return lik, None, None
        return lik, float(lik[prev]), self.mu[prev].copy()

    def absorb(self, k: int, n: float, mean: np.ndarray, m2: np.ndarray) -> None:
        """Add a sample by its size, mean and squared deviations."""
        self._ensure(k)
        total = self.n[k] + n
        step = mean - self.mu[k]
        self.m2[k] += m2 + step * step * self.n[k] * n / total
        self.mu[k] += step * n / total
        self.n[k] = total
        self._refresh(k)

    def learn(self, k, x_prev, x, opens) -> None:
        self.absorb(k, 1.0, x, np.zeros(self.d))

    def saved(self, k: int) -> dict:
        return {"mu": self.mu[k].tolist(), "m2": self.m2[k].tolist(), "model": None}

    def restored(self, k: int, n: float, mu: np.ndarray, m2: np.ndarray, model: bytes | None) -> None:
        self.absorb(k, n, mu, m2)


class PluggedBank:
    """One user model per event type."""

    def __init__(self, config: EventConfig, d: int):
        self.config, self.d = config, d
        self.models: list[EventModel] = []

    def _new(self) -> EventModel:
        c = self.config
        return c.factory(self.d, c.var_df0, c.scale(self.d), c.prior_log_prob)

    def logliks(self, x, used):
        return np.array([m.log_likelihood_f0(x) for m in self.models[:used]])

    def fresh(self, x):
        return self._new().log_likelihood_f0(x)

    def score(self, x, x_prev, prev, used):
        lik = self.logliks(x, used)
        if prev is None or x_prev is None:
            return lik, None, None
        predicted, following = self.models[prev].log_likelihood_next(x_prev, x)
        return lik, following, np.asarray(predicted)

    def saved(self, k: int) -> dict:
        return {"mu": [], "m2": [], "model": cloudpickle.dumps(self.models[k])}

    def restored(self, k: int, n: float, mu: np.ndarray, m2: np.ndarray, model: bytes | None) -> None:
        if model is None:
            raise ValueError("a run with its own models goes on from saved models only")
        self.models.append(cloudpickle.loads(model))

    def learn(self, k, x_prev, x, opens):
        while len(self.models) <= k:
            self.models.append(self._new())
        if opens:
            self.models[k].new_token()
            self.models[k].update_f0(x)
        else:
            self.models[k].update(x_prev, x)


def _bank(config: EventConfig, d: int):
    return MeanVarianceBank(config, d) if config.factory is None else PluggedBank(config, d)


class EventRunner:
    """State of one sequence."""

    def __init__(self, config: EventConfig, d: int):
        self.config, self.bank = config, _bank(config, d)
        self.counts: list[float] = []
        self.prev: int | None = None
        self.x_prev: np.ndarray | None = None

    def warm(self, topic: int, n: float, mu: np.ndarray, m2: np.ndarray, model: bytes | None = None) -> None:
        """Start from a fitted model; topics arrive in order from 0."""
        if topic != len(self.counts):
            raise ValueError("topics of a model must be numbered from 0 without gaps")
        self.bank.restored(topic, float(n), mu, m2, model)
        self.counts.append(float(n))

    def goes_on(self, prev: int | None, x_prev: list[float] | None) -> None:
        """The label and the scene before the next one."""
        if prev is not None:
            self.prev, self.x_prev = prev, np.array(x_prev, dtype=float)

    def saved(self) -> Iterator[dict]:
        """One row per topic, from which ``warm`` and ``goes_on`` start."""
        for k, n in enumerate(self.counts):
            yield {"topic": k, "n": n, "prev": self.prev, "x_prev": self.x_prev.tolist()} | self.bank.saved(k)

    def step(self, x: np.ndarray) -> dict:
        c, used = self.config, len(self.counts)
        lik, following, predicted = self.bank.score(x, self.x_prev, self.prev, used)
        prior = np.array(self.counts)
        if used < c.k_max:
            lik, prior = np.append(lik, self.bank.fresh(x)), np.append(prior, c.alfa)
        prev = self.prev
        if prev is None:
            topic, opens = int(np.argmax(np.log(prior) + lik)), True
            out = {
                "log_like": [0.0], "log_prior": [c.alfa], "post": [1.0],
                "log_boundary_probability": 0.0, "pe": 0.0,
            }
        else:
            own = self.counts[prev]
            restart_lik = lik[prev]
            restart = restart_lik + np.log(own)
            repeat = following + np.log(own + c.lmda)
            candidates = np.log(prior) + lik
            candidates[prev] = max(restart, repeat)
            topic = int(np.argmax(candidates))
            opens = topic != prev or restart > repeat
            candidates[prev] = restart
            log_boundary = _lse(candidates) - _lse(np.append(candidates, repeat))
            # The label alone: both ways to stay, half the stickiness.
            lik[prev] = np.logaddexp(following, restart_lik)
            prior[prev] = own + c.lmda / 2.0
            log_prior = np.log(prior)
            joint = log_prior + lik
            e = x - predicted
            out = {
                "log_like": lik.tolist(), "log_prior": log_prior.tolist(),
                "post": np.exp(joint - _lse(joint)).tolist(),
                "log_boundary_probability": log_boundary, "pe": float(np.sqrt(e @ e)),
            }
        joint = np.array(out["log_like"]) + np.array(out["log_prior"])
        out |= {"topic": topic, "is_boundary": bool(opens), "e_hat": int(joint.argmax()), "log_loss": _lse(joint)}
        if topic == len(self.counts):
            self.counts.append(0.0)
        self.counts[topic] += 1.0
        self.bank.learn(topic, self.x_prev, x, opens)
        self.prev, self.x_prev = topic, x
        return out


SLIM = {
    "topic": ("int", pa.int32()), "is_boundary": ("boolean", pa.bool_()), "e_hat": ("int", pa.int32()),
    "log_loss": ("double", pa.float64()), "log_boundary_probability": ("double", pa.float64()),
    "pe": ("double", pa.float64()),
}
FULL = SLIM | {n: ("array<double>", pa.list_(pa.float64())) for n in ("log_like", "log_prior", "post")}


#: What a run leaves behind for the next one, per sequence and topic.
HANDED = {
    "topic": ("int", pa.int32()), "n": ("double", pa.float64()), "mu": ("array<double>", pa.list_(pa.float64())),
    "m2": ("array<double>", pa.list_(pa.float64())), "model": ("binary", pa.binary()), "prev": ("int", pa.int32()),
    "x_prev": ("array<double>", pa.list_(pa.float64())),
}


def _with_headers(scenes: DataFrame, keep: list[str], warm: DataFrame | None) -> DataFrame:
    """Scenes plus, in front of each sequence, one row per topic of its model in ``_head``."""
    none = lambda t: F.lit(None).cast(t)
    types = dict(scenes.dtypes)
    head_type = "struct<" + ", ".join(f"{c}:{t}" for c, (t, _) in HANDED.items()) + ">"
    rows = scenes.select(
        "seq_id", "pos", *keep, F.col("scene").cast("array<double>").alias("scene"), none(head_type).alias("_head"), F.lit(2**31 - 1).alias("_at")
    )
    if warm is None:
        return rows
    fields = [F.col(c).cast(t) if c in warm.columns else none(t) for c, (t, _) in HANDED.items()]
    head = F.struct(*[f.alias(c) for f, c in zip(fields, HANDED)])
    return rows.unionByName(warm.select(
        "seq_id", none(types["pos"]).alias("pos"), *[none(types[k]).alias(k) for k in keep],
        F.array().cast("array<double>").alias("scene"), head.alias("_head"), F.col("topic").cast("int").alias("_at"),
    ))


def _runs(batches: Iterator[pa.RecordBatch], config: EventConfig, start: list, take, ended=None):
    """Advance one :class:`EventRunner` per sequence. ``take(batch of scenes, results)`` makes the output of a batch;
    ``ended(key, runner)`` is called at the end of each sequence."""
    nobody = object()
    current, state = nobody, None
    for batch in batches:
        keys, heads = batch.column("seq_id").to_pylist(), batch.column("_head")
        scene = np.array(heads.is_null())
        passed = batch.filter(pa.array(scene))
        x, at, rows = matrix(passed.column("scene")), 0, []
        for i, key in enumerate(keys):
            if key != current:
                if ended and state is not None:
                    ended(current, state)
                current, state = key, None
            head = None if scene[i] else heads[i].as_py()
            if state is None:
                d = x.shape[1] if head is None else len(head["x_prev"] or head["mu"])
                state = EventRunner(config, d)
                for t in start:
                    state.warm(*t)
            if head is None:
                rows.append(state.step(x[at]))
                at += 1
                continue
            state.warm(len(state.counts), head["n"], np.array(head["mu"]), np.array(head["m2"]), head["model"])
            state.goes_on(head["prev"], head["x_prev"])
        yield from take(passed, rows)
    if ended and state is not None:
        ended(current, state)
        yield from take(None, [])


def run_events(
    scenes: DataFrame, config: EventConfig = EventConfig(), keep: tuple[str, ...] = (), full: bool = False,
    model: DataFrame | None = None, warm: DataFrame | None = None, max_topics: int = 4096,
) -> DataFrame:
    """One row per scene with label, boundary, prediction error and log probabilities.

    ``full`` adds the arrays over candidates. ``model`` (``topic, n, mu, m2``, checked to be
    small) is a starting model for all sequences; ``warm`` has a ``seq_id`` as well and gives
    each sequence its own, in the same shuffle as the scenes. A ``warm`` of :func:`handed_over_events` also tells the
    previous label and scene, so that two runs over the parts of a sequence equal one run.
    """
    wanted = FULL if full else SLIM
    names = ["seq_id", "pos", *keep]
    start = _starting(model, max_topics)

    def take(passed, rows):
        if rows:
            out = [passed.column(n) for n in names]
            out += [pa.array([r[n] for r in rows], t) for n, (_, t) in wanted.items()]
            yield pa.RecordBatch.from_arrays(out, names=names + list(wanted))

    fields = field_types(scenes, names) + [f"{n} {t}" for n, (t, _) in wanted.items()]
    rows = in_order(_with_headers(scenes, list(keep), warm), "_at", "pos")
    return stream(rows, lambda batches: _runs(batches, config, start, take), ", ".join(fields))


def _starting(model: DataFrame | None, max_topics: int) -> list:
    if model is None:
        return []
    fitted = bounded_rows(model.select("topic", "n", "mu", "m2"), max_topics, "topic model")
    return sorted((r["topic"], r["n"], np.array(r["mu"]), np.array(r["m2"])) for r in fitted)


def handed_over_events(
    scenes: DataFrame, config: EventConfig = EventConfig(), model: DataFrame | None = None,
    warm: DataFrame | None = None, max_topics: int = 4096,
) -> DataFrame:
    """``seq_id, topic, n, mu, m2, model, prev, x_prev`` after the scenes: the ``warm`` of a later run.

    ``model`` holds a plugged-in model as bytes. A sequence without new scenes keeps what ``warm`` says of it.
    """
    start = _starting(model, max_topics)

    def run(batches):
        key_type, done = None, []

        def watched():
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field("seq_id").type
                yield batch

        def ended(key, state):
            done.extend((key, row) for row in state.saved())

        def take(passed, rows):
            if done:
                arrays = [pa.array([k for k, _ in done], key_type)]
                arrays += [pa.array([r[c] for _, r in done], t) for c, (_, t) in HANDED.items()]
                done.clear()
                yield pa.RecordBatch.from_arrays(arrays, names=["seq_id", *HANDED])

        yield from _runs(watched(), config, start, take, ended)

    fields = field_types(scenes, ["seq_id"]) + [f"{n} {t}" for n, (t, _) in HANDED.items()]
    return stream(in_order(_with_headers(scenes, [], warm), "_at", "pos"), run, ", ".join(fields))


def run_events_with_tokens(
    scenes: DataFrame, config: EventConfig = EventConfig(),
) -> DataFrame:
    """Label whole events whose borders are given by ``token_id`` (rising with ``pos``).

    One row per event: its type, scenes, log loss and the arrays over candidates. A type is
    chosen after the last scene and learns only then; its count grows by the scenes. With the
    mean/variance model an event is summarised as it streams by; other models need its
    scenes, which are kept until it ends.
    """
    arrays = {n: FULL[n] for n in ("log_like", "log_prior", "post")}

    class Token:
        def __init__(self, bank, used, x):
            self.n, self.mean, self.m2 = 0, np.zeros(len(x)), np.zeros(len(x))
            self.lik, self.fresh, self.scenes = np.zeros(used), 0.0, []

        def add(self, bank, used, x):
            if isinstance(bank, MeanVarianceBank) or not self.scenes:
                self.lik = self.lik + bank.logliks(x, used)
            else:
                history = np.array(self.scenes)
                self.lik = self.lik + np.array(
                    [m.log_likelihood_sequence(history, x) for m in bank.models[:used]]
                )
            self.fresh += bank.fresh(x)
            self.n += 1
            step = x - self.mean
            self.mean = self.mean + step / self.n
            self.m2 = self.m2 + step * (x - self.mean)
            if not isinstance(bank, MeanVarianceBank):
                self.scenes.append(x)

    def close(state: EventRunner, token) -> dict:
        used, c = len(state.counts), config
        prior, lik = np.array(state.counts), token.lik
        if used < c.k_max:
            prior, lik = np.append(prior, c.alfa), np.append(lik, token.fresh)
        if state.prev is not None:
            prior[state.prev] += c.lmda
        log_prior = np.log(prior)
        joint = log_prior + lik
        topic = int(joint.argmax())
        if topic == used:
            state.counts.append(0.0)
        state.counts[topic] += token.n
        state.prev = topic
        if isinstance(state.bank, MeanVarianceBank):
            state.bank.absorb(topic, token.n, token.mean, token.m2)
        else:
            for i, x in enumerate(token.scenes):
                state.bank.learn(topic, token.scenes[i - 1] if i else None, x, i == 0)
        return {
            "topic": topic, "n_scenes": token.n, "log_loss": _lse(joint), "log_like": lik.tolist(),
            "log_prior": log_prior.tolist(), "post": np.exp(joint - _lse(joint)).tolist(),
        }

    types = {"topic": pa.int32(), "n_scenes": pa.int64(), "log_loss": pa.float64()} | {
        n: t for n, (_, t) in arrays.items()
    }

    def run(batches: Iterator[pa.RecordBatch]):
        current, state, token, schema = None, None, None, None

        def emit(done):
            columns = [pa.array([d[0][j] for d in done], schema.field(n).type) for j, n in enumerate(("seq_id", "token_id"))]
            columns += [pa.array([d[1][n] for d in done], t) for n, t in types.items()]
            return pa.RecordBatch.from_arrays(columns, names=["seq_id", "token_id", *types])

        for batch in batches:
            schema = batch.schema
            x = matrix(batch.column("scene"))
            keys = list(zip(batch.column("seq_id").to_pylist(), batch.column("token_id").to_pylist()))
            done = []
            for i, key in enumerate(keys):
                if key != current:
                    if token is not None:
                        done.append((current, close(state, token)))
                    if current is None or key[0] != current[0]:
                        state = EventRunner(config, x.shape[1])
                    current, token = key, Token(state.bank, len(state.counts), x[i])
                token.add(state.bank, len(state.counts), x[i])
            if done:
                yield emit(done)
        if token is not None:
            yield emit([(current, close(state, token))])

    fields = field_types(scenes, ["seq_id", "token_id"]) + ["topic int", "n_scenes bigint", "log_loss double"]
    fields += [f"{n} {t}" for n, (t, _) in arrays.items()]
    rows = in_order(scenes.select("seq_id", "token_id", "pos", "scene"), "token_id", "pos")
    return stream(rows, run, ", ".join(fields))


def event_surprise(results: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Bayesian surprise: how likely the scene was under the previous label posterior.

    Candidates that did not exist at the previous scene have no weight. 0 for the first.
    """
    named = results.select("seq_id", "pos", "log_like", V.add(F.col("log_like"), F.col("log_prior")).alias("joint"))
    lagged = with_lag(named, {"_joint": "joint"}, rows)
    aligned = F.slice("log_like", 1, F.size("_joint"))
    value = V.array_logsumexp(V.add(F.col("_joint"), aligned)) - V.array_logsumexp(F.col("_joint"))
    return lagged.select(
        "seq_id", "pos", F.when(F.col("pos") == 0, F.lit(0.0)).otherwise(value).alias("surprise")
    )
