"""Online topic assignment under a sticky prior, for all scorers, and its parameter grid.

The choice at one scene depends on every earlier choice of the sequence, so this step is a
recursion. Sequences run in parallel over tasks, and inside a task the sequences of an Arrow
batch and all configurations advance together, one position at a time, as array operations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventide.functions.vector import LOG_2PI
from eventide.operators.metrics import with_f1
from eventide.operators.ordered import field_types, in_order, matrix, stream
from eventide.operators.positions import with_lag

#: A topic keeps the prior variance until it has this many scenes.
WARM_COUNT = 3

GAUSS = ("gauss-origin", "gauss-global", "gauss-self")
VMF = ("vmf-origin", "vmf-const")
ANCHORS = ("centroid", "ema", "last", "max_c_l")
SIGNALS = ("signals",)


@dataclass(frozen=True)
class Config:
    """Parameters of one segmenter.

    ``scorer`` names how a scene is scored against a topic: ``gauss-*`` (diagonal Gaussian;
    the suffix says where a new topic is centred), ``vmf-*`` (``kappa`` times the cosine),
    an anchor (``centroid``, ``ema``, ``last``, ``max_c_l``) or ``signals`` (weighted cosine,
    token overlap and entity overlap).
    """

    alpha: float = 1.0
    lmda: float = 10.0
    sigma0_sq: float = 0.01
    sigma_min_sq: float = 1e-6
    k_max: int = 256
    scorer: str = "gauss-origin"
    kappa: float = 1.0
    beta: float = 0.5
    new_score: float = 0.0
    b_cos: float = 1.0
    b_jac: float = 0.0
    b_ent: float = 0.0

    def __post_init__(self):
        if self.alpha <= 0:
            raise ValueError("alpha must be positive: an empty state would have no candidate")
        if self.scorer not in GAUSS + VMF + ANCHORS + SIGNALS:
            raise ValueError(f"unknown scorer {self.scorer!r}")


FREQUENT_SHIFT = Config(alpha=10.0, lmda=1.0, sigma0_sq=0.1)
PERSISTENCE = Config(alpha=1.0, lmda=10.0, sigma0_sq=0.01)


class Bank:
    """State of ``sequences`` x ``configs`` segmenters that share one scorer.

    Arrays have one leading row per (sequence, configuration) pair and one slot per topic.
    A slot that is not in use has count 0, hence prior 0, and never wins.
    """

    _SLOTTED = ("counts", "mu", "m2", "inv_var", "scaled", "const", "last", "sq", "last_sq")
    _PLAIN = ("used", "prev", "seen", "mean")
    #: Tokens and entities; only the ``signals`` scorer keeps them.
    members = ()

    def __init__(self, configs: Sequence[Config], dim: int, sequences: int = 1, slots: int = 4):
        self.configs, self.dim, self.sequences = list(configs), dim, sequences
        self.scorer = configs[0].scorer
        rows = sequences * len(configs)

        def per_row(name):
            return np.tile(np.array([getattr(c, name) for c in configs], dtype=np.float64), sequences)

        for name in ("alpha", "lmda", "sigma0_sq", "sigma_min_sq", "k_max", "kappa", "beta",
                     "new_score"):
            setattr(self, name, per_row(name))
        self.log_alpha = np.log(self.alpha)
        self.used = np.zeros(rows, dtype=np.int64)
        self.prev = np.full(rows, -1, dtype=np.int64)
        self.seen = np.zeros(sequences)
        self.mean = np.zeros((sequences, dim))
        gauss = self.scorer in GAUSS
        two = self.scorer in ("last", "max_c_l")
        wide, flat = (rows, slots, dim), (rows, slots)
        self.counts, self.mu = np.zeros(flat), np.zeros(wide)
        self.m2 = np.zeros(wide) if gauss else None
        self.inv_var = np.zeros(wide) if gauss else None
        self.scaled = np.zeros(wide) if gauss else None
        self.const = np.zeros(flat) if gauss else None
        self.sq = None if gauss else np.zeros(flat)
        self.last = np.zeros(wide) if two else None
        self.last_sq = np.zeros(flat) if two else None

    # -- scores ----------------------------------------------------------------

    def _project(self, table: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Dot product of every slot with the scene of its sequence, one row per pair."""
        n, width = len(x), table.shape[1]
        rows = table[: n * len(self.configs)].reshape(n, -1, self.dim)
        return (rows @ x[:, :, None]).reshape(-1, width)

    def _cosines(self, table, squares, x, x_norm, rows) -> np.ndarray:
        """True cosine, 0 where either norm is below 1e-9."""
        norms = np.sqrt(squares[:rows])
        safe = (norms >= 1e-9) & (x_norm >= 1e-9)
        return np.where(safe, self._project(table, x) / np.where(safe, norms * x_norm, 1.0), 0.0)

    def _scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the slots (rows x slots) and of a new topic (rows)."""
        rows, each = len(x) * len(self.configs), len(self.configs)
        if self.scorer in GAUSS:
            quad = self._project(self.inv_var, x * x) - 2.0 * self._project(self.scaled, x)
            known = -0.5 * (quad + self.const[:rows])
            if self.scorer == "gauss-self":
                squares = 0.0
            else:
                off = x if self.scorer == "gauss-origin" else x - self.mean[: len(x)]
                squares = np.repeat(np.einsum("nd,nd->n", off, off), each)
            s0 = self.sigma0_sq[:rows]
            return known, -0.5 * (squares / s0 + self.dim * (LOG_2PI + np.log(s0)))
        if self.scorer in ANCHORS:
            x_norm = np.repeat(np.sqrt(np.einsum("nd,nd->n", x, x)), each)[:, None]
            if self.scorer == "last":
                cos = self._cosines(self.last, self.last_sq, x, x_norm, rows)
            else:
                cos = self._cosines(self.mu, self.sq, x, x_norm, rows)
            if self.scorer == "max_c_l":
                cos = np.maximum(cos, self._cosines(self.last, self.last_sq, x, x_norm, rows))
            return cos / self.sigma0_sq[:rows, None], self.new_score[:rows] / self.sigma0_sq[:rows]
        cos = self._project(self.mu, x) / (np.sqrt(self.sq[:rows]) + 1e-9)
        kappa = self.kappa[:rows]
        return kappa[:, None] * cos, (0.0 * kappa if self.scorer == "vmf-origin" else -kappa)

    # -- one position ------------------------------------------------------------

    def assign(self, x: np.ndarray, tokens=frozenset(), entities=frozenset()):
        """Advance the first ``len(x)`` sequences by one scene each; their tokens and entities do not matter here.

        Returns topic ids and change flags, one per (sequence, configuration).
        """
        n = len(x)
        if n == 1 and len(self.configs) == 1 and self.scorer in GAUSS:
            return self._assign_alone(x[0])
        rows = np.arange(n * len(self.configs))
        count = len(rows)
        self.seen[:n] += 1.0
        if self.scorer == "gauss-global":
            self.mean[:n] += (x - self.mean[:n]) / self.seen[:n, None]
        prev, used = self.prev[:count], self.used[:count]
        started = used > 0
        if started.any():
            known, fresh = self._scores(x)
            prior = self.counts[:count].copy()
            prior[rows, prev] += np.where(started, self.lmda[:count], 0.0)
            with np.errstate(divide="ignore"):
                known += np.log(prior)
            best = known.argmax(axis=1)
            # Strictly better: the lowest topic id wins ties.
            opens = (used < self.k_max[:count]) & (self.log_alpha[:count] + fresh > known[rows, best])
            topic = np.where(opens | ~started, used, best)
        else:
            topic = np.zeros(count, dtype=np.int64)
        self._learn(rows, topic, x)
        changed = (prev >= 0) & (topic != prev)
        self.prev[:count] = topic
        return topic, changed

    def _assign_alone(self, s: np.ndarray):
        """The same step for one sequence and one Gaussian configuration, without index
        arrays: a long sequence advances alone, so its time per scene counts."""
        c, used, prev = self.configs[0], int(self.used[0]), int(self.prev[0])
        self.seen[0] += 1.0
        if self.scorer == "gauss-global":
            self.mean[0] += (s - self.mean[0]) / self.seen[0]
        topic = 0
        if used:
            quad = self.inv_var[0, :used] @ (s * s) - 2.0 * (self.scaled[0, :used] @ s) + self.const[0, :used]
            known = np.log(self.counts[0, :used]) - 0.5 * quad
            known[prev] = math.log(self.counts[0, prev] + c.lmda) - 0.5 * quad[prev]
            topic = int(known.argmax())
            if used < c.k_max:
                off = s - self.mean[0] if self.scorer == "gauss-global" else s
                squares = 0.0 if self.scorer == "gauss-self" else float(off @ off)
                fresh = -0.5 * (squares / c.sigma0_sq + self.dim * (LOG_2PI + math.log(c.sigma0_sq)))
                if math.log(c.alpha) + fresh > known[topic]:
                    topic = used
        if topic == used:
            self.used[0] += 1
            if used >= self.counts.shape[1]:
                self._grow()
        n = self.counts[0, topic] + 1.0
        old = self.mu[0, topic].copy()
        new = old + (s - old) / n
        spread = self.m2[0, topic] + (s - old) * (s - new)
        self.counts[0, topic], self.mu[0, topic], self.m2[0, topic] = n, new, spread
        if n < WARM_COUNT:
            inv, log_det = np.full(self.dim, 1.0 / c.sigma0_sq), self.dim * math.log(c.sigma0_sq)
        else:
            var = np.maximum(spread / n, c.sigma_min_sq)
            inv, log_det = 1.0 / var, float(np.log(var).sum())
        self.inv_var[0, topic], self.scaled[0, topic] = inv, inv * new
        self.const[0, topic] = float((inv * new) @ new) + log_det + self.dim * LOG_2PI
        self.prev[0] = topic
        return np.array([topic]), np.array([prev >= 0 and topic != prev])

    def _learn(self, rows, topic, x) -> None:
        self.used[rows] = np.maximum(self.used[rows], topic + 1)
        while int(topic.max()) >= self.counts.shape[1]:
            self._grow()
        s = np.repeat(x, len(self.configs), axis=0)
        self.counts[rows, topic] += 1.0
        n = self.counts[rows, topic][:, None]
        old = self.mu[rows, topic]
        if self.scorer == "ema":
            b = self.beta[rows][:, None]
            new = np.where(n == 1.0, s, b * s + (1.0 - b) * old)
        else:
            new = old + (s - old) / n
        self.mu[rows, topic] = new
        if self.scorer in GAUSS:
            spread = self.m2[rows, topic] + (s - old) * (s - new)
            self.m2[rows, topic] = spread
            warm = np.maximum(spread / n, self.sigma_min_sq[rows][:, None])
            var = np.where(n < WARM_COUNT, self.sigma0_sq[rows][:, None], warm)
            inv = 1.0 / var
            self.inv_var[rows, topic] = inv
            self.scaled[rows, topic] = inv * new
            self.const[rows, topic] = (inv * new * new + np.log(var)).sum(axis=1) + self.dim * LOG_2PI
            return
        self.sq[rows, topic] = np.einsum("rd,rd->r", new, new)
        if self.last is not None:
            self.last[rows, topic] = s
            self.last_sq[rows, topic] = np.einsum("rd,rd->r", s, s)

    def _grow(self) -> None:
        """Twice as many topic slots."""
        wider = lambda a: np.concatenate([a, np.zeros_like(a)], axis=1)
        for name in self._SLOTTED:
            if getattr(self, name) is not None:
                setattr(self, name, wider(getattr(self, name)))

    # -- saving and restoring ----------------------------------------------------------

    def topic(self, k: int) -> dict:
        """Size, mean, squared deviations and last scene of a topic of the only sequence; it keeps no sets."""
        vector = lambda table: [] if table is None else table[0, k].tolist()
        return {
            "n": float(self.counts[0, k]), "mu": vector(self.mu), "m2": vector(self.m2),
            "last": vector(self.last), "n_tok": 0.0, "n_ent": 0.0,
        }

    def put_topic(self, k: int, n: float, mu, m2, last, n_tok: float, n_ent: float) -> None:
        """Set a topic of the only sequence to what :meth:`topic` returned."""
        while self.counts.shape[1] <= k:
            self._grow()
        mu = np.asarray(mu, dtype=float)
        self.counts[0, k], self.mu[0, k] = n, mu
        if self.last is not None:
            self.last[0, k] = last
            self.last_sq[0, k] = self.last[0, k] @ self.last[0, k]
        if self.sq is not None:
            self.sq[0, k] = mu @ mu
            return
        self.m2[0, k] = m2
        warm = np.maximum(self.m2[0, k] / n, self.sigma_min_sq[0])
        var = np.full(self.dim, self.sigma0_sq[0]) if n < WARM_COUNT else warm
        inv = 1.0 / var
        self.inv_var[0, k], self.scaled[0, k] = inv, inv * mu
        self.const[0, k] = (inv * mu * mu + np.log(var)).sum() + self.dim * LOG_2PI

    def put_head(self, used: int, prev: int, seen: float, mean) -> None:
        """Set the rest of the state of the only sequence."""
        while self.counts.shape[1] < used:
            self._grow()
        self.used[0], self.prev[0], self.seen[0] = used, prev, seen
        self.mean[0] = mean

    # -- moving one sequence between banks ------------------------------------------

    def take(self, sequence: int) -> dict:
        """State of one sequence, to be put into another bank with the same configurations."""
        each = len(self.configs)
        part = slice(sequence * each, (sequence + 1) * each)
        state = {n: getattr(self, n)[part].copy() for n in self._SLOTTED if getattr(self, n) is not None}
        state |= {n: getattr(self, n)[part].copy() for n in ("used", "prev")}
        state |= {n: getattr(self, n)[sequence].copy() for n in ("seen", "mean")}
        return state

    def put(self, sequence: int, state: dict) -> None:
        each = len(self.configs)
        part = slice(sequence * each, (sequence + 1) * each)
        while self.counts.shape[1] < state["counts"].shape[1]:
            self._grow()
        width = state["counts"].shape[1]
        for n in self._SLOTTED:
            if getattr(self, n) is not None:
                getattr(self, n)[part, :width] = state[n]
        for n in ("used", "prev"):
            getattr(self, n)[part] = state[n]
        for n in ("seen", "mean"):
            getattr(self, n)[sequence] = state[n]


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products along the first axis, added up in its order: equal inputs tie wherever they stand."""
    return np.add.accumulate(a * b, axis=0)[-1]


class _Held:
    """Which tokens (or entities) the topics of each history hold: one bit per topic."""

    def __init__(self, slots: int):
        self.ids: dict[str, int] = {}
        self.bits = np.zeros((64, 1, slots // 8), dtype=np.uint8)
        self.sizes = np.zeros((1, slots), dtype=np.int64)

    def rows(self, items) -> np.ndarray:
        at = np.array([self.ids.setdefault(i, len(self.ids)) for i in items], dtype=np.int64)
        if len(self.ids) > len(self.bits):
            more = max(len(self.ids), 2 * len(self.bits)) - len(self.bits)
            self.bits = np.concatenate([self.bits, np.zeros((more, *self.bits.shape[1:]), np.uint8)])
        return at

    def shared(self, rows: np.ndarray) -> np.ndarray:
        """How many of the items each topic of each history holds."""
        if not len(rows):
            return np.zeros(self.sizes.shape, dtype=np.int64)
        return np.unpackbits(self.bits[rows], axis=2, bitorder="little").sum(axis=0, dtype=np.int64)

    def add(self, rows: np.ndarray, topic: np.ndarray, shared: np.ndarray) -> None:
        h = np.arange(len(topic))
        self.sizes[h, topic] += len(rows) - shared[h, topic]
        self.bits[rows[:, None], h, topic >> 3] |= (1 << (topic & 7)).astype(np.uint8)

    def branch(self, parents: np.ndarray) -> None:
        self.bits, self.sizes = self.bits[:, parents], self.sizes[parents]

    def grow(self) -> None:
        self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)], axis=2)
        self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)], axis=1)


class SignalBank:
    """State of one sequence under one or more ``signals`` configurations.

    What a topic holds follows from the choices alone, so configurations that have chosen alike share a *history*: means,
    sizes and sets are kept and compared once per history, and a configuration only weighs the three
    signals. There are never more histories than configurations. Sums run in the order of the dimensions and logarithms
    are those of the C library, so that scores that tie by definition tie here as well.
    """

    def __init__(self, configs: Sequence[Config], dim: int, sequences: int = 1, slots: int = 8):
        self.configs, self.dim = list(configs), dim
        column = lambda name: np.array([getattr(c, name) for c in configs], dtype=np.float64)[:, None]
        self.b_cos, self.b_jac, self.b_ent = column("b_cos"), column("b_jac"), column("b_ent")
        self.k_max = column("k_max")[:, 0]
        self.fresh = np.array([math.log(c.alpha) for c in configs]) + column("new_score")[:, 0]
        self.lmdas, self.sticky = np.unique(column("lmda")[:, 0], return_inverse=True)
        self.logs = np.full((1, len(self.lmdas) + 1), -np.inf)
        #: The history of each configuration.
        self.of = np.zeros(len(configs), dtype=np.int64)
        self.used, self.prev = np.zeros(1, dtype=np.int64), np.full(1, -1, dtype=np.int64)
        self.seen, self.mean = np.zeros(1), np.zeros((1, dim))
        slots = -(-max(slots, 8) // 8) * 8
        self.counts, self.norm = np.zeros((1, slots), dtype=np.int64), np.zeros((1, slots))
        self.mu = np.zeros((dim, 1, slots))
        self.held = {"t": _Held(slots), "e": _Held(slots)}

    def _log(self, most: int) -> None:
        """Logarithms of the counts up to ``most``, alone and with each stickiness added."""
        if most < len(self.logs):
            return
        ln = lambda x: math.log(x) if x > 0 else -math.inf
        rows = [[ln(n), *(ln(n + l) for l in self.lmdas.tolist())] for n in range(len(self.logs), 2 * most + 8)]
        self.logs = np.concatenate([self.logs, np.array(rows)])

    def _overlap(self, kind: str, n: int, shared: np.ndarray) -> np.ndarray:
        sizes = self.held[kind].sizes
        either = sizes + n - shared
        return np.where((sizes > 0) & (n > 0), shared / np.where(either > 0, either, 1), 0.0)

    def assign(self, x: np.ndarray, tokens=frozenset(), entities=frozenset()):
        """Advance the sequence by one scene: topic ids and change flags, one per configuration."""
        s = x[0]
        rows = {"t": self.held["t"].rows(tokens), "e": self.held["e"].rows(entities)}
        shared = {k: self.held[k].shared(at) for k, at in rows.items()}
        self.seen[0] += 1.0
        of, used = self.of, self.used[self.of]
        prev = self.prev[of]
        if self.used[0]:
            self._log(int(self.counts.max()))
            alike = _dot(self.mu, s[:, None, None])
            known = self.b_cos * alike[of] / (self.norm + 1e-9)[of]
            known += self.b_jac * self._overlap("t", len(rows["t"]), shared["t"])[of]
            known += self.b_ent * self._overlap("e", len(rows["e"]), shared["e"])[of]
            prior = self.logs[self.counts, 0][of]
            every = np.arange(len(of))
            prior[every, prev] = self.logs[self.counts[of, prev], self.sticky + 1]
            known += prior
            best = known.argmax(axis=1)
            # Strictly better: the lowest topic id wins ties.
            topic = np.where((used < self.k_max) & (self.fresh > known[every, best]), used, best)
        else:
            topic = np.zeros(len(of), dtype=np.int64)
        self._branch(topic, rows, shared, s)
        return topic, (prev >= 0) & (topic != prev)

    def _branch(self, topic: np.ndarray, rows: dict, shared: dict, s: np.ndarray) -> None:
        """Histories whose configurations choose differently part; then each learns the scene."""
        while int(topic.max()) >= self.counts.shape[1]:
            self._grow()
            shared = {k: np.concatenate([v, np.zeros_like(v)], axis=1) for k, v in shared.items()}
        width = self.counts.shape[1]
        codes, self.of = np.unique(self.of * width + topic, return_inverse=True)
        parents, chosen = codes // width, codes % width
        if len(codes) > len(self.used):
            self.used, self.counts, self.norm = self.used[parents], self.counts[parents], self.norm[parents]
            self.mu = self.mu[:, parents]
            for kind, held in self.held.items():
                held.branch(parents)
                shared[kind] = shared[kind][parents]
        h = np.arange(len(codes))
        self.prev = chosen
        self.used = np.maximum(self.used, chosen + 1)
        self.counts[h, chosen] += 1
        old = self.mu[:, h, chosen]
        new = old + (s[:, None] - old) / self.counts[h, chosen]
        self.mu[:, h, chosen] = new
        self.norm[h, chosen] = np.sqrt(_dot(new, new))
        for kind, held in self.held.items():
            held.add(rows[kind], chosen, shared[kind])

    def _grow(self) -> None:
        """Twice as many topic slots."""
        wider = lambda a: np.concatenate([a, np.zeros_like(a)], axis=-1)
        self.counts, self.norm, self.mu = wider(self.counts), wider(self.norm), wider(self.mu)
        for held in self.held.values():
            held.grow()

    # -- saving and restoring, with one configuration ------------------------------

    @property
    def members(self) -> list[tuple[str, str]]:
        """The tokens (``t``) and entities (``e``) that topics hold."""
        return [(kind, item) for kind, held in self.held.items() for item in held.ids]

    def topic(self, k: int) -> dict:
        """Size, mean and set sizes of a topic."""
        return {
            "n": float(self.counts[0, k]), "mu": self.mu[:, 0, k].tolist(), "m2": [], "last": [],
            "n_tok": float(self.held["t"].sizes[0, k]), "n_ent": float(self.held["e"].sizes[0, k]),
        }

    def put_topic(self, k: int, n: float, mu, m2, last, n_tok: float, n_ent: float) -> None:
        """Set a topic to what :meth:`topic` returned."""
        while self.counts.shape[1] <= k:
            self._grow()
        mu = np.asarray(mu, dtype=float)
        self.counts[0, k], self.mu[:, 0, k] = n, mu
        self.norm[0, k] = np.sqrt(_dot(mu[:, None], mu[:, None]))[0]
        self.held["t"].sizes[0, k], self.held["e"].sizes[0, k] = n_tok, n_ent

    def put_head(self, used: int, prev: int, seen: float, mean) -> None:
        """Set the rest of the state."""
        while self.counts.shape[1] < used:
            self._grow()
        self.used[0], self.prev[0], self.seen[0] = used, prev, seen

    def holders(self, kind: str, item: str) -> list[int]:
        """Topics that hold a token (``t``) or an entity (``e``)."""
        held = self.held[kind]
        if item not in held.ids:
            return []
        return np.flatnonzero(np.unpackbits(held.bits[held.ids[item], 0], bitorder="little")).tolist()

    def items(self, kind: str, k: int) -> list[str]:
        """Tokens (``t``) or entities (``e``) that a topic holds."""
        held = self.held[kind]
        has = held.bits[: len(held.ids), 0, k >> 3] >> (k & 7) & 1
        return [item for item, h in zip(held.ids, has.tolist()) if h]

    def put_items(self, kind: str, k: int, items: Sequence[str]) -> None:
        """Add items to those that a topic holds."""
        held = self.held[kind]
        rows = held.rows(items)
        held.bits[rows, 0, k >> 3] |= np.uint8(1 << (k & 7))

    def put_holders(self, kind: str, item: str, topics: Sequence[int]) -> None:
        topics = np.asarray(list(topics), dtype=np.int64)
        while len(topics) and self.counts.shape[1] <= int(topics.max()):
            self._grow()
        held = self.held[kind]
        row = held.rows([item])[0]
        held.bits[row, 0] = 0
        np.bitwise_or.at(held.bits[row, 0], topics >> 3, (1 << (topics & 7)).astype(np.uint8))


def bank_of(config: Config, dim: int) -> "Bank | SignalBank":
    """A bank for one sequence under one configuration."""
    return (SignalBank if config.scorer in SIGNALS else Bank)([config], dim)


class BatchRunner:
    """Runs one bank per scorer over Arrow batches in (sequence, position) order.

    Sequences inside a batch advance together; the last one may go on in the next batch, so
    its state is carried over.
    """

    #: Upper limit for the floats of one bank's widest array; a Gaussian bank has four such arrays.
    MAX_CELLS = 1_000_000

    def __init__(self, configs: Sequence[Config]):
        by_scorer: dict[str, list[int]] = {}
        for i, c in enumerate(configs):
            by_scorer.setdefault(c.scorer, []).append(i)
        self.groups = [(ids, [configs[i] for i in ids]) for ids in by_scorer.values()]
        self.width = len(configs)
        self.open_key, self.open_states = None, None

    def run(self, keys: list, x: np.ndarray, tokens: list, entities: list):
        """Topics and change flags as (rows x configs) arrays."""
        n = len(keys)
        starts = [i for i in range(n) if i == 0 or keys[i] != keys[i - 1]] + [n]
        topics = np.empty((n, self.width), dtype=np.int32)
        changed = np.empty((n, self.width), dtype=bool)
        resumed = n > 0 and self.open_states is not None and keys[0] == self.open_key
        spans = list(zip(starts[:-1], starts[1:]))
        states = []
        for g, (ids, configs) in enumerate(self.groups):
            carried = self.open_states[g] if resumed else None
            states.append(self._group(ids, configs, spans, x, tokens, entities, carried, topics, changed))
        if n:
            self.open_key, self.open_states = keys[-1], states
        return topics, changed

    @staticmethod
    def _signals(ids, configs, spans, x, tokens, entities, carried, topics, changed) -> SignalBank | None:
        """Sequence by sequence: tokens have their numbers within a sequence."""
        bank = carried
        for i, span in enumerate(spans):
            if i or bank is None:
                bank = SignalBank(configs, x.shape[1])
            for row in range(*span):
                topics[row, ids], changed[row, ids] = bank.assign(x[row : row + 1], tokens[row], entities[row])
        return bank

    def _group(self, ids, configs, spans, x, tokens, entities, carried, topics, changed):
        dim, each = x.shape[1], len(configs)
        if configs[0].scorer in SIGNALS:
            return self._signals(ids, configs, spans, x, tokens, entities, carried, topics, changed)
        order = sorted(range(len(spans)), key=lambda i: spans[i][0] - spans[i][1])
        final_state, at = None, 0
        while at < len(order):
            # The longest sequence of a chunk bounds its topics.
            longest = spans[order[at]][1] - spans[order[at]][0]
            slots = min(max(longest, 4), max(c.k_max for c in configs))
            size = max(1, self.MAX_CELLS // (slots * dim * each))
            chunk = order[at : at + size]
            at += len(chunk)
            bank = Bank(configs, dim, len(chunk), slots=min(slots, 16))
            if carried is not None and 0 in chunk:
                bank.put(chunk.index(0), carried)
            if len(chunk) == 1:
                for row in range(*spans[chunk[0]]):
                    topics[row, ids], changed[row, ids] = bank.assign(x[row : row + 1])
                if len(spans) - 1 in chunk:
                    final_state = bank.take(0)
                continue
            lengths = np.array([spans[i][1] - spans[i][0] for i in chunk])
            firsts = np.array([spans[i][0] for i in chunk])
            for step in range(longest):
                rows = firsts[: int((lengths > step).sum())] + step
                topic, change = bank.assign(x[rows])
                topics[rows[:, None], ids] = topic.reshape(-1, each)
                changed[rows[:, None], ids] = change.reshape(-1, each)
            if len(spans) - 1 in chunk:
                final_state = bank.take(chunk.index(len(spans) - 1))
        return final_state


# -- DataFrame operators -------------------------------------------------------


def _sets(batch: pa.RecordBatch, name: str) -> list[frozenset]:
    if name not in batch.schema.names:
        return [frozenset()] * batch.num_rows
    return [frozenset(v or ()) for v in batch.column(name).to_pylist()]


def segment(
    scenes: DataFrame, config: Config = Config(), keep: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """``seq_id, pos, <keep>, topic, is_boundary`` for every scene; a fresh state per sequence.

    ``scenes`` has ``seq_id, pos, scene`` and, for the ``signals`` scorer, the string arrays
    ``tokens`` and ``entities``.
    """
    sets = [c for c in ("tokens", "entities") if config.scorer in SIGNALS and c in scenes.columns]
    passed = ["seq_id", "pos", *keep]
    fields = field_types(scenes, passed) + ["topic int", "is_boundary boolean"]
    names = passed + ["topic", "is_boundary"]

    def run(batches: Iterator[pa.RecordBatch]):
        runner = BatchRunner([config])
        for batch in batches:
            topics, changed = runner.run(
                batch.column("seq_id").to_pylist(), matrix(batch.column("scene")),
                _sets(batch, "tokens"), _sets(batch, "entities"),
            )
            out = [batch.column(n) for n in passed]
            out += [pa.array(topics[:, 0], pa.int32()), pa.array(changed[:, 0], pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=names)

    # A kept column may also be an input of the recursion.
    columns = list(dict.fromkeys([*passed, "scene", *sets]))
    return stream(in_order(scenes.select(*columns), partitions=partitions), run, ", ".join(fields))


def with_truth(assigned: DataFrame, label: str = "label", flag: str | None = None) -> DataFrame:
    """Score rows ``gt, pred`` of an assignment that kept its labels; first turns drop out."""
    if flag is not None:
        gt = F.coalesce(F.col(label) == flag, F.lit(False))
        rows = assigned.where(F.col("pos") > 0)
    else:
        rows = with_lag(assigned, {"_prev": label}).where(F.col("pos") > 0)
        gt = ~F.col(label).eqNullSafe(F.col("_prev"))
    return rows.select("seq_id", "pos", gt.alias("gt"), F.col("is_boundary").alias("pred"))


#: Configurations that run over one copy of the scenes; more are spread over several copies.
CONFIGS_PER_COPY = 128
#: The same if all are ``signals``, which share what they compute.
SIGNALS_PER_COPY = 1024
#: Groups whose counts a task keeps before it emits them.
OPEN_GROUPS = 256


def grid_counts(
    scenes: DataFrame, configs: Sequence[Config], flag: str | None = None, partitions: int | None = None,
    per_copy: int | None = None, by: tuple[str, ...] = (),
) -> DataFrame:
    """``cfg_id, tp, fp, fn`` for every configuration (``cfg_id`` = its place in the list).

    All configurations of a copy run while a scene is at hand, so vectors are shuffled once
    per ``per_copy`` configurations, not once per configuration. A task emits one row of
    counts per configuration, which is the map side of the final sum. Needs ``label`` per
    scene: truth is a label change, or ``label == flag``. ``by`` names columns that are
    constant within a sequence; counts are kept apart by them.
    """
    if per_copy is None:
        per_copy = SIGNALS_PER_COPY if all(c.scorer in SIGNALS for c in configs) else CONFIGS_PER_COPY
    blocks = [list(range(i, min(i + per_copy, len(configs)))) for i in range(0, len(configs), per_copy)]
    sets = [c for c in ("tokens", "entities") if c in scenes.columns and any(x.scorer in SIGNALS for x in configs)]
    rows = scenes.select("seq_id", "pos", "scene", "label", *by, *sets)
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(len(blocks) - 1))))

    def emit(group: tuple, counts: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        used = np.flatnonzero(counts[:, 3]).astype(np.int32)
        out = [pa.array([group[i]] * len(used), schema.field(c).type) for i, c in enumerate(by)]
        out += [pa.array(used), *(pa.array(counts[used, i]) for i in range(3))]
        return pa.RecordBatch.from_arrays(out, names=[*by, "cfg_id", "tp", "fp", "fn"])

    def run(batches: Iterator[pa.RecordBatch]):
        totals: dict[tuple, np.ndarray] = {}
        runners = [BatchRunner([configs[j] for j in ids]) for ids in blocks]
        before, schema = (None, None), None
        for batch in batches:
            schema = batch.schema
            keys = list(zip(batch.column("seq_id").to_pylist(), batch.column("copy").to_pylist()))
            groups = list(zip(*(batch.column(c).to_pylist() for c in by))) if by else None
            labels = batch.column("label").to_pylist()
            x, tok, ent = matrix(batch.column("scene")), _sets(batch, "tokens"), _sets(batch, "entities")
            # A partition is sorted by copy inside a sequence; runs of one copy go together.
            copy = np.array([k[1] for k in keys], dtype=np.int64)
            gt, scored = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
            of_group: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                scored[i] = key == before[0]
                gt[i] = labels[i] == flag if flag is not None else labels[i] != before[1]
                before = (key, labels[i])
                of_group.setdefault(groups[i] if by else (), []).append(i)
            pred = np.zeros((len(keys), len(configs)), dtype=bool)
            for b, ids in enumerate(blocks):
                at = np.flatnonzero(copy == b)
                if len(at):
                    flags = runners[b].run(
                        [keys[i] for i in at], x[at], [tok[i] for i in at], [ent[i] for i in at]
                    )[1]
                    pred[at[:, None], ids] = flags
            for group, members in of_group.items():
                counts = totals.setdefault(group, np.zeros((len(configs), 4), dtype=np.int64))
                members = np.array(members)
                for b, ids in enumerate(blocks):
                    at = members[copy[members] == b]
                    if not len(at):
                        continue
                    counts[ids, 3] = 1
                    at = at[scored[at]]
                    p, g = pred[at][:, ids], gt[at][:, None]
                    counts[ids, 0] += (p & g).sum(axis=0)
                    counts[ids, 1] += (p & ~g).sum(axis=0)
                    counts[ids, 2] += (~p & g).sum(axis=0)
                if len(totals) >= OPEN_GROUPS:
                    yield from (emit(k, c, schema) for k, c in totals.items())
                    totals = {}
        yield from (emit(k, c, schema) for k, c in totals.items())

    group_fields = field_types(scenes, list(by))
    partial = stream(
        in_order(copies, salt=("copy",), partitions=partitions),
        run,
        ", ".join(group_fields + ["cfg_id int, tp bigint, fp bigint, fn bigint"]),
    )
    return partial.groupBy(*by, "cfg_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def grid_scores(scenes: DataFrame, configs: Sequence[Config], **kw) -> DataFrame:
    return with_f1(grid_counts(scenes, configs, **kw))


# -- grids ---------------------------------------------------------------------
# The parameter lists of the four published experiments, in loop order.


def gauss_grid() -> list[Config]:
    return [
        Config(alpha=a, lmda=l, sigma0_sq=s)
        for a in (0.1, 1.0, 10.0)
        for l in (0.0, 0.1, 0.3, 1.0, 3.0, 10.0)
        for s in (0.0001, 0.001, 0.005, 0.01, 0.05, 0.1)
    ]


VARIANT_GRID = {
    "gauss-origin": ((1.0, 10.0), (0.0, 1.0, 3.0), (0.01, 0.05, 0.1, 0.2)),
    "gauss-global": ((0.1, 1.0, 10.0), (0.0, 0.3, 1.0, 3.0), (0.001, 0.005, 0.01, 0.05, 0.1)),
    "gauss-self": ((0.1, 1.0, 10.0), (0.0, 0.3, 1.0, 3.0), (0.01, 0.05, 0.1)),
    "vmf-origin": ((0.1, 1.0, 10.0), (0.0, 0.3, 1.0, 3.0), (1.0, 3.0, 10.0, 30.0)),
    "vmf-const": ((0.1, 1.0, 10.0), (0.0, 0.3, 1.0, 3.0), (0.5, 1.0, 2.0, 3.0)),
}


def variant_grid() -> list[Config]:
    out = []
    for scorer, (alphas, lmdas, params) in VARIANT_GRID.items():
        for a in alphas:
            for l in lmdas:
                for p in params:
                    spread = {"sigma0_sq": p} if scorer in GAUSS else {"kappa": p}
                    out.append(Config(alpha=a, lmda=l, scorer=scorer, k_max=64, **spread))
    return out


def anchor_grid() -> list[Config]:
    return [
        Config(alpha=a, lmda=l, sigma0_sq=s, new_score=nb, beta=b, scorer=anchor, k_max=64)
        for anchor in ANCHORS
        for a in (1.0, 10.0)
        for l in (0.0, 1.0, 3.0)
        for s in (0.05, 0.1)
        for nb in (0.3, 0.5, 0.7)
        for b in ((0.3, 0.5, 0.7, 0.9) if anchor == "ema" else (0.5,))
    ]


def signal_grid() -> list[Config]:
    return [
        Config(alpha=1.0, lmda=l, b_cos=c, b_jac=j, b_ent=e, new_score=nb, scorer="signals", k_max=64)
        for l in (0.0, 0.3, 1.0)
        for c in (0.0, 1.0, 3.0)
        for j in (0.0, 3.0, 10.0, 30.0)
        for e in (0.0, 3.0, 10.0, 30.0)
        for nb in (0.3, 0.5, 0.7, 1.0)
        if any((c, j, e))
    ]


def config_table(spark, configs: Sequence[Config]) -> DataFrame:
    """The configurations as a table, to name the rows of a grid result."""
    names = ("scorer", "alpha", "lmda", "sigma0_sq", "kappa", "beta", "new_score", "b_cos", "b_jac", "b_ent")
    rows = pd.DataFrame(
        {"cfg_id": np.arange(len(configs), dtype=np.int32)}
        | {n: [getattr(c, n) for c in configs] for n in names}
    )
    return spark.createDataFrame(rows)
