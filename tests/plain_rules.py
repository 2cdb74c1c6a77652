"""Plain one-row-at-a-time statements of the rules, to compare the operators with."""

from __future__ import annotations

import math

import numpy as np


def cos(a, b):
    na, nb = math.sqrt(float(a @ a)), math.sqrt(float(b @ b))
    return 0.0 if na < 1e-9 or nb < 1e-9 else float(a @ b) / (na * nb)


def overlap(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def assign_all(scenes, c, tokens=None, entities=None):
    """Topics of one sequence: score every candidate, take the first best, then learn."""
    d = len(scenes[0])
    topics, prev, mean, out = [], None, np.zeros(d), []
    for i, s in enumerate(scenes):
        s = np.asarray(s, dtype=float)
        tok = tokens[i] if tokens else set()
        ent = entities[i] if entities else set()
        mean = mean + (s - mean) / (i + 1)
        candidates = []
        for k, t in enumerate(topics):
            p = t["n"] + (c.lmda if k == prev else 0.0)
            m = np.mean(t["x"], axis=0)
            if c.scorer.startswith("gauss"):
                v = np.full(d, c.sigma0_sq) if t["n"] < 3 else np.maximum(np.var(t["x"], axis=0), c.sigma_min_sq)
                score = -0.5 * float(np.sum((s - m) ** 2 / v + np.log(2 * math.pi * v)))
            elif c.scorer.startswith("vmf"):
                score = c.kappa * float(s @ m) / (math.sqrt(float(m @ m)) + 1e-9)
            elif c.scorer == "signals":
                score = (c.b_cos * float(s @ m) / (math.sqrt(float(m @ m)) + 1e-9)
                         + c.b_jac * overlap(tok, t["tok"]) + c.b_ent * overlap(ent, t["ent"]))
            else:
                last = t["x"][-1]
                score = {"centroid": cos(s, m), "ema": cos(s, t["ema"]), "last": cos(s, last),
                         "max_c_l": max(cos(s, m), cos(s, last))}[c.scorer] / c.sigma0_sq
            candidates.append(math.log(p) + score)
        if len(topics) < c.k_max:
            def iso(e):
                return -0.5 * (float(e @ e) / c.sigma0_sq + d * math.log(2 * math.pi * c.sigma0_sq))
            fresh = {
                "gauss-origin": lambda: iso(s), "gauss-global": lambda: iso(s - mean),
                "gauss-self": lambda: iso(np.zeros(d)), "vmf-origin": lambda: 0.0,
                "vmf-const": lambda: -c.kappa, "signals": lambda: c.new_score,
            }.get(c.scorer, lambda: c.new_score / c.sigma0_sq)()
            candidates.append(math.log(c.alpha) + fresh)
        k = int(np.argmax(candidates))
        if k == len(topics):
            topics.append({"n": 0, "x": [], "tok": set(), "ent": set(), "ema": s})
        t = topics[k]
        t["ema"] = s if t["n"] == 0 else c.beta * s + (1 - c.beta) * t["ema"]
        t["n"] += 1
        t["x"].append(s)
        t["tok"] |= tok
        t["ent"] |= ent
        out.append((k, prev is not None and k != prev))
        prev = k
    return out
