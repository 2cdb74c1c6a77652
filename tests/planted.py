"""Planted sequences for tests."""

import numpy as np


def centers(k, d, rng):
    c = rng.normal(size=(k, d))
    return c / np.linalg.norm(c, axis=1, keepdims=True)


def blocks(rng, lengths, labels, d=16, noise=0.02, k=4):
    """Unit vectors around one centre per label, in runs."""
    c = centers(k, d, rng)
    x, y = [], []
    for n, label in zip(lengths, labels):
        v = c[label] + rng.normal(scale=noise, size=(n, d))
        x.append(v / np.linalg.norm(v, axis=1, keepdims=True))
        y += [label] * n
    return np.concatenate(x), y


def wandering(rng, n, d=8, k=4, noise=0.15, change=0.2):
    c = centers(k, d, rng)
    x, y, current = [], [], 0
    for _ in range(n):
        if rng.random() < change:
            current = int(rng.integers(k))
        v = c[current] + rng.normal(scale=noise, size=d)
        x.append(v / np.linalg.norm(v))
        y.append(current)
    return np.array(x), y


def frame(spark, sequences, partitions=3, **extra):
    """DataFrame of sequences [(x, labels), ...], rows in a scrambled order."""
    rows = [
        (s, i, [float(v) for v in x[i]], int(y[i]), *[extra[e][s][i] for e in extra])
        for s, (x, y) in enumerate(sequences)
        for i in range(len(x))
    ]
    np.random.default_rng(0).shuffle(rows)
    types = "".join(f", {e} array<string>" for e in extra)
    schema = "seq_id bigint, pos int, scene array<double>, label int" + types
    return spark.createDataFrame(rows, schema).repartition(partitions)
