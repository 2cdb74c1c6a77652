"""Near-duplicates of a stated similarity against all pairs by brute force, and crowds under one value."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from eventide.llm import simhash_similar as S
from eventide.llm.common import table

SF = "/root/testdata/sf0.01"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    span = min(5, len(words))
    return frozenset(tuple(words[k : k + span]) for k in range(len(words) - span + 1)) if words else frozenset()


def alike(a, b):
    return a == b or len(a & b) * 100 >= len(a | b) * 80


def joined(sets):
    """Components of all similar pairs, found by comparing every pair that shares a shingle."""
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(sets)), 2):
        if alike(sets[a], sets[b]):
            root[find(a)] = find(b)
    return [find(k) for k in range(len(sets))]


def partition(pairs):
    out = {}
    for item, label in pairs:
        out.setdefault(label, set()).add(item)
    return {frozenset(v) for v in out.values()}


def test_groups_of_the_table_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = docs.select("doc_id", "text").collect()
    wanted = partition(zip([r.doc_id for r in rows], joined([shingle_set(r.text) for r in rows])))
    assert partition((r.doc_id, r.least) for r in S.groups(docs).collect()) == wanted


def changed(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.randrange(10**6)}"
    return words


def test_recall_of_pairs_near_the_limit(spark):
    """Texts of 60 to 400 words, each with one copy whose similarity lies between 0.8 and 0.9."""
    rng = random.Random(5)
    rows, pairs = [], []
    while len(pairs) < 150:
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        copy = changed(rng, words, max(1, len(words) // 50))
        a, b = shingle_set(" ".join(words)), shingle_set(" ".join(copy))
        if 0.8 <= len(a & b) / len(a | b) < 0.9:
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(copy))]
    found = {r.doc_id: r.least for r in S.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert len(set(found.values())) >= len(pairs)  # no two originals meet


def test_a_crowd_of_near_copies_is_one_group(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(k, " ".join(changed(rng, words, 2))) for k in range(400)] + [(1000 + k, " ".join(f"o{rng.randrange(5000)}" for _ in range(80))) for k in range(50)]
    monkeypatch.setattr(S, "CHUNK", 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(r.doc_id for r in S.stage(spark, docs, SF).collect())
    assert kept == [0, *range(1000, 1050)]


@pytest.mark.parametrize("chunk, batch, n", [(4096, 10_000, 9), (7, 5, 60), (1, 1, 12)])
def test_texts_of_one_value_meet_in_rounds(monkeypatch, chunk, batch, n):
    """Without any link, every pair under one value is compared in the end, whatever the chunks and batches are."""
    monkeypatch.setattr(S, "CHUNK", chunk)
    bits = np.zeros((n, S.WORDS), np.int64)
    unsure = np.zeros((n, S.SEGMENTS, S.UNSURE), np.uint8) + np.arange(S.UNSURE, dtype=np.uint8)
    left, most, seen = np.arange(n) * 7 + 1, 1, set()
    names = ["node", "bits", "unsure"]
    while len(left):
        rows = pa.RecordBatch.from_arrays([pa.array(left), pa.array(bits[: len(left)].tolist(), pa.list_(pa.int64())), pa.array([u.tobytes() for u in unsure[: len(left)]])], names=names)
        reports = pa.Table.from_batches(S._reports([rows], most), schema=S.REPORT).sort_by([("key", "ascending"), ("full", "descending"), ("a", "ascending")])
        pairs = pa.Table.from_batches(S._stars(reports.to_batches(max_chunksize=batch), most), schema=S.PAIR).to_pylist()
        seen |= {frozenset((p["a"], p["b"])) for p in pairs if p["a"] != p["b"]}
        left = np.array(sorted({p["a"] for p in pairs if p["a"] == p["b"]}), np.int64)
        most *= 2
    assert len(seen) == n * (n - 1) // 2


def test_keys_hold_every_state_of_the_unsure_bits():
    bits, unsure = S.fingerprint(S.shingles(" ".join(f"w{k}" for k in range(50)))[0])
    keys = S.keys_of(bits[None], unsure[None])[0]
    assert len(set(keys.tolist())) == S.SEGMENTS * 2**S.UNSURE
    assert all(b < S.SEGMENT_BITS for b in unsure.ravel())


def test_odd_rows(spark):
    long = " ".join(f"w{k % 977}x{k}" for k in range(120_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (5, "ONE "), (None, "two words"), (6, "two words"), (None, "null id"), (7, long), (8, long + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "'x' AS least", "2 AS bits")
    kept = S.stage(spark, docs, SF)
    assert kept.columns == docs.columns
    got = [(r.doc_id, len(r.text or "")) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (4, 3), (6, 9), (None, 7), (7, len(long))], key=str)
    assert S.stage(spark, docs.limit(0), SF).collect() == []


def test_no_link_of_a_crowd_is_lost(spark):
    """Texts that each change two words of an earlier one: only the whole tree of links holds them together. Every similar pair under one value counts."""
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(100)]]
    while len(texts) < 300:
        texts.append(changed(rng, rng.choice(texts), 2))
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    prints = [S.fingerprint(S.shingles(t)[0]) for _, t in rows]
    keys = [set(k) for k in S.keys_of(np.array([b for b, _ in prints]), np.array([u for _, u in prints])).tolist()]
    sets, label = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if label[a] != label[b] and alike(sets[a], sets[b]) and not keys[a].isdisjoint(keys[b]):
            label = [label[a] if x == label[b] else x for x in label]
    found = S.groups(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()
    assert partition((r.doc_id, r.least) for r in found) == partition(enumerate(label))


def test_a_sketch_leaves_out_no_similar_pair():
    rng = np.random.default_rng(4)
    for n in (1, 5, 60, 900, 6000):
        a = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
        for m in (0, n // 10, n // 9, n // 4):
            b = np.concatenate([a[m:], rng.integers(0, 2**63, m // 8).astype(np.uint64)])
            alike = len(np.intersect1d(a, b)) * 100 >= len(np.union1d(a, b)) * S.SIMILARITY
            side = lambda label, h: (S._counts([S.sketch_of(h)]), (np.array([label]), np.array([len(h)])))
            (x, left), (y, right) = side(1, a), side(2, b)
            assert S._allowed(x, y, left, right)[1][0, 0] or not alike


def test_crossed_pairs_for_any_batch():
    """Under one value all pairs of different labels, whatever the batches and tiles are."""
    node, label = np.arange(40) * 3, np.arange(40) % 3
    sketch = S.sketch_of(np.arange(500, dtype=np.uint64) << np.uint64(54))
    key = np.repeat([7, 8, 9], [1, 38, 1])
    table = pa.table({"key": key, "label": label, "node": node, "size": np.full(40, 500), "sketch": pa.array([sketch] * 40)})
    wanted = {(node[i], node[j]) for i in range(1, 39) for j in range(i + 1, 39) if label[i] != label[j]}
    for size in (1, 7, 100):
        rows = [r for b in S._crossed(table.to_batches(max_chunksize=size), True) for r in b.to_pylist()]
        assert len(rows) == len(wanted) and {(r["a"], r["b"]) for r in rows} == wanted
        few = [r for b in S._crossed(table.to_batches(max_chunksize=size), False) for r in b.to_pylist()]
        assert sorted(r["a"] for r in few) == node[1:39].tolist() and all(r["b"] <= 6 for r in few)


def test_a_text_is_dealt_to_its_shared_values_only(spark):
    """Two texts that share one value by chance, a third of another size under it, and texts that share none."""
    rng = np.random.default_rng(9)
    bits = rng.integers(-(2**63), 2**63, (40, S.WORDS))
    # The last bits of a row belong to the last segment.
    low = np.unpackbits(bits.view(np.uint8), axis=1)
    low[1:3, -S.SEGMENT_BITS :] = low[0, -S.SEGMENT_BITS :]
    bits = np.packbits(low, axis=1).view(np.int64)
    unsure = np.tile(np.arange(S.UNSURE, dtype=np.uint8), (S.SEGMENTS, 1)).tobytes()
    rows = [(k, b, bytearray(unsure), 900 if k == 2 else 100 + k) for k, b in enumerate(bits.tolist())]
    texts = spark.createDataFrame(rows, "node long, bits array<long>, unsure binary, size long")
    assert len({(r.key, r.node) for r in S._shared(texts, S.MOST).collect()}) == 2 * 2**S.UNSURE
    assert {r.node for r in S._shared(texts, S.MOST).collect()} == {0, 1}


def test_texts_with_a_partner_of_similar_size_for_any_batch():
    rng = np.random.default_rng(10)
    rows = sorted({(int(k), int(s), int(n)) for k, s, n in zip(rng.integers(0, 60, 300), rng.integers(1, 400, 300), rng.integers(0, 10**6, 300))})
    wanted = {(k, n) for k, s, n in rows if any(k == j and n != m and min(s, z) * 100 >= max(s, z) * S.SIMILARITY for j, z, m in rows)}
    assert 0 < len(wanted) < len(rows)
    twice = [r for r in rows for _ in range(1 + r[2] % 2)]
    table = pa.table({c: [r[i] for r in twice] for i, c in enumerate(("key", "size", "node"))})
    for size in (1, 2, 7, 1000):
        found = [(r["key"], r["node"]) for b in S._sized(table.to_batches(max_chunksize=size)) for r in b.to_pylist()]
        assert len(found) == len(wanted) and set(found) == wanted
