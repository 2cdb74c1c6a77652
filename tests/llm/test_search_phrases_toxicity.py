"""Lexical search, phrase mining and weak supervision against plain versions."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventide.llm import catalog, collocations, lexical_search, phrase_trie, weak_toxicity
from eventide.llm.byte_words import coded_words, text_slices

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (4, "One"), (None, "no id here"), (5, "same words here\nsame words here\n\nsame words here"), (6, "x " * 3000), (7, "É é ü Ü\x0bA.b;c"), (8, "A" * 50_000)]


def ranked(docs, items, top=10):
    """Scores of all documents for all items, as the rule has them."""
    own = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, size = sum(bool(w) for _, w in own), sum(len(w) for _, w in own)
    df = Counter(w for _, words in own for w in set(words))
    wanted = defaultdict(Counter)
    for item, text in items:
        wanted[item].update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, words in own:
            tf, m = Counter(words), 100 - 75 + (75 * len(words) * n_docs) // max(size, 1)
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, n in terms.items() if tf[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


def made_text(rng, words, size):
    return " ".join(words[min(int(rng.exponential(len(words) / 6)), len(words) - 1)] for _ in range(size))


def test_search_on_odd_rows(spark, tables):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(300)]
    docs = [*ODD, *[(100 + k, made_text(rng, words, int(rng.integers(1, 120)))) for k in range(400)]]
    docs += [(k + 1000, t) for k, t in docs[50:90]]
    items = [(1, "w1 W2 w250, w3 w3"), (2, "absent"), (3, None), (None, "one É w299"), (4, "x a"), (4, "w7"), (5, made_text(rng, words, 80))]
    folder = tables.documents("search-odd", docs, benchmark=items)
    mine = sorted([tuple(r) for r in catalog.QUERIES["op12_lexical_search"](spark, folder).select("item_id", "rank", "doc_id", "score").collect()], key=repr)
    assert mine == ranked(docs, items)


def test_search_reads_only_its_columns(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "x", 5)], "doc_id int, text string, term string, shard long")
    items = spark.createDataFrame([("q", "beta", 1.0)], "item_id string, text string, score double")
    index = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lexical_search._shards, lexical_search.INDEX_SCHEMA)
    assert [tuple(r)[:3] for r in lexical_search.search(index, items).collect()] == [("q", 1, 1)]


@pytest.mark.parametrize("block,span", [(4, 16), (128, 1024), (3, 7)])
def test_block_max_equals_full_scores(monkeypatch, block, span):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "RANGE", span)
    rng = np.random.default_rng(block)
    words = [f"w{k}" for k in range(60)]
    texts = [made_text(rng, words, int(rng.integers(0, 60))) for _ in range(500)]
    batch = lexical_search.inverted("s", pa.array(range(500)), [coded_words(pa.array(texts), lexical_search.RULE)], [500])
    rows = {r["term"]: r for r in batch.to_pylist()}
    ids, _, n = np.frombuffer(rows[None]["data"], "<i8").reshape(3, -1)
    total = int(n.sum())
    shrink = lambda x: 25 + (75 * x * 500) // total
    unpacked_blocks = []
    plain = lexical_search.PostingsList.postings
    monkeypatch.setattr(lexical_search.PostingsList, "postings", lambda self, b: unpacked_blocks.append(len(b)) or plain(self, b))
    for q in range(20):
        terms = rng.choice(60, 12, replace=False)
        lists = [(int(rng.integers(0, 3000)), lexical_search.PostingsList(*[rows[f"w{t}"][c] for c in ("first", "most_tf", "least_n", "place", "data")], shrink)) for t in terms if f"w{t}" in rows]
        best, scores = lexical_search.block_max_max_score(lists, shrink(n), ids)
        full = np.zeros(500, np.int64)
        for w, p in lists:
            doc, tf = plain(p, np.arange(len(p.first)))
            full[doc] += w * lexical_search.impact(tf, shrink(n)[doc])
        order = [k for k in np.lexsort([ids, -full])[:10] if full[k] > 0]
        assert scores.tolist() == full[order].tolist() and ids[best].tolist() == ids[order].tolist()
    # A rare heavy term sets the floor; of the light frequent ones only blocks with a document of the rare one are read.
    rare = min((t for t in rows if t), key=lambda t: rows[t]["df"] if rows[t]["df"] > 15 else 10**6)
    lists = [(w, lexical_search.PostingsList(*[rows[t][c] for c in ("first", "most_tf", "least_n", "place", "data")], shrink)) for w, t in ((3000, rare), (1, "w0"), (1, "w1"))]
    unpacked_blocks.clear()
    lexical_search.block_max_max_score(lists, shrink(n), ids)
    assert block != 4 or sum(unpacked_blocks) < 0.75 * sum(len(p.first) for _, p in lists)


def phrases(docs, least, top, longest=5):
    """Ranks and scores as the rule has them."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        likely = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        rows = []
        for p, a in likely.items():
            if any(100 * b >= 100 * a for q, b in likely.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, _, left, right = min(((1000 * a * totals[lang]) // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, n, p.decode(), -a, left, right, totals[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("trie_phrases,coded_words_most", [(500_000, 500_000), (7, 9)])
def test_phrases(spark, trie_phrases, coded_words_most):
    rng = np.random.default_rng(2)
    words = [f"v{k}" for k in range(25)] + ["É", "x\x0ey"]
    docs = [("en", None), (None, "solo words. solo words; solo words"), ("und", "Solo WORDS! solo\twords"), ("fr", ""), ("en", "a" * 30_000)]
    docs += [(str(rng.choice(["en", "fr"])), ". ".join(made_text(rng, words, int(rng.integers(1, 40))) for _ in range(3))) for _ in range(120)]
    docs += [("en", "all of these five words together")] * 6
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "lang string, text string, word string, a long").repartition(3)
    mine = sorted(tuple(r) for r in collocations.collocations(df, least=5, top=40, trie_phrases=trie_phrases, coded_words=coded_words_most).collect())
    assert mine == phrases(docs, 5, 40) and len(mine) > 40


def test_an_early_report_loses_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 12, 5000).astype(np.int32)
    trie = phrase_trie.PhraseTrie(np.arange(1, 12)[:, None], np.arange(1, 12))
    seen = {}
    for kept in (20, 10**6):
        monkeypatch.setattr(collocations, "KEPT_KEYS", kept)
        monkeypatch.setattr(collocations, "STEP_TOKENS", 100)
        shared = type("S", (), {"value": trie})()
        lists = [tokens[k : k + 50].tolist() + [0] for k in range(0, 5000, 50)]
        batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32()))], names=["codes"])
        total = Counter()
        for out in collocations._proposer(shared, True)(iter([batch])):
            for r in out.to_pylist():
                total[r["prefix"], r["code"]] += r["a"]
        seen[kept] = total
    expected = Counter((a, b) for row in lists for a, b in zip(row, row[1:]) if a and b)
    assert seen[20] == seen[10**6] == expected


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_trie_accepts_exactly_its_phrases(k):
    rng = np.random.default_rng(k)
    own = np.unique(rng.integers(1, 9 if k > 1 else 60, (400, k)) * 7, axis=0)
    trie = phrase_trie.PhraseTrie(own, np.arange(len(own)) + 1000)
    tokens = (rng.integers(0, 10, 20_000) * 7).astype(np.int32)
    at, states = trie.ends(tokens)
    place = {tuple(p): n + 1000 for n, p in enumerate(own.tolist())}
    expected = [(i, place[tuple(tokens[i : i + k])]) for i in range(len(tokens) - k + 1) if tuple(tokens[i : i + k]) in place]
    assert list(zip(at.tolist(), trie.accepted[states].tolist())) == expected


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array([None, "a" * 50, "", "b" * 500, *["c"] * 30])], names=["text"])
    parts = list(text_slices([batch], most=100))
    assert sum(p.num_rows for p in parts) == batch.num_rows and max(sum(len(t or "") for t in p.column("text").to_pylist()) for p in parts) == 500


def drawn_votes(rng, n):
    """Votes of five voters with known accuracies; the last copies the one before it four times out of five."""
    y = rng.random(n) < 0.2
    fire = np.array([[0.02, 0.7], [0.05, 0.6], [0.01, 0.5], [0.1, 0.8]])
    cols = [rng.random(n) < np.where(y, b, a) for a, b in fire]
    copy = np.where(rng.random(n) < 0.8, cols[3], rng.random(n) < 0.1)
    return y, np.column_stack([*cols, copy]).astype(np.int64), fire


def test_label_model_finds_accuracies_and_correlations():
    y, fired, fire = drawn_votes(np.random.default_rng(4), 60_000)
    patterns, back, n = np.unique(fired, axis=0, return_inverse=True, return_counts=True)
    model = weak_toxicity.fit_votes(patterns, np.full(len(n), 2), n.astype(float))
    assert abs(model.prior - 0.2) < 0.02
    assert model.parent[4] == 3 or model.parent[3] == 4
    p = model.posterior(patterns, np.full(len(n), 2))[back.ravel()]
    assert abs(p[y].sum() / y.sum() - 1) < 0.25 and ((p > 0.5) == y).mean() > 0.95
    # The plain sum over both classes of the model's probabilities of all patterns is one.
    every = weak_toxicity.unpack(np.arange(32), 5)
    assert abs(np.exp(model.joint(every, np.full(32, 2))).sum() - 1) < 1e-9


def test_linear_model_is_the_minimum(spark):
    rng = np.random.default_rng(5)
    rows = [([int(w) for w in np.flatnonzero(rng.random(6) < 0.4)], float(rng.random() * 0.05), float(rng.random() < 0.5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "words array<int>, share double, p double")
    w = weak_toxicity.fit_linear(df, 6)
    x = np.array([[*(k in r[0] for k in range(6)), np.log1p(200 * r[1]), 1] for r in rows], float)
    p = 1 / (1 + np.exp(-x @ w))
    gradient = x.T @ (p - [r[2] for r in rows]) / 300 + weak_toxicity.RIDGE * np.append(w[:-1], 0)
    assert np.abs(gradient).max() < 2e-3


def test_toxicity_of_planted_documents(spark, tables):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "re") for b in ("na", "ke", "so", "vu", "pi")]
    docs, labels = [*ODD], [(None, 1, 1), (1, 1, None), (4, 1, 0), (4, 1, 0)]
    for k in range(600):
        bad = k % 6 == 0
        text = made_text(rng, words, int(rng.integers(20, 80)))
        if bad:
            text += " you are a stupid loser, " + " ".join(rng.choice(["clown", "scum", "worthless", "lonavu"], 3))
        docs.append((1000 + k, text))
        if k % 2:
            labels.append((1000 + k, 1, int(bad)))
        elif bad and k % 4 == 0:
            labels.append((1000 + k, 1, 1))
    folder = tables.documents("toxic", docs, labels=labels)
    out = catalog.QUERIES["op13_weak_toxicity"](spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((d[0] is None, d[0] or 0) for d in docs)
    by_id = {r.doc_id: r for r in out}
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    held = [(r.predicted, (r.doc_id - 1000) % 6 == 0) for r in out if r.held_out and r.doc_id >= 1000]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert by_id[2].predicted == 0


def test_toxicity_without_votes(spark, tables):
    folder = tables.documents("mild", [(k, "calm words") for k in range(9)], labels=[(k, 1, 0) for k in range(5)])
    assert {(r.score, r.predicted) for r in catalog.QUERIES["op13_weak_toxicity"](spark, folder).collect()} == {(0.0, 0)}


def test_toxicity_of_supplied_documents(spark):
    folder = "/root/testdata/sf0.1"
    own = catalog.QUERIES["op13_weak_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((own.predicted == 1) & (own.toxic == 1)).sum() / (own.toxic == 1).sum() > 0.75
    assert ((own.predicted == 1) & (own.toxic == 0)).sum() / (own.toxic == 0).sum() < 0.02
