"""The language model's tables against the tree in memory, and contexts that are a small share of a corpus."""

import zlib

import numpy as np
import pytest

from eventide.llm import catalog, common, suffix_tree_lm

HELD = [k for k in range(100_000, 100_100) if zlib.crc32(str(k).encode()) % 7 == 2]


def plain_scores(rows, least, gamma):
    """log10 of each row's text by the tree in memory, in which every word of the training rows is common."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    texts = [[*(t or "").split(), " "] for _, t in rows]
    number = {}
    for t, h in zip(texts, held):
        if not h:
            for w in t:
                number.setdefault(w, len(number))
    ids = [np.array([number.get(w, -1) for w in t]) for t in texts]
    train = np.concatenate([x for x, h in zip(ids, held) if not h])
    first = np.concatenate([np.arange(len(x)) == 0 for x, h in zip(ids, held) if not h])
    common = np.bincount(train)
    size = len(train) + len(common) + 1.0
    tree = suffix_tree_lm.SuffixTree(np.log10((common + 1) / size), common, len(train))
    tree.first_candidates(least / len(train))
    for k in range(3):
        context = tree.contexts(train, first)[-1]
        pairs, n = np.unique(context[context >= 0] * tree.width + train[context >= 0], return_counts=True)
        tree.learn(pairs, n, gamma)
        if k < 2:
            tree.next_candidates(pairs, n, least / len(train))
    assert all(level["kept"].any() for level in tree.levels)
    return [tree.score(x, np.arange(len(x)) == 0).sum() - (x < 0).sum() * np.log10(size) for x in ids]


@pytest.mark.parametrize("hot", [0.0, 5e-3, 1.0])
def test_tables_equal_the_tree(spark, hot):
    draw = np.random.default_rng(3)
    rows = []
    for d in [None, *range(200), *HELD[:4]]:
        x = draw.integers(0, 12, 120)
        x[2::4] = (x[1::4] + 1) % 12
        x[3::4] = (x[2::4] * 2 + x[1::4]) % 12
        x[4::8] = (x[3::8][: len(x[4::8])] + x[1::8][: len(x[4::8])] * 5) % 12
        rows.append((d, " ".join(f"w{v}" for v in x) + (" unknown w1" if d in HELD else "")))
    rows += [(300, None), (301, ""), rows[5]]
    got = suffix_tree_lm.scored(spark.createDataFrame(rows, "doc_id long, text string"), least=5, gamma=1e-2, hot=hot).collect()
    want = sorted(zip([(d is not None, d or 0) for d, _ in rows], plain_scores(rows, 5, 1e-2)))
    assert [r for _, r in want] == pytest.approx([r.score for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.score))])


def test_a_context_that_is_a_small_share_is_learned(spark, tables):
    draw = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{v}" for v in draw.integers(0, 2000, 1000))) for k in range(100)]
    rows += [(1000 + k, "alpha beta gamma delta") for k in range(32)] + [(HELD[0], "alpha beta gamma delta")]
    got = catalog.QUERIES["op10_suffix_tree_lm"](spark, tables.documents("share", rows)).where(f"doc_id = {HELD[0]}").first()
    assert got["score"] > got["base_score"] + 8


def _sentences(texts, seed):
    """Texts of frequent, seldom and single words with something to learn."""
    draw = np.random.default_rng(seed)
    rows = []
    for d in range(texts):
        x = np.minimum(draw.zipf(1.3, 200), 3000)
        x[2::4] = (x[1::4] + 1) % 40
        x[3::4] = (x[2::4] * 2 + x[1::4]) % 40
        x[4::8] = (x[3::8][: len(x[4::8])] + x[1::8][: len(x[4::8])] * 5) % 40
        rows.append((d, " ".join(f"W{v}" for v in x) + f"\tonce{d}"))
    return rows + [(HELD[0], "unknown w1 w2 w4 w5 W1 w2"), (None, None)]


@pytest.mark.parametrize("hot", [1.0, 2e-2])
def test_shards_equal_the_tree(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_tree_lm, "SHARD_BYTES", 1 << 15)
    monkeypatch.setattr(suffix_tree_lm, "COMMON", 50)
    rows = _sentences(300, 7)
    got = suffix_tree_lm.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least=5, gamma=1e-2, hot=hot).collect()
    want = plain_scores([(d, t and t.lower()) for d, t in rows], 5, 1e-2)
    got = {r.doc_id: r for r in got}
    assert want == pytest.approx([got[d].score for d, _ in rows])
    assert got[None].n_tokens == 1 and got[HELD[0]].n_known == 7


def test_what_is_written_is_a_small_part_of_the_text(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "scratch_folder", lambda spark: str(tmp_path))
    rows = _sentences(1500, 8)
    suffix_tree_lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert 0 < size < 0.2 * sum(len(t or "") for _, t in rows)


def test_no_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_tree_lm.scored(empty).collect() == []
