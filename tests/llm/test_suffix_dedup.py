"""Removal of repeated passages against a dictionary of all strings; the suffix sorter against plain sorting."""

import hashlib
import random

import numpy as np
import pytest

from eventide.llm import suffix_dedup
from eventide.llm.suffix_groups import suffix_order


def expected(rows, width=100):
    """Judge every string by the first place it occurs at; rows in the order of ids."""
    seen, out = {}, {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    for k in order:
        doc, text = rows[k]
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - width + 1):
            piece = raw[s : s + width]
            if seen.setdefault(piece, (doc, s)) != (doc, s):
                gone[s : s + width] = b"\1" * width
        left = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = (doc, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return sorted(out.values(), key=repr)


def result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted([tuple(r) for r in suffix_dedup.deduplicated(df).collect()], key=repr)


@pytest.mark.parametrize("seed", range(40))
def test_suffix_order(seed):
    draw = random.Random(seed)
    texts = [[draw.choice(range(1, 2 + seed % 4)) for _ in range(draw.randint(0, 60))] + [0] for _ in range(9)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    order = suffix_order(np.array(sum(texts, [])), offsets)
    for k, text in enumerate(texts):
        own = order[offsets[k] : offsets[k + 1]] - offsets[k]
        assert own.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def _prose(draw, n):
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(1, 9))) for _ in range(n))


def test_repeats(spark):
    draw = random.Random(3)
    passage, other = _prose(draw, 60), _prose(draw, 25)
    rows = [(k, _prose(draw, draw.randint(0, 80))) for k in range(30)]
    rows += [(100 + k, _prose(draw, 10) + passage + _prose(draw, 12)) for k in range(12)]
    rows += [(200 + k, passage[k * 7 :] + other + other[: k * 11]) for k in range(12)]
    near = passage.split()
    for k in range(20):
        edited = list(near)
        edited[draw.randrange(len(edited))] = "x" * draw.randint(1, 5)
        rows.append((300 + k, " ".join(edited)))
    rows += [(400, "ab" * 400), (401, "a" * 999), (402, "b" + "ab" * 90), (403, "abcdefg" * 60 + "é" * 200), (404, "line of text\n" * 40)]
    draw.shuffle(rows)
    assert result(spark, rows) == expected(rows)


def test_odd_rows(spark):
    draw = random.Random(4)
    text = _prose(draw, 50)
    rows = [(None, text), (5, text), (1, None), (2, ""), (3, text[:99]), (4, text[:100]), (6, text), (6, text), (7, "a" * 120), (7, "a" * 120)]
    got = result(spark, rows)
    assert got == expected(rows)
    # Rows of one id with different texts: the repeat stays in one of them.
    two = result(spark, [(1, text + "left"), (1, text + "right")])
    assert sorted(r[2] > 0 for r in two) == [False, True]


def test_empty_and_extra_columns(spark):
    assert result(spark, []) == []
    df = spark.createDataFrame([(1, "x" * 150, 7, 9)], "doc_id long, text string, key int, place int")
    assert [r.n_removed for r in suffix_dedup.deduplicated(df).collect()] == [149]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert result(spark, rows) == expected(rows)
