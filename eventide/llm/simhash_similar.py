"""Near-duplicates of a stated similarity by long SimHash fingerprints and multi-index hashing.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. At 0.8 about 15 % of
a SimHash's bits differ, too many for a few segments with a fixed radius. So a fingerprint has 448 bits in sixteen segments
of 28, and the ball of a segment is taken where its bits are unsure: the three bits whose sums lie nearest to zero may flip,
on both sides of a pair, so each text is held under eight values of each segment. What meets under a value is
verified exactly, by the shingles themselves. A link that is found is
always true; a pair at 0.8 meets in at least one segment nine times in ten or more, a closer pair nearly always.

A value that many texts share loses no pair. At first a text meets the first ``most`` texts of its values, which tells the texts that share a
value with any other, and which value; tasks do the same within a chunk of texts before anything is shuffled. Most values are held by one text alone, and of
the others most are shared by chance, by texts whose sizes already rule out the similarity; both go before a text is dealt to its values. Texts that are left under a value then meet with a sketch, the counts of
their shingles in 128 bins: counts can't differ by more than the sets do, so a pair whose counts differ too much is not similar, and
no other pair is left out. In a first pass each text is verified against two partners alone, the smallest number and the closest that the sketch allows; what is linked gets one label.
In the second pass texts of one label need not meet again, and every pair of different labels that the sketch allows is verified. So each pair of texts
under one value is verified, known to differ, or known to belong to one component, and nobody leaves before that.

A document goes if a chain of links leads to one that stays. Of each component of links the document with the smallest id stays.

Defined cases: null, empty and blank texts have no word and count as copies of each other. A text of fewer words than a shingle is one
shingle. Texts with the same words (A-Z in lower case) are copies and enter the search once, told apart by 64 bits of hash. A null id stays only if
its component has no other; of rows equal in id and text one stays. Texts of any length are read whole, a slice of shingles
at a time. Empty tables give empty results. Columns other than ``doc_id`` and ``text`` pass through; ``__text_hash`` is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import safe_join, slices, written
from .components import components

SHINGLE = 5
#: Least Jaccard similarity of a link, in hundredths.
SIMILARITY = 80
SEED = 42
WORDS = 7
SEGMENTS = 16
SEGMENT_BITS = WORDS * 64 // SEGMENTS
UNSURE = 3
#: Bins of a sketch, and its greatest count: two bins make a byte.
BINS = 128
TOP = 15
#: Texts of a value that all others under it meet at first.
MOST = 2
CHUNK = 4096
#: Pairs of sketches that a task compares at a time.
PAIRS = 100_000


def shingles(text: str | None, span: int = SHINGLE) -> tuple[np.ndarray, int]:
    """The distinct hashes of the text's shingles, and a hash of all its words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    whole = xxhash.xxh64_intdigest(joined, SEED)
    if not words:
        return np.zeros(0, np.uint64), whole
    span = min(span, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist())
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), np.uint64, len(words) - span + 1)), whole


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Seven 64-bit numbers for each hash: the hash plus a multiple of an odd number, its bits spread by shifts and multiplication."""
    out = hashes[:, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out ^ (out >> np.uint64(31))


def fingerprint(hashes: np.ndarray, piece: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """The bits of a set of shingles as seven numbers, and for each segment its least sure bits."""
    sums = np.zeros(WORDS * 64, np.int64)
    for first in range(0, len(hashes), piece):
        mixed = _mixed(hashes[first : first + piece])
        sums += np.unpackbits(mixed.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    margins = 2 * sums - len(hashes)
    bits = np.packbits(margins > 0).view(np.int64)
    unsure = np.argsort(np.abs(margins).reshape(SEGMENTS, SEGMENT_BITS), axis=1, kind="stable")[:, :UNSURE]
    return bits, unsure.astype(np.uint8)


def sketch_of(hashes: np.ndarray) -> bytes:
    """How many hashes fall into each bin, ``TOP`` at most."""
    counts = np.minimum(np.bincount(hashes >> np.uint64(57), minlength=BINS), TOP).astype(np.uint8)
    return (counts[::2] | counts[1::2] << 4).tobytes()


def _counts(sketches: list[bytes]) -> np.ndarray:
    packed = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, BINS // 2)
    return np.concatenate([packed & TOP, packed >> 4], axis=1).astype(np.int16)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, bits, unsure, sizes, sketches = [], [], [], [], []
        for text in batch.column("text"):
            hashes, whole = shingles(text.as_py())
            b, u = fingerprint(hashes)
            nodes.append(whole)
            bits.append(b.tolist())
            unsure.append(u.tobytes())
            sizes.append(len(hashes))
            sketches.append(sketch_of(hashes))
        columns = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(bits, pa.list_(pa.int64())), pa.array(unsure, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *columns], names=["doc_id", "text_hash", "node", "bits", "unsure", "size", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices([batch], 200):
            hashes = [shingles(t.as_py())[0].view(np.int64) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(hashes, pa.list_(pa.int64()))], names=["node", "hashes"])


def keys_of(bits: np.ndarray, unsure: np.ndarray) -> np.ndarray:
    """For each row of fingerprints all keys: the segment's number before the value, in every state of its unsure bits."""
    n = len(bits)
    planes = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1).reshape(n, SEGMENTS, SEGMENT_BITS)
    keys = (planes @ (np.int64(1) << np.arange(SEGMENT_BITS))) + (np.arange(SEGMENTS, dtype=np.int64) << SEGMENT_BITS)
    keys = keys[:, :, None]
    for k in range(UNSURE):
        keys = np.concatenate([keys, keys ^ (np.int64(1) << unsure[:, :, k, None].astype(np.int64))], axis=2)
    return keys.reshape(n, -1)


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted keys: where each row's group starts, its rank there, and the size of its group."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    sizes = np.diff(np.append(first, len(keys)))
    start = first[group]
    return start, np.arange(len(keys)) - start, sizes[group]


def _met(keys, nodes, start, rank, most, rows):
    """The value of each of the rows, and its text with the first ``most`` before it in its group."""
    for r in range(most):
        at = rows[rank[rows] > r]
        if not len(at):
            return
        yield keys[at], nodes[at], nodes[start[at] + r]


REPORT = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("full", pa.bool_())])
PAIR = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _reports(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The first ``most`` texts of each value in a chunk; the others meet them here, and are marked by a pair with themselves."""
    for part in slices(batches, CHUNK):
        n = part.num_rows
        if not n:
            continue
        nodes = part.column("node").to_numpy()
        bits = part.column("bits").flatten().to_numpy().reshape(n, WORDS)
        unsure = np.frombuffer(b"".join(part.column("unsure").to_pylist()), np.uint8).reshape(n, SEGMENTS, UNSURE)
        keys = keys_of(bits, unsure)
        owner = np.repeat(nodes, keys.shape[1])
        keys = keys.ravel()
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        start, rank, size = _places(keys)
        held = rank < most
        blank = pa.nulls(int(held.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(keys[held]), pa.array(owner[held]), blank, pa.array(size[held] > most)], schema=REPORT)
        rest = np.flatnonzero(~held)
        if len(rest):
            marks = np.unique(owner[rest])
            key, a, b = (np.concatenate(c) for c in zip(*_met(keys, owner, start, rank, most, rest), (marks, marks, marks)))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b), pa.array(np.zeros(len(a), bool))], schema=REPORT)


def _stars(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """From reports sorted by value, the pairs that met under it. Of a value only the first ``most`` rows are kept from batch to batch."""
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    for batch in batches:
        known = batch.column("b").is_valid().to_numpy(zero_copy_only=False)
        if known.any():
            done = batch.filter(pa.array(known))
            yield done.select(PAIR.names).cast(PAIR)
            batch = batch.filter(pa.array(~known))
        if not batch.num_rows:
            continue
        old = len(kept[0])
        columns = (batch.column("key").to_numpy(), batch.column("a").to_numpy(), batch.column("full").to_numpy(zero_copy_only=False))
        keys, nodes, full = (np.concatenate(c) for c in zip(kept, columns))
        start, rank, size = _places(keys)
        rows = np.arange(old, len(keys))
        wide = np.flatnonzero((size > most) | full[start])
        found = [np.concatenate(c) for c in zip(*_met(keys, nodes, start, rank, most, rows), (keys[wide], nodes[wide], nodes[wide]))]
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], schema=PAIR)
        last = slice(start[-1], start[-1] + most)
        kept = (keys[last], nodes[last], full[last])


def _members(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """From reports sorted by value, the texts of each value that several texts share."""
    for batch in _stars(batches, most):
        key, a, b = (batch.column(c).to_numpy() for c in PAIR.names)
        # A pair with itself has no other text.
        real = a != b
        rows = np.unique(np.concatenate([np.column_stack([key[real], x[real]]) for x in (a, b)]), axis=0)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["key", "node"])


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts sorted by value, size and number, those with another text of their value whose size allows the similarity.

    The closest sizes are next to each other, so a row needs its neighbours only; the last one waits for the next batch.
    """
    kept, before = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node, size = (batch.column(c).to_numpy() for c in ("key", "node", "size"))
        if kept:
            key, node, size = (np.concatenate([[k], c]) for k, c in zip(kept, (key, node, size)))
        # A text may have come twice under its value.
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node, size = key[new], node[new], size[new]
        near = (key[1:] == key[:-1]) & (100 * size[:-1] >= SIMILARITY * size[1:])
        use = np.concatenate([[before], near])[:-1] | near
        kept, before = (key[-1], node[-1], size[-1]), bool(near[-1]) if len(near) else before
        if use.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][use]), pa.array(node[:-1][use])], names=["key", "node"])
    if kept and before:
        yield pa.RecordBatch.from_arrays([pa.array([kept[0]]), pa.array([kept[1]])], names=["key", "node"])


def _shared(texts: DataFrame, most: int) -> DataFrame:
    """Values and their texts (``key``, ``node``), where several texts share the value and their sizes allow the similarity."""
    reports = texts.mapInArrow(partial(_reports, most=most), "key long, a long, b long, full boolean")
    dealt = reports.repartition("key").sortWithinPartitions("key", F.desc("full"), "a")
    members = written(dealt.mapInArrow(partial(_members, most=most), "key long, node long"), "members")
    sized = members.join(texts.select("node", "size"), "node")
    return sized.repartition("key").sortWithinPartitions("key", "size", "node").mapInArrow(_sized, "key long, node long")


def _allowed(rows: np.ndarray, others: np.ndarray, left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Least differences of the sets of ``rows`` and ``others``, and whether labels differ and 0.8 is in reach."""
    if len(rows) * len(others) < BINS:
        apart = np.abs(rows[:, None] - others[None]).sum(axis=2, dtype=np.int32)
    else:
        apart = np.zeros((len(rows), len(others)), np.int32)
        for k in range(BINS):
            apart += np.abs(rows[:, k, None] - others[None, :, k])
    # A similarity of s leaves a difference of (1 - s) / (1 + s) of both sizes.
    reach = (100 + SIMILARITY) * apart <= (100 - SIMILARITY) * (left[1][:, None] + right[1][None, :])
    return apart, reach & (left[0][:, None] != right[0][None, :])


def _crossed(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """From texts sorted by value, pairs of one value with different labels that may be similar: all of them, or for each text ``a`` the smallest
    ``b`` and the closest ``c``. The texts of one value are held as ids and sketches."""

    def closed(held: list):
        table = pa.Table.from_batches(held)
        label, node, size = (table.column(c).to_numpy() for c in ("label", "node", "size"))
        if len(label) < 2 or (label == label[0]).all():
            return
        order = np.argsort(node)
        label, node, size = label[order], node[order], size[order]
        sketch = _counts(table.column("sketch").to_pylist())[order]
        step = max(1, PAIRS // len(node))
        for first in range(0, len(node), step):
            at = slice(first, first + step)
            # Pairs are symmetric: all of them are met by rows that follow.
            rest = slice(first, None) if every else slice(0, None)
            apart, reach = _allowed(sketch[at], sketch[rest], (label[at], size[at]), (label[rest], size[rest]))
            if every:
                i, j = np.nonzero(np.triu(reach, 1))
                found = (node[at][i], node[rest][j], node[rest][j])
            else:
                i = np.flatnonzero(reach.any(axis=1))
                nearest = np.where(reach[i], apart[i], np.iinfo(np.int32).max).argmin(axis=1)
                found = (node[at][i], node[reach[i].argmax(axis=1)], node[nearest])
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b", "c"])

    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(starts[1:], len(keys))
        # Most texts are alone under a value; the first and the last may go on in other batches.
        some = ends - starts > 1
        some[[0, -1]] = True
        for at, end in zip(starts[some].tolist(), ends[some].tolist()):
            if held and keys[at] != key:
                if len(held) > 1 or held[0].num_rows > 1:
                    yield from closed(held)
                held = []
            key = keys[at]
            held.append(batch.slice(at, end - at))
    if held:
        yield from closed(held)


def _crossing(shared: DataFrame, texts: DataFrame, every: bool) -> DataFrame:
    """Pairs of texts that meet in ``shared``, differ in ``label`` and may be similar: all, or two of each text at most."""
    rows = shared.join(texts, "node").select("key", "label", "node", "size", "sketch")
    dealt = rows.repartition("key").sortWithinPartitions("key")
    pairs = dealt.mapInArrow(partial(_crossed, every=every), "a long, b long, c long")
    if not every:
        pairs = pairs.groupBy("a").agg(F.min("b").alias("b"), F.mode("c", True).alias("c"))
        pairs = pairs.select("a", F.explode(F.array("b", "c")).alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose sets of shingles are similar."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # Written, so that its size is known: while it is small, it is sent to the texts, and they stay where they are.
    rows = written(asked.join(texts.select("node", "first.*"), "node"), "asked")
    sources = safe_join(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), rows, ["doc_id", "text_hash"], "inner")
    sets = sources.select("node", "text").mapInArrow(_sets, "node long, hashes array<long>")
    sets = written(sets.groupBy("node").agg(F.first("hashes").alias("hashes")), "shingle-sets")
    side = lambda name: sets.select(F.col("node").alias(name), F.col("hashes").alias(f"set_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - shared
    return both.where(shared * 100 >= either * SIMILARITY).select("a", "b")


def groups(docs: DataFrame, most: int = MOST) -> DataFrame:
    """For every row of ``docs`` its ``doc_id``, ``text_hash``, and ``least``, which all rows of a group share."""
    marked = written(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        _marked, "doc_id long, text_hash long, node long, bits array<long>, unsure binary, size long, sketch binary"), "marked")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = F.min_by(F.struct("doc_id", "text_hash"), order).alias("first")
    texts = written(marked.groupBy("node").agg(first, F.first("bits").alias("bits"), *[F.first(c).alias(c) for c in ("unsure", "size", "sketch")]), "texts")
    shared = written(_shared(texts, most), "shared")
    sketched = texts.select("node", "size", "sketch")
    few = written(_crossing(shared, sketched.withColumn("label", F.col("node")), False), "few")
    members = components(written(_verified(few, texts, docs), "similar")).select("node", "least")
    named = sketched.join(members, "node", "left").withColumn("label", F.coalesce("least", "node")).drop("least")
    rest = written(_crossing(shared, named, True), "rest")
    if not rest.isEmpty():
        links = members.select(F.col("node").alias("a"), F.col("least").alias("b")).union(_verified(rest, texts, docs))
        members = components(links).select("node", "least")
    named = marked.select("doc_id", "text_hash", "node").join(members, "node", "left")
    return named.select("doc_id", "text_hash", F.coalesce("least", "node").alias("least"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays, as one row."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = groups(docs).groupBy("least").agg(F.min_by(F.struct("doc_id", "text_hash"), order).alias("first"))
    kept = written(first.select("first.doc_id", F.col("first.text_hash").alias("__text_hash")), "kept")
    rows = safe_join(docs.withColumn("__text_hash", F.xxhash64("text")), kept, ["doc_id", "__text_hash"], "left_semi")
    return rows.dropDuplicates(["doc_id", "__text_hash"]).select(*docs.columns)
