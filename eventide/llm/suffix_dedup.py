"""Removal of repeated passages: every byte covered by a string of ``WIDTH`` bytes that also starts earlier goes.

A suffix array over the whole corpus would move each byte many times. Here a cheap pass finds which strings can repeat at
all, and the suffix arrays of :mod:`suffix_groups` sort only texts that differ around something they share:

1. *Anchors.* Among the short substrings of a string of ``WIDTH`` bytes the one with the smallest hash is its anchor. Equal
   strings have equal anchors, so consecutive strings with one anchor form a *segment*, and segments meet by the anchor's hash. A row per
   segment (some 30 bytes of text) is shuffled, with a hash of its bytes instead of the bytes.
2. *Copies.* Segments with equal bytes are one class. All but the first occurrence of a class are removed; a task that has seen the
   bytes before says so at once, so a group of any number of copies sends one row per class and task.
3. *Suffix arrays.* Where classes of different bytes share an anchor, the first occurrence of each sends its bytes. Each such
   group is one text for the suffix sorter. Neighbours in the suffix array that agree in ``WIDTH`` bytes are one string; all its places but
   the first are removed.
4. The places go to their documents, which are cut and hashed.

Strings are judged on the input, so all steps are independent of the order of removal. A segment is at most two widths long, however long or
periodic the text is. What one task sorts at a time is bounded by the distinct segments that share one anchor.

Defined cases: a null text is empty; a text shorter than ``WIDTH`` loses nothing. A null id counts as smaller than all others. Rows with
one id and different texts are ordered by a hash of the text; equal rows have the same place, and so do not remove each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import slices, table, written
from .suffix_groups import FIRST, MARK, repeats, suffix_order

WIDTH = 100
ANCHOR = 36
#: Starts that share an anchor: every string holds this many anchors' places.
SPAN = WIDTH - ANCHOR + 1
#: Bytes of text scanned together, and bytes of segments sorted together.
SCAN_BYTES = 2 << 20
SORT_BYTES = 1 << 20
NO_ID = -(1 << 63)
#: A place in one number: 24 bits of the text's hash, 31 bits of the start, 1 bit for periodic bytes, 7 bits for the further starts.
TEXT_BITS, PERIODIC = 24, 128
START_SHIFT = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``ANCHOR`` bytes at each place, by doubling polynomial hashes of shorter strings."""
    base = [pow(_BASE, 1 << k, 1 << 64) for k in range(6)]
    table_ = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX
    table_ ^= table_ >> np.uint64(29)
    power = {0: table_[data]}
    for k in range(5):
        h, step = power[k], 1 << k
        power[k + 1] = h[:-step] * np.uint64(base[k]) + h[step:] if len(h) > step else h[:0]
    out, size = None, 0
    for k in range(5, -1, -1):
        while size + (1 << k) <= ANCHOR:
            h = power[k][size:]
            out = h.copy() if out is None else out[: len(h)] * np.uint64(base[k]) + h[: len(out)]
            size += 1 << k
    out ^= out >> np.uint64(31)
    out *= _MIX
    return out ^ (out >> np.uint64(32))


def _least_in(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each ``span`` consecutive values, from minima that run up and down blocks of this length."""
    pad = -len(values) % span
    blocks = np.concatenate([values, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, span)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(values) - span + 1
    return np.minimum(down[:m], up[span - 1 : span - 1 + m])


def _periodic(data: np.ndarray) -> np.ndarray:
    """Running number of stretches of 32 bytes that equal the bytes at most ``SPAN`` places on."""
    n = len(data) // 32
    found = np.zeros(n + 1, bool)
    for d in range(1, SPAN + 1):
        same = data[:-d] == data[d:]
        k = len(same) // 32
        found[:k] |= same[: k * 32].reshape(-1, 32).all(axis=1)
    return np.concatenate([[0], np.cumsum(found)])


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """All segments: text number, first start, further starts, anchor hash, hash of the bytes, periodic or not."""
    import xxhash

    whole = b"".join(texts)
    data = np.frombuffer(whole, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.cumsum(sizes) - sizes
    empty = np.zeros(0, np.int64)
    if len(data) < WIDTH:
        return empty, empty, empty, empty, empty, empty.astype(bool)
    least = _least_in(_anchor_hashes(data), SPAN)
    # A string must not reach over the end of its text.
    starts = np.arange(len(least))
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    inside = starts + WIDTH <= (offsets + sizes)[owner]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    run = np.maximum.accumulate(np.where(new, starts, 0))
    new |= (starts - run) % SPAN == 0
    heads = np.flatnonzero(new & inside)
    # The strings of a text that stay inside it come first, so a segment ends before the next head or where its text ends.
    all_heads = np.append(np.flatnonzero(new), len(least))
    ends = np.minimum(all_heads[np.searchsorted(all_heads, heads, side="right")], (offsets + sizes)[owner[heads]] - WIDTH + 1)
    digest = xxhash.xxh3_64_intdigest
    own = np.array([digest(whole[a : b + WIDTH - 1]) for a, b in zip(heads.tolist(), ends.tolist())], np.uint64).view(np.int64)
    marks = _periodic(data)
    periodic = marks[np.minimum((ends + WIDTH - 1) // 32 + 1, len(marks) - 1)] > marks[heads // 32]
    return owner[heads], heads - offsets[owner[heads]], ends - heads - 1, least[heads].view(np.int64), own, periodic


def _text_code() -> Column:
    return F.shiftrightunsigned(F.xxhash64("text"), 64 - TEXT_BITS)


def _place(code: np.ndarray, start: np.ndarray, further: np.ndarray, periodic) -> np.ndarray:
    return (code << 39) | (start << START_SHIFT) | np.where(periodic, PERIODIC, 0) | further


def _start(place: np.ndarray) -> np.ndarray:
    return (place >> START_SHIFT) & ((1 << 31) - 1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts with ids and codes, about ``SCAN_BYTES`` at a time."""
    texts, ids, codes, size = [], [], [], 0
    for batch in slices(batches):
        keys = batch.column("key").to_pylist()
        for text, key, code in zip(batch.column("text").to_pylist(), keys, batch.column("code").to_pylist()):
            texts.append((text or "").encode("utf-8", "surrogatepass"))
            ids.append(key)
            codes.append(code)
            size += len(texts[-1])
            if size >= SCAN_BYTES:
                yield texts, np.array(ids, np.int64), np.array(codes, np.int64)
                texts, ids, codes, size = [], [], [], 0
    if texts:
        yield texts, np.array(ids, np.int64), np.array(codes, np.int64)


def _long(values: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(values.astype(np.int64), pa.int64(), mask=null)


ANCHOR_SCHEMA = "anchor long, bytes_hash long, key long, place long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per class of the chunk with its first place; later places go on without class, as removed."""
    for texts, ids, codes in _chunks(batches):
        text, start, further, anchor, own, periodic = segments(texts)
        key, place = ids[text], _place(codes[text], start, further, periodic)
        by = np.lexsort((place, key, own, anchor))
        key, place, anchor, own = key[by], place[by], anchor[by], own[by]
        later = np.zeros(len(by), bool)
        later[1:] = (anchor[1:] == anchor[:-1]) & (own[1:] == own[:-1]) & ((key[1:] != key[:-1]) | (place[1:] != place[:-1]))
        same_row = np.zeros(len(by), bool)
        same_row[1:] = (anchor[1:] == anchor[:-1]) & (own[1:] == own[:-1]) & ~later[1:]
        later = later & ~same_row
        # A place that repeats the one before it is the same row given twice.
        if same_row.any():
            keep = ~same_row
            key, place, anchor, own, later = key[keep], place[keep], anchor[keep], own[keep], later[keep]
        # Removed places spread over the partitions by place, not by anchor.
        yield pa.RecordBatch.from_arrays([_long(np.where(later, key * 31 + place, anchor)), _long(own, later), _long(key), _long(place)], names=["anchor", "bytes_hash", "key", "place"])


def _whole_groups(batches: Iterator[pa.RecordBatch], by: str, enough: int = 1, size_of=len) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``by``, never split between two tables of at least ``enough``."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(by).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        cut = int(cuts[-1]) if len(cuts) else 0
        if held and values[0] != held[-1].column(by)[-1].as_py() and size >= enough:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        if cut and size + size_of(batch.slice(0, cut)) >= enough:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, size = [batch.slice(cut)], size_of(batch.slice(cut))
        else:
            held.append(batch)
            size += size_of(batch)
    if held:
        yield pa.Table.from_batches(held)


PLACE_SCHEMA = "key long, place long, anchor long"


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed places (no anchor), and first places of classes whose bytes have to be compared (with anchor)."""
    for rows in _whole_groups(batches, "anchor"):
        own_column = rows.column("bytes_hash")
        done = own_column.is_null().to_numpy()
        anchor, key, place = (rows.column(c).to_numpy() for c in ("anchor", "key", "place"))
        own = own_column.fill_null(0).to_numpy()
        passed = [key[done], place[done]]
        anchor, own, key, place = anchor[~done], own[~done], key[~done], place[~done]
        by = np.lexsort((place, key, own, anchor))
        anchor, own, key, place = anchor[by], own[by], key[by], place[by]
        new_anchor = np.ones(len(by), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_class = new_anchor.copy()
        new_class[1:] |= own[1:] != own[:-1]
        same_row = np.zeros(len(by), bool)
        same_row[1:] = ~new_class[1:] & (key[1:] == key[:-1]) & (place[1:] == place[:-1])
        group = np.cumsum(new_anchor) - 1
        classes = np.bincount(group[new_class], minlength=1)
        # A place with the bytes of the first place of its class, which may be the same row given twice, only counts once.
        first_of = np.maximum.accumulate(np.where(new_class, np.arange(len(by)), 0))
        twice = (key == key[first_of]) & (place == place[first_of]) & ~new_class if len(by) else same_row
        removed = ~new_class & ~twice
        compare = new_class & ((classes[group] > 1) | ((place & PERIODIC) > 0)) if len(by) else new_class
        out_key = np.concatenate([passed[0], key[removed], key[compare]])
        out_place = np.concatenate([passed[1], place[removed], place[compare]])
        out_anchor = np.concatenate([np.zeros(len(passed[0]) + int(removed.sum()), np.int64), anchor[compare]])
        null = np.arange(len(out_key)) < len(passed[0]) + int(removed.sum())
        yield pa.RecordBatch.from_arrays([_long(out_key), _long(out_place), _long(out_anchor, null)], names=["key", "place", "anchor"])


SEGMENT_SCHEMA = "anchor long, key long, place long, bytes binary"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the places that are asked of each document."""
    for batch in slices(batches, 500):
        asked = batch.column("asked")
        sizes = np.diff(asked.offsets.to_numpy())
        flat = asked.flatten()  # of the slice alone
        place, anchor = flat.field("place").to_numpy(), flat.field("anchor").to_numpy()
        key = np.repeat(batch.column("key").to_numpy(zero_copy_only=False), sizes)
        start = _start(place)
        stop = start + (place & (PERIODIC - 1)) + WIDTH
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        owner = np.repeat(np.arange(len(texts)), sizes).tolist()
        cut = [texts[o][a:b] for o, a, b in zip(owner, start.tolist(), stop.tolist())]
        yield pa.RecordBatch.from_arrays([_long(anchor), _long(key), _long(place), pa.array(cut, pa.binary())], names=["anchor", "key", "place", "bytes"])


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places whose strings start earlier too, found in the suffix arrays of the groups."""
    for rows in _whole_groups(batches, "anchor", SORT_BYTES, lambda b: b.column("bytes").nbytes):
        anchor, key, place = (rows.column(c).to_numpy() for c in ("anchor", "key", "place"))
        pieces = rows.column("bytes").to_pylist()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        last = np.ones(len(anchor), bool)
        last[:-1] = anchor[1:] != anchor[:-1]
        # Each piece is followed by a mark, and each group, after the mark of its last piece, by the end.
        gaps = 1 + last.astype(np.int64)
        begin = np.cumsum(sizes + gaps) - sizes - gaps
        total = int((sizes + gaps).sum())
        raw = np.zeros(total, np.uint8)
        where = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        raw[where] = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = np.full(total, MARK, np.int64)
        symbols[where] = raw[where].astype(np.int64) + FIRST
        ends = (begin + sizes + gaps)[last]
        symbols[ends - 1] = 0
        order = suffix_order(symbols, np.concatenate([[0], ends]))
        piece = np.repeat(np.arange(len(pieces)), sizes + gaps)
        within = np.arange(total) - begin[piece]
        valid = within <= (sizes - WIDTH)[piece]
        equal = repeats(raw, order, valid, WIDTH)
        string = np.cumsum(~equal)
        # The strings that have a neighbour: those that repeat, and the one at the head of each run.
        use = equal.copy()
        use[:-1] |= equal[1:]
        spot = order[use]
        string, of, shift = string[use], piece[spot], within[spot]
        code, at = place[of] >> 39, _start(place[of]) + shift
        by = np.lexsort((at, code, key[of], string))
        string, of, code, at = string[by], of[by], code[by], at[by]
        head = np.ones(len(by), bool)
        head[1:] = string[1:] != string[:-1]
        head = np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
        # A row that is given twice sends its pieces twice; these are one place.
        later = (key[of] != key[of[head]]) | (code != code[head]) | (at != at[head])
        of, code, at = of[later], code[later], at[later]
        # Neighbouring starts of one piece become one place.
        by = np.lexsort((at, of))
        of, code, at = of[by], code[by], at[by]
        head = np.ones(len(by), bool)
        head[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(head)
        further = np.diff(np.append(first, len(by))) - 1
        yield pa.RecordBatch.from_arrays([_long(key[of[first]]), _long(_place(code[first], at[first], further, False))], names=["key", "place"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the removed bytes out of each text."""
    for batch in slices(batches):
        out = []
        for text, places in zip(batch.column("text").to_pylist(), batch.column("removed")):
            raw = (text or "").encode("utf-8", "surrogatepass")
            place = places.values.to_numpy() if places.is_valid else np.zeros(0, np.int64)
            if not len(place):
                out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            start = _start(place)
            edge = np.bincount(start, minlength=len(raw) + 1) - np.bincount(start + (place & (PERIODIC - 1)) + WIDTH, minlength=len(raw) + 1)
            gone = np.cumsum(edge)[: len(raw)] > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
        columns = list(zip(*out)) if out else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per document what is left of it: ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), _text_code().alias("code"))
    scanned = keyed.select("text", "key", "code").mapInArrow(_scan, ANCHOR_SCHEMA)
    sorted_anchors = scanned.repartition(n, "anchor").sortWithinPartitions("anchor")
    places = written(sorted_anchors.mapInArrow(_classify, PLACE_SCHEMA), "repeat-places").withColumn("code", F.shiftright("place", 39))
    asked = places.where(F.col("anchor").isNotNull()).groupBy("key", "code").agg(F.collect_list(F.struct("place", "anchor")).alias("asked"))
    pieces = keyed.select("key", "code", "text").join(asked.hint("shuffle_hash"), ["key", "code"]).select("key", "text", "asked").mapInArrow(_cut_out, SEGMENT_SCHEMA)
    sorted_pieces = pieces.repartition(n, "anchor").sortWithinPartitions("anchor")
    found = written(sorted_pieces.mapInArrow(_sort_groups, "key long, place long"), "repeat-strings")
    removed = places.where(F.col("anchor").isNull()).select("key", "place").union(found).withColumn("code", F.shiftright("place", 39))
    per_text = removed.groupBy("key", "code").agg(F.collect_list("place").alias("removed"))
    rows = keyed.join(per_text.hint("shuffle_hash"), ["key", "code"], "left").select("doc_id", "text", "removed")
    return rows.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
