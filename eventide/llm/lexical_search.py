"""Ranked lexical search with Block-Max MaxScore over a partitioned inverted index.

Index: each task cuts its documents into shards of bounded size and inverts them in place, without a shuffle. Inside a shard documents are
numbered by length, so that neighbours in a postings list are alike; a list is cut into blocks of ``BLOCK`` postings, each with its first
document, its largest term frequency and its shortest document, and the postings themselves are variable-length bytes. A row of the
written index is one term of one shard; the row without a term holds the shard's documents and their lengths. The index holds every document and every term and knows
nothing of the queries.

Search: index rows of the queries' terms meet the queries of a block (at most ``QUERIES`` items) shard by shard. Per item, a term's
bound over the shard splits the lists: those whose bounds together stay below the current tenth score are not essential, and documents
that appear in them alone can't enter. Essential lists are added up for a range of documents; then, from the largest bound down, the block
maxima of each non-essential list reject candidates *before* the block is decompressed, and only blocks that hold a survivor are. A candidate is rejected only if
its bound is below the tenth score: equal ones stay, since the smaller id wins. The best ten of each shard are merged by a window over the item.

The bound of a block is the impact of its largest frequency in its shortest document: the impact grows with the frequency and falls with the length, so
no document of the block exceeds it. Collection counts come from the index: frequencies of the queries' terms are sums over shards, and only two totals reach the driver.

Defined cases: a null or empty text has no terms and is in no result; an item without terms, or whose terms no document has, has no rows. Rows of ``benchmark`` with one
``item_id`` are one item with the terms of all of them; a null ``item_id`` is an id like any other. Repeated documents are ranked each; a null ``doc_id`` comes after all ids
of its score. Empty tables give no rows. Other columns aren't read. A very long text is a shard of its own; memory follows the longest text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .byte_words import byte_rule, coded_words, text_slices
from .common import lower_ascii, new_path, table, written

#: Words are runs of ASCII letters, digits and non-ASCII characters.
RULE = byte_rule(bytes(b for b in range(128) if not chr(b).isalnum()))
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Postings of a block; documents and bytes of text of a shard; documents scored together; items searched together.
BLOCK = 128
SHARD_ROWS = 8192
SHARD_BYTES = 24 << 20
RANGE = 1024
QUERIES = 256

INDEX_SCHEMA = "shard string, term string, df long, first array<int>, most_tf array<int>, least_n array<int>, place array<int>, data binary"


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes (seven bits each, the last without the high bit) and the end of each value."""
    values = values.astype(np.uint32)
    sizes = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        sizes += values >= (1 << bits)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - sizes
    for j in range(5):
        some = np.flatnonzero(sizes > j)
        if not len(some):
            break
        more = (sizes[some] > j + 1).astype(np.uint8) << 7
        out[starts[some] + j] = ((values[some] >> np.uint32(7 * j)) & np.uint32(127)).astype(np.uint8) | more
    return out, ends


def unpacked(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    begin = np.concatenate([[0], last[:-1] + 1])
    values = np.zeros(len(last), np.int64)
    for j in range(int((last - begin).max()) + 1 if len(last) else 0):
        some = begin + j <= last
        values[some] |= (raw[begin[some] + j].astype(np.int64) & 127) << (7 * j)
    return values


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32)))


def inverted(shard: str, ids: pa.Array, parts: list[tuple[np.ndarray, np.ndarray, pa.Array]], rows: list[int]) -> pa.RecordBatch:
    """Index rows of one shard. ``parts`` holds word rows, word codes and distinct words of its slices, ``rows`` the slices' sizes."""
    distinct = pc.dictionary_encode(pa.concat_arrays([d for _, _, d in parts]))
    to_term = distinct.indices.to_numpy()
    terms = distinct.dictionary
    docs, codes, before_row, before_term = [], [], 0, 0
    for (doc, code, words), size in zip(parts, rows):
        docs.append(doc.astype(np.int64) + before_row)
        codes.append(to_term[before_term : before_term + len(words)][code].astype(np.int64))
        before_row, before_term = before_row + size, before_term + len(words)
    doc, code = np.concatenate(docs), np.concatenate(codes)
    lengths = np.bincount(doc, minlength=before_row)
    order = np.argsort(lengths, kind="stable")
    number = np.empty(before_row, np.int64)
    number[order] = np.arange(before_row)
    keys, tf = np.unique(code << 32 | number[doc], return_counts=True)
    code, doc, n = keys >> 32, keys & 0xFFFFFFFF, np.sort(lengths)
    header = np.concatenate([pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)[order], ids.is_null().to_numpy(zero_copy_only=False)[order].astype(np.int64), n])
    terms_here, list_start, df = np.unique(code, return_index=True, return_counts=True)
    place = np.arange(len(code)) - np.repeat(list_start, df)
    starts = np.flatnonzero(place % BLOCK == 0)
    first = doc[starts]
    delta = np.diff(doc, prepend=0)
    delta[starts] = 0
    raw, ends = packed(np.column_stack([delta, tf]).ravel())
    begin = np.concatenate([[0], ends[1::2]])[:-1] if len(ends) else np.zeros(0, np.int64)
    list_bytes = np.concatenate([begin[list_start], [len(raw)]]) if len(begin) else np.zeros(1, np.int64)
    blocks = np.cumsum(-(-df // BLOCK))
    block_at = begin[starts] - np.repeat(list_bytes[:-1], np.diff(np.concatenate([[0], blocks])))
    most = np.maximum.reduceat(tf, starts) if len(starts) else tf
    least = np.minimum.reduceat(n[doc], starts) if len(starts) else n[:0]
    data = pa.Array.from_buffers(pa.large_binary(), len(df), [None, pa.py_buffer(list_bytes.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
    body = [pa.array([shard] * len(df), pa.string()), terms.take(pa.array(terms_here)).cast(pa.string()), pa.array(df.astype(np.int64)), _lists(first, blocks), _lists(most, blocks), _lists(least, blocks), _lists(block_at, blocks), data]
    none = pa.array([[]], pa.list_(pa.int32()))
    head = [pa.array([shard]), pa.array([None], pa.string()), pa.array([int(n.sum())]), pa.array([[int((n > 0).sum())]], pa.list_(pa.int32())), none, none, none, pa.array([header.astype("<i8").tobytes()], pa.binary())]
    names = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([h, b]) for h, b in zip(head, body)], names=names)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    ids, parts, rows, size = [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number, size
        whole = inverted(f"{task}-{number}", pa.concat_arrays(ids), parts, rows)
        number, size = number + 1, 0
        ids.clear(), parts.clear(), rows.clear()
        for k in range(0, whole.num_rows, 50_000):
            yield whole.slice(k, 50_000)
        del whole
        pa.default_memory_pool().release_unused()

    for batch in text_slices(batches):
        grows = batch.column("text").nbytes
        if rows and (sum(rows) + batch.num_rows > SHARD_ROWS or size + grows > SHARD_BYTES):
            yield from flush()
        ids.append(batch.column("doc_id").cast(pa.int64()))
        parts.append(coded_words(batch.column("text"), RULE))
        rows.append(batch.num_rows)
        size += grows
    if rows:
        yield from flush()


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Write the index of ``doc_id`` and ``text`` and read it back."""
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_shards, INDEX_SCHEMA).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(path)


class PostingsList:
    """One term's list in a shard: block bounds in the open, postings packed."""

    def __init__(self, first, most_tf, least_n, place, data, shrink):
        self.first = np.asarray(first, np.int64)
        self.place = np.append(np.asarray(place, np.int64), len(data))
        self.raw = np.frombuffer(data, np.uint8)
        most = np.asarray(most_tf, np.int64)
        self.bound = impact(most, shrink(np.asarray(least_n, np.int64)))
        self.top = int(self.bound.max())

    def blocks(self, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First block and the one behind the last that may hold documents of each range."""
        return np.maximum(np.searchsorted(self.first, lows, "right") - 1, 0), np.searchsorted(self.first, highs, "left")

    def most(self, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """The largest block bound in each range, 0 where no block reaches it."""
        a, b = self.blocks(lows, highs)
        some = np.maximum.reduceat(np.append(self.bound, 0), np.column_stack([a, b]).ravel())[::2]
        return np.where(a < b, some, 0)

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and frequencies of some blocks, ascending; only these are decompressed."""
        if len(blocks) and blocks[-1] - blocks[0] + 1 == len(blocks):
            raw = self.raw[self.place[blocks[0]] : self.place[blocks[-1] + 1]]
        else:
            raw = np.concatenate([self.raw[self.place[b] : self.place[b + 1]] for b in blocks])
        values = unpacked(raw)
        steps, tf = values[::2], values[1::2]
        # The number of postings per block: all full but the last block of the list.
        sizes = np.full(len(blocks), BLOCK)
        sizes[-1] = len(steps) - BLOCK * (len(blocks) - 1)
        starts = np.cumsum(sizes) - sizes
        run = np.cumsum(steps)
        return run + np.repeat(self.first[blocks] - run[starts], sizes), tf


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def block_max_max_score(lists: list[tuple[int, PostingsList]], m: np.ndarray, ids: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the best documents of a shard; ``lists`` holds weights (repeats included) and lists of an item's terms.

    ``ids`` is the rank of a document's id in the shard and decides between equal scores.
    """
    lists = sorted(((w, p) for w, p in lists if w > 0), key=lambda x: x[0] * x[1].top)
    best, scores, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    below = np.cumsum([0] + [w * p.top for w, p in lists])
    lows = np.arange(0, len(m), RANGE)
    highs = np.minimum(lows + RANGE, len(m))
    # The ranges that promise most come first, so that the floor rises early; ranges below it are not read.
    promise = sum((w * p.most(lows, highs) for w, p in lists), np.zeros(len(lows), np.int64))
    for k in np.argsort(-promise, kind="stable"):
        low, high = int(lows[k]), int(highs[k])
        if promise[k] < floor:
            break
        # Lists before this place can't lift a document to the floor, even all together.
        essential = int(np.searchsorted(below[1:], floor, "left"))
        if essential == len(lists):
            break
        total = np.zeros(high - low, np.int64)
        for w, p in lists[essential:]:
            a, b = p.blocks(low, high)
            if a < b:
                doc, tf = p.postings(np.arange(a, b))
                inside = slice(*np.searchsorted(doc, [low, high]))
                doc, tf = doc[inside], tf[inside]
                total[doc - low] += w * impact(tf, m[doc])
        left = np.flatnonzero(total) + low
        value = total[left - low]
        for k in range(essential - 1, -1, -1):
            w, p = lists[k]
            block = np.searchsorted(p.first, left, "right") - 1
            most = value + below[k] + np.where(block >= 0, w * p.bound[block], 0)
            alive = most >= floor
            left, value, block = left[alive], value[alive], block[alive]
            if not len(left):
                break
            wanted = np.unique(block[block >= 0])
            if len(wanted):
                doc, tf = p.postings(wanted)
                at = np.minimum(np.searchsorted(doc, left), len(doc) - 1)
                hit = doc[at] == left
                value[hit] += w * impact(tf[at[hit]], m[left[hit]])
        best, scores = np.concatenate([best, left]), np.concatenate([scores, value])
        order = np.lexsort([ids[best], -scores])[:top]
        best, scores = best[order], scores[order]
        if len(best) == top:
            floor = max(int(scores[-1]), 1)
    return best, scores


def _searcher(n_docs: int, n_terms: int, top: int):
    def search(group: pa.Table) -> pa.Table:
        head = pc.index(pc.is_null(group.column("term")), True).as_py()
        whole = np.frombuffer(group.column("data")[head].as_py(), "<i8").reshape(3, -1)
        shrink = lambda n: 25 + (75 * n * n_docs) // max(n_terms, 1)
        m = shrink(whole[2])
        rank = np.empty(whole.shape[1], np.int64)
        rank[np.lexsort([whole[0], whole[1]])] = np.arange(whole.shape[1])
        items: dict = {}
        for row in group.to_pylist():
            if row["term"] is None:
                continue
            own = PostingsList(row["first"], row["most_tf"], row["least_n"], row["place"], row["data"], shrink)
            for item in row["items"]:
                items.setdefault(item["item_id"], []).append((row["weight"] * item["repeats"], own))
        out: dict[str, list] = {"item_id": [], "doc_id": [], "score": []}
        for item, lists in items.items():
            best, scores = block_max_max_score(lists, m, rank, top)
            out["item_id"] += [item] * len(best)
            out["doc_id"] += [None if null else int(i) for i, null in zip(whole[0][best], whole[1][best])]
            out["score"] += scores.tolist()
        return pa.table({"item_id": pa.array(out["item_id"], group.schema.field("items").type.value_type.field("item_id").type), "doc_id": pa.array(out["doc_id"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    return search


def query_terms(items: DataFrame) -> DataFrame:
    """Rows of ``item_id``, ``term`` and ``repeats``."""
    terms = F.split(lower_ascii(F.coalesce("text", F.lit(""))), NO_TERM)
    return items.select("item_id", F.explode(terms).alias("term")).where("term <> ''").groupBy("item_id", "term").agg(F.count("*").alias("repeats"))


def search(index: DataFrame, items: DataFrame, top: int = TOP, queries: int = QUERIES) -> DataFrame:
    """The ``top`` documents of each item: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    heads = index.where("term IS NULL")
    n_docs, n_terms = heads.agg(F.coalesce(F.sum(F.col("first")[0].cast("long")), F.lit(0)), F.coalesce(F.sum("df"), F.lit(0))).first()
    wanted = written(query_terms(items), "search-terms")
    n_items = wanted.select("item_id").distinct().count()
    blocks = max(1, math.ceil(n_items / queries))
    by_block = wanted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    by_term = by_block.groupBy("term", "block").agg(F.collect_list(F.struct("item_id", "repeats")).alias("items"))
    lists = written(index.where("term IS NOT NULL").join(wanted.select("term").distinct(), "term"), "search-lists")
    frequency = lists.groupBy("term").agg(F.sum("df").alias("n_docs"))
    weight = F.floor(1000 * F.log((F.lit(2 * n_docs + 2)).cast("double") / (2 * F.col("n_docs") + 1))).cast("long")
    weighed = by_term.join(frequency.select("term", weight.alias("weight")), "term")
    found = lists.join(weighed, "term").select("shard", "block", "term", "weight", "items", "first", "most_tf", "least_n", "place", "data")
    # The shard's documents go with every block of items.
    kinds = dict(found.dtypes)
    heads = heads.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "term", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("weight", "items")], "first", "most_tf", "least_n", "place", "data")
    schema = f"item_id {dict(items.dtypes)['item_id']}, doc_id long, score long"
    parts = heads.unionByName(found).groupBy("shard", "block").applyInArrow(_searcher(n_docs, n_terms, top), schema)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents"), new_path(spark, "search-index"))
    return search(index, table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH words AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
sizes AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS size FROM sizes),
wanted AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM words) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // size)))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
