"""Token ids in Parquet: list columns with dictionary or delta encoding, controlled row groups and page indexes.

Writing: documents are put in the order of their ids by a range partitioning, each text is encoded with the ``tokenizers``
library, an end id is appended, and Spark's Parquet writer writes one sorted file per range. Each row holds the ids
as a list and, in columns of their own, the document's id and its number of ids; a reader that asks for the metadata alone never
touches the pages of ids. Ids take dictionary encoding, ids of documents and counts delta encoding (format version 2);
row groups are small enough for a task and pages small enough for the column index to skip most of a row group.

Reading: the place of a document among all ids comes from its count alone. Running totals inside a file need only this
file, and a table with one row per file gives the totals before it.

Encoding doesn't look across the parts into which the tokenizer first splits a text: words, numbers and signs with the space before
them, white space. For texts of ASCII and Latin letters, digits and signs these parts are found on the bytes of many texts at once; each distinct part is encoded once, and the ids of the texts
are gathered from the parts. All other texts, and those that hold an added token of the tokenizer, are encoded whole by one plain call each. A worker keeps encoded parts up to a bound in
bytes; they are a cache and never change a result. Recovery from lost executors needs nothing special: all steps are deterministic by row.

Defined cases: a null or empty text has only the end id. Rows with one id follow each other in the order of their texts; a null id comes first.
An empty table gives no rows. Other columns of the documents are not written. A very long text is encoded whole; memory follows the longest text.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Sent, new_path, slices, small_batches, table, written

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Sizes of row groups and pages in bytes.
ROW_GROUP = 32 << 20
PAGE = 256 << 10
#: Bytes of texts or ids that Spark hands to a worker at a time, and rows that are read from a file at a time.
ARROW_BYTES = 4 << 20
READ_ROWS = 512
#: Bytes of text that are encoded together, and bytes (counted with what Python adds) of the parts that a worker keeps encoded.
BATCH_BYTES = 4 << 20
KEPT_BYTES = 64 << 20
#: What a kept part takes beside its bytes and ids.
ENTRY_BYTES = 130
#: Parts joined to one text for the tokenizer (and such texts in one call), and texts whose ids are put together at a time.
RUN = 50
GATHERED = 400
#: Texts whose parts are found on bytes: ASCII, and Latin letters without the two signs among them.
PLAIN = re.compile(r"[\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*")
#: Kinds of bytes: white space, letters (all bytes of Latin letters too), digits, signs.
_KIND = np.full(256, 3, np.int8)
_KIND[[9, 10, 13, 32]], _KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 0, 1, 1, 1, 2


def part_starts(raw: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where parts begin in plain texts that follow each other; ``text_starts`` are the starts of those that aren't empty.

    A run of one kind is a part, with the space before it. Of several white characters before a word the last one stands apart. After an
    apostrophe that begins a part, the endings s, t, m, d, re, ve and ll belong to it and end it.
    """
    n = len(raw)
    first = np.zeros(n + 1, bool)
    first[text_starts] = first[n] = True
    kind = _KIND[raw]
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change)
    end = np.append(run[1:], n)
    white = kind[run] == 0
    start = np.zeros(n + 1, bool)
    start[run[white]] = True
    goes_on = end[white][~first[end[white]]]
    start[goes_on - 1] = True
    others = run[~white]
    start[others[first[others] | (raw[others - 1] != 32)]] = True
    quote = np.flatnonzero((raw == 39) & start[:n])
    if len(quote):
        padded = np.concatenate([raw, np.zeros(2, np.uint8)])
        a, b = padded[quote + 1], padded[quote + 2]
        same = ~first[np.minimum(quote + 1, n)]
        one = same & np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = same & ~first[np.minimum(quote + 2, n)] & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        for found, size in ((quote[one], 1), (quote[two], 2)):
            start[found + 1] = False
            start[found + 1 + size] = True
    return np.flatnonzero(start[:n])


class Store:
    """Ids of encoded parts, back to back, and the parts' places. The arrays double when they are full."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.flat, self.used, self.bytes = np.zeros(1 << 16, np.int32), 0, 0
        self.lengths, self.starts = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)

    @staticmethod
    def _grown(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        out = np.zeros(max(size, 2 * len(array)), array.dtype)
        out[: len(array)] = array
        return out

    def add(self, parts: list[bytes], flat: np.ndarray, lengths: np.ndarray) -> None:
        n, new = len(self.place), len(parts)
        self.flat = self._grown(self.flat, self.used + len(flat))
        self.lengths, self.starts = self._grown(self.lengths, n + new), self._grown(self.starts, n + new)
        self.flat[self.used : self.used + len(flat)] = flat
        self.lengths[n : n + new] = lengths
        self.starts[n : n + new] = self.used + np.cumsum(lengths) - lengths
        self.place.update(zip(parts, range(n, n + new)))
        self.used += len(flat)
        self.bytes += ENTRY_BYTES * new + sum(map(len, parts)) + 4 * len(flat)

    def only(self, parts: list[bytes]) -> Store:
        """A store of those of some parts that are known."""
        known = [p for p in parts if p in self.place]
        at = np.fromiter(map(self.place.__getitem__, known), np.int64, len(known))
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        out = Store()
        out.add(known, self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[at] - (ends - lengths), lengths)], lengths)
        return out


class PartEncoder:
    """Encodes texts part by part; parts seen before are not encoded again. Only the path of the tokenizer is sent to workers."""

    def __init__(self, path: str):
        self.path, self.tokenizer = path, None

    def _ready(self) -> None:
        from tokenizers import Tokenizer

        # A task has one core; a thread per core of the machine would each keep buffers of its own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(self.path)
        # Where an added token stands in a text it is cut out first, so such texts are encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.line_break,) = self._ids("\n")
        self.store = Store()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode(self, parts: list[bytes]) -> None:
        """Keep the ids of new parts. Parts without white space at the end go line by line through one call: a line break between them
        is a part of its own and joins with neither side."""
        words = [p for p in parts if p[-1] > 32]
        runs = [words[k : k + RUN] for k in range(0, len(words), RUN)]
        alone = [p for p in parts if p[-1] <= 32]
        for k in range(0, len(runs), RUN):
            some = runs[k : k + RUN]
            for own, coded in zip(some, self.tokenizer.encode_batch_fast([b"\n".join(r).decode() for r in some], add_special_tokens=False)):
                ids = np.array(coded.ids, np.int32)
                breaks = ids == self.line_break
                cuts = np.flatnonzero(breaks)
                if len(cuts) == len(own) - 1:
                    self.store.add(own, ids[~breaks], np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
                else:
                    alone += own
        for part in alone:
            ids = np.array(self._ids(part.decode()), np.int32)
            self.store.add([part], ids, np.array([len(ids)]))

    def __call__(self, texts: list[str], end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of some texts in a row, each text followed by ``end``, and the number of ids per text, until all are done."""
        if self.tokenizer is None:
            self._ready()
        first, plain = 0, PLAIN.fullmatch
        for k, text in enumerate([*texts, None]):
            if text is None or any(a in text for a in self.added) or not plain(text):
                if first < k:
                    yield from self._by_parts(texts[first:k], end)
                if text is not None:
                    own = np.array([*self._ids(text), end], np.int32)
                    yield own, np.array([len(own)])
                first = k + 1

    def _by_parts(self, texts: list[str], end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for plain texts without added tokens."""
        whole = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        begins = np.cumsum(sizes) - sizes
        raw = b"".join(whole)
        del whole
        starts = part_starts(np.frombuffer(raw, np.uint8), begins[sizes > 0])
        offsets = np.append(starts, len(raw)).astype(np.int32)
        coded = pc.dictionary_encode(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]))
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if self.store.bytes > KEPT_BYTES:
            self.store = self.store.only(distinct)
        place = self.store.place
        new = [p for p in distinct if p not in place]
        if new:
            self._encode(new)
        chosen = np.fromiter(map(place.__getitem__, distinct), np.int32, len(distinct))[codes]
        per_text = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
        del coded, codes, distinct, starts, offsets, raw
        begin = np.cumsum(per_text) - per_text
        for k in range(0, len(texts), GATHERED):
            own = per_text[k : k + GATHERED]
            part = chosen[begin[k] : begin[k] + own.sum()]
            yield _gathered(part, self.store.flat, self.store.starts, self.store.lengths, own, end)


def _gathered(
    codes: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, per_text: np.ndarray, end: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces ``codes`` in a row, with ``end`` after each text."""
    per_piece = lengths[codes]
    ends = np.cumsum(per_piece, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    source = np.arange(total) + np.repeat(starts[codes] - (ends - per_piece), per_piece)
    text_ends = np.concatenate([[0], ends])[np.cumsum(per_text)]
    sizes = np.diff(np.concatenate([[0], text_ends]))
    return np.insert(flat[source], text_ends, end).astype(np.int32), sizes + 1


def _encoder(shared, end: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in slices(batches, 2500):
            texts = batch.column("text").to_pylist()
            for first, last in _slices(texts):
                for ids, sizes in encoder([t or "" for t in texts[first:last]], end):
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(first, len(sizes)), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(ids))],
                        names=["doc_id", "n_tokens", "ids"],
                    )
                    first += len(sizes)
                pa.default_memory_pool().release_unused()

    return encode


def _slices(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BATCH_BYTES`` each."""
    first = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= BATCH_BYTES:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def write_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END_ID) -> None:
    """Encode ``text`` of all documents and write the ids in the order of ``doc_id``."""
    import public_tokenizers

    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(partitions, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    encoded = ordered.mapInArrow(_encoder(Sent(spark, PartEncoder(public_tokenizers.path(tokenizer))), end), "doc_id long, n_tokens long, ids array<int>")
    writer = encoded.write.option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("parquet.enable.dictionary", "true")
    with small_batches(spark, ARROW_BYTES, READ_ROWS):
        writer.option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with ``start``, the number of ids before the document.

    Files are named by their range. Inside a file the running total follows the rows' order, which the row index of the
    reader gives.
    """
    rows = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path).select(
        "*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row")
    )
    totals = rows.groupBy("__file").agg(F.sum("n_tokens").alias("__total"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("__file").alias("__of"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__file").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    places = rows.select("__file", "__row", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("__inside"))
    joined = rows.join(places.withColumnsRenamed({"__file": "__f", "__row": "__r"}), (F.col("__file") == F.col("__f")) & (F.col("__row") == F.col("__r")), "left")
    joined = joined.join(offsets, F.col("__file") == F.col("__of"), "left")
    return joined.select("doc_id", (F.col("__before") + F.col("__inside")).alias("start"), "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        lists = batch.column("ids")
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = lists.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_tokens"), batch.column("__file"), batch.column("__row"), pa.array(sums, pa.int64())],
            names=["doc_id", "n_tokens", "__file", "__row", "ids_crc32"],
        )


def checksummed(spark: SparkSession, path: str) -> DataFrame:
    """Per written document its place, its number of ids and the checksum of its ids, all from the files.

    The checksums are written first: only a job that runs here has its batches bounded.
    """
    rows = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path).select(
        "doc_id", "n_tokens", "ids", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row")
    )
    with small_batches(spark, ARROW_BYTES, READ_ROWS):
        sums = written(rows.mapInArrow(_checksums, "doc_id long, n_tokens long, __file string, __row long, ids_crc32 long"), "token-sums")
    inside = Window.partitionBy("__file").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    counts = spark.read.schema("n_tokens long").parquet(path).select("n_tokens", F.col("_metadata.file_name").alias("__of"))
    totals = counts.groupBy("__of").agg(F.sum("n_tokens").alias("__total"))
    offsets = totals.select("__of", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    placed = sums.withColumn("__inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(offsets, F.col("__file") == F.col("__of"), "left").select(
        "doc_id", (F.col("__before") + F.col("__inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def op7_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), path)
    return checksummed(spark, path)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: token ids of the documents that are left, as rows of the files."""
    path = new_path(spark, "token-ids")
    write_ids(docs, path)
    return checksummed(spark, path)
