"""Near-duplicates by SimHash and multi-index hashing.

The fingerprint of a text has a bit set where more than half of its shingles' hashes have it. Two fingerprints that differ in
at most three bits differ in at most one bit in one of their two halves. So one table per half holds every distinct
fingerprint under the value of that half; a fingerprint asks it for all values in the Hamming ball of radius one
around its own half, and the full distance of what it finds is verified. A pair of values is only asked for from the side with the
lower value, so no pair is met twice in one table.

Copies share one fingerprint and enter the search once. A half that more than ``CROWD`` fingerprints share is searched by the other
half, itself cut in two with a ball of radius one in each part; that is exact too, and spreads the crowd over its subkeys.
Links between fingerprints become components by stars of joins, written to the shared folder round by round.

Defined cases: a null or empty text has fingerprint zero and is linked like any other. A text of fewer words than a shingle
is one shingle. A null id never becomes a component's id unless the component has no other. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import safe_join, table, written
from .components import components

SHINGLE = 3
#: The seed of the hash (fixed value).
SEED = 42
DISTANCE = 3
#: Fingerprints under one value of a half from which on the other half takes part in the key.
CROWD = 512
HALVES = ((0, 32), (32, 32))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned 64-bit number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    span = min(shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    n = len(words) - span + 1
    for first in range(0, n, 65_536):  # bounded memory for very long texts
        last = min(first + 65_536, n)
        cuts = zip(starts[first:last].tolist(), ends[first + span - 1 : last + span - 1].tolist())
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in cuts])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([simhash(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(values)], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, a hash of the text that tells rows of one id apart, and the fingerprint ``fp``."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def _part(fp: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1))


def _ball(value: Column, bits: int) -> Column:
    """The value, and it with one of its zero bits set."""
    flips = [F.when(F.shiftright(value, b).bitwiseAND(F.lit(1)) == 0, value.bitwiseOR(F.lit(1 << b))) for b in range(bits)]
    return F.array_compact(F.array(value, *flips))


def _full_ball(value: Column, bits: int) -> Column:
    return F.array(value, *[value.bitwiseXOR(F.lit(1 << b)) for b in range(bits)])


def _near(asked: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of different fingerprints that meet under ``keys`` and are close enough."""
    met = asked.join(held.withColumnRenamed("fp", "other"), keys).where(F.col("fp") != F.col("other"))
    close = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= DISTANCE)
    return close.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """All pairs of the fingerprints ``fp`` at most ``DISTANCE`` bits apart."""
    halves = [F.struct(F.lit(k).alias("half"), _part(F.col("fp"), s, b).alias("value")) for k, (s, b) in enumerate(HALVES)]
    held = distinct.select("fp", F.inline(F.array(*halves)))
    asked = held.select("fp", "half", F.explode(_ball(F.col("value"), 32)).alias("value"))
    crowded = written(held.groupBy("half", "value").count().where(F.col("count") > crowd).select("half", "value"), "crowded")
    pairs = _near(asked.join(crowded, ["half", "value"], "left_anti"), held.join(crowded, ["half", "value"], "left_anti"), ["half", "value"])
    # The other half of a crowded value, in two parts of 16 bits.
    rest = F.when(F.col("half") == 0, _part(F.col("fp"), 32, 32)).otherwise(_part(F.col("fp"), 0, 32))
    low, high = F.col("rest").bitwiseAND(F.lit(0xFFFF)), F.shiftright("rest", 16)
    held_rest = held.join(crowded, ["half", "value"], "left_semi").withColumn("rest", rest)
    asked_rest = asked.join(crowded, ["half", "value"], "left_semi").withColumn("rest", rest)
    keys = ["half", "value", "part", "own"]
    by_part = F.array(F.struct(F.lit(0).alias("part"), low.alias("own")), F.struct(F.lit(1).alias("part"), high.alias("own")))
    held_rest = held_rest.select("fp", "half", "value", F.inline(by_part))
    asked_rest = asked_rest.select("fp", "half", "value", F.explode(F.array(*[
        F.struct(F.lit(k).alias("part"), _full_ball(v, 16).alias("owns")) for k, v in enumerate((low, high))
    ])).alias("p")).select("fp", "half", "value", F.col("p.part").alias("part"), F.explode("p.owns").alias("own"))
    return pairs.union(_near(asked_rest, held_rest, keys)).distinct()


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Every document's ``fp`` and ``component_id``, the smallest id among the documents it is linked to, itself included."""
    marked = written(fingerprints(docs), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    members = components(links(distinct.select("fp"), crowd)).select(F.col("node").alias("fp"), "least")
    labelled = distinct.join(members, "fp", "left").withColumn("least", F.coalesce("least", "fp"))
    heads = labelled.groupBy("least").agg(F.min("first_id").alias("component_id"))
    classes = labelled.join(heads, "least").select("fp", "least", "component_id")
    return marked.join(classes, "fp").select("doc_id", "text_hash", "fp", "least", "component_id")


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays, as one row."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = near_duplicates(docs).groupBy("least").agg(F.min_by(F.struct("doc_id", "text_hash"), order).alias("first"))
    kept = first.select("first.doc_id", F.col("first.text_hash").alias("__text_hash"))
    rows = safe_join(docs.withColumn("__text_hash", F.xxhash64("text")), kept, ["doc_id", "__text_hash"], "left_semi")
    return rows.dropDuplicates(["doc_id", "__text_hash"]).select(*docs.columns)
