"""Phrase collocation mining: level-wise counts by broadcast double-array tries.

Words that occur often enough get a code. The texts become arrays of codes in a written table, with 0 for all other words and for the
breaks between pieces, so no phrase crosses either. Then, level by level from two words to ``LONGEST``:

*Candidates.* A phrase can only be frequent if its first and last ``k - 1`` words are. Tasks walk a trie of the frequent phrases of the level below over their tokens and note each
occurrence that one more coded word follows (if one trie holds the whole level, only where the words from the second on are in it too). Each shard (all tokens of a task) reports each such phrase
once, with how often it saw it. Phrases whose reports reach the threshold together, and whose last words are frequent, are the candidates: none that is frequent can be missing, and a trie holds
little else. All pairs of frequent words, or all joins of overlapping phrases, would be as safe but grow with the square of a frequent word's partners.

*Counts.* Candidates go, in parts of at most ``TRIE_PHRASES``, into a double-array trie each, which is broadcast. Tasks advance the states of all
positions by numpy, count accepting states with bincount, and the vectors of counts of all shards are added up by a shuffle.

Scores join the table of counts with itself once per side of each cut, in exact decimals of 38 digits. The best of a language are ranked in salted groups before the last ranking.

Only what fits a trie reaches the driver: words and candidates in parts of bounded size, one after the other. More of them mean more passes over the codes, not a larger broadcast.

Defined cases: a null or empty text has no words; a null language is ``und``, together with rows that say so. Repeated rows count each. Without frequent words, or on empty tables, there are
no rows. Other columns aren't read. A very long text is processed whole; memory follows the longest text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.positions import dense_positions
from .byte_words import byte_rule, coded_words, text_slices
from .common import Sent, table, written
from .phrase_trie import PhraseTrie

RULE = byte_rule(b" \t", b".,;:!?\n\x0b\x0c\r")
LEAST = 100
LONGEST = 5
TOP = 2000
#: Phrases of one trie, words that are coded in one pass, and tokens of one shard.
TRIE_PHRASES = 500_000
CODED_WORDS = 500_000
SHARD_TOKENS = 4 << 20
#: Different keys that a task gathers before it reports all of them, and tokens that it handles together.
KEPT_KEYS = 4 << 20
STEP_TOKENS = 1 << 20
#: Phrases of one vector of counts, and groups of tasks whose vectors are added first.
CHUNK = 2048
GROUPS = 64
SCALE = 1000
WIDE = "decimal(19,0)"


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    lang = pc.fill_null(batch.column("lang"), "und")
    for one in pc.unique(lang).to_pylist():
        yield one, batch.column("text").filter(pc.equal(lang, one))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        for lang, texts in _by_language(batch):
            _, codes, distinct = coded_words(texts, RULE, breaks=True)
            counts = np.bincount(codes, minlength=len(distinct))
            some = np.flatnonzero(counts)
            words = distinct.take(pa.array(some)).cast(pa.string())
            line = pc.index(words, "\n").as_py()
            total = int(counts.sum() - (counts[some[line]] if line >= 0 else 0))
            keep = np.arange(len(some)) != line
            words = pa.concat_arrays([words.filter(pa.array(keep)), pa.array([None], pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(np.append(counts[some[keep]], total))], names=["lang", "word", "a"])


def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Counts of frequent words by language; the row without a word has the number of all words."""
    counted = docs.select("lang", "text").mapInArrow(_word_counts, "lang string, word string, a long")
    return written(counted.groupBy("lang", "word").agg(F.sum("a").alias("a")).where(F.col("word").isNull() | (F.col("a") >= least)), "phrase-words")


def vocabulary(counts: DataFrame) -> DataFrame:
    """Frequent words with dense codes from 1 on, over all languages."""
    words = counts.where("word IS NOT NULL").withColumn("seq_id", F.lit(0))
    coded = dense_positions(words, ["lang", "word"], F.pmod(F.xxhash64("lang", "word"), F.lit(4096)))
    return written(coded.select("lang", "word", "a", (F.col("pos") + 1).cast("int").alias("code")), "phrase-codes")


def encoded(docs: DataFrame, words: DataFrame, limit: int = CODED_WORDS) -> DataFrame:
    """The texts as arrays of codes; each pass fills in the words of one range of codes."""
    spark = docs.sparkSession
    size = words.count()
    rows = docs.select("lang", "text")
    passes = max(1, math.ceil(size / limit))
    for k in range(passes):
        part = words.where(F.col("code").between(k * limit + 1, (k + 1) * limit)).select("lang", "word", "code").toArrow()
        shared = spark.sparkContext.broadcast({lang: part.filter(pc.equal(part.column("lang"), lang)).select(["word", "code"]).combine_chunks() for lang in pc.unique(part.column("lang")).to_pylist()})
        rows = written(rows.mapInArrow(_encoder(shared, k > 0, k == passes - 1), "lang string, text string, codes array<int>" if k < passes - 1 else "codes array<int>"), "phrase-tokens")
    return rows


def _encoder(shared, has_codes: bool, last: bool):
    """Codes of the words of this pass, added to those of earlier ones; the last pass leaves texts out."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            lang = pc.fill_null(batch.column("lang"), "und")
            for one in pc.unique(lang).to_pylist():
                own = batch.filter(pc.equal(lang, one))
                rows, codes, distinct = coded_words(own.column("text"), RULE, breaks=True)
                known = shared.value.get(one)
                to_code = np.zeros(len(distinct), np.int32)
                if known is not None:
                    at = pc.index_in(distinct.cast(pa.string()), value_set=known.column("word").combine_chunks())
                    hit = at.is_valid().to_numpy(zero_copy_only=False)
                    to_code[hit] = known.column("code").to_numpy()[at.drop_null().to_numpy()]
                # A text ends with 0, so that no phrase goes on in the next one.
                sizes = np.bincount(rows, minlength=own.num_rows)
                flat = np.insert(to_code[codes], np.cumsum(sizes), 0).astype(np.int32)
                if has_codes:
                    flat = np.maximum(flat, own.column("codes").flatten().to_numpy())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int32)), pa.array(flat))
                kept = [] if last else [own.column("lang"), own.column("text")]
                yield pa.RecordBatch.from_arrays([*kept, lists], names=[*([] if last else ["lang", "text"]), "codes"])

    return encode


def _token_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Tokens of whole rows, about ``STEP_TOKENS`` at a time."""
    held, size = [], 0
    for batch in batches:
        lists = batch.column("codes")
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + STEP_TOKENS, "right")) - 1)
            held.append(flat[ends[first] : ends[last]])
            size += len(held[-1])
            first = last
            if size >= STEP_TOKENS:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _proposer(shared, whole: bool):
    """Occurrences of the trie's phrases with the coded word behind them, with their count in this shard. ``whole``: the trie holds all phrases of its level."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: PhraseTrie = shared.value
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(trie.accepted[keys >> 32]), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(counts)], names=["prefix", "code", "a"])

        for tokens in _token_steps(batches):
            at, states = trie.ends(tokens)
            follows = at + trie.length < len(tokens)
            if whole:
                begins = np.zeros(len(tokens) + 1, bool)
                begins[at] = True
                follows &= begins[at + 1]
            at, states = at[follows], states[follows]
            word = tokens[at + trie.length]
            own, own_counts = np.unique((states.astype(np.int64) << 32 | word)[word > 0], return_counts=True)
            keys, back = np.unique(np.concatenate([keys, own]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, own_counts]), len(keys)).astype(np.int64)
            if len(keys) > KEPT_KEYS:
                # Too many to keep: they are reported now, and again if they come again.
                yield rows()
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield rows()

    return propose


def _counter(shared):
    """Counts of accepting states over all tokens of a shard, as vectors of ``CHUNK`` phrases."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: PhraseTrie = shared.value
        counts = np.zeros(len(trie.accepted), np.int64)
        for tokens in _token_steps(batches):
            counts += np.bincount(trie.ends(tokens)[1], minlength=len(counts))
        own, task = counts[trie.states], TaskContext.get().partitionId()
        for k in range(0, len(own), CHUNK):
            part = own[k : k + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK], pa.int32()), pa.array([task % GROUPS], pa.int32()), pa.array([part], pa.list_(pa.int64()))], names=["chunk", "part", "counts"])

    return count


def _vector_sum(group: pa.Table) -> pa.Table:
    total = sum(row.values.to_numpy() for row in group.column("counts"))
    return group.slice(0, 1).select(["chunk", "part"]).append_column("counts", pa.array([total], pa.list_(pa.int64())))


def phrase_counts(tokens: DataFrame, trie: Sent, least: int) -> DataFrame:
    """``id, a`` of the trie's phrases that occur ``least`` times or more; vectors of the shards are added up in two steps."""
    schema = "chunk int, part int, counts array<long>"
    vectors = tokens.mapInArrow(_counter(trie), schema).groupBy("chunk", "part").applyInArrow(_vector_sum, schema)

    def name(group: pa.Table) -> pa.Table:
        total, first = sum(row.values.to_numpy() for row in group.column("counts")), group.column("chunk")[0].as_py() * CHUNK
        some = np.flatnonzero(total >= least)
        return pa.table({"id": pa.array(trie.value.ids[first + some]), "a": pa.array(total[some])})

    return vectors.groupBy("chunk").applyInArrow(name, "id long, a long")


def _tries(phrases: DataFrame, limit: int) -> Iterator:
    """Broadcast tries that together hold all ``phrases`` (``id``, ``ids``), each about ``limit`` of them at most, and whether one holds all."""
    spark = phrases.sparkSession
    parts = max(1, math.ceil(phrases.count() / limit))
    for k in range(parts):
        rows = phrases.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).select("id", "ids").toArrow()
        if rows.num_rows:
            codes = rows.column("ids").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
            shared = Sent(spark, PhraseTrie(codes, rows.column("id").to_numpy()))
            yield shared, parts == 1
            shared.unpersist()


def frequent_phrases(tokens: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST, trie_phrases: int = TRIE_PHRASES) -> list[DataFrame]:
    """Per length from 1 on a written table of ``id``, ``ids`` (codes) and ``a``, the count of the phrases that reach ``least``."""
    size = tokens.agg(F.coalesce(F.sum(F.size("codes").cast("long")), F.lit(0))).first()[0]
    # Fewer, larger shards report less.
    spread = tokens.coalesce(max(1, math.ceil(size / SHARD_TOKENS)))
    levels = [written(words.select(F.col("code").cast("long").alias("id"), F.array("code").alias("ids"), "a"), "phrases-1")]
    for k in range(2, longest + 1):
        below = levels[-1]
        if below.isEmpty():
            break
        # A trie at a time: its reports are written before the next one is sent.
        proposed = [written(spread.mapInArrow(_proposer(t, whole), "prefix long, code int, a long").groupBy("prefix", "code").agg(F.sum("a").alias("a")).where(F.col("a") >= least), f"phrases-{k}-seen") for t, whole in _tries(below, trie_phrases)]
        likely = reduce(DataFrame.unionByName, proposed)
        grown = likely.join(below.select(F.col("id").alias("prefix"), "ids"), "prefix").select(F.concat("ids", F.array("code")).alias("ids"))
        safe = grown.join(below.select(F.col("ids").alias("tail")), F.slice("ids", 2, k - 1) == F.col("tail"), "left_semi")
        candidates = written(safe.select(F.monotonically_increasing_id().alias("id"), "ids"), f"phrases-{k}-candidates")
        counted = [written(phrase_counts(spread, t, least), f"phrases-{k}-counts") for t, _ in _tries(candidates, trie_phrases)]
        if not counted:
            break
        levels.append(written(candidates.join(reduce(DataFrame.unionByName, counted), "id").select("id", "ids", "a"), f"phrases-{k}"))
    return levels


def scored(levels: list[DataFrame], words: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """Ranks and scores of the phrases that no longer one of the same count covers."""
    counts = reduce(DataFrame.unionByName, [x.select("ids", "a") for x in levels])
    phrases = counts.where(F.size("ids") > 1)
    # A longer phrase with the same count implies one that is longer by one word, so that one decides.
    longer = phrases.where(F.size("ids") > 2)
    size = F.size("ids")
    inner = longer.select(F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("inner"), "a")
    covers = inner.groupBy("inner").agg(F.max("a").alias("above"))
    kept = phrases.join(covers, F.col("ids") == F.col("inner"), "left").where("above IS NULL OR 100 * above < 100 * a").select("ids", "a")
    spoken = words.select("lang", "code").join(totals.select("lang", F.col("a").alias("n")), "lang")
    placed = kept.join(spoken, F.col("ids")[0] == F.col("code")).drop("code")
    cuts = placed.withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"head": F.expr("slice(ids, 1, cut)"), "tail": F.expr("slice(ids, cut + 1, size(ids) - cut)")})
    cuts = cuts.join(counts.select(F.col("ids").alias("head"), F.col("a").alias("l")), "head").join(counts.select(F.col("ids").alias("tail"), F.col("a").alias("r")), "tail")
    wide = lambda c: F.col(c).cast(WIDE)
    score = F.call_function("div", F.lit(SCALE).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r"))
    best = cuts.withColumn("score", score).groupBy("ids", "lang", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    flat = written(best.select("ids", "lang", "a", "n", "best.score", "best.l", "best.r"), "phrases-scored")
    # Words of the phrases, by the codes at their places.
    spelled = flat.select("ids", F.posexplode("ids").alias("place", "code")).join(words.select("code", "word"), "code").groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("spelled"))
    named = flat.join(spelled.select("ids", F.concat_ws(" ", "spelled.word").alias("phrase")), "ids")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = named.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, trie_phrases: int = TRIE_PHRASES, coded_words: int = CODED_WORDS) -> DataFrame:
    """``docs`` has ``lang`` and ``text``."""
    counts = word_counts(docs, least)
    words = vocabulary(counts)
    tokens = encoded(docs, words, coded_words)
    levels = frequent_phrases(tokens, words, least, longest, trie_phrases)
    return scored(levels, words, counts.where("word IS NULL"), top)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, words FROM (
    SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words FROM documents)
  WHERE len(words) > 0),
totals AS (SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM pieces GROUP BY lang),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
counts AS (
  SELECT lang, phrase, CAST(count(*) AS HUGEINT) AS a FROM (
    SELECT lang, words[i : i + k - 1] AS phrase FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(words))
  GROUP BY ALL HAVING count(*) >= 100),
phrases AS (SELECT * FROM counts WHERE len(phrase) > 1),
inner_parts AS (
  SELECT lang, a AS above, unnest(range(1, len(phrase))) AS size, phrase FROM phrases),
covered AS (
  SELECT lang, part, max(above) AS above FROM (
    SELECT lang, above, phrase[i : i + size - 1] AS part FROM (SELECT *, unnest(range(1, len(phrase) - size + 2)) AS i FROM inner_parts))
  GROUP BY ALL),
kept AS (SELECT p.* FROM phrases p LEFT JOIN covered c ON p.lang = c.lang AND p.phrase = c.part WHERE c.above IS NULL OR 100 * c.above < 100 * p.a),
cuts AS (
  SELECT k.lang, k.phrase, k.a, k.cut, x.a AS l, y.a AS r, n, (1000 * k.a * n) // (x.a * y.a) AS score
  FROM (SELECT *, unnest(range(1, len(phrase))) AS cut FROM kept) k
  JOIN counts x ON x.lang = k.lang AND x.phrase = k.phrase[1 : cut]
  JOIN counts y ON y.lang = k.lang AND y.phrase = k.phrase[cut + 1 : len(k.phrase)]
  JOIN totals t ON t.lang = k.lang),
best AS (SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""
