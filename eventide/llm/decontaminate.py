"""Benchmark decontamination with a distributed positional inverted index.

Windows of consecutive words of the test items are looked up in the training documents. One pass counts the test items'
terms in the corpus. Each window then chooses its rarest terms; a second pass stores the postings (document, position) of
the chosen terms alone, as a written table. The lists of a window are intersected from its rarest term on: a posting less
the term's place in the window is a start, and a start survives if the next terms have postings at their places. Survivors
are compared with the document's own words, so the result is exact; :func:`proximity` answers unordered queries within a
distance from the same index.

A term that occurs nowhere ends its windows at once. Common words never drive a lookup unless a window has no other; the
lists are joined on (document, position), so neither a common term nor a long document gathers in one task. The test side
is small tables whose file sizes decide between broadcast and shuffle.

Defined cases: a null text has no words; a null ``item_id`` hits but is not listed; items with equal text are all listed;
rows of one ``doc_id`` are each judged on their own text. Empty tables give no rows (documents) or no hits (items).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import lower_ascii, safe_join, table, written

WINDOW = 10
#: Terms of a window whose postings are intersected before the words are compared.
PROBES = 3
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAPS), "")


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``item_id``, ``words`` of every window: ``width`` consecutive words, or all of a shorter item."""
    split = items.select("item_id", terms(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - width + 1, F.lit(1)))
    return split.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("all"), s, width))).alias("words"))


def _phrase(words: Column) -> Column:
    return F.xxhash64(F.array_join(words, " "))


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Occurrences in the corpus of each ``word`` of the vocabulary that occurs at all."""
    tokens = docs.select(F.explode(terms(F.col("text"))).alias("word"))
    return tokens.join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The positional index of the vocabulary: ``doc_id``, ``pos``, ``word``."""
    tokens = docs.select("doc_id", F.posexplode(terms(F.col("text"))).alias("pos", "word"))
    return tokens.join(vocabulary, "word").select("doc_id", "pos", "word")


def _probes(phrases: DataFrame, counts: DataFrame, probes: int) -> DataFrame:
    """The phrases whose terms all occur, each with its rarest terms and their places, rarest first."""
    placed = phrases.select("phrase", F.size("words").alias("len"), F.posexplode("words").alias("place", "word"))
    known = placed.join(counts, "word").groupBy("phrase", "len").agg(F.sort_array(F.collect_list(F.struct("n", "place", "word"))).alias("order"))
    chosen = [F.coalesce(F.get("order", F.lit(k)), F.get("order", F.lit(0))) for k in range(probes)]
    return known.where(F.size("order") == F.col("len")).select(
        "phrase", "len", *[c["place"].alias(f"place{k}") for k, c in enumerate(chosen)], *[c["word"].alias(f"word{k}") for k, c in enumerate(chosen)]
    )


def _starts(index: DataFrame, probes: DataFrame, n: int) -> DataFrame:
    """``doc_id``, ``phrase``, ``len``, ``start`` where all probed terms stand at their places."""
    found = index.join(probes.withColumnRenamed("word0", "word"), "word").withColumn("start", F.col("pos") - F.col("place0")).where("start >= 0").drop("pos", "word")
    for k in range(1, n):
        other = index.select(F.col("doc_id").alias("__doc"), F.col("pos").alias("__pos"), F.col("word").alias("__word"))
        on = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__pos") == F.col("start") + F.col(f"place{k}")) & (F.col("__word") == F.col(f"word{k}"))
        found = found.join(other, on, "left_semi")
    return found.select("doc_id", "phrase", "len", "start").distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, probes: int = PROBES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``item_ids`` (sorted strings), judged word by word."""
    of_items = written(windows(items, width).select("item_id", "words", _phrase(F.col("words")).alias("phrase")).distinct(), "bench-windows")
    phrases = of_items.select("phrase", "words").dropDuplicates(["phrase"])
    vocabulary = written(phrases.select(F.explode("words").alias("word")).distinct(), "bench-terms")
    counts = written(term_counts(docs, vocabulary), "bench-counts")
    chosen = written(_probes(phrases, counts, probes), "bench-probes")
    wanted = written(chosen.select(F.explode(F.array(*[f"word{k}" for k in range(probes)])).alias("word")).distinct(), "bench-wanted")
    index = written(postings(docs, wanted), "postings")
    ids = of_items.groupBy("phrase").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    starts = _starts(index, chosen, probes).join(ids, "phrase")
    per_doc = starts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "len", "phrase", "ids")).alias("__found"))
    rows = safe_join(docs, per_doc, ["doc_id"]).withColumn("__all", terms(F.col("text")))
    true = F.filter("__found", lambda x: F.xxhash64(F.array_join(F.slice(F.col("__all"), x["start"] + 1, x["len"]), " ")) == x["phrase"])
    none = F.array().cast("array<struct<start:int,len:int,phrase:bigint,ids:array<string>>>")
    rows = rows.withColumn("__true", F.coalesce(true, none))
    covered = F.array_distinct(F.flatten(F.transform("__true", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1))))
    item_ids = F.sort_array(F.array_distinct(F.flatten(F.transform("__true", lambda x: x["ids"]))))
    return rows.select(
        *docs.columns, F.size("__all").cast("long").alias("n_words"), F.size(covered).cast("long").alias("n_hit"), item_ids.alias("item_ids")
    )


def proximity(docs: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """Documents where two terms of a query (``query``, ``first``, ``second``) stand at most ``within`` words apart, in any order.

    Positions are cut into stretches of ``within`` words; the second list is copied to the neighbouring stretches, so that
    the lists meet by equality. Returns ``query``, ``doc_id``, the positions of both, once each.
    """
    vocabulary = pairs.select(F.explode(F.array("first", "second")).alias("word")).distinct()
    index = written(postings(docs, vocabulary), "postings")
    span = max(within, 1)
    stretch = F.expr(f"pos div {span}")
    a = index.withColumnRenamed("word", "first").join(pairs, "first").select("query", "doc_id", F.col("pos").alias("first_pos"), stretch.alias("stretch"))
    b = index.withColumnRenamed("word", "second").join(pairs, "second").select(
        "query", F.col("doc_id").alias("__doc"), F.col("pos").alias("second_pos"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch")
    )
    near = a.join(b, ["query", "stretch"]).where(F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.abs(F.col("first_pos") - F.col("second_pos")) <= within))
    return near.where("first_pos != second_pos").select("query", "doc_id", "first_pos", "second_pos").distinct()


def op3_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a test item occurs."""
    clashing = {"n_words", "n_hit", "item_ids"} & set(docs.columns)
    plain = docs.withColumnsRenamed({c: f"__own_{c}" for c in clashing})
    clean = contamination(plain, table(spark, sf_dir, "benchmark")).where("n_hit = 0").drop("n_words", "n_hit", "item_ids")
    return clean.withColumnsRenamed({f"__own_{c}": c for c in clashing}).select(*docs.columns)


ORACLE = r"""
with d as materialized (
  select row_number() over () as rid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null),
windows as (
  select distinct item_id, array_to_string(w[s : s + 9], ' ') as phrase, len(w[s : s + 9]) as width
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from b where len(w) > 0)),
widths as (select distinct width from windows),
places as (
  select rid, s, width, array_to_string(w[s : s + width - 1], ' ') as phrase
  from (select rid, w, width, unnest(range(1, len(w) - width + 2)) as s from d, widths)),
hits as (select rid, s, p.width, item_id from places p join windows using (phrase, width)),
hit_words as (select rid, count(distinct k) as n_hit from (select rid, unnest(range(s, s + width)) as k from hits) group by rid),
hit_items as (
  select rid, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct rid, cast(item_id as varchar) as id from hits where item_id is not null) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (rid) left join hit_items using (rid)
"""
