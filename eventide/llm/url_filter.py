"""URL filters with dated lists: every capture is judged by the entries that were active when it was fetched.

A list is a log of changes: from a date on, a key (a host or a parent domain) is blocked, allowed, or off the list. The next change
of the same key ends an entry, so the log becomes validity intervals (from, until). A capture asks for its host and every parent
domain; among the entries active at fetch time the one with the longest key decides.

The as-of join is an equality join: intervals are cut at month borders, and key and month must match, which leaves
at most the few changes within one month to compare by time. A host with a third of all captures is spread over its months,
and over salts that copy the few intervals. Nothing is sorted or windowed by host. The size of the written intervals decides
between broadcast and shuffle.

Defined cases: a null or malformed URL, or a null fetch time, has no host or no active entry and is not blocked. Several changes of
one key at one time: the one that is greatest by action wins. Repeated rows of captures get equal results. An empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table, written

SALTS = 8
BLOCK, ALLOW, OFF = "block", "allow", "off"


def host(url: Column) -> Column:
    """Lower-case host without user and port; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(found != "", F.regexp_replace(found, r"\.$", ""))


def domains(name: Column) -> Column:
    """The host and its parents with at least two labels."""
    labels = F.split(name, r"\.")
    last = F.greatest(F.size(labels) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def _month(time: Column) -> Column:
    return F.year(time) * 12 + F.month(time)


def intervals(log: DataFrame) -> DataFrame:
    """``key``, ``action``, ``since``, ``until`` (null: still active) of a log (``key``, ``since``, ``action``)."""
    single = log.where(F.col("key").isNotNull() & F.col("since").isNotNull()).groupBy("key", "since").agg(F.max("action").alias("action"))
    next_change = F.lead("since").over(Window.partitionBy("key").orderBy("since"))
    return single.withColumn("until", next_change).where(F.col("action") != OFF)


def filtered(captures: DataFrame, log: DataFrame, url: str = "url", time: str = "fetched_at", salts: int = SALTS) -> DataFrame:
    """``captures`` with ``host``, ``rule`` (the deciding key), ``since`` and ``blocked``."""
    active = written(intervals(log), "list-intervals")
    newest = captures.agg(F.max(time)).first()[0]
    until = F.coalesce(F.least("until", F.lit(newest)), F.lit(newest))
    # An interval is repeated in every month from its start to its end or the newest capture.
    months = F.when(F.col("since") <= until, F.sequence(_month(F.col("since")), _month(until))).otherwise(F.array().cast("array<int>"))
    salted = active.withColumn("month", F.explode(months)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = captures.select(
        F.xxhash64(url, time).alias("id"), F.col(url).alias("u"), F.col(time).alias("t"), F.explode(domains(host(F.col(url)))).alias("key")
    ).withColumn("month", _month(F.col("t"))).withColumn("salt", F.pmod(F.col("id"), F.lit(salts)).cast("int"))
    met = keyed.join(salted, ["key", "month", "salt"]).where((F.col("t") >= F.col("since")) & (F.col("until").isNull() | (F.col("t") < F.col("until"))))
    # The longest key decides. Captures with equal URL and time share a decision.
    decided = met.groupBy("u", "t").agg(F.max_by(F.struct("key", "action", "since"), F.length("key")).alias("rule"))
    joined = captures.join(decided, (F.col(url) == F.col("u")) & (F.col(time) == F.col("t")), "left")
    return joined.select(
        *[captures[c] for c in captures.columns], host(captures[url]).alias("host"), F.col("rule.key").alias("rule"), F.col("rule.since").alias("since"),
        F.coalesce(F.col("rule.action") == BLOCK, F.lit(False)).alias("blocked"),
    )


DAY = 86_400
START = 1_672_531_200  # 2023-01-01


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages as captures over two years; the fetch time follows from the page's number, since the table has none."""
    at = F.lit(START) + F.pmod(F.col("page_id") * 7919, F.lit(730 * 24)) * 3600
    return pages.select("page_id", "url", F.timestamp_seconds(at).alias("fetched_at"))


def log_of(pages: DataFrame) -> DataFrame:
    """A list log over the hosts that occur and their parents: each third key comes on, is allowed or goes off, and comes on again.

    The dates follow from the key's length and first letters, so the same rule can be written in other SQL.
    """
    keys = pages.select(F.explode(domains(host(F.col("url")))).alias("key")).distinct().withColumn("code", F.length("key") * 31 + F.ascii("key") * 7)
    listed = keys.where(F.col("code") % 3 == 0)
    changes = F.array(
        F.struct((F.col("code") * 11 % 200).alias("day"), F.lit(BLOCK).alias("action")),
        F.struct((F.col("code") * 11 % 200 + F.col("code") % 250 + 20).alias("day"), F.when(F.col("code") % 2 == 0, ALLOW).otherwise(OFF).alias("action")),
        F.struct((F.col("code") * 11 % 200 + F.col("code") % 250 + 220).alias("day"), F.lit(BLOCK).alias("action")),
    )
    return listed.select("key", F.inline(changes)).select("key", F.timestamp_seconds(F.lit(START) + F.col("day") * DAY).alias("since"), "action")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = filtered(captures_of(pages), log_of(pages))
    return out.select("page_id", "host", "rule", F.unix_seconds("since").alias("since"), "blocked")


ORACLE = rf"""
with hosts as (
  select page_id, url, {START} + (page_id * 7919 % (730 * 24)) * 3600 as t,
    nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '') as host from pages),
keyed as (
  select page_id, t, host, array_to_string(parts[k : ], '.') as key
  from (select page_id, t, host, parts, unnest(range(1, greatest(len(parts) - 1, 1) + 1)) as k from (select *, string_split(host, '.') as parts from hosts where host is not null))),
keys as (select distinct key, length(key) * 31 + ascii(key) * 7 as code from keyed),
changes as (
  select key, day, action from (
    select key, code * 11 % 200 as day, 'block' as action from keys where code % 3 = 0
    union all select key, code * 11 % 200 + code % 250 + 20, case when code % 2 = 0 then 'allow' else 'off' end from keys where code % 3 = 0
    union all select key, code * 11 % 200 + code % 250 + 220, 'block' from keys where code % 3 = 0)),
intervals as (select key, action, {START} + day * {DAY} as since, {START} + lead(day) over (partition by key order by day) * {DAY} as until from changes),
rules as (
  select page_id, arg_max(struct_pack(key := i.key, action := i.action, since := i.since), length(i.key)) as rule
  from keyed join intervals i on keyed.key = i.key and t >= since and (until is null or t < until) and action != 'off' group by page_id)
select h.page_id, h.host, rule.key as rule, cast(rule.since as bigint) as since, coalesce(rule.action = 'block', false) as blocked
from hosts h left join rules using (page_id)
"""
