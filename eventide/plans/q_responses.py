"""Responses in time bins: rates, correlations, permutations, regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.operators import responses as P, transitions as T
from eventide.plans.q_transitions import LONG
from eventide.plans.registry import query, round_doubles
from eventide.sources import tables

HOUR = 3600
DAYS = 30
N_BINS = DAYS * 24
PERMUTATIONS = 500
T_QUANTILE = 1.9633  # 97.5 % of Student's t at 718 degrees of freedom


def durations(spark, sf):
    movies = tables.table(spark, sf, "events").select(F.col("event_type").alias("movie")).distinct()
    return movies.withColumn("seconds", F.lit(float(DAYS * 86400)))


PRESSES = f"""presses as (select user_id as subj, event_type as movie,
  greatest(ceil(date_diff('microsecond', timestamp '{tables.RECORDING_START}', ts)/1000.0::double/{1000.0 * HOUR}::double) - 1, 0)::int as bin,
  date_diff('microsecond', timestamp '{tables.RECORDING_START}', ts) as us from events),
spine as (select movie, b::int as bin from (select distinct movie from presses), unnest(generate_series(0, {N_BINS - 1})) g(b))"""
RATES = f"""{PRESSES}, rate as (select s.movie, s.bin, count(distinct p.us)::double/(select count(distinct subj) from presses) as rate
  from spine s left join presses p on p.movie = s.movie and p.bin = s.bin group by 1, 2)"""


def r_pb_sql(m1, m0, s, n1, n0) -> str:
    return (
        f"round(case when {n1} > 0 and {n0} > 0 and {s} > 0 then ({m1}-{m0})/{s}*sqrt(({n1})::double*({n0})"
        f"/((({n1})+({n0}))::double*(({n1})+({n0})))) end, 6) + 0.0::double as r_pb"
    )


@query("binned_counts", f"""with {PRESSES} select s.movie, s.bin, count(p.subj) as n from spine s
 left join presses p on p.movie = s.movie and p.bin = s.bin group by 1, 2""")
def binned_counts(spark, sf):
    return P.binned_counts(tables.presses(spark, sf), durations(spark, sf), HOUR)


@query("group_rate", f"with {RATES} select movie, bin, round(rate, 6) as rate from rate")
def group_rate(spark, sf):
    return round_doubles(P.group_rate(tables.presses(spark, sf), durations(spark, sf), HOUR))


@query("subject_rpb", f"""with {RATES}, subs as (select distinct subj from presses),
mine as (select subj, movie, bin, count(*) as c from presses group by 1, 2, 3),
d as (select subs.subj, rate.rate, coalesce(mine.c, 0) as c from subs cross join rate
  left join mine on mine.subj = subs.subj and mine.movie = rate.movie and mine.bin = rate.bin),
a as (select subj, sum((c = 1)::int)::bigint as n1, sum((c = 0)::int)::bigint as n0, avg(rate) filter (c = 1) as m1,
  avg(rate) filter (c = 0) as m0, stddev_pop(rate) as s from d group by 1)
select subj, n1, n0, {r_pb_sql('m1', 'm0', 's', 'n1', 'n0')} from a""")
def subject_rpb(spark, sf):
    return round_doubles(
        P.subject_point_biserial(tables.presses(spark, sf), durations(spark, sf), HOUR)
    )


#: Flag of a bin: did one of a fixed group of subjects press in it? (Stands for a model's boundaries.)
FLAGS = f"""{RATES}, bins as (select r.movie, r.bin, r.rate as value,
  exists (select 1 from presses p where p.movie = r.movie and p.bin = r.bin and p.subj % 7 = 0) as flag from rate r)"""


def flagged_bins(spark, sf):
    presses = tables.presses(spark, sf)
    rates = P.group_rate(presses, durations(spark, sf), HOUR)
    hit = presses.where(F.col("subj") % 7 == 0).select(
        "movie", P.press_bin(F.col("ms"), HOUR).alias("bin"), F.lit(True).alias("hit")
    ).distinct()
    return rates.join(hit, ["movie", "bin"], "left").select(
        "movie", "bin", F.col("rate").alias("value"), F.coalesce("hit", F.lit(False)).alias("flag")
    )


@query("point_biserial", f"""with {FLAGS}, a as (select movie, sum(flag::int)::bigint as n1, sum((not flag)::int)::bigint as n0,
  avg(value) filter (flag) as m1, avg(value) filter (not flag) as m0, stddev_pop(value) as s from bins group by 1)
select movie, n1, n0, {r_pb_sql('m1', 'm0', 's', 'n1', 'n0')} from a""")
def point_biserial(spark, sf):
    return round_doubles(P.point_biserial(flagged_bins(spark, sf), "flag", "value", "movie"))


@query("permutation_null", f"""with {FLAGS},
st as (select movie, count(*) as n, sum(flag::int) as n1, sum(value) as total, stddev_pop(value) as s from bins group by 1),
d as (select bins.movie, p, value, row_number() over (partition by bins.movie, p order by md5(p || ':' || bins.movie || ':' || bin), bin) as rn
  from bins, unnest(generate_series(0, {PERMUTATIONS - 1})) g(p)),
a as (select d.movie, p::int as p, sum(value) as sum1, any_value(n) as n, any_value(n1) as n1, any_value(total) as total, any_value(s) as s
  from d join st on st.movie = d.movie and rn <= n1 group by 1, 2)
select movie, p, {r_pb_sql('sum1/n1', '(total-sum1)/(n-n1)', 's', 'n1', '(n-n1)')} from a""")
def permutation_null(spark, sf):
    return round_doubles(P.permutation_null(flagged_bins(spark, sf), PERMUTATIONS))


@query("best_attainable", f"""with {RATES}, w as (select movie, row_number() over o as m, sum(rate) over o as top, count(*) over p as n,
  sum(rate) over p as total, stddev_pop(rate) over p as s from rate
  window o as (partition by movie order by rate desc, bin rows between unbounded preceding and current row), p as (partition by movie)),
r as (select movie, {r_pb_sql('top/m', '(total-top)/(n-m)', 's', 'm', '(n-m)')} from w where m < n)
select movie, max(r_pb) as r_pb from r group by 1""")
def best_attainable(spark, sf):
    rates = P.group_rate(tables.presses(spark, sf), durations(spark, sf), HOUR)
    return round_doubles(P.best_attainable(rates))


@query("top_bins", f"with {RATES} select movie, bin, round(rate, 6) as rate from rate order by rate desc, movie, bin limit 10")
def top_bins(spark, sf):
    rates = P.group_rate(tables.presses(spark, sf), durations(spark, sf), HOUR)
    return round_doubles(P.top_bins(rates, 10))


@query("regression_line", f"""with {RATES}, f as (select movie, regr_slope(rate, bin) as slope, regr_intercept(rate, bin) as icpt,
  regr_sxx(rate, bin) as sxx, avg(bin) as mx, count(*) as n from rate group by 1),
e as (select movie, sum((rate - (icpt + slope*bin))**2) as sse from rate join f using (movie) group by 1),
b as (select movie, bin, rate, icpt + slope*bin as fitted, {T_QUANTILE}::double*sqrt(sse/(n-2)*(1.0/n + (bin-mx)**2/sxx)) as band
  from rate join f using (movie) join e using (movie))
select movie, bin, round(rate, 6) as rate, round(fitted, 6) as fitted, round(fitted-band, 6) as lower, round(fitted+band, 6) as upper from b""")
def regression_line(spark, sf):
    rates = P.group_rate(tables.presses(spark, sf), durations(spark, sf), HOUR)
    return round_doubles(P.regression_line(rates, "bin", "rate", T_QUANTILE, "movie"))


@query("binned_boundaries", f"""with {LONG}, f as (select *, coalesce(label <> lag(label) over (partition by seq_id order by pos), false) as b from long),
t as (select seq_id, (pos+1)/7.0::double as t, b from f),
ends as (select seq_id, (ceil(max(t)) - 1)::int as last from t group by 1),
bins as (select seq_id, x::int as bin from ends, unnest(generate_series(0, last)) g(x))
select bins.seq_id, bins.bin, coalesce(bool_or(b), false) as boundary from bins
  left join t on t.seq_id = bins.seq_id and floor(t.t) = bins.bin group by 1, 2""")
def binned_boundaries(spark, sf):
    scenes = tables.long_scenes(spark, sf).select("seq_id", "pos", F.col("label").alias("topic"))
    return P.binned_boundaries(T.boundary_flags(scenes), 7.0, 1.0)
