"""General event model: labels, boundary probability, surprise, errors, known events."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.functions import vector as V
from eventide.operators import events as N, moments as M, responses as P
from eventide.operators.positions import with_carry, with_lag
from eventide.operators.transitions import prediction_error_ratio
from eventide.plans.q_transitions import LONG, SHORT
from eventide.plans.registry import query, round_doubles
from eventide.sources import tables

CONFIG = N.EventConfig(alfa=1.0, lmda=5.0, var_df0=10.0, var_scale0=0.3)
MODE = 10.0 / 12.0 * 0.3

_VAR = f"(case when ns[k] > 1 then (10.0*0.3 + m2s[k][j])/(12.0 + ns[k]) else {MODE!r} end)"
_LIK = f"-0.5*list_sum(list_transform(generate_series(1, 64), lambda j: (s[j]-mus[k][j])**2/{_VAR} + ln(2*pi()*{_VAR})))"
_ISO = f"-0.5*(list_dot_product(s, s)/{MODE!r} + 64*ln(2*pi()*{MODE!r}))"


def lse(x: str) -> str:
    return f"(list_max({x}) + ln(list_sum(list_transform({x}, lambda q: exp(q - list_max({x}))))))"


def _grown(name: str, put: str) -> str:
    return (
        f"list_transform(generate_series(1, greatest(len(ns), topic+1)), lambda k: "
        f"case when k = topic+1 then {put} else {name}[k] end)"
    )


def event_ctes(source: str, base: str | None = None) -> str:
    """CTEs ending in ``ev``, one row per scene of ``source`` with all results; ``base`` selects the first scenes."""
    old, n1 = "coalesce(mus[topic+1][j], 0)", "(coalesce(ns[topic+1], 0)+1)"
    base = base or f"""select seq_id, pos, 0 as topic, true as is_boundary, [scene] as mus, [list_transform(scene, lambda x: 0::double)] as m2s,
  [1] as ns, [0::double] as log_like, [1::double] as log_prior, 0::double as lbp, 0::double as pe from {source} where pos = 0"""
    return f"""ev as (
 {base}
 union all
 select seq_id, pos, topic, topic <> prev or restart > rep as is_boundary,
  {_grown('mus', f"list_transform(generate_series(1, 64), lambda j: {old} + (s[j]-{old})/{n1})")} as mus,
  {_grown('m2s', f"list_transform(generate_series(1, 64), lambda j: coalesce(m2s[topic+1][j], 0) + (s[j]-{old})*(s[j]-({old} + (s[j]-{old})/{n1})))")} as m2s,
  {_grown('ns', n1)} as ns,
  list_transform(generate_series(1, len(lik)), lambda k: case when k = prev+1 then lik[k] + ln(2.0::double) else lik[k] end) as log_like,
  list_transform(generate_series(1, len(lik)), lambda k: case when k > len(ns) then ln(1.0::double) else ln(ns[k] + case when k = prev+1 then 2.5 else 0 end) end) as log_prior,
  {lse('a')} - {lse('list_append(a, rep)')} as lbp,
  sqrt(list_sum(list_transform(generate_series(1, 64), lambda j: (s[j]-mus[prev+1][j])**2))) as pe
 from (select *, (list_position(cand, list_max(cand)) - 1)::int as topic,
    list_transform(generate_series(1, len(cand)), lambda k: case when k = prev+1 then restart else cand[k] end) as a from (
  select *, list_transform(generate_series(1, len(lik)), lambda k: case when k = prev+1 then greatest(restart, rep)
     when k > len(ns) then ln(1.0::double) + lik[k] else ln(ns[k]) + lik[k] end) as cand from (
   select *, lik[prev+1] + ln(ns[prev+1]) as restart, lik[prev+1] + ln(ns[prev+1] + 5.0) as rep from (
    select *, list_append(list_transform(generate_series(1, len(ns)), lambda k: {_LIK}), {_ISO}) as lik
    from (select p.seq_id, n.pos, p.topic as prev, p.mus, p.m2s, p.ns, n.scene as s
          from ev p join {source} n on n.seq_id = p.seq_id and n.pos = p.pos + 1)))))),
evr as (select *, list_transform(generate_series(1, len(log_like)), lambda k: log_like[k] + log_prior[k]) as joint from ev)"""


EV = f"with recursive {LONG}, {event_ctes('long')}"


@query("event_run", f"""{EV} select seq_id, pos, topic, is_boundary, (list_position(joint, list_max(joint)) - 1)::int as e_hat,
 round({lse('joint')}, 6) + 0.0::double as log_loss, round(lbp, 6) + 0.0::double as log_boundary_probability, round(pe, 6) as pe from evr""")
def event_run(spark, sf):
    return round_doubles(N.run_events(tables.long_scenes(spark, sf), CONFIG))


@query("event_posterior", f"""{EV} select seq_id, pos, (k-1)::int as k, round(log_like[k], 6) + 0.0::double as log_like, round(log_prior[k], 6) + 0.0::double as log_prior,
 round(case when pos = 0 then 1 else exp(joint[k] - {lse('joint')}) end, 6) as post from evr, unnest(generate_series(1, len(joint))) g(k)""")
def event_posterior(spark, sf):
    rows = N.run_events(tables.long_scenes(spark, sf), CONFIG, full=True)
    cells = F.posexplode(F.arrays_zip("log_like", "log_prior", "post")).alias("k", "c")
    return round_doubles(rows.select("seq_id", "pos", cells).select("seq_id", "pos", "k", "c.*"))


@query("event_surprise", f"""{EV}, l as (select *, lag(joint) over (partition by seq_id order by pos) as pj from evr)
select seq_id, pos, round(case when pos = 0 then 0 else {lse('list_transform(generate_series(1, len(pj)), lambda k: pj[k] + log_like[k])')} - {lse('pj')} end, 6) + 0.0::double as surprise from l""")
def event_surprise(spark, sf):
    rows = N.run_events(tables.long_scenes(spark, sf), CONFIG, full=True)
    return round_doubles(N.event_surprise(rows))


@query("error_ratio", f"""{EV}, l as (select *, lag(pe) over (partition by seq_id order by pos) as pp from evr)
select seq_id, pos, round(pe, 6) as pe, round(case when pp > 0 then pe/pp end, 6) as pe_ratio from l""")
def error_ratio(spark, sf):
    rows = N.run_events(tables.long_scenes(spark, sf), CONFIG).select("seq_id", "pos", "pe")
    return round_doubles(prediction_error_ratio(rows))


@query("boundary_probability_bins", f"""{EV}, l as (select *, lag((list_position(joint, list_max(joint)) - 1)::int) over (partition by seq_id order by pos) as pe_hat from evr),
f as (select seq_id, pos, (pos+1)/7.0::double as t, case when pos = 0 then 0 else
  {lse('list_transform(list_filter(generate_series(1, len(joint)), lambda k: k <> pe_hat + 1), lambda k: joint[k])')} - {lse('joint')} end as lp from l),
ends as (select seq_id, (ceil(max(t)) - 1)::int as last from f group by 1)
select f.seq_id, floor(t)::int as bin, round(ln(sum(exp(lp))) - ln(7.0::double), 6) + 0.0::double as log_p from f join ends using (seq_id)
where floor(t) <= last group by 1, 2""")
def boundary_probability_bins(spark, sf):
    rows = N.run_events(tables.long_scenes(spark, sf), CONFIG, full=True)
    joint = rows.select("seq_id", "pos", V.add(F.col("log_like"), F.col("log_prior")).alias("log_post"))
    return round_doubles(P.binned_boundary_probability(P.boundary_log_probability(joint), 7.0, 1.0))


# Events with known borders: runs of equal labels.
TOKENS = f"""{LONG}, ch as (select *, coalesce((label <> lag(label) over (partition by seq_id order by pos))::int, 0) as chg from long),
tk as (select *, sum(chg) over (partition by seq_id order by pos)::int as token_id from ch),
tok as (select seq_id, token_id, list(scene order by pos) as xs, count(*)::int as n from tk group by 1, 2),
tokm as (select *, list_transform(generate_series(1, 64), lambda j: list_avg(list_transform(xs, lambda x: x[j]))) as tm from tok),
toks as (select *, list_transform(generate_series(1, 64), lambda j: list_sum(list_transform(xs, lambda x: (x[j]-tm[j])**2))) as t2 from tokm)"""
_TLIK = f"list_sum(list_transform(xs, lambda s: {_LIK}))"
_TISO = f"list_sum(list_transform(xs, lambda s: {_ISO}))"
_N0 = "coalesce(ns[topic+1], 0)"
_MU0 = "coalesce(mus[topic+1][j], 0)"


@query("event_tokens", f"""with recursive {TOKENS}, w as (
 select seq_id, token_id, 0 as topic, n, [tm] as mus, [t2] as m2s, [n] as ns, [ln(1.0::double) + {_TISO}] as joint from toks where token_id = 0
 union all
 select seq_id, token_id, topic, n,
  {_grown('mus', f"list_transform(generate_series(1, 64), lambda j: {_MU0} + (tm[j]-{_MU0})*n/({_N0}+n))")} as mus,
  {_grown('m2s', f"list_transform(generate_series(1, 64), lambda j: coalesce(m2s[topic+1][j], 0) + t2[j] + (tm[j]-{_MU0})**2*{_N0}*n/({_N0}+n))")} as m2s,
  {_grown('ns', f"{_N0}+n")} as ns, joint
 from (select *, (list_position(joint, list_max(joint)) - 1)::int as topic from (
   select *, list_append(list_transform(generate_series(1, len(ns)), lambda k: ln(ns[k] + case when k = prev+1 then 5.0 else 0 end) + {_TLIK}), ln(1.0::double) + {_TISO}) as joint
   from (select p.seq_id, n.token_id, p.topic as prev, p.mus, p.m2s, p.ns, n.xs, n.n, n.tm, n.t2
     from w p join toks n on n.seq_id = p.seq_id and n.token_id = p.token_id + 1))))
select seq_id, token_id, topic, n::bigint as n_scenes, round({lse('joint')}, 6) as log_loss, len(joint)::int as candidates from w""")
def event_tokens(spark, sf):
    lagged = with_lag(tables.long_scenes(spark, sf), {"_prev": "label"})
    changed = F.coalesce((F.col("label") != F.col("_prev")).cast("int"), F.lit(0))
    return round_doubles(
        N.run_events_with_tokens(numbered_events(lagged.withColumn("_c", changed)), CONFIG).select(
            "seq_id", "token_id", "topic", "n_scenes", "log_loss", F.size("log_like").alias("candidates")
        )
    )


def numbered_events(marked):
    """``token_id``: running number of changes ``_c``, block-wise."""
    joined, w = with_carry(
        marked,
        ["seq_id"],
        {"_block_sum": F.sum("_c")},
        lambda before, _: {"_earlier": F.coalesce(F.sum("_block_sum").over(before), F.lit(0))},
    )
    return joined.select("*", (F.sum("_c").over(w) + F.col("_earlier")).cast("int").alias("token_id"))


EVENT_COLUMNS = f"""seq_id, pos, topic, is_boundary, (list_position(joint, list_max(joint)) - 1)::int as e_hat,
 round({lse('joint')}, 6) + 0.0::double as log_loss, round(lbp, 6) + 0.0::double as log_boundary_probability, round(pe, 6) as pe from evr"""

# The model of all labelled scenes, and the first scene of a sequence against it.
_MODEL = """xs as (select label, list(scene) as xs, count(*)::double as n from short group by 1),
means as (select *, list_transform(generate_series(1, 64), lambda j: list_avg(list_transform(xs, lambda x: x[j]))) as mu from xs),
devs as (select *, list_transform(generate_series(1, 64), lambda j: list_sum(list_transform(xs, lambda x: (x[j]-mu[j])**2))) as m2 from means),
model as (select list(mu order by label) as mus, list(m2 order by label) as m2s, list(n order by label) as ns from devs)"""
_WARM_BASE = f"""select seq_id, pos, topic, true as is_boundary,
  {_grown('mus', f"list_transform(generate_series(1, 64), lambda j: {_MU0} + (s[j]-{_MU0})/({_N0}+1))")} as mus,
  {_grown('m2s', f"list_transform(generate_series(1, 64), lambda j: coalesce(m2s[topic+1][j], 0) + (s[j]-{_MU0})*(s[j]-({_MU0} + (s[j]-{_MU0})/({_N0}+1))))")} as m2s,
  {_grown('ns', f"{_N0}+1")} as ns, [0::double] as log_like, [1::double] as log_prior, 0::double as lbp, 0::double as pe
 from (select *, (list_position(cand, list_max(cand)) - 1)::int as topic from (
   select *, list_append(list_transform(generate_series(1, len(ns)), lambda k: ln(ns[k]) + {_LIK}), {_ISO}) as cand
   from (select seq_id, pos, scene as s, mus, m2s, ns from short, model where pos = 0)))"""


@query("warm_start_run", f"with recursive {SHORT}, {_MODEL}, {event_ctes('short', _WARM_BASE)} select {EVENT_COLUMNS}")
def warm_start_run(spark, sf):
    """Sequences scored from a model fitted on all labelled scenes."""
    scenes = tables.short_scenes(spark, sf)
    model = M.topic_moments(scenes, "label").withColumnRenamed("label", "topic")
    return round_doubles(N.run_events(scenes, CONFIG, model=model))


# A model that predicts no change: first scenes by their mean, variances by the errors so far.
_ERR_VAR = f"(case when es[k] > 1 then (3.0 + e2s[k][j])/(12.0 + es[k]) else {MODE!r} end)"
_FIRST_LIK = f"-0.5*list_sum(list_transform(generate_series(1, 64), lambda j: (s[j]-f0s[k][j])**2/{_ERR_VAR} + ln(2*pi()*{_ERR_VAR})))"
_NEXT_LIK = f"-0.5*list_sum(list_transform(generate_series(1, 64), lambda j: (s[j]-xp[j])**2/{_ERR_VAR} + ln(2*pi()*{_ERR_VAR})))"
_ERR = "(case when opens then s[j]-coalesce(f0s[topic+1][j], s[j]) else s[j]-xp[j] end)"
_SEEN = "(coalesce(es[topic+1], 0) + case when opens and topic = len(ns) then 0 else 1 end)"
_EM = "coalesce(ems[topic+1][j], 0)"
_STEP = f"(case when {_SEEN} = 0 then 0 else ({_ERR}-{_EM})/{_SEEN} end)"
_STARTS = "(coalesce(sts[topic+1], 0) + case when opens then 1 else 0 end)"
_OVER = "list_transform(generate_series(1, 64), lambda j: {0})"
_F0 = "coalesce(f0s[topic+1][j], 0)"
_LAST = f"""ev as (
 select seq_id, pos, 0 as topic, true as is_boundary, [scene] as f0s, [1] as sts, [0] as es, [list_transform(scene, lambda x: 0::double)] as ems,
  [list_transform(scene, lambda x: 0::double)] as e2s, [1] as ns, scene as xp, [0::double] as log_like, [1::double] as log_prior, 0::double as lbp, 0::double as pe
 from short where pos = 0
 union all
 select seq_id, pos, topic, opens,
  {_grown('f0s', _OVER.format(f"case when opens then {_F0} + (s[j]-{_F0})/{_STARTS} else {_F0} end"))} as f0s, {_grown('sts', _STARTS)} as sts,
  {_grown('es', _SEEN)} as es, {_grown('ems', _OVER.format(f"{_EM} + {_STEP}"))} as ems,
  {_grown('e2s', _OVER.format(f"coalesce(e2s[topic+1][j], 0) + ({_ERR}-{_EM})*({_ERR}-({_EM} + {_STEP}))"))} as e2s,
  {_grown('ns', "coalesce(ns[topic+1], 0) + 1")} as ns, s as xp,
  list_transform(generate_series(1, len(lik)), lambda k: case when k = prev+1 then greatest(lik[k], fol) + ln(1 + exp(-abs(lik[k] - fol))) else lik[k] end) as log_like,
  list_transform(generate_series(1, len(lik)), lambda k: case when k > len(ns) then ln(1.0::double) else ln(ns[k] + case when k = prev+1 then 2.5 else 0 end) end) as log_prior,
  {lse('a')} - {lse('list_append(a, rep)')} as lbp, sqrt(list_sum(list_transform(generate_series(1, 64), lambda j: (s[j]-xp[j])**2))) as pe
 from (select *, topic <> prev or restart > rep as opens from (
  select *, (list_position(cand, list_max(cand)) - 1)::int as topic,
    list_transform(generate_series(1, len(cand)), lambda k: case when k = prev+1 then restart else cand[k] end) as a from (
  select *, list_transform(generate_series(1, len(lik)), lambda k: case when k = prev+1 then greatest(restart, rep)
     when k > len(ns) then ln(1.0::double) + lik[k] else ln(ns[k]) + lik[k] end) as cand from (
   select *, lik[prev+1] + ln(ns[prev+1]) as restart, fol + ln(ns[prev+1] + 5.0) as rep from (
    select *, list_append(list_transform(generate_series(1, len(ns)), lambda k: {_FIRST_LIK}), {_ISO}) as lik,
      list_transform([prev+1], lambda k: {_NEXT_LIK})[1] as fol
    from (select p.seq_id, n.pos, p.topic as prev, p.f0s, p.sts, p.es, p.ems, p.e2s, p.ns, p.xp, n.scene as s
          from ev p join short n on n.seq_id = p.seq_id and n.pos = p.pos + 1))))))),
evr as (select *, list_transform(generate_series(1, len(log_like)), lambda k: log_like[k] + log_prior[k]) as joint from ev)"""


@query("last_scene_run", f"with recursive {SHORT}, {_LAST} select {EVENT_COLUMNS}")
def last_scene_run(spark, sf):
    """The plug-in path: a model that predicts no change."""
    config = N.EventConfig(alfa=1.0, lmda=5.0, var_df0=10.0, var_scale0=0.3, factory=N.LastSceneModel)
    return round_doubles(N.run_events(tables.short_scenes(spark, sf), config))


@query("event_run_resumed", f"{EV} select {EVENT_COLUMNS}")
def event_run_resumed(spark, sf):
    """Two runs, the second one from what the first one left: the same rows as one run."""
    scenes, early = tables.long_scenes(spark, sf), F.col("pos") % 100 < 37 + F.col("seq_id") % 20
    first = scenes.where(early)
    second = N.run_events(scenes.where(~early), CONFIG, warm=N.handed_over_events(first, CONFIG))
    return round_doubles(N.run_events(first, CONFIG).union(second))
