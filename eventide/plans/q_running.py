"""Label-given analytics: moments, running state, label probability, fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.functions import prior as P, text as X, vector as V
from eventide.operators import moments as M, running as R
from eventide.operators.positions import with_lag
from eventide.plans.q_transitions import EVENT_TURNS, FEAT, LONG, SHORT
from eventide.plans.registry import query, round_doubles
from eventide.sources import tables

SIGMA0 = 0.05
NU0, VAR0 = 10.0, 0.06

CELLS = "cells as (select {keys}, j as dim, scene[j + 1] as x from {source}, unnest(generate_series(0, 63)) g(j))"


def cells(source: str, keys: str) -> str:
    return CELLS.format(source=source, keys=keys)


LABEL_MOMENTS = f"""{SHORT}, {cells('short', 'label')},
m as (select label, dim::int as dim, count(*) as n, avg(x) as mu, var_pop(x) as v from cells group by 1, 2)"""


@query("topic_moments", f"""with {LABEL_MOMENTS}
select label, dim, n, round(mu, 6) + 0.0::double as mu, round(v, 6) as var, round(case when n < 3 then {SIGMA0} else greatest(v, 1e-6) end, 6) as topic_var,
 round(({NU0}*{VAR0} + n*v)/({NU0} + n + 2), 6) as map_var from m""")
def topic_moments(spark, sf):
    m = M.topic_moments(tables.short_scenes(spark, sf), "label")
    n = F.col("n")
    parts = F.arrays_zip(
        F.col("mu"),
        F.transform("m2", lambda x: x / n).alias("var"),
        M.topic_variance(n, F.col("m2"), SIGMA0).alias("topic_var"),
        M.map_variance(n, F.col("m2"), NU0, VAR0).alias("map_var"),
    )
    rows = m.select("label", "n", F.posexplode(parts).alias("dim", "c"))
    return round_doubles(rows.select("label", "dim", "n", "c.mu", "c.var", "c.topic_var", "c.map_var"))


@query("spherical_variance", f"""with {SHORT}, {cells('short', 'label')}
select label, (count(*) / 64)::bigint as n, round(({NU0}*{VAR0} + count(*)*var_pop(x))/({NU0} + count(*) + 2), 6) as var
from cells group by 1""")
def spherical_variance(spark, sf):
    m = M.topic_moments(tables.short_scenes(spark, sf), "label")
    var = M.spherical_map_variance(F.col("n"), F.col("mu"), F.col("m2"), NU0, VAR0)
    return round_doubles(m.select("label", "n", var.alias("var")))


@query("merged_moments", f"""with {LABEL_MOMENTS}
select label, dim, n, round(mu, 6) + 0.0::double as mu, round(v*n, 6) as m2 from m""")
def merged_moments(spark, sf):
    parts = M.topic_moments(tables.short_scenes(spark, sf), "label", "pos")
    m = M.merge_moments(parts, "label")
    rows = m.select("label", "n", F.posexplode(F.arrays_zip("mu", "m2")).alias("dim", "c"))
    return round_doubles(rows.select("label", "dim", "n", "c.mu", "c.m2"))


BOUNDED = f"""{SHORT}, marked as (select *, pos = 0 or label <> lag(label) over (partition by seq_id order by pos) as opens from short)"""


@query("pretrained_model", f"""with {BOUNDED}, {cells('marked', 'label, opens')}
select label as topic, dim::int as dim, count(*) as n, round(avg(x), 6) + 0.0::double as mu, round(var_pop(x)*count(*), 6) as m2,
 sum(opens::int)::bigint as starts, round(avg(x) filter (opens), 6) + 0.0::double as start_mu from cells group by 1, 2""")
def pretrained_model(spark, sf):
    lagged = with_lag(tables.short_scenes(spark, sf), {"_prev": "label"})
    opens = (F.col("pos") == 0) | ~F.col("label").eqNullSafe(F.col("_prev"))
    model = M.pretrain(lagged.withColumn("is_boundary", opens))
    parts = F.posexplode(F.arrays_zip("mu", "m2", "start_mu")).alias("dim", "c")
    rows = model.select("topic", "n", "starts", parts)
    return round_doubles(rows.select("topic", "dim", "n", "c.mu", "c.m2", "starts", "c.start_mu"))


@query("scored_scenes", f"""with {LABEL_MOMENTS},
p as (select seq_id, pos, m.label as topic, any_value(ln(n)) - 0.5*sum((s.scene[dim+1]-mu)**2/greatest(v, 1e-6) + ln(2*pi()*greatest(v, 1e-6))) as score
  from short s join m on true group by 1, 2, 3),
r as (select *, row_number() over (partition by seq_id, pos order by score desc, topic) as rn,
  max(score) over (partition by seq_id, pos) as top from p)
select seq_id, pos, max(topic) filter (rn = 1) as topic, round(max(top), 6) as log_score,
  round(max(top) + ln(sum(exp(score - top))), 6) as log_evidence from r group by 1, 2""")
def scored_scenes(spark, sf):
    scenes = tables.short_scenes(spark, sf)
    model = M.topic_moments(scenes, "label").withColumnRenamed("label", "topic")
    return round_doubles(M.score_scenes(scenes, model, SIGMA0))


@query("running_mean", f"""with {SHORT}, {cells('short', 'seq_id, pos')}
select seq_id, pos, dim::int as dim, round(avg(x) over (partition by seq_id, dim order by pos), 6) + 0.0::double as mean from cells""")
def running_mean(spark, sf):
    rows = R.running_mean(tables.short_scenes(spark, sf))
    return round_doubles(rows.select("seq_id", "pos", F.posexplode("mean").alias("dim", "mean")))


STATE_SQL = f"""{LONG}, {cells('long', 'seq_id, pos, label')},
st as (select *, count(*) over w as n, avg(x) over w as mu, var_pop(x) over w as v,
   count(*) over wi as ni, avg(x) over wi as mui, var_pop(x) over wi as vi from cells
  window w as (partition by seq_id, label, dim order by pos rows between unbounded preceding and 1 preceding),
         wi as (partition by seq_id, label, dim order by pos rows between unbounded preceding and current row)),
sv as (select *, case when n < 3 then {SIGMA0} else greatest(v, 1e-6) end as s2, coalesce(mu, 0) as m from st)"""


@query("running_scores", f"""with {STATE_SQL}
select seq_id, pos, label, any_value(n) as n_before, round(-0.5*sum((x-m)**2/s2 + ln(2*pi()*s2)), 6) as loglik,
  round(sum((x-m)**2/s2), 6) as prediction_error from sv group by 1, 2, 3""")
def running_scores(spark, sf):
    return round_doubles(R.running_scores(tables.long_scenes(spark, sf), SIGMA0))


@query("boundary_scores", f"""with {STATE_SQL}, prior as (select *, lag(x) over pw as px, lag(ni) over pw as pn, lag(mui) over pw as pm, lag(vi) over pw as pv from st
  window pw as (partition by seq_id, dim order by pos))
select seq_id, pos, round(sum((x-pm)**2/case when pn < 3 then {SIGMA0} else greatest(pv, 1e-6) end), 6) as score
from prior where pos > 0 group by 1, 2""")
def boundary_scores(spark, sf):
    return round_doubles(R.boundary_scores(tables.long_scenes(spark, sf), SIGMA0))


COUNTS = f"""{EVENT_TURNS}, c0 as (select *, row_number() over (partition by seq_id, label order by pos) - 1 as c,
  coalesce(label = lag(label) over (partition by seq_id order by pos), false) as repeats from event_turns)"""


@query("running_counts", f"with {COUNTS} select seq_id, pos, label, c, repeats, "
       "(case when c = 0 then 1.0 else c + case when repeats then 10.0 else 0 end end)::double as prior from c0")
def running_counts(spark, sf):
    rows = R.running_counts(tables.event_turns(spark, sf))
    sticky = F.when(F.col("repeats"), F.lit(10.0)).otherwise(F.lit(0.0))
    prior = F.when(F.col("c") == 0, F.lit(1.0)).otherwise(F.col("c") + sticky)
    return rows.select("seq_id", "pos", "label", F.col("c").cast("bigint"), "repeats", prior.alias("prior"))


@query("label_logprob", f"""with {COUNTS}
select seq_id, count(*) as turns, round(sum(case when c = 0 then ln(1.0::double) else ln(c + case when repeats then 10 else 0 end) end
  - ln(1.0 + pos + case when repeats then 10 else 0 end)), 6) as log_prob from c0 group by 1""")
def label_logprob(spark, sf):
    return round_doubles(R.label_logprob(tables.event_turns(spark, sf), 1.0, 10.0))


# Slots of the prior: labels in order of first use would need state; here slots are the five
# event types in name order, and the counts are those before each turn.
@query("sticky_prior", """with t as (select user_id as seq_id, event_type, row_number() over (partition by user_id order by ts, event_id) as rn from events),
h as (select seq_id, event_type, count(*) as c from t group by 1, 2),
types as (select distinct event_type from events),
slots as (select u.seq_id, y.event_type, coalesce(h.c, 0) as c, row_number() over (partition by u.seq_id order by coalesce(h.c, 0) desc, y.event_type) - 1 as slot
  from (select distinct seq_id from t) u cross join types y left join h on h.seq_id = u.seq_id and h.event_type = y.event_type),
used as (select seq_id, sum((c > 0)::int) as k from slots group by 1)
select seq_id, slot::int as slot, (c + case when slot = k then 1.5 else 0 end + case when slot = 0 then 10.0 else 0 end)::double as prior
from slots join used using (seq_id)""")
def sticky_prior(spark, sf):
    per = tables.table(spark, sf, "events").groupBy(F.col("user_id").alias("seq_id"), "event_type").agg(
        F.count("*").alias("c")
    )
    used = per.groupBy("seq_id").agg(F.sort_array(F.collect_list("c"), asc=False).alias("counts"))
    n_types = tables.table(spark, sf, "events").agg(F.count_distinct("event_type").alias("n"))
    padded = used.withColumn("n", n_types.scalar()).select(
        "seq_id",
        F.concat("counts", F.array_repeat(F.lit(0).cast("bigint"), (F.col("n") - F.size("counts")).cast("int"))).alias("counts"),
    )
    prior = P.sticky_prior(F.col("counts"), F.lit(0), 1.5, 10.0)
    return padded.select("seq_id", F.posexplode(prior).alias("slot", "prior"))


@query("last_in_topic", f"""with {LONG}, l as (select *, lag(scene) over (partition by seq_id, label order by pos) as prev from long)
select seq_id, pos, label, round(list_dot_product(scene, prev), 6) + 0.0::double as last_dot from l""")
def last_in_topic(spark, sf):
    rows = R.previous_in_topic(tables.long_scenes(spark, sf))
    d = V.dot(V.as_double("scene"), V.as_double("last_scene"))
    return round_doubles(rows.select("seq_id", "pos", "label", d.alias("last_dot")))


@query("moving_anchor", f"""with recursive {LONG}, r as (select *, row_number() over (partition by seq_id, label order by pos) as rn from long),
w as (select seq_id, label, pos, rn, scene as anchor, null::double as anchor_cos from r where rn = 1
 union all select n.seq_id, n.label, n.pos, n.rn, list_transform(generate_series(1, 64), lambda j: 0.3*n.scene[j] + 0.7*w.anchor[j]),
  list_dot_product(w.anchor, n.scene)/(sqrt(list_dot_product(w.anchor, w.anchor))*sqrt(list_dot_product(n.scene, n.scene)))
 from w join r n on n.seq_id = w.seq_id and n.label = w.label and n.rn = w.rn + 1)
select seq_id, pos, label, round(anchor_cos, 6) + 0.0::double as anchor_cos from w""")
def moving_anchor(spark, sf):
    return round_doubles(R.moving_anchor(tables.long_scenes(spark, sf), 0.3))


@query("trailing_variance", f"""with {LONG}, {cells('long', 'seq_id, pos, label')}
select seq_id, pos, dim::int as dim, round(var_pop(x) over (partition by seq_id, label, dim order by pos rows between 3 preceding and current row), 6) as trailing_var from cells""")
def trailing_variance(spark, sf):
    rows = R.trailing_variance(tables.long_scenes(spark, sf), 4)
    return round_doubles(rows.select("seq_id", "pos", F.posexplode("trailing_var").alias("dim", "trailing_var")))


@query("known_tokens", f"""with {FEAT}, k as (select seq_id, pos, tokens, flatten(list(tokens) over (partition by seq_id, label order by pos
  rows between unbounded preceding and 1 preceding)) as seen from feat)
select seq_id, pos, coalesce(len(list_distinct(seen)), 0)::int as n_known,
 round(case when coalesce(len(seen), 0) = 0 or len(tokens) = 0 then 0 else len(list_intersect(tokens, seen))::double/len(list_distinct(list_concat(tokens, seen))) end, 6) as overlap
from k""")
def known_tokens(spark, sf):
    turns = tables.dialogue_turns(spark, sf).withColumn("tokens", X.tokens("text"))
    return round_doubles(R.known_token_counts(turns).select("seq_id", "pos", "n_known", "overlap"))


# Every per-pair vector function, on neighbouring scenes.
PAIR = f"""{SHORT}, p as (select seq_id, pos, scene as a, lag(scene) over (partition by seq_id order by pos) as b from short),
q as (select *, list_dot_product(a, a) as aa, list_dot_product(b, b) as bb, list_dot_product(a, b) as ab,
  list_transform(generate_series(1, 64), lambda j: (a[j]+b[j])/2) as mu,
  list_transform(generate_series(1, 64), lambda j: 0.01 + 0.001*j) as v from p where pos > 0)"""


@query("vector_functions", f"""with {PAIR}
select seq_id, pos, round(ab, 6) + 0.0::double as dot, round(ab/(sqrt(aa)*sqrt(bb)), 6) + 0.0::double as cosine,
 round(list_dot_product(a, mu)/(sqrt(list_dot_product(mu, mu)) + 1e-9), 6) + 0.0::double as to_centroid,
 round(sqrt(list_sum(list_transform(generate_series(1, 64), lambda j: (a[j]-b[j])**2))), 6) as euclid,
 round(-0.5*list_sum(list_transform(generate_series(1, 64), lambda j: (a[j]-mu[j])**2/v[j] + ln(2*pi()*v[j]))), 6) as diagonal,
 round(-0.5*list_sum(list_transform(generate_series(1, 64), lambda j: (a[j]-b[j])**2/v[j] + ln(2*pi()*v[j]))), 6) as zero_mean,
 round(-0.5*(aa/0.05 + 64*ln(2*pi()*0.05)), 6) as isotropic,
 round(list_sum(list_transform(generate_series(1, 64), lambda j: (a[j]-mu[j])**2/v[j])), 6) as error,
 round(5.0*list_dot_product(a, mu)/(sqrt(list_dot_product(mu, mu)) + 1e-9), 6) + 0.0::double as vmf,
 round(ab/(sqrt(aa)*sqrt(bb))/0.1, 6) + 0.0::double as anchor,
 round(ln(list_sum(list_transform(a, lambda x: exp(x)))), 6) as lse
from q""")
def vector_functions(spark, sf):
    lagged = with_lag(tables.short_scenes(spark, sf), {"b": "scene"}).where(F.col("pos") > 0)
    dims = F.sequence(F.lit(1), F.lit(64))
    q = lagged.select(
        "seq_id", "pos", V.as_double("scene").alias("a"), V.as_double("b").alias("b"),
        F.transform(dims, lambda j: j * 0.001 + 0.01).alias("v"),
    ).withColumn("mu", V.scale(V.add(F.col("a"), F.col("b")), 0.5))
    a, b, v, mu = (F.col(c) for c in ("a", "b", "v", "mu"))
    return round_doubles(
        q.select(
            "seq_id", "pos",
            V.dot(a, b).alias("dot"),
            V.cosine(a, b).alias("cosine"),
            V.cosine_to_centroid(a, mu).alias("to_centroid"),
            V.distance("euclidean", a, b).alias("euclid"),
            V.diagonal_loglik(a, mu, v).alias("diagonal"),
            V.zero_mean_loglik(V.subtract(a, b), v).alias("zero_mean"),
            V.isotropic_loglik(a, 0.05).alias("isotropic"),
            V.prediction_error(a, mu, v).alias("error"),
            P.vmf_score(a, mu, 5.0).alias("vmf"),
            P.anchor_score(a, b, 0.1).alias("anchor"),
            V.array_logsumexp(a).alias("lse"),
        )
    )
