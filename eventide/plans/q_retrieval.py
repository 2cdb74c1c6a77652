"""The long-term store as queries: retrieval, importance, recognition, session checks, V-measure."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.functions import vector as V
from eventide.operators import metrics, retrieval as R, transitions as T
from eventide.operators.memory import centroids
from eventide.operators.moments import topic_moments
from eventide.operators.positions import with_lag
from eventide.plans.q_transitions import EVENT_TURNS, LONG, SHORT
from eventide.plans.registry import query, round_doubles
from eventide.sources import tables

TOPICS = 2
TURNS = 12


def last_scenes(scenes):
    """The last scene of each sequence as its query."""
    return scenes.groupBy("seq_id").agg(F.max_by("scene", "pos").alias("query"))


CENTROIDS = f"""{LONG}, q as (select seq_id, arg_max(scene, pos) as q from long group by 1),
cells as (select seq_id, label, pos, i, scene[i] as x from long, unnest(generate_series(1, 64)) g(i)),
dims as (select seq_id, label, i, avg(x) as m from cells group by all),
topics as (select seq_id, label, list(m order by i) as c from dims group by all),
spans as (select seq_id, label, count(*) as n, min(pos) as first_pos, max(pos) as last_pos from long group by all),
near as (select seq_id, label, n, first_pos, last_pos, list_cosine_similarity(c, q) as cosine,
  row_number() over (partition by seq_id order by list_cosine_similarity(c, q) desc, label) as rank
  from topics join q using (seq_id) join spans using (seq_id, label))"""


@query("nearest_topics", f"""with {CENTROIDS} select seq_id, label, n, first_pos, last_pos, round(cosine, 6) + 0.0::double as cosine, rank::int as rank
 from near where rank <= {TOPICS}""")
def nearest_topics(spark, sf):
    scenes = tables.long_scenes(spark, sf)
    return round_doubles(R.nearest_topics(scenes, last_scenes(scenes), TOPICS))


@query("memory_window", f"""with {CENTROIDS}, kept as (select l.seq_id, pos, l.label, row_number() over (partition by l.seq_id order by pos desc) as r
  from long l join near using (seq_id, label) where rank <= {TOPICS})
select seq_id, pos, label, (r - 1)::int as back from kept where r <= {TURNS}""")
def memory_window(spark, sf):
    scenes = tables.long_scenes(spark, sf)
    return R.memory_window(scenes, last_scenes(scenes), TOPICS, TURNS)


#: Cosine from which topics merge, and the turns that a topic must have.
MERGE, MERGE_TURNS = 0.25, 3


@query("topic_merge", f"""with recursive {LONG}, cells as (select seq_id * 100 + label as id, i, scene[i] as x from long, unnest(generate_series(1, 64)) g(i)),
dims as (select id, i, count(*) as n, avg(x) as m, sum(x * x) as q from cells group by all),
topics as (select id, any_value(n) as n, list(m order by i) as c from dims group by id),
links as (select a.id as a, b.id as b from topics a join topics b on a.id <> b.id and a.n >= {MERGE_TURNS} and b.n >= {MERGE_TURNS} and list_cosine_similarity(a.c, b.c) >= {MERGE}),
reach as (select id as a, id as b from topics union select r.a, l.b from reach r join links l on r.b = l.a),
firsts as (select a as id, min(b) as first from reach group by a),
sums as (select first, i, sum(d.n) as n, sum(d.n * m) as s, sum(q) as q from firsts join dims d using (id) group by all),
spreads as (select first, any_value(n) as n, sum(q - s * s / n) as spread, list(s / n order by i) as mu from sums group by first)
select first, (select count(*) from firsts f where f.first = s.first) as topics, n::bigint as n, round(mu[1], 6) + 0.0::double as mu_1, round(mu[64], 6) + 0.0::double as mu_64,
 round(spread, 6) + 0.0::double as spread from spreads s""")
def topic_merge(spark, sf):
    """Topics of all sequences whose centroids are alike become one, with the moments of all their scenes."""
    scenes = tables.long_scenes(spark, sf).withColumn("id", F.col("seq_id") * 100 + F.col("label"))
    moments = topic_moments(scenes, "id")
    merged = R.merged_topics(moments, R.topic_merges(moments.withColumnRenamed("mu", "centroid"), MERGE, MERGE_TURNS))
    return round_doubles(merged.select("first", "topics", "n", F.col("mu")[0].alias("mu_1"), F.col("mu")[63].alias("mu_64"), V.total(F.col("m2")).alias("spread")))


@query("sliding_window", f"""with {LONG}, w as (select seq_id, pos, label, row_number() over (partition by seq_id order by pos desc) - 1 as back from long)
select seq_id, pos, label, back::int as back from w where back < {TURNS}""")
def sliding_window(spark, sf):
    return R.sliding_window(tables.long_scenes(spark, sf), TURNS)


@query("nearest_turns", f"""with {LONG}, q as (select seq_id, arg_max(scene, pos) as q from long group by 1),
s as (select seq_id, pos, label, list_cosine_similarity(scene, q) as cosine from long join q using (seq_id)),
r as (select *, row_number() over (partition by seq_id order by cosine desc, pos) as rank from s)
select seq_id, pos, label, round(cosine, 6) + 0.0::double as cosine, rank::int as rank from r where rank <= {TURNS}""")
def nearest_turns(spark, sf):
    scenes = tables.long_scenes(spark, sf)
    return round_doubles(R.nearest_turns(scenes, last_scenes(scenes), TURNS))


@query("topic_importance", f"""with {EVENT_TURNS}, l as (select *, lag(label) over (partition by seq_id order by pos) as prev from event_turns),
t as (select seq_id, label, count(*) as n, max(pos) as last_pos, count(*) filter (pos = 0 or label <> prev) as visits from l group by all),
m as (select distinct seq_id, a as label, b from (select seq_id, label as a, prev as b from l where pos > 0 and label <> prev
  union all select seq_id, prev, label from l where pos > 0 and label <> prev)),
b as (select seq_id, label, count(*) as borders from m group by all),
w as (select seq_id, sum(n) as turns, sum(visits - 1) as rets, count(*) as topics, max(last_pos) as fin from t group by 1)
select t.seq_id, t.label, n, visits - 1 as returns, last_pos, coalesce(borders, 0) as borders,
 round(0.4::double*n/turns + case when rets > 0 then 0.2::double*(visits-1)/rets else 0 end + case when fin > 0 then 0.3::double*last_pos/fin else 0 end
  + case when topics > 1 then 0.1::double*coalesce(borders, 0)/(topics-1) else 0 end, 6) + 0.0::double as importance
from t join w using (seq_id) left join b on b.seq_id = t.seq_id and b.label = t.label""")
def topic_importance(spark, sf):
    return round_doubles(R.topic_importance(tables.event_turns(spark, sf)))


@query("recognition", f"""with {SHORT}, cells as (select label, i, avg(scene[i]) as m from short, unnest(generate_series(1, 64)) g(i) group by all),
c as (select label, list(m order by i) as mean from cells group by 1),
s as (select *, lag(scene) over (partition by seq_id order by pos) as lure from short)
select s.label, count(*) as samples, round(avg(exp(-2.5*list_distance(mean, scene)**2) - exp(-2.5*list_distance(mean, lure)**2)), 6) + 0.0::double as recognition
from s join c using (label) where lure is not null group by 1""")
def recognition(spark, sf):
    """The centroid of the label as the reconstruction, the previous scene as the lure."""
    scenes = tables.short_scenes(spark, sf)
    lured = with_lag(scenes, {"lure": "scene"}).where(F.col("lure").isNotNull())
    samples = lured.join(centroids(scenes, "label").withColumnRenamed("centroid", "mean"), "label").select(
        "label", "mean", V.as_double("scene").alias("scene"), V.as_double("lure").alias("lure")
    )
    return round_doubles(R.recognition(samples, "label"))


SESSIONS = f"""{EVENT_TURNS}, r as (select *, date_trunc('day', ts) as session, coalesce(label <> lag(label) over (partition by seq_id order by pos), true) as is_boundary from event_turns)"""


def session_rows(spark, sf):
    """Sessions are days; a boundary is a change of the event type."""
    turns = tables.event_turns(spark, sf)
    flagged = T.boundary_flags(turns.withColumnRenamed("label", "topic")).select("seq_id", "pos", F.col("topic").alias("label"), "is_boundary", "ts")
    return flagged.withColumn("session", F.date_trunc("day", "ts"))


@query("edge_recall", f"""with {SESSIONS}, e as (select *, session <> lag(session) over (partition by seq_id order by pos) as edge from r)
select count(*) filter (edge) as edges, count(*) filter (edge and is_boundary) as found,
 round(count(*) filter (edge and is_boundary)::double / nullif(count(*) filter (edge), 0), 6) as recall from e""")
def edge_recall(spark, sf):
    return round_doubles(R.edge_recall(session_rows(spark, sf)))


@query("topics_per_session", f"""with {SESSIONS}, s as (select seq_id, session, count(distinct label) as topics from r group by all)
select count(*) as sessions, round(avg(topics), 6) + 0.0::double as topics from s""")
def topics_per_session(spark, sf):
    return round_doubles(R.topics_per_session(session_rows(spark, sf)))


@query("session_purity", f"""with {SESSIONS}, c as (select seq_id, session, label, count(*) as n from r group by all),
t as (select seq_id, session, max(n) as top, sum(n) as n from c group by all)
select seq_id, count(*) as clusters, round(sum(top)::double/sum(n), 6) as purity, round(min(top::double/n), 6) as min_purity from t group by 1""")
def session_purity(spark, sf):
    return round_doubles(metrics.purity(session_rows(spark, sf), "label", "session", "seq_id"))


@query("v_measure", f"""with {EVENT_TURNS}, x as (select label as t, hour(ts) as p, seq_id % 3 as g from event_turns),
c as (select g, t, p, count(*)::double as n from x group by all), ct as (select g, t, sum(n) as n from c group by all), cp as (select g, p, sum(n) as n from c group by all),
s as (select g, (select sum(n*ln(n)) from c where c.g = o.g) as b, (select sum(n*ln(n)) from ct where ct.g = o.g) as st, (select sum(n*ln(n)) from cp where cp.g = o.g) as sp,
  (select sum(n) from c where c.g = o.g) as n from (select distinct g from x) o),
h as (select g, n, 1 - (sp - b)/(n*ln(n) - st) as h, 1 - (st - b)/(n*ln(n) - sp) as k from s)
select g, n::bigint as rows, round(h, 6) + 0.0::double as homogeneity, round(k, 6) + 0.0::double as completeness, round(2*h*k/(h+k), 6) + 0.0::double as v_measure from h""")
def v_measure(spark, sf):
    turns = tables.event_turns(spark, sf).select((F.col("seq_id") % 3).alias("g"), "label", F.hour("ts").alias("hour"))
    return round_doubles(metrics.v_measure(turns, "label", "hour", "g"))
