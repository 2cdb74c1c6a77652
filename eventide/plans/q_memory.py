"""Binding, clean-up, noisy traces and their reconstruction, linear dynamics."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.functions import hashed as H, vector as V
from eventide.operators import binding as B, memory as Y, metrics, moments as M
from eventide.operators.dynamics import linear_dynamics
from eventide.plans.q_transitions import SHORT
from eventide.plans.registry import query, round_doubles
from eventide.sources import tables

DIM = 64
ROLES = ["Verb", "Agent", "Patient"]


def uniform_sql(key: str, i: int = 0) -> str:
    return f"((('0x' || substr(md5({key}), {8 * i + 1}, 8))::bigint + 0.5::double)/4294967296)"


def normal_sql(key: str) -> str:
    return f"(sqrt(-2*ln({uniform_sql(key, 0)}))*cos({uniform_sql(key, 1)}*6.283185307179586::double))"


@query("symbol_vectors", f"""select name, d::int as dim, round({normal_sql("name || ':' || d")}/sqrt(64.0::double), 6) + 0.0::double as x
 from (select distinct event_type as name from events), unnest(generate_series(0, 63)) g(d)""")
def symbol_vectors(spark, sf):
    names = tables.table(spark, sf, "events").select(F.col("event_type").alias("name"))
    return round_doubles(B.symbol_table(names, DIM).select("name", F.posexplode("vec").alias("dim", "x")))


@query("symbol_kinds", f"""with n as (select distinct event_type as name from events), g as (select name, d from n, unnest(generate_series(0, 63)) g(d))
select name, d::int as dim, round(case when {uniform_sql("name || ':' || d", 2)} < 0.3 then {normal_sql("name || ':' || d")} else 0 end, 6) + 0.0::double as spike_slab,
 (d = floor({uniform_sql("name || ':hot'")}*64))::int::double as one_hot from g""")
def symbol_kinds(spark, sf):
    names = tables.table(spark, sf, "events").select(F.col("event_type").alias("name")).distinct()
    both = names.select(
        "name",
        F.arrays_zip(
            H.symbol_vector(F.col("name"), DIM, "spike_slab", 0.3).alias("spike_slab"),
            H.symbol_vector(F.col("name"), DIM, "one_hot").alias("one_hot"),
        ).alias("z"),
    )
    return round_doubles(both.select("name", F.posexplode("z").alias("dim", "c")).select("name", "dim", "c.*"))


ROLE_SQL = f"""roles as (select r as role, i, list_transform(generate_series(0, 63), lambda d: {normal_sql("r || ':' || d")}/sqrt(64.0::double)) as rv
  from (values ('Verb', 0), ('Agent', 1), ('Patient', 2)) t(r, i))"""


def _convolve(a: str, b: str, sign: str) -> str:
    j = "(k - i + 64) % 64" if sign == "bind" else "(i - k + 64) % 64"
    inner = f"list_sum(list_transform(generate_series(0, 63), lambda i: {a}[i+1]*{b}[{j}+1]))"
    scale = "" if sign == "bind" else "/64"
    return f"list_transform(generate_series(0, 63), lambda k: {inner}{scale})"


PARTS = f"""{SHORT}, {ROLE_SQL}, bound as (select s.seq_id, s.pos, s.pos // 3 as sentence, s.vec_id, r.role, s.scene, r.rv,
  {_convolve('s.scene', 'r.rv', 'bind')} as b from short s join roles r on r.i = s.pos % 3)"""


def _roles(spark):
    names = spark.createDataFrame([(r,) for r in ROLES], "name string")
    return B.symbol_table(names, DIM)


def _parts(spark, sf):
    scenes = tables.short_scenes(spark, sf)
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("pos") % 3 + 1).cast("int"))
    return scenes.select(
        "seq_id", "pos", F.floor(F.col("pos") / 3).cast("bigint").alias("sentence"), role.alias("role"),
        F.col("vec_id").cast("string").alias("filler"), V.as_double("scene").alias("scene"),
    )


@query("bind", f"""with {PARTS} select seq_id, pos, k::int as dim, round(b[k+1], 6) + 0.0::double as x
 from bound, unnest(generate_series(0, 63)) g(k)""")
def bind_query(spark, sf):
    roles = _roles(spark).select(F.col("name").alias("role"), F.col("vec").alias("rv"))
    bound = _parts(spark, sf).join(roles, "role").select("seq_id", "pos", B.bind("scene", "rv").alias("b"))
    return round_doubles(bound.select("seq_id", "pos", F.posexplode("b").alias("dim", "x")))


def _sentences(spark, sf):
    parts = _parts(spark, sf)
    fillers = parts.select(F.col("filler").alias("name"), F.col("scene").alias("vec"))
    return B.encode_sentences(parts.drop("scene"), fillers, _roles(spark), "seq_id", "sentence")


SENTENCES = f"""{PARTS}, cells as (select seq_id, sentence, k, sum(b[k+1]) as x from bound, unnest(generate_series(0, 63)) g(k) group by 1, 2, 3),
sent as (select seq_id, sentence, list(x order by k) as vec from cells group by 1, 2)"""


@query("sentence_vectors", f"""with {SENTENCES} select seq_id, sentence, k::int as dim, round(x, 6) + 0.0::double as x from cells""")
def sentence_vectors(spark, sf):
    rows = _sentences(spark, sf)
    return round_doubles(rows.select("seq_id", "sentence", F.posexplode("vec").alias("dim", "x")))


DECODED = f"""{SENTENCES}, dec as (select seq_id, sentence, role, {_convolve('vec', 'rv', 'unbind')} as vec from sent, roles)"""


def _decoded(spark, sf):
    """Each sentence unbound with each role (the three roles are a fixed list)."""
    role = F.explode(F.array(*map(F.lit, ROLES))).alias("role")
    roles = _roles(spark).select(F.col("name").alias("role"), F.col("vec").alias("rv"))
    asked = _sentences(spark, sf).select("seq_id", "sentence", "vec", role).join(roles, "role")
    return asked.select("seq_id", "sentence", "role", B.unbind("vec", "rv").alias("vec"))


@query("unbind", f"""with {DECODED} select d.seq_id, d.sentence, d.role, b.pos,
  round(list_dot_product(d.vec, b.scene)/(sqrt(list_dot_product(d.vec, d.vec))*sqrt(list_dot_product(b.scene, b.scene))), 6) + 0.0::double as cosine,
  round((select corr(d.vec[k], b.scene[k]) from unnest(generate_series(1, 64)) g(k)), 6) + 0.0::double as r
 from dec d join bound b on b.seq_id = d.seq_id and b.sentence = d.sentence and b.role = d.role""")
def unbind_query(spark, sf):
    fillers = _parts(spark, sf).drop("filler")
    pairs = _decoded(spark, sf).join(fillers, ["seq_id", "sentence", "role"])
    scored = pairs.withColumn("cosine", V.cosine(F.col("vec"), F.col("scene")))
    r = metrics.pearson(scored, "vec", "scene", "seq_id", "sentence", "role", "pos", "cosine")
    return round_doubles(r)


VOCABULARY = """vocab as (select label::varchar as name, list(m order by j) as v from (
  select label, j, avg(scene[j]) as m from short, unnest(generate_series(1, 64)) g(j) group by 1, 2) group by 1)"""


def _vocabulary(spark, sf):
    m = M.topic_moments(tables.short_scenes(spark, sf), "label")
    return m.select(F.col("label").cast("string").alias("name"), F.col("mu").alias("vec"))


def _cleanup_sql(k: int) -> str:
    return f"""with {DECODED}, {VOCABULARY}, sc as (select seq_id, sentence, role, name, -50*(1 - list_dot_product(vec, v)/(sqrt(list_dot_product(vec, vec))*sqrt(list_dot_product(v, v)))) as s
  from dec, vocab), p as (select *, exp(s - max(s) over w)/sum(exp(s - mx)) over w as prob from (select *, max(s) over (partition by seq_id, sentence, role) as mx from sc) window w as (partition by seq_id, sentence, role)),
r as (select *, row_number() over (partition by seq_id, sentence, role order by s desc, name) as rank from p)
select seq_id, sentence, role, rank::int as rank, name, round(prob, 6) as prob from r where rank <= {k}"""


@query("cleanup_topk", _cleanup_sql(3))
def cleanup_topk(spark, sf):
    return round_doubles(B.cleanup(_decoded(spark, sf), _vocabulary(spark, sf), 3))


@query("cleanup_blocks", _cleanup_sql(4))
def cleanup_blocks(spark, sf):
    """The route for vocabularies that are too large for one task."""
    return round_doubles(B.cleanup(_decoded(spark, sf), _vocabulary(spark, sf), 4, blocks=(3, 4)))


@query("distance_matrix", f"""with {SHORT}, {VOCABULARY}
select a.name as a, b.name as b, round(1 - list_dot_product(a.v, b.v)/(sqrt(list_dot_product(a.v, a.v))*sqrt(list_dot_product(b.v, b.v))), 6) as cosine,
  round(sqrt(list_sum(list_transform(generate_series(1, 64), lambda j: (a.v[j]-b.v[j])**2))), 6) as euclidean
from vocab a join vocab b on a.name < b.name""")
def distance_matrix(spark, sf):
    v = _vocabulary(spark, sf)
    cos = B.distance_matrix(v, "cosine").withColumnRenamed("distance", "cosine")
    euc = B.distance_matrix(v, "euclidean").withColumnRenamed("distance", "euclidean")
    return round_doubles(cos.join(euc, ["a", "b"]))


#: Distance of symbols that count as near.
NEAR = 1.35


@query("near_symbols", f"""with {SHORT}, {VOCABULARY}, d as (
select a.name as a, b.name as b, sqrt(list_sum(list_transform(generate_series(1, 64), lambda j: (a.v[j]-b.v[j])**2))) as distance from vocab a join vocab b on a.name < b.name)
select a, b, round(distance, 6) as distance from d where distance <= {NEAR}""")
def near_symbols(spark, sf):
    """Pairs of symbols under a distance, by pivots and the triangle inequality."""
    return round_doubles(B.distance_matrix(_vocabulary(spark, sf), "euclidean", within=NEAR))


# --- traces -----------------------------------------------------------------------

TAU, KEEP, BAND, EPSILON, SAMPLES = 0.005, 0.7, 2, 1e-6, 5
_K = "'0:' || seq_id || ':' || pos"
TRACES = f"""{SHORT}, traces as (select seq_id, pos as trace_id,
  list_transform(generate_series(0, 63), lambda i: scene[i+1] + {normal_sql(_K + " || ':x:' || i")}*sqrt({TAU}::double)) as x,
  case when {uniform_sql(_K + " || ':e'")} < {KEEP} then label end as e,
  (pos + floor({uniform_sql(_K + " || ':t'")}*{2 * BAND + 1}) - {BAND})::int as t from short)"""


def _traces(spark, sf):
    return Y.corrupt(tables.short_scenes(spark, sf), TAU, KEEP, BAND)


@query("noisy_traces", f"""with {TRACES} select seq_id, trace_id, e, t, round(x[1], 6) + 0.0::double as x0, round(sqrt(list_dot_product(x, x)), 6) as norm from traces""")
def noisy_traces(spark, sf):
    return round_doubles(
        _traces(spark, sf).select("seq_id", "trace_id", "e", "t", F.col("x")[0].alias("x0"), V.norm(F.col("x")).alias("norm"))
    )


POSTERIOR = f"""{TRACES}, raw as (
 select s.seq_id, s.pos, t.trace_id, -0.5*(list_sum(list_transform(generate_series(1, 64), lambda j: (t.x[j]-s.scene[j])**2))/{TAU} + 64*ln(2*pi()*{TAU})) as score
  from short s join traces t on t.seq_id = s.seq_id and abs(t.t - s.pos) <= {BAND} and (t.e is null or t.e = s.label)
 union all select seq_id, pos, null, ln({EPSILON}) from short),
mx as (select *, max(score) over (partition by seq_id, pos) as m from raw),
post as (select seq_id, pos, trace_id, score - (m + ln(sum(exp(score - m)) over (partition by seq_id, pos))) as log_p from mx)"""


def _posterior(spark, sf):
    return Y.trace_posterior(_traces(spark, sf), tables.short_scenes(spark, sf), BAND, TAU, EPSILON)


@query("trace_posterior", f"with {POSTERIOR} select seq_id, pos, trace_id, round(log_p, 6) + 0.0::double as log_p from post")
def trace_posterior(spark, sf):
    return round_doubles(_posterior(spark, sf))


DRAWN = f"""{POSTERIOR}, g as (select s::int as sample_id, seq_id, pos, trace_id,
  log_p - ln(-ln({uniform_sql("'0:' || s || ':' || seq_id || ':' || pos || ':' || coalesce(trace_id::varchar, 'null')")})) as v
  from post, unnest(generate_series(0, {SAMPLES - 1})) t(s)),
r as (select *, row_number() over (partition by sample_id, seq_id, pos order by v desc) as rn from g),
drawn as (select sample_id, seq_id, pos, trace_id from r where rn = 1)"""


@query("drawn_traces", f"with {DRAWN} select * from drawn")
def drawn_traces(spark, sf):
    return Y.draw_traces(_posterior(spark, sf), SAMPLES)


def _samples(spark, sf):
    traces = _traces(spark, sf).select("seq_id", "trace_id", "x", "e")
    return Y.draw_traces(_posterior(spark, sf), SAMPLES).join(traces, ["seq_id", "trace_id"], "left")


@query("reconstruction_recall", f"""with {DRAWN} select t.seq_id, t.trace_id, round(count(distinct d.sample_id)/{SAMPLES}.0::double, 6) as recall
 from traces t left join drawn d on d.seq_id = t.seq_id and d.trace_id = t.trace_id group by 1, 2""")
def reconstruction_recall(spark, sf):
    return round_doubles(Y.recall(_samples(spark, sf).select("sample_id", "seq_id", "x"), _traces(spark, sf), SAMPLES))


@query("sample_agreement", f"""with {DRAWN}, a as (select d.sample_id, avg((coalesce(t.e, -1) = s.label)::int::double) as ag from drawn d
  join short s on s.seq_id = d.seq_id and s.pos = d.pos left join traces t on t.seq_id = d.seq_id and t.trace_id = d.trace_id group by 1)
select count(*) as samples, round(avg(ag), 6) as agreement from a""")
def sample_agreement(spark, sf):
    truth = tables.short_scenes(spark, sf).select("seq_id", "pos", F.col("label").alias("e_true"))
    rows = _samples(spark, sf).join(truth, ["seq_id", "pos"])
    return round_doubles(metrics.sample_agreement(rows.withColumn("e", F.coalesce("e", F.lit(-1)))))


FUSED = f"""{DRAWN}, mom as (select label, list(m order by j) as mu, list(v order by j) as var from (
  select label, j, avg(scene[j]) as m, greatest(var_pop(scene[j]), 1e-6) as v from short, unnest(generate_series(1, 64)) g(j) group by 1, 2) group by 1),
fused as (select d.sample_id, d.seq_id, d.pos, s.label, s.scene, mom.mu, case when t.x is null then mom.mu else
  list_transform(generate_series(1, 64), lambda j: (mom.mu[j]/mom.var[j] + t.x[j]/{TAU})/(1/mom.var[j] + 1/{TAU})) end as mean,
  case when t.x is null then mom.var else list_transform(mom.var, lambda v: 1/(1/v + 1/{TAU})) end as variance
 from drawn d join short s on s.seq_id = d.seq_id and s.pos = d.pos join mom on mom.label = s.label
 left join traces t on t.seq_id = d.seq_id and t.trace_id = d.trace_id)"""


def _fused(spark, sf):
    scenes = tables.short_scenes(spark, sf)
    m = M.topic_moments(scenes, "label")
    model = m.select("label", "mu", M.topic_variance(F.col("n"), F.col("m2"), 0.05).alias("var"))
    slots = scenes.select("seq_id", "pos", "label").join(model, "label")
    filled = _samples(spark, sf).select("sample_id", "seq_id", "pos", "x").join(slots, ["seq_id", "pos"])
    return Y.fuse_traces(filled, TAU)


@query("trace_fusion", f"""with {FUSED} select sample_id, seq_id, pos, label, round(mean[1], 6) + 0.0::double as mean0, round(sqrt(list_dot_product(mean, mean)), 6) as norm,
  round(list_sum(variance), 6) as spread from fused""")
def trace_fusion(spark, sf):
    return round_doubles(
        _fused(spark, sf).select(
            "sample_id", "seq_id", "pos", "label", F.col("mean")[0].alias("mean0"),
            V.norm(F.col("mean")).alias("norm"), V.total(F.col("variance")).alias("spread"),
        )
    )


@query("relative_distance", f"""with {FUSED}, d as (select sample_id, sqrt(list_sum(list_transform(generate_series(1, 64), lambda j: (mean[j]-scene[j])**2))) as a,
  sqrt(list_sum(list_transform(generate_series(1, 64), lambda j: (mean[j]-mu[j])**2))) as b from fused)
select sample_id, count(*) as rows, round(avg(a), 6) as error, round(avg(b - a), 6) as relative_distance from d group by 1""")
def relative_distance(spark, sf):
    rebuilt = _fused(spark, sf).select("sample_id", "seq_id", "pos", "mean")
    return round_doubles(Y.relative_distance(rebuilt, tables.short_scenes(spark, sf), "sample_id"))


@query("linear_dynamics")
def linear_dynamics_query(spark, sf):
    return round_doubles(
        linear_dynamics(tables.long_scenes(spark, sf)).select(
            "label", "dim", "n", "bias", V.norm(F.col("weights")).alias("weight_norm")
        )
    )
