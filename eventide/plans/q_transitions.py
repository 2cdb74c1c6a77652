"""Truth, neighbour scores, sweeps, corpus counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.functions import text as X, vector as V
from eventide.operators import metrics, sweep, transitions as T
from eventide.operators.positions import with_lag
from eventide.plans.registry import query, round_doubles
from eventide.sources import tables
from eventide.sources.readers import first_sequences, slice_scenes, user_turns

COSINE_GRID = sweep.arange(-0.4, 0.5, 0.025)
OVERLAP_GRID = sweep.arange(0.0, 0.6, 0.02)

# --- shared SQL fragments ---------------------------------------------------

SHORT = """
short as (select vec_id // 10 as seq_id, (vec_id % 10)::bigint as pos, label, vec_id,
                 embedding::double[] as scene from embeddings)"""
LONG = """
long as (select vec_id // 100 as seq_id, label, vec_id, embedding::double[] as scene,
                (row_number() over (partition by vec_id // 100 order by label, vec_id) - 1)::bigint as pos
         from embeddings)"""
EVENT_TURNS = """
event_turns as (select user_id as seq_id, event_type as label, ts, event_id,
                (row_number() over (partition by user_id order by ts, event_id) - 1)::bigint as pos
         from events)"""
TURNS = """
turns as (select conv_id as seq_id, turn::bigint as pos, role as label, text from conversations)"""

STOP_LIST = ",".join(f"'{w}'" for w in X.STOP_WORDS)
TOKENS_SQL = (
    r"list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), "
    rf"lambda w: regexp_full_match(w, '[a-z]{{3,}}') and w not in ({STOP_LIST})))"
)
# The engine of the check has no look-around: every non-word character is doubled, so that
# a run may consume the characters on both of its edges.
_WS = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]"
_STRIP = rf"regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')"
_REST = f"case when instr({_STRIP}, ' ') > 0 then substr({_STRIP}, instr({_STRIP}, ' ')) else '' end"
_DOUBLED = rf"regexp_replace({_REST}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"
ENTITIES_SQL = (
    rf"list_distinct(list_transform(regexp_extract_all({_DOUBLED}, "
    rf"'(?:^|[^\p{{L}}\p{{N}}_])([A-Z][A-Za-z0-9]+(?:{_WS}+[A-Z][A-Za-z0-9]+)*)(?:$|[^\p{{L}}\p{{N}}_])', 1), "
    rf"lambda r: lower(regexp_replace(r, '({_WS}){_WS}', '\1', 'g'))))"
)


def f1_columns(tp: str, fp: str, fn: str) -> str:
    """Select list for P, R and F1 from integer counts."""
    p = f"(case when {tp}+{fp} > 0 then ({tp})::double/({tp}+{fp}) else 0 end)"
    r = f"(case when {tp}+{fn} > 0 then ({tp})::double/({tp}+{fn}) else 0 end)"
    return (
        f"round({p}, 6) as precision, round({r}, 6) as recall, "
        f"round(case when {p}+{r} > 0 then 2*{p}*{r}/({p}+{r}) else 0 end, 6) as f1"
    )


def sweep_sql(ctes: str, transitions: str, thetas: list[float]) -> str:
    """The naive form: every threshold against every transition."""
    grid = ",".join(f"({i}::int, {t!r}::double)" for i, t in enumerate(thetas))
    return f"""with {ctes}, tr as ({transitions}),
grid as (select * from (values {grid}) g(theta_id, theta)),
c as (select theta_id, theta,
  coalesce(sum((gt and score < theta)::int), 0)::bigint as tp,
  coalesce(sum((not gt and score < theta)::int), 0)::bigint as fp,
  coalesce(sum((gt and not score < theta)::int), 0)::bigint as fn
  from grid, tr group by 1, 2)
select theta_id, round(theta, 6) as theta, tp, fp, fn, {f1_columns('tp', 'fp', 'fn')} from c"""


def transitions_sql(source: str, value: str, score: str) -> str:
    return f"""select seq_id, pos, label <> pl as gt, {score} as score from (
  select seq_id, pos, label, {value} as v, lag(label) over w as pl, lag({value}) over w as pv
  from {source} window w as (partition by seq_id order by pos)) where pos > 0"""


COSINE_TR = transitions_sql("short", "scene", "list_dot_product(v, pv)")
JACCARD = (
    "case when len(v) = 0 or len(pv) = 0 then 0::double else "
    "len(list_intersect(v, pv))::double / len(list_distinct(list_concat(v, pv))) end"
)
TOKEN_TR = transitions_sql("feat", "tokens", JACCARD)
ENTITY_TR = transitions_sql("feat", "entities", JACCARD)
FEAT = f"{TURNS}, feat as (select *, {TOKENS_SQL} as tokens, {ENTITIES_SQL} as entities from turns)"


# --- queries ------------------------------------------------------------------

@query("shift_truth", f"""with {SHORT} select seq_id, pos, label <> pl as gt from (
  select *, lag(label) over (partition by seq_id order by pos) as pl from short) where pos > 0""")
def shift_truth(spark, sf):
    return T.label_shifts(tables.short_scenes(spark, sf))


@query("event_shift_truth", f"""with {EVENT_TURNS} select seq_id, pos, label <> pl as gt from (
  select *, lag(label) over (partition by seq_id order by pos) as pl from event_turns) where pos > 0""")
def event_shift_truth(spark, sf):
    return T.label_shifts(tables.event_turns(spark, sf))


@query("flagged_truth", """select conv_id as seq_id, turn::bigint as pos, role = 'user' as gt
from conversations where turn > 0""")
def flagged_truth(spark, sf):
    return T.flagged_shifts(tables.dialogue_turns(spark, sf), flag="user")


def _turn_shifts(turns):
    lagged = with_lag(turns, {"_prev": "label"})
    shift = (F.col("pos") > 0) & ~F.col("label").eqNullSafe(F.col("_prev"))
    return lagged.withColumn("shift", shift).drop("_prev")


def _shift_sql(source: str) -> str:
    return f"""s as (select *, pos > 0 and label <> lag(label) over (partition by seq_id order by pos)
      as shift from {source})"""


COUNTS_SQL = """select count(distinct seq_id) as conversations, count(*) as turns,
 coalesce(sum(coalesce(shift, false)::int), 0)::bigint as shifts,
 count(*) - count(distinct seq_id) as transitions,
 round(sum(coalesce(shift, false)::int)::double / (count(*) - count(distinct seq_id)), 6) as shift_rate from s"""


@query("corpus_counts", f"with {EVENT_TURNS}, {_shift_sql('event_turns')} {COUNTS_SQL}")
def corpus_counts(spark, sf):
    return round_doubles(metrics.corpus_counts(_turn_shifts(tables.event_turns(spark, sf))))


@query("dialogue_counts", f"with {TURNS}, {_shift_sql('turns')} {COUNTS_SQL}")
def dialogue_counts(spark, sf):
    return round_doubles(metrics.corpus_counts(_turn_shifts(tables.dialogue_turns(spark, sf))))


PROFILE_SQL = """, p as (select seq_id, count(*) as turns, count(distinct label) as labels,
  sum(coalesce(shift, false)::int) as shifts from s group by 1)
select count(*) as sequences, round(avg(turns), 6) as mean_turns, min(turns) as min_turns,
  max(turns) as max_turns, round(median(turns)::double, 6) as median_turns,
  round(avg(labels), 6) as mean_labels, round(avg(shifts), 6) as mean_shifts from p"""


@query("sequence_profile", f"with {EVENT_TURNS}, {_shift_sql('event_turns')} {PROFILE_SQL}")
def sequence_profile(spark, sf):
    return round_doubles(metrics.sequence_profile(_turn_shifts(tables.event_turns(spark, sf))))


@query("dialogue_profile", f"with {TURNS}, {_shift_sql('turns')} {PROFILE_SQL}")
def dialogue_profile(spark, sf):
    return round_doubles(metrics.sequence_profile(_turn_shifts(tables.dialogue_turns(spark, sf))))


@query("role_profile", """with n as (select conv_id, count(*) as turns,
  sum((role = 'user')::int) as user_turns, max(turn) as last_turn from conversations group by 1)
select count(*) as sequences, round(sum(user_turns)::double / sum(turns), 6) as user_share,
  max(last_turn) as last_turn, sum((user_turns = 0)::int)::bigint as without_user from n""")
def role_profile(spark, sf):
    turns = tables.table(spark, sf, "conversations")
    per_seq = turns.groupBy("conv_id").agg(
        F.count("*").alias("turns"),
        F.count_if(F.col("role") == "user").alias("user_turns"),
        F.max("turn").alias("last_turn"),
    )
    return round_doubles(
        per_seq.agg(
            F.count("*").alias("sequences"),
            (F.sum("user_turns").cast("double") / F.sum("turns")).alias("user_share"),
            F.max("last_turn").alias("last_turn"),
            F.count_if(F.col("user_turns") == 0).alias("without_user"),
        )
    )


@query("event_date_span", """with s as (select user_id as seq_id, min(ts) as lo, max(ts) as hi, count(*) as n
  from events group by 1)
select seq_id, n, strftime(lo, '%Y-%m-%d') as first_day, strftime(hi, '%Y-%m-%d') as last_day,
  date_diff('day', lo::date, hi::date)::int as days from s""")
def event_date_span(spark, sf):
    spans = tables.table(spark, sf, "events").groupBy(F.col("user_id").alias("seq_id")).agg(
        F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )
    return spans.select(
        "seq_id",
        "n",
        F.date_format("lo", "yyyy-MM-dd").alias("first_day"),
        F.date_format("hi", "yyyy-MM-dd").alias("last_day"),
        F.date_diff("hi", "lo").alias("days"),
    )


@query("adjacent_cosine", f"""with {SHORT} select seq_id, pos, gt, round(score, 6) + 0.0::double as score
  from ({COSINE_TR})""")
def adjacent_cosine(spark, sf):
    return round_doubles(T.scored_transitions(tables.short_scenes(spark, sf), "dot", "scene"))


@query("cosine_sweep", sweep_sql(SHORT, COSINE_TR, COSINE_GRID))
def cosine_sweep(spark, sf):
    tr = T.scored_transitions(tables.short_scenes(spark, sf), "dot", "scene")
    return round_doubles(sweep.threshold_sweep(tr, COSINE_GRID))


@query("best_threshold", f"""select * from ({sweep_sql(SHORT, COSINE_TR, COSINE_GRID)})
  order by f1 desc, theta_id limit 1""")
def best_threshold(spark, sf):
    tr = T.scored_transitions(tables.short_scenes(spark, sf), "dot", "scene")
    return round_doubles(
        sweep.first_best(sweep.threshold_sweep(tr, COSINE_GRID), "f1", "theta_id")
    )


def _features(spark, sf):
    return tables.dialogue_turns(spark, sf).withColumns(
        {"tokens": X.tokens("text"), "entities": X.entities("text")}
    )


@query("token_sets", f"""with {FEAT} select seq_id, pos, len(tokens)::int as n_tokens,
  len(entities)::int as n_entities, array_to_string(list_sort(tokens), ' ') as tokens,
  array_to_string(list_sort(entities), '|') as entities from feat""")
def token_sets(spark, sf):
    f = _features(spark, sf)
    return f.select(
        "seq_id",
        "pos",
        F.size("tokens").alias("n_tokens"),
        F.size("entities").alias("n_entities"),
        F.array_join(F.array_sort("tokens"), " ").alias("tokens"),
        F.array_join(F.array_sort("entities"), "|").alias("entities"),
    )


@query("text_profile", f"""with {FEAT} select count(*) as turns, round(avg(len(tokens)), 6) as mean_tokens,
  round(avg(len(entities)), 6) as mean_entities, round(avg(length(text)), 6) as mean_chars from feat""")
def text_profile(spark, sf):
    return round_doubles(metrics.text_profile(_features(spark, sf), "tokens", "entities", "text"))


@query("jaccard_sweep", sweep_sql(FEAT, TOKEN_TR, OVERLAP_GRID))
def jaccard_sweep(spark, sf):
    tr = T.scored_transitions(_features(spark, sf), "jaccard", "tokens")
    return round_doubles(sweep.threshold_sweep(tr, OVERLAP_GRID))


@query("entity_sweep", sweep_sql(FEAT, ENTITY_TR, OVERLAP_GRID))
def entity_sweep(spark, sf):
    tr = T.scored_transitions(_features(spark, sf), "jaccard", "entities")
    return round_doubles(sweep.threshold_sweep(tr, OVERLAP_GRID))


@query("all_boundary_f1", f"""with {SHORT}, tr as ({COSINE_TR}), c as (
  select sum(gt::int)::bigint as tp, sum((not gt)::int)::bigint as fp, 0::bigint as fn from tr)
select tp, fp, fn, {f1_columns('tp', 'fp', 'fn')} from c""")
def all_boundary_f1(spark, sf):
    truth = T.label_shifts(tables.short_scenes(spark, sf))
    return round_doubles(metrics.f1_score(T.all_boundary(truth)))


@query("first_sequences", f"""with {TURNS} select seq_id, pos, label from turns where seq_id in
  (select distinct seq_id from turns order by seq_id limit 25)""")
def first_sequences_query(spark, sf):
    return first_sequences(tables.dialogue_turns(spark, sf), 25).select("seq_id", "pos", "label")


@query("user_turns", "select conv_id as seq_id, turn::bigint as pos, length(text)::int as chars "
       "from conversations where role = 'user'")
def user_turns_query(spark, sf):
    t = user_turns(tables.dialogue_turns(spark, sf), "label")
    return t.select("seq_id", "pos", F.length("text").alias("chars"))


@query("scene_slice", f"""with {SHORT} select seq_id, pos, label, round(sqrt(list_dot_product(scene, scene)), 6) as norm
  from short where pos >= 3 and pos < 7""")
def scene_slice(spark, sf):
    s = slice_scenes(tables.short_scenes(spark, sf), 3, 7)
    return round_doubles(
        s.select("seq_id", "pos", "label", V.norm(V.as_double("scene")).alias("norm"))
    )


@query("turns_with_scenes", f"""with {TURNS}, {SHORT} select seq_id, pos, turns.label as role, short.label,
  round(sqrt(list_dot_product(scene, scene)), 6) as norm from turns join short using (seq_id, pos)""")
def turns_with_scenes(spark, sf):
    """Text rows and their vectors meet by key, not by place in a list."""
    turns = tables.dialogue_turns(spark, sf).select("seq_id", "pos", F.col("label").alias("role"))
    joined = turns.join(tables.short_scenes(spark, sf), ["seq_id", "pos"])
    norm = V.norm(V.as_double("scene")).alias("norm")
    return round_doubles(joined.select("seq_id", "pos", "role", "label", norm))


@query("joined_f1", f"""with {SHORT}, tr as ({COSINE_TR}), c as (select
  sum((gt and score < 0.05)::int)::bigint as tp, sum((not gt and score < 0.05)::int)::bigint as fp,
  sum((gt and not score < 0.05)::int)::bigint as fn from tr)
select tp, fp, fn, {f1_columns('tp', 'fp', 'fn')} from c""")
def joined_f1(spark, sf):
    """Truth and predictions from separate tables."""
    scenes = tables.short_scenes(spark, sf)
    predicted = T.below(T.scored_transitions(scenes, "dot", "scene"), 0.05)
    joined = T.label_shifts(scenes).join(predicted.select("seq_id", "pos", "pred"), ["seq_id", "pos"])
    return round_doubles(metrics.f1_score(joined))


@query("value_logsumexp", """with m as (select event_type, max(value) as m from events group by 1)
select event_type, round(any_value(m) + ln(sum(exp(value - m))), 6) as logsumexp from events join m using (event_type) group by 1""")
def value_logsumexp(spark, sf):
    return round_doubles(metrics.logsumexp(tables.table(spark, sf, "events"), "value", "event_type"))
