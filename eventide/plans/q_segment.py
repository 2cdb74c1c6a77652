"""Topic assignment, parameter grids, full evaluations, context windows, encoders."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from eventide.functions import text as X, vector as V
from eventide.operators import metrics, segment as G
from eventide.operators.context import contextualized, questions, unroll
from eventide.operators.encode import encode
from eventide.plans import evaluation as E
from eventide.plans.q_transitions import (
    COSINE_GRID, FEAT, LONG, SHORT, TOKENS_SQL, TURNS, f1_columns, sweep_sql,
    transitions_sql,
)
from eventide.plans.recursion_sql import assignment_ctes
from eventide.plans.registry import query, round_doubles
from eventide.sources import tables

NO_SETS = "select *, []::varchar[] as tokens, []::varchar[] as entities from"
SHORT_SRC = f"{SHORT}, src as ({NO_SETS} short)"
LONG_SRC = f"{LONG}, src as ({NO_SETS} long)"

#: A regime in which the supplied, unrelated vectors still share topics.
MIXED = G.Config(alpha=1.0, lmda=10.0, sigma0_sq=0.25)


def _walk(source: str, configs, select: str) -> str:
    return f"with recursive {source}, {assignment_ctes('src', configs)} {select}"


ASSIGNED = "select seq_id, pos, topic, is_boundary from walk"


@query("segment_frequent", _walk(SHORT_SRC, [G.FREQUENT_SHIFT], ASSIGNED))
def segment_frequent(spark, sf):
    return G.segment(tables.short_scenes(spark, sf), G.FREQUENT_SHIFT)


@query("segment_persistent", _walk(LONG_SRC, [G.PERSISTENCE], ASSIGNED))
def segment_persistent(spark, sf):
    return G.segment(tables.long_scenes(spark, sf), G.PERSISTENCE)


@query("segment_mixed", _walk(LONG_SRC, [MIXED], ASSIGNED))
def segment_mixed(spark, sf):
    return G.segment(tables.long_scenes(spark, sf), MIXED)


# Scores per configuration: truth joined to the walk, counted without first turns.
GRID_SQL = f""", truth as (select seq_id, pos, label <> lag(label) over (partition by seq_id order by pos) as gt from src),
c as (select cfg_id, coalesce(sum((gt and is_boundary)::int), 0)::bigint as tp,
   coalesce(sum((not gt and is_boundary)::int), 0)::bigint as fp,
   coalesce(sum((gt and not is_boundary)::int), 0)::bigint as fn
  from walk join truth using (seq_id, pos) where pos > 0 group by 1),
scored as (select cfg_id, tp, fp, fn, {f1_columns('tp', 'fp', 'fn')} from c)"""

PLAIN_SCORES = "select * from scored"


@query("segment_f1", _walk(LONG_SRC, [MIXED], GRID_SQL + " select tp, fp, fn, precision, recall, f1 from scored"))
def segment_f1(spark, sf):
    return round_doubles(E.shift_f1(tables.long_scenes(spark, sf), MIXED))


VARIANTS = [
    G.Config(alpha=1.0, lmda=10.0, sigma0_sq=0.25, scorer=s, kappa=6.0, k_max=64)
    for s in G.GAUSS + G.VMF
]


@query("segment_variants", _walk(LONG_SRC, VARIANTS, GRID_SQL + PLAIN_SCORES))
def segment_variants(spark, sf):
    return round_doubles(G.grid_scores(tables.long_scenes(spark, sf), VARIANTS))


ANCHOR_CASES = [
    G.Config(alpha=1.0, lmda=3.0, sigma0_sq=0.1, scorer=s, new_score=0.1, beta=0.5, k_max=64)
    for s in G.ANCHORS
]


@query("segment_anchors", _walk(LONG_SRC, ANCHOR_CASES, GRID_SQL + PLAIN_SCORES))
def segment_anchors(spark, sf):
    return round_doubles(G.grid_scores(tables.long_scenes(spark, sf), ANCHOR_CASES))


@query("grid_gauss", _walk(SHORT_SRC, G.gauss_grid(), GRID_SQL + PLAIN_SCORES))
def grid_gauss(spark, sf):
    return round_doubles(G.grid_scores(tables.short_scenes(spark, sf), G.gauss_grid()))


CONFIG_COLUMNS = "scorer, alpha, lmda, sigma0_sq, kappa, beta, new_score, b_cos, b_jac, b_ent"
TOP_COLUMNS = f"cfg_id, tp, fp, fn, precision, recall, f1, {CONFIG_COLUMNS}"


def _top_sql(k: int) -> str:
    return GRID_SQL + (
        f" select {TOP_COLUMNS} from scored join (select cfg_id, {CONFIG_COLUMNS} from configs) using (cfg_id)"
        f" order by f1 desc, cfg_id limit {k}"
    )


QUARTER_SRC = f"""src as (select vec_id // 25 as seq_id, (vec_id % 25)::bigint as pos, label,
  embedding::double[] as scene, []::varchar[] as tokens, []::varchar[] as entities from embeddings)"""


@query("grid_top10", _walk(QUARTER_SRC, G.gauss_grid(), _top_sql(10)))
def grid_top10(spark, sf):
    return round_doubles(E.top_of_grid(tables.short_scenes(spark, sf, 25), G.gauss_grid(), 10))


BEST_SQL = GRID_SQL + f""", named as (select scored.*, {CONFIG_COLUMNS} from scored join configs using (cfg_id)),
r as (select *, row_number() over (partition by scorer order by f1 desc, cfg_id) as rn from named)
select {TOP_COLUMNS} from r where rn = 1"""


@query("variant_best", _walk(SHORT_SRC, G.variant_grid(), BEST_SQL))
def variant_best(spark, sf):
    return round_doubles(E.best_by_scorer(tables.short_scenes(spark, sf), G.variant_grid()))


@query("anchor_best", _walk(SHORT_SRC, G.anchor_grid(), BEST_SQL))
def anchor_best(spark, sf):
    return round_doubles(E.best_by_scorer(tables.short_scenes(spark, sf), G.anchor_grid()))


# --- text scenes --------------------------------------------------------------

def encode_sql(tokens: str, d: int = 64) -> str:
    """Unit vector of token counts per hash bucket."""
    buckets = f"list_transform({tokens}, lambda t: (('0x' || substr(md5(t), 1, 8))::bigint % {d})::int)"
    counts = f"list_transform(generate_series(0, {d - 1}), lambda i: len(list_filter({buckets}, lambda b: b = i))::double)"
    return counts


def encoded_ctes(source: str, tokens: str = "tokens", d: int = 64) -> str:
    """``enc``: the source with ``scene``; zero vectors stay zero."""
    return f"""raw_enc as (select *, {encode_sql(tokens, d)} as cnt from {source}),
enc as (select *, case when list_sum(cnt) > 0 then list_transform(cnt, lambda x: x/sqrt(list_dot_product(cnt, cnt))) else cnt end as scene
  from raw_enc)"""


def _dialogue_scenes(spark, sf):
    turns = tables.dialogue_turns(spark, sf).withColumns(
        {"tokens": X.tokens("text"), "entities": X.entities("text")}
    )
    return encode(turns)


TEXT_SRC = f"{FEAT}, {encoded_ctes('feat')}, src as (select seq_id, pos, label, scene, tokens, entities from enc)"


@query("hash_encode", f"""with {FEAT}, {encoded_ctes('feat')}
select seq_id, pos, (i - 1)::int as dim, round(scene[i], 6) as x from enc, unnest(generate_series(1, 64)) g(i)
where scene[i] <> 0""")
def hash_encode(spark, sf):
    cells = _dialogue_scenes(spark, sf).select("seq_id", "pos", F.posexplode("scene").alias("dim", "x"))
    return round_doubles(cells.where(F.col("x") != 0))


SIGNAL_CASES = [
    G.Config(alpha=1.0, lmda=l, b_cos=c, b_jac=j, b_ent=e, new_score=nb, scorer="signals", k_max=64)
    for l, c, j, e, nb in (
        (0.0, 1.0, 0.0, 0.0, 0.3), (0.3, 1.0, 3.0, 0.0, 0.5), (1.0, 3.0, 10.0, 10.0, 0.7),
        (0.0, 0.0, 30.0, 0.0, 1.0), (1.0, 0.0, 0.0, 30.0, 0.3),
    )
]


@query("segment_signals", _walk(TEXT_SRC, SIGNAL_CASES, GRID_SQL + PLAIN_SCORES))
def segment_signals(spark, sf):
    return round_doubles(G.grid_scores(_dialogue_scenes(spark, sf), SIGNAL_CASES))


@query("signal_top15", _walk(TEXT_SRC, G.signal_grid(), _top_sql(15)))
def signal_top15(spark, sf):
    return round_doubles(E.top_of_grid(_dialogue_scenes(spark, sf), G.signal_grid(), 15))


@query("segment_text", _walk(TEXT_SRC, [G.Config(alpha=1.0, lmda=10.0, sigma0_sq=0.25)], ASSIGNED))
def segment_text(spark, sf):
    return G.segment(_dialogue_scenes(spark, sf), G.Config(alpha=1.0, lmda=10.0, sigma0_sq=0.25))


# --- reports ------------------------------------------------------------------

REGIMES = {"persistence": G.PERSISTENCE, "frequent-shift": G.FREQUENT_SHIFT, "mixed": MIXED}


def _methods_sql(tail: str) -> str:
    tr = transitions_sql("long", "scene", "list_dot_product(v, pv)")
    swept = sweep_sql(LONG, tr, COSINE_GRID)
    names = ",".join(f"({i}, '{n}')" for i, n in enumerate(REGIMES))
    return f"""with recursive {LONG_SRC}, {assignment_ctes('src', list(REGIMES.values()))} {GRID_SQL},
tr0 as ({tr}), ab as (select sum(gt::int)::bigint as tp, sum((not gt)::int)::bigint as fp, 0::bigint as fn from tr0),
best as (select * from ({swept}) order by f1 desc, theta_id limit 1),
methods as (
 select 'all-boundary' as method, null::double as theta, tp, fp, fn, {f1_columns('tp', 'fp', 'fn')} from ab
 union all select 'cosine-threshold', theta, tp, fp, fn, precision, recall, f1 from best
 union all select method, null, tp, fp, fn, precision, recall, f1 from scored
   join (values {names}) n(cfg_id, method) using (cfg_id)) {tail}"""


@query("method_table", _methods_sql("select * from methods"))
def method_table(spark, sf):
    return round_doubles(E.method_table(tables.long_scenes(spark, sf), COSINE_GRID, REGIMES))


_GATE = ",".join(f"('{n}')" for n in REGIMES)


@query("segment_report", _methods_sql(f"""
select 'data' as section, 'transitions' as item, (tp+fp)::double as value from ab
union all select 'data', 'shifts', tp::double from ab
union all select 'data', 'shift_rate', precision from methods where method = 'all-boundary'
union all select 'method', method || '/precision', precision from methods
union all select 'method', method || '/recall', recall from methods
union all select 'method', method || '/f1', f1 from methods
union all select 'gate', g.name, (m.f1 > c.f1 and m.f1 > 0.4)::int::double
 from (values {_GATE}) g(name) join methods m on m.method = g.name join methods c on c.method = 'cosine-threshold'"""))
def segment_report(spark, sf):
    return round_doubles(E.report(tables.long_scenes(spark, sf), COSINE_GRID, REGIMES))


def _measured_ms(scenes, config) -> float:
    """Milliseconds per turn that a run of the segmenter takes now."""
    t0 = time.perf_counter()
    turns = G.segment(scenes, config).count()
    return (time.perf_counter() - t0) * 1000 / max(turns, 1)


def _gates(spark, sf):
    """Gate rows of two benchmarks: long and short sequences."""
    rows = None
    for name, scenes in (("long", tables.long_scenes(spark, sf)), ("short", tables.short_scenes(spark, sf))):
        ms = F.when(F.col("method") == "mixed", F.lit(_measured_ms(scenes, MIXED)))
        table = E.method_table(scenes, COSINE_GRID, {"mixed": MIXED}).withColumn("benchmark", F.lit(name)).withColumn("ms", ms)
        rows = table if rows is None else rows.unionByName(table)
    return metrics.gate(rows, "mixed", "cosine-threshold", time="ms")


def _gate_sql(name: str, src: str, table: str) -> str:
    tr = transitions_sql(table, "scene", "list_dot_product(v, pv)")
    best = sweep_sql(SHORT if table == "short" else LONG, tr, COSINE_GRID)
    return (
        f"select '{name}' as benchmark, (select f1 from ({_walk(src, [MIXED], GRID_SQL + PLAIN_SCORES)})) as f1, "
        f"(select max(f1) from ({best})) as baseline_f1"
    )


GATES_SQL = (
    f"with g as ({_gate_sql('long', LONG_SRC, 'long')} union all {_gate_sql('short', SHORT_SRC, 'short')}), "
    "v as (select *, f1 > baseline_f1 as beats_baseline, f1 > 0.4 as beats_floor, true as in_time, "
    "f1 > baseline_f1 and f1 > 0.4 as passed from g)"
)


@query("gates", GATES_SQL + " select * from v")
def gates(spark, sf):
    return round_doubles(_gates(spark, sf))


@query("combined_gate", GATES_SQL + " select bool_and(passed) as passed from v")
def combined_gate(spark, sf):
    return metrics.combined_gate(_gates(spark, sf), ["long", "short"])


# --- context --------------------------------------------------------------------

QUESTIONS = f"""{TURNS}, led as (select *, lead(label) over w as nr, lead(text) over w as nt from turns
  window w as (partition by seq_id order by pos)),
asked as (select seq_id, pos as turn, text, case when nr = 'assistant' then nt else '' end as answer,
  (row_number() over (partition by seq_id order by pos) - 1)::bigint as pos from led where label = 'user')"""


def context_sql(k) -> str:
    if k == 0:
        return "'Q: ' || text"
    frame = "unbounded preceding" if k == "all" else f"{k} preceding"
    earlier = (
        "string_agg('Q: ' || text || ' A: ' || answer || ' ', '' order by pos) over "
        f"(partition by seq_id order by pos rows between {frame} and 1 preceding)"
    )
    return f"coalesce({earlier}, '') || 'Q: ' || text"


CONTEXT_WINDOWS = (0, 1, 2, 3, "all")


@query("context_text", f"with {QUESTIONS} " + " union all ".join(
    f"select '{k}' as k, seq_id, pos, {context_sql(k)} as context from asked" for k in CONTEXT_WINDOWS))
def context_text(spark, sf):
    asked = questions(tables.dialogue_turns(spark, sf))
    out = None
    for k in CONTEXT_WINDOWS:
        rows = contextualized(asked, k).select(F.lit(str(k)).alias("k"), "seq_id", "pos", "context")
        out = rows if out is None else out.unionByName(rows)
    return out


TEXT_GRID = [round(0.05 * i, 2) for i in range(1, 19)]


def _context_sweep_sql() -> str:
    """Label of a question: whether its turn number is divisible by four (a fixed, arbitrary
    property of the row, so that shifts exist)."""
    rows = []
    for k in CONTEXT_WINDOWS:
        texts = f"{QUESTIONS}, t as (select seq_id, pos, (turn % 4)::varchar as label, {context_sql(k)} as text from asked)"
        feats = f"{texts}, f0 as (select *, {TOKENS_SQL} as tokens, []::varchar[] as entities from t), {encoded_ctes('f0')}"
        src = f"{feats}, src as (select seq_id, pos, label, scene, tokens, entities from enc)"
        tr = transitions_sql("src", "scene", "list_dot_product(v, pv)")
        walk = f"with recursive {src}, {assignment_ctes('src', [G.FREQUENT_SHIFT, G.PERSISTENCE])} {GRID_SQL} select * from scored"
        best = f"select * from ({sweep_sql(src, tr, TEXT_GRID)}) order by f1 desc, theta_id limit 1"
        chars = f"with {texts} select round(avg(length(text)), 6) from t"
        rows.append(
            f"select '{k}' as k, ({chars}) as mean_chars, (select theta from ({best})) as theta, "
            f"(select f1 from ({best})) as cosine_f1, "
            f"(select f1 from ({walk}) where cfg_id = 0) as frequent_f1, "
            f"(select f1 from ({walk}) where cfg_id = 1) as persistent_f1"
        )
    return " union all ".join(rows)


@query("context_sweep", _context_sweep_sql())
def context_sweep(spark, sf):
    asked = questions(tables.dialogue_turns(spark, sf)).withColumn(
        "label", (F.col("turn") % 4).cast("string")
    )
    return round_doubles(E.context_sweep(asked, CONTEXT_WINDOWS, TEXT_GRID))


ENCODER_DIMS = (32, 64, 128)


def _encoder_sql() -> str:
    rows = []
    for d in ENCODER_DIMS:
        src = f"{FEAT}, {encoded_ctes('feat', d=d)}, src as (select seq_id, pos, label, scene, tokens, entities from enc)"
        tr = transitions_sql("src", "scene", "list_dot_product(v, pv)")
        walk = f"with recursive {src}, {assignment_ctes('src', [G.FREQUENT_SHIFT, G.PERSISTENCE])} {GRID_SQL}"
        rows.append(
            f"select {d} as encoder, case cfg_id when 0 then 'frequent' else 'persistent' end as method, f1 "
            f"from ({walk} select * from scored) "
            f"union all select {d}, 'cosine-threshold', f1 from (select * from ({sweep_sql(src, tr, TEXT_GRID)}) order by f1 desc, theta_id limit 1) "
            f"union all select {d}, 'all-boundary', f1 from (with {src}, tr as ({tr}), c as (select sum(gt::int)::bigint as tp, sum((not gt)::int)::bigint as fp, 0::bigint as fn from tr) "
            f"select {f1_columns('tp', 'fp', 'fn')} from c)"
        )
    return " union all ".join(rows)


@query("encoder_sweep", _encoder_sql())
def encoder_sweep(spark, sf):
    return round_doubles(E.encoder_sweep(tables.dialogue_turns(spark, sf), ENCODER_DIMS, TEXT_GRID))


# --- sliding windows, clusterings --------------------------------------------------

@query("unroll", f"""with {SHORT}, steps as (select unnest(generate_series(0, 3)) as step)
select a.seq_id, a.pos, step::int as step, round(coalesce(sqrt(list_dot_product(b.scene, b.scene)), 0), 6) as norm,
  round(coalesce(b.scene[1], 0), 6) + 0.0::double as x0
from short a cross join steps left join short b on b.seq_id = a.seq_id and b.pos = a.pos - 3 + step""")
def unroll_query(spark, sf):
    rows = unroll(tables.short_scenes(spark, sf), 4).select(
        "seq_id", "pos", F.posexplode("window").alias("step", "v")
    )
    return round_doubles(
        rows.select("seq_id", "pos", "step", V.norm(F.col("v")).alias("norm"), F.col("v")[0].alias("x0"))
    )


def _choose2(n: str) -> str:
    return f"({n})::double*(({n})-1)/2"


ARI_SQL = f""", cells as (select label as t, topic as p, count(*) as n from lab group by 1, 2),
tot as (select sum({_choose2('n')}) as agree, sum(n)::bigint as rows from cells),
ta as (select sum({_choose2('n')}) as a from (select sum(n) as n from cells group by t)),
tb as (select sum({_choose2('n')}) as b from (select sum(n) as n from cells group by p))"""
LABELLED = "lab as (select label, topic from walk join src using (seq_id, pos))"


@query("adjusted_rand", _walk(LONG_SRC, [MIXED], f", {LABELLED} {ARI_SQL} select rows, round((agree - a*b/({_choose2('rows')}))/((a+b)/2 - a*b/({_choose2('rows')})), 6) as ari from tot, ta, tb"))
def adjusted_rand(spark, sf):
    pairs = G.segment(tables.long_scenes(spark, sf), MIXED, keep=["label"])
    return round_doubles(metrics.adjusted_rand(pairs, "label", "topic"))


@query("cluster_purity", _walk(LONG_SRC, [MIXED], f""", {LABELLED} {ARI_SQL},
m as (select p, max(n) as top, sum(n) as n from cells group by 1)
select count(*) as clusters, round(sum(top)::double/sum(n), 6) as purity, round(min(top::double/n), 6) as min_purity from m"""))
def cluster_purity(spark, sf):
    pairs = G.segment(tables.long_scenes(spark, sf), MIXED, keep=["label"])
    return round_doubles(metrics.purity(pairs, "label", "topic"))
