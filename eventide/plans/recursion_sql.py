"""The assignment recursion as a recursive query, for checking the operator.

One row per (configuration, sequence) advances a position per step; the state (topic means,
squared deviations, last scenes, sizes, token sets) travels in list columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from eventide.operators.segment import GAUSS, SIGNALS, VMF, Config

_DOT = "list_dot_product({a}, {b})"
_NORM = "sqrt(list_dot_product({a}, {a}))"


def _cos(a: str, b: str) -> str:
    na, nb = _NORM.format(a=a), _NORM.format(a=b)
    return f"(case when {na} < 1e-9 or {nb} < 1e-9 then 0 else {_DOT.format(a=a, b=b)}/({na}*{nb}) end)"


def _overlap(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return (
        f"(case when len({a}) = 0 or len({b}) = 0 then 0 else "
        f"{both}::double/(len({a}) + len({b}) - {both}) end)"
    )


def _known(scorer: str) -> str:
    if scorer in GAUSS:
        v = "(case when ns[k] < 3 then sigma0_sq else greatest(m2s[k][j]/ns[k], 1e-6) end)"
        return (
            "-0.5*list_sum(list_transform(generate_series(1, len(s)), lambda j: "
            f"(s[j]-mus[k][j])*(s[j]-mus[k][j])/{v} + ln(2*pi()*{v})))"
        )
    centroid = f"{_DOT.format(a='s', b='mus[k]')}/({_NORM.format(a='mus[k]')} + 1e-9)"
    if scorer in VMF:
        return f"kappa*{centroid}"
    if scorer in SIGNALS:
        return (
            f"b_cos*{centroid} + b_jac*{_overlap('tokens', 'toks[k]')} "
            f"+ b_ent*{_overlap('entities', 'ents[k]')}"
        )
    near, last = _cos("s", "mus[k]"), _cos("s", "lasts[k]")
    cos = {"centroid": near, "ema": near, "last": last, "max_c_l": f"greatest({near}, {last})"}
    return f"{cos[scorer]}/sigma0_sq"


def _fresh(scorer: str) -> str:
    iso = "-0.5*({sq}/sigma0_sq + len(s)*ln(2*pi()*sigma0_sq))"
    if scorer == "gauss-origin":
        return iso.format(sq="list_dot_product(s, s)")
    if scorer == "gauss-global":
        off = "list_transform(generate_series(1, len(s)), lambda j: s[j]-(gm[j] + (s[j]-gm[j])/(pos+1)))"
        return iso.format(sq=f"list_dot_product({off}, {off})")
    if scorer == "gauss-self":
        return iso.format(sq="0")
    if scorer == "vmf-origin":
        return "0"
    if scorer == "vmf-const":
        return "-kappa"
    return "new_score" if scorer in SIGNALS else "new_score/sigma0_sq"


def _cases(by, scorers: Sequence[str]) -> str:
    if len(scorers) == 1:
        return by(scorers[0])
    return "case scorer " + " ".join(f"when '{s}' then {by(s)}" for s in scorers) + " end"


def config_rows(configs: Sequence[Config]) -> str:
    rows = ",".join(
        f"({i}::int,'{c.scorer}',{c.alpha!r}::double,{c.lmda!r}::double,{c.sigma0_sq!r}::double,"
        f"{c.kappa!r}::double,{c.beta!r}::double,{c.new_score!r}::double,{c.b_cos!r}::double,"
        f"{c.b_jac!r}::double,{c.b_ent!r}::double,{c.k_max}::int)"
        for i, c in enumerate(configs)
    )
    return (
        f"configs as (select * from (values {rows}) c(cfg_id, scorer, alpha, lmda, sigma0_sq, kappa, "
        "beta, new_score, b_cos, b_jac, b_ent, k_max))"
    )


def assignment_ctes(source: str, configs: Sequence[Config]) -> str:
    """CTEs ending in ``walk(cfg_id, seq_id, pos, topic, is_boundary)``.

    ``source`` is a CTE with ``seq_id, pos, scene, tokens, entities``.
    """
    scorers = list(dict.fromkeys(c.scorer for c in configs))
    needs_m2 = any(s in GAUSS for s in scorers)
    needs_last = any(s in ("last", "max_c_l") for s in scorers)
    needs_sets = any(s in SIGNALS for s in scorers)
    needs_gm = "gauss-global" in scorers
    has_ema = "ema" in scorers

    def slots(name: str, put: str, keep: bool) -> str:
        if not keep:
            return f"{name}"
        return (
            f"list_transform(generate_series(1, greatest(len(ns), topic+1)), lambda k: "
            f"case when k = topic+1 then {put} else {name}[k] end)"
        )

    n1 = "(coalesce(ns[topic+1], 0)+1)"
    old = "coalesce(mus[topic+1][j], 0)"
    move = f"{old} + (s[j]-{old})/{n1}"
    if has_ema:
        ema = f"case when {n1} = 1 then s[j] else beta*s[j] + (1-beta)*{old} end"
        move = f"case when scorer = 'ema' then {ema} else {move} end"
    over = "list_transform(generate_series(1, len(s)), lambda j: {0})"
    spread = f"coalesce(m2s[topic+1][j], 0) + (s[j]-{old})*(s[j]-({old} + (s[j]-{old})/{n1}))"
    joined = lambda old_set, new: f"list_distinct(list_concat(coalesce({old_set}[topic+1], []), {new}))"
    return f"""{config_rows(configs)},
walk as (
 select c.*, seq_id, pos, 0 as topic, false as is_boundary, [scene] as mus,
  [list_transform(scene, lambda x: 0::double)] as m2s, [scene] as lasts, [1] as ns,
  scene as gm, [tokens] as toks, [entities] as ents
 from {source}, configs c where pos = 0
 union all
 select cfg_id, scorer, alpha, lmda, sigma0_sq, kappa, beta, new_score, b_cos, b_jac, b_ent, k_max,
  seq_id, pos, topic, topic <> prev as is_boundary,
  {slots('mus', over.format(move), True)} as mus,
  {slots('m2s', over.format(spread), needs_m2)} as m2s,
  {slots('lasts', 's', needs_last)} as lasts,
  {slots('ns', n1, True)} as ns,
  {over.format("gm[j] + (s[j]-gm[j])/(pos+1)") if needs_gm else "gm"} as gm,
  {slots('toks', joined('toks', 'tokens'), needs_sets)} as toks,
  {slots('ents', joined('ents', 'entities'), needs_sets)} as ents
 from (
  select *, (list_position(scores, list_max(scores)) - 1)::int as topic from (
   select *, case when len(ns) < k_max then list_append(known, ln(alpha) + fresh) else known end as scores from (
    select *, list_transform(generate_series(1, len(ns)), lambda k:
       ln(ns[k] + case when k = prev+1 then lmda else 0 end) + ({_cases(_known, scorers)})) as known,
      ({_cases(_fresh, scorers)})::double as fresh
    from (select p.* exclude (pos, topic, is_boundary), p.topic as prev, n.pos, n.scene as s, n.tokens, n.entities
          from walk p join {source} n on n.seq_id = p.seq_id and n.pos = p.pos + 1)))))"""
