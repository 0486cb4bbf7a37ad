"""Ranking, tiers, reviews and the feedback loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from matricula import fixed_values as V
from matricula.functions import text
from matricula.operators import ranking, reviews
from matricula.operators.common import spread
from matricula.session import cut_lineage
from workload.registry import query

_WORD = r"(^|[^\p{L}\p{N}_])"
_WORD_END = r"($|[^\p{L}\p{N}_])"


def re2(pattern: str) -> str:
    """Word boundaries around accented letters, spelled out for RE2."""
    return "|".join(
        _WORD + alt[2:-2] + _WORD_END if alt.startswith(r"\b") else alt for alt in pattern.split("|")
    )


_ACT_MASK = " + ".join(
    f"case when regexp_matches(text, '{re2(p)}') then {1 << i} else 0 end"
    for i, (p, _) in enumerate(V.ACTIVITY_SUBJECTS)
)
_SUBJECT_MASK = " + ".join(
    "case when list_has_any(ml, [{}]) then {} else 0 end".format(
        ", ".join("'" + s.lower() + "'" for s in subjects), 1 << i
    )
    for i, (_, subjects) in enumerate(V.ACTIVITY_SUBJECTS)
)


def _clamp(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


def _peaked(gap: str, sigma: float) -> str:
    return _clamp(
        f"exp(-(({gap})*({gap}))/(2e0*{sigma}e0*{sigma}e0)) + case when ({gap}) >= 0 "
        f"then 0.08e0*least(({gap})/{sigma}e0, 0.5e0) else 0e0 end"
    )


def rescored_ctes(weights: dict[str, str] | None = None, suffix: str = "") -> str:
    """`scored` and `ranked` over the shared `pairs`, with per-component factors."""
    w = {c: f"{v}e0" for c, v in V.DEFAULT_WEIGHTS.items()}
    w["cost"] = f"coalesce(w_cost, {w['cost']})"
    for c, f in (weights or {}).items():
        w[c] = f"({w[c]} * {f})"
    total = " + ".join(w[c] for c in V.COMPONENTS)
    dot = " + ".join(f"{w[c]}*{c}" for c in V.COMPONENTS)
    return f"""scored{suffix} as (select profile_id, id, round({_clamp(f"({dot})/({total})")}, 6) score, {', '.join(V.COMPONENTS)} from pairs),
    ranked{suffix} as (select *, cast(row_number() over (partition by profile_id order by score desc, id) as int) rank from scored{suffix})"""


def scored_ctes(weights: dict[str, str] | None = None, catalog: str = "{v_catalog}") -> str:
    """CTEs ending in `ranked(profile_id, id, score, <components>, rank)` over all admitted pairs."""
    imp = {a: f"(abs(pf_{a}-0.5e0)*2)" for a in V.CULTURE_AXES}
    cw = " + ".join(imp.values())
    cs = " + ".join(f"{imp[a]}*(1e0-abs(pf_{a}-c_{a}))" for a in V.CULTURE_AXES)
    gpa, sat = _peaked("gpa-avg_gpa", 0.35), _peaked("cast(sat-avg_sat as double)", 130.0)
    return rf"""
    acts as (select profile_id, m, count(*) n from (select profile_id, {_ACT_MASK} m from {{v_activities}}) group by 1, 2),
    act_n as (select profile_id, sum(n) total from acts group by 1),
    unis as (select u.*, {_SUBJECT_MASK} um from (select *, list_transform(majors, lambda x: lower(x)) ml from {catalog}) u),
    masks as (select distinct um from unis),
    hits as (select profile_id, um, sum(case when (m & um) <> 0 then n else 0 end) hits from acts, masks group by 1, 2),
    pairs as (
      select p.profile_id, u.id,
        round(case when sat is not null and avg_sat is not null then ({gpa} + {sat})/2e0 else {gpa} end, 6) academic,
        case when net_price is null then 0.5e0
          when max_tuition is null then round({_clamp("1e0-(net_price+prem)/60000e0")}, 6)
          when net_price+prem <= max_tuition then 1e0
          else round({_clamp("1e0-((net_price+prem)-max_tuition)/greatest(max_tuition,1e0)")}, 6) end cost,
        round(0.5e0*(case when list_contains(ml, lower(intended_major)) then 1e0 else 0.3e0 end)
          + 0.25e0*(case when regions is null or list_contains(regions, region) then 1e0 else 0e0 end)
          + 0.25e0*(case when settings is null or list_contains(settings, setting) then 1e0 else 0e0 end), 6) fit,
        case when {cw} = 0 then 0.5e0 else round({_clamp(f"({cs})/({cw})")}, 6) end culture,
        case when a.total is null then 0.5e0 else round({_clamp("0.5e0+0.5e0*(cast(h.hits as double)/cast(a.total as double))")}, 6) end activities,
        case when wi+ws = 0 then 0.5e0 else round({_clamp("(coalesce((1e0-abs(intensity-(1e0-acceptance_rate)))*wi,0e0)+coalesce((1e0-abs(scale-greatest(0e0,least(1e0,enrollment/25000e0))))*ws,0e0))/(wi+ws)")}, 6) end personality,
        w_cost
      from (select p.*, u.*, 
              case when upper(home_state) <> upper(state) and tuition_in_state is not null then greatest(0e0, sticker_tuition-tuition_in_state) else 0e0 end prem,
              case when acceptance_rate is not null then abs(intensity-0.5e0)*2 else 0e0 end wi,
              case when enrollment is not null then abs(scale-0.5e0)*2 else 0e0 end ws
            from {{v_profiles}} p join unis u
              on (case scope when 'usa' then country = 'USA' when 'international' then country <> 'USA' else true end)
             and (institution_type is null or institution_type = u.type)) p
      join (select id as uid, um as umm from unis) q on q.uid = p.id
      left join act_n a on a.profile_id = p.profile_id
      left join hits h on h.profile_id = p.profile_id and h.um = q.umm
      join (select id from unis) u on u.id = p.id),
    {rescored_ctes(weights)}"""


def ranked_profiles(t):
    masks = ranking.activity_masks(t["v_activities"])
    return t.dealt("v_profiles").join(masks, "profile_id", "left")


def top5(t, k=5, feedback=None):
    return ranking.rank_top_k(ranked_profiles(t), t["v_catalog"], k, feedback=feedback)


@query(
    "rank_top5",
    "F1 F2 J6 M1 M2 M3 M4 M5 M6 M7 M8 A13 A14 A15 W1 T31",
    "with " + scored_ctes() + f" select profile_id, rank, id, score, {', '.join(V.COMPONENTS)} from ranked where rank <= 5",
)
def rank_top5(t):
    return top5(t)


@query(
    "admit_tiers",
    "M9",
    "with " + scored_ctes() + """
    select r.profile_id, r.rank, r.id, r.score,
      case when p.gpa is null then null when c.acceptance_rate <= 0.15e0 then 'extreme_reach'
        when c.avg_gpa - p.gpa >= 0.12e0 then 'reach' when c.avg_gpa - p.gpa <= -0.12e0 then 'safety'
        else 'target' end admit_tier
    from ranked r join {v_catalog} c on r.id = c.id join {v_profiles} p on r.profile_id = p.profile_id
    where rank <= 5""",
)
def admit_tiers(t):
    tiers = ranking.with_admit_tier(top5(t), t["v_profiles"], t["v_catalog"])
    return tiers.select("profile_id", "rank", "id", "score", "admit_tier")


@query(
    "match_paging",
    "F18 W10 W11 T35",
    "with " + scored_ctes() + """,
    tiered as (select r.profile_id, r.rank, r.id, c.net_price, c.acceptance_rate,
        case when c.acceptance_rate <= 0.15e0 then 'extreme_reach' when c.avg_gpa - p.gpa >= 0.12e0 then 'reach'
          when c.avg_gpa - p.gpa <= -0.12e0 then 'safety' else 'target' end admit_tier
      from ranked r join {v_catalog} c on r.id = c.id join {v_profiles} p on r.profile_id = p.profile_id where rank <= 20),
    placed as (select *, row_number() over (partition by profile_id order by coalesce(net_price, 1e9), rank) position,
        row_number() over (partition by profile_id order by coalesce(acceptance_rate, 1e0), rank) by_selectivity
      from tiered where admit_tier in ('reach', 'target', 'safety'))
    select profile_id, id, cast(position as int) "position", cast(by_selectivity as int) by_selectivity,
      case admit_tier when 'reach' then 'Reach' when 'target' then 'Target' else 'Safety' end tier_label
    from placed where position > 5 and position <= 10""",
)
def match_paging(t):
    from matricula.functions.display import tier_label

    top = ranking.with_universities(top5(t, 20), t["v_catalog"], ["net_price", "acceptance_rate"])
    tiers = ranking.with_admit_tier(
        top.drop("net_price", "acceptance_rate"), t["v_profiles"], t["v_catalog"]
    ).join(t["v_catalog"].select("id", "net_price", "acceptance_rate"), "id")
    chosen = ranking.filter_tiers(tiers, ["reach", "target", "safety"])
    both = ranking.resort(
        ranking.resort(chosen, "selectivity").withColumnRenamed("position", "by_selectivity"), "price"
    )
    return ranking.page(both, 2, 5).select(
        "profile_id", "id", "position", "by_selectivity", tier_label(F.col("admit_tier")).alias("tier_label")
    )


_FEEDBACK = {"academic": "0.6e0", "cost": "1.5e0"}


def _feedback(t):
    return t["v_profiles"].select(
        "profile_id",
        F.create_map(
            F.lit("academic"), F.lit(0.6), F.lit("cost"), F.lit(1.5), F.lit("prestige"), F.lit(1.2)
        ).alias("feedback"),
    )


@query(
    "rank_with_feedback",
    "M8 E1",
    "with " + scored_ctes(_FEEDBACK) + " select profile_id, rank, id, score from ranked where rank <= 5",
)
def rank_with_feedback(t):
    return top5(t, feedback=_feedback(t)).select("profile_id", "rank", "id", "score")


def _odd_reviews(ranked):
    """A review naming an unknown id, repeating ids, and stating unusable numbers."""
    worst_first = F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "id")), asc=False), lambda r: r["id"]
    )
    return ranked.groupBy("profile_id").agg(worst_first.alias("ids")).select(
        "profile_id",
        F.concat(F.array(F.lit("nowhere")), F.col("ids"), F.col("ids")).alias("keep_ids"),
        F.element_at(
            F.array(*[F.lit(c) for c in ("1.7", "-3", "abc", "0.4")]),
            (F.col("profile_id") % 4 + 1).cast("int"),
        ).alias("confidence"),
        F.create_map(
            F.lit("cost"), F.lit("9"), F.lit("fit"), F.lit("0.1"), F.lit("academic"), F.lit("x")
        ).alias("weight_feedback"),
        F.create_map(F.lit("nowhere"), F.lit("n"), F.col("ids")[0], F.lit("kept note")).alias("notes"),
    )


@query(
    "sanitized_reviews",
    "J13 M12 M13 F24",
    "with " + scored_ctes() + """,
    pool as (select *, max(rank) over (partition by profile_id) worst from ranked where rank <= 8)
    select profile_id, cast(worst - rank as int) pos, id,
      case profile_id % 4 when 0 then 1e0 when 1 then 0e0 when 2 then 0e0 else 0.4e0 end confidence,
      1.5e0 fb_cost, 0.5e0 fb_fit, 2 n_feedback, case when rank = worst then 'kept note' end note
    from pool where worst - rank < 5""",
)
def sanitized_reviews(t):
    ranked = cut_lineage(top5(t, 8))  # read by the reviews and by their sanitation, ranked once
    clean = reviews.sanitize(_odd_reviews(ranked), ranked, 5)
    return clean.select(
        "profile_id", F.posexplode("keep_ids").alias("pos", "id"), "confidence",
        F.col("feedback")["cost"].alias("fb_cost"), F.col("feedback")["fit"].alias("fb_fit"),
        F.size("feedback").alias("n_feedback"), "notes",
    ).withColumn("note", F.try_element_at("notes", F.col("id"))).drop("notes")


_ARGMAX = "case " + " ".join(
    f"when {c} = greatest({', '.join(V.COMPONENTS)}) then '{c}'" for c in V.COMPONENTS
) + " end"


@query(
    "feedback_loop_default",
    "I1 J14 M14 W7 E2",
    "with " + scored_ctes() + f"""
    select r.profile_id, cast(rank as int) "position", r.id, c.name, score, 'Strong on ' || {_ARGMAX} || printf(' (score %.2f).', score) rationale
    from ranked r join {{v_catalog}} c on r.id = c.id where rank <= 5""",
)
def feedback_loop_default(t):
    _, results = reviews.feedback_loop(ranked_profiles(t), t["v_catalog"])
    return results.select(
        "profile_id", F.col("position").cast("int").alias("position"), "id", "name", "score", "rationale",
    )


def scripted_review(k=5):
    """Disagrees once with a change of weights, then agrees."""

    def review(ranked, iteration):
        base = reviews.default_review(ranked, iteration, k)
        if iteration:
            return base.withColumn("confidence", F.lit("0.5"))
        return base.select(
            "profile_id",
            F.reverse("keep_ids").alias("keep_ids"),
            F.lit("0.5").alias("confidence"),
            F.create_map(F.lit("academic"), F.lit("0.6"), F.lit("cost"), F.lit("7")).alias("weight_feedback"),
            "notes",
        )

    return review


@query(
    "feedback_loop_trace",
    "I1 R5 W7 E2",
    "with " + scored_ctes() + """,
    first as (select profile_id, string_agg(id, ',' order by rank) top_ids from ranked where rank <= 5 group by 1),
    """ + rescored_ctes(_FEEDBACK, "2") + """,
    second as (select profile_id, string_agg(id, ',' order by rank) top_ids from ranked2 where rank <= 5 group by 1)
    select profile_id, 0 iteration, top_ids, 0.5e0 confidence, null stop_reason from first
    union all select profile_id, 1, top_ids, 0.5e0, 'R1_converged' from second""",
)
def feedback_loop_trace(t):
    trace, _ = reviews.feedback_loop(ranked_profiles(t), t["v_catalog"], scripted_review())
    return trace.withColumn("top_ids", F.array_join("top_ids", ","))


def stopping_review(k=5):
    """Never agrees. A third is sure of itself, a third asks for nothing, a third for other weights."""

    def review(ranked, iteration):
        third = F.col("profile_id") % 3
        weights = F.create_map(F.lit("academic"), F.lit("0.6"), F.lit("cost"), F.lit("7"))
        return reviews.default_review(ranked, iteration, k).select(
            "profile_id",
            F.reverse("keep_ids").alias("keep_ids"),
            F.when(third == 0, "0.95").otherwise("0.5").alias("confidence"),
            F.when(third == 2, weights).otherwise(F.create_map().cast("map<string,string>")).alias("weight_feedback"),
            "notes",
        )

    return review


@query(
    "feedback_loop_stops",
    "I1 R5 W7 E2",
    "with " + scored_ctes() + """,
    first as (select profile_id, string_agg(id, ',' order by rank) top_ids from ranked where rank <= 5 group by 1),
    """ + rescored_ctes(_FEEDBACK, "2") + """,
    second as (select profile_id, string_agg(id, ',' order by rank) top_ids from ranked2 where rank <= 5 group by 1)
    select profile_id, 0 iteration, top_ids, case when profile_id % 3 = 0 then 0.95e0 else 0.5e0 end confidence, case when profile_id % 3 = 0 then 'R2_confident' end stop_reason from first
    union all select profile_id, 1, top_ids, 0.5e0, 'R3_no_change' from first where profile_id % 3 = 1
    union all select profile_id, 1, s.top_ids, 0.5e0, case when s.top_ids = f.top_ids then 'R3_no_change' else 'R4_iteration_cap' end from second s join first f using (profile_id) where profile_id % 3 = 2""",
)
def feedback_loop_stops(t):
    trace, _ = reviews.feedback_loop(ranked_profiles(t), t["v_catalog"], stopping_review(), max_iterations=2)
    return trace.withColumn("top_ids", F.array_join("top_ids", ","))


@query(
    "activity_subjects",
    "J19 T31",
    "with hit as (select activity_id, case " + " ".join(
        f"when regexp_matches(text, '{re2(p)}') then '{'|'.join(subjects)}'" for p, subjects in V.ACTIVITY_SUBJECTS
    ) + " else '' end subjects from {v_activities}) select activity_id, subjects from hit",
)
def activity_subjects(t):
    masked = spread(t["v_activities"]).select(
        "activity_id", text.activity_mask(F.col("text")).alias("mask")
    )
    return masked.select(
        "activity_id", F.array_join(text.subjects_of_mask(F.col("mask")), "|").alias("subjects")
    )
