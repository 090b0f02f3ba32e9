"""The scoring policy: one expression from the signals of a line or template to its score and reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import severity
from tidemark.functions.text import has_catastrophe, has_failure

# Fixed values of the policy.
THRESHOLDS = {"low": 0.80, "normal": 0.70, "high": 0.60}
CHRONIC_DAMP, GLOBAL_RARE_BONUS = 0.45, 0.18
SOFTCAP_START, SOFTCAP_TAU = 0.80, 0.60
HISTORY_HEAD, HISTORY_COUNT, HISTORY_SPAN, HISTORY_DAMP = 0.25, 5, 0.40, 0.45
RARE_CODES = ("rare", "unclustered", "semantic_outlier", "rare_template")
REASON = "struct<code:string,weight:double>"


@dataclass(frozen=True)
class Policy:
    rare_min: int = 3
    rare_pct: float = 0.01
    safe_rarity_damp: float = 1.0


#: The count-based scan uses the policy's own defaults, the full detector these.
FULL = Policy(rare_min=3, rare_pct=0.02, safe_rarity_damp=0.5)


def soft_cap(x: Column) -> Column:
    return F.when(x <= SOFTCAP_START, F.greatest(F.lit(0.0), x)).otherwise(SOFTCAP_START + (1 - SOFTCAP_START) * (1 - F.exp(-(x - SOFTCAP_START) / SOFTCAP_TAU)))


def volume_confidence(n: Column, k: float) -> Column:
    return F.lit(1.0) if k <= 0 else n / (n + k)


def score(
    level: Column, message: Column, count: Column, level_total: Column, total: Column, policy: Policy = Policy(), *, cluster: Column | None = None,
    cluster_size: Column | None = None, outlier: Column | None = None, z: Column | None = None, distance: Column | None = None, burst: Column | None = None,
    flood: Column | None = None, recurring: Column | None = None, global_rare: Column | None = None, span: Column | None = None, novel: Column | None = None,
    surge: Column | None = None, chronic: Column | None = None, history: Column | None = None, confidence: Column | None = None, said: tuple[Column, Column] | None = None, reasons: bool = True,
) -> Column:
    """struct(score, reasons) by the policy; reasons are (code, weight) in the policy's order. Signals not given are off.

    said tells whether the message speaks of a catastrophe or a failure, where that is known already.
    """
    catastrophe, failure = said if said else (has_catastrophe(message), has_failure(message))
    no, zero = F.lit(False), F.lit(0.0)
    burst, flood, recurring, global_rare, novel, surge, chronic, outlier = (x if x is not None else no for x in (burst, flood, recurring, global_rare, novel, surge, chronic, outlier))
    span, history, z, distance = (x if x is not None else zero for x in (span, history, z, distance))
    confidence = confidence if confidence is not None else F.lit(1.0)
    count, total_f = count.cast("double"), total.cast("double")
    rank = severity.rank(level)
    hard, serious = rank <= 1, rank <= 4

    routine = F.when((rank >= 3) & (rank <= 4) & (count >= HISTORY_COUNT) & (span >= HISTORY_SPAN), F.least(F.lit(1.0), F.greatest(zero, (history - HISTORY_HEAD) / (1 - HISTORY_HEAD)))).otherwise(zero)
    damped = severity.base(rank) * F.when(chronic, CHRONIC_DAMP).otherwise(1.0) * (1 - HISTORY_DAMP * routine)
    base = F.when(hard, severity.base(rank)).otherwise(damped)

    limit = F.greatest(F.lit(policy.rare_min), F.floor(level_total * policy.rare_pct)).cast("double")
    size = count if cluster is None else cluster_size.cast("double")
    noise = no if cluster is None else cluster == -1
    small = size <= limit
    by_size = F.when(noise, 0.75).when(small, 0.45 + 0.30 * (1 - size / (limit + 1))).otherwise(zero)
    far = F.when(outlier, F.least(0.35 + 0.10 * F.greatest(zero, z - 2), F.lit(0.75))).otherwise(zero)
    few = count <= F.greatest(F.lit(2.0), F.floor(level_total * 0.005).cast("double"))
    rarity = F.greatest(by_size, far, F.when(few, 0.40).otherwise(zero))
    extreme = outlier & (z >= 4.0) & (distance > 0.08)
    rarity = rarity * F.when((rank >= 5) & ~extreme, policy.safe_rarity_damp).otherwise(1.0) * F.when(chronic, CHRONIC_DAMP).otherwise(1.0) * confidence

    live = ~chronic & serious
    conc = (count / (count + 8)) * (1 - span)
    bonuses = [
        ("global_rare", global_rare & live, GLOBAL_RARE_BONUS * confidence),
        ("burst", burst, F.lit(0.50)),
        ("flood", flood, 0.35 + 0.25 * F.least(F.lit(1.0), count / total_f)),
        ("recurring", recurring & ~chronic, 0.02 + 0.25 * conc),
        ("catastrophe", live & catastrophe, F.lit(0.20)),
        ("failure", live & failure, F.lit(0.22)),
        ("novel", novel & serious, F.lit(0.35)),
        ("surge", surge & serious & ~novel, F.lit(0.30)),
    ]
    raw = base + rarity
    for _, test, weight in bonuses:
        raw = raw + F.when(test, weight).otherwise(zero)
    value = soft_cap(raw)
    if not reasons:
        return F.struct(value.alias("score"))
    why = lambda code, test, weight: F.when(test, F.struct(F.lit(code).alias("code"), weight.cast("double").alias("weight")))
    rare_first = [
        ("unclustered", noise), ("rare", ~noise & small), ("semantic_outlier", outlier), ("rare_template", few & ~noise & ~small),
    ]
    rare, before = [], no
    for code, test in rare_first:  # the first reason of rarity has its weight
        rare.append(why(code, test, F.when(before, zero).otherwise(F.round(rarity, 4))))
        before = before | test
    every = [why("hard_flag", hard, base), why("routine_history", ~hard & (routine > 0), zero), why("severity", ~hard & (damped > 0), damped), *rare, why("chronic", chronic, zero), *(why(c, t, F.round(w, 4)) for c, t, w in bonuses)]
    return F.struct(value.alias("score"), F.filter(F.array(*every), lambda r: r.isNotNull()).alias("reasons"))
