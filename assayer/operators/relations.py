"""Relations between normalised claims, and belief states: equi-joins with residual predicates, aggregations, and counts of pairs by range
windows where only their number is asked for."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import paired

#: Tolerances by unit; others have DEFAULT_TOLERANCE (fixed values).
TOLERANCES: dict[str, float] = {}
DEFAULT_TOLERANCE = 0.05
EPSILON = 1e-12


def pairs(claims: DataFrame, equal: list[tuple[str, Column | None]], residual) -> DataFrame:
    """Ordered pairs (a, b) that agree null-safely in ``equal`` and satisfy ``residual(a, b)``."""
    keyed = claims
    for name, expression in equal:
        keyed = keyed if expression is None else keyed.withColumn(name, expression)
    return paired(keyed, [name for name, _ in equal], "ord", residual("a", "b"))


def _two(extra: dict[str, Column]) -> list[Column]:
    return [F.col("a.claim_id").alias("claim_a"), F.col("b.claim_id").alias("claim_b"), *(c.alias(n) for n, c in extra.items())]


def _tolerance(unit: Column) -> Column:
    out = F.lit(DEFAULT_TOLERANCE)
    for u, t in TOLERANCES.items():
        out = F.when(unit == u, t).otherwise(out)
    return out


def contradictions(claims: DataFrame) -> DataFrame:
    """Absolute claims of one context, subject (case aside) and metric: opposed polarity at equal values, or values apart."""
    key = Window.partitionBy("context_id", F.lower("subject"), "metric").orderBy("ord")
    absolute = claims.where("subtype = 'absolute'").withColumn("tol", _tolerance(F.first("unit").over(key)))
    difference = F.abs(F.col("a.value") - F.col("b.value"))
    opposed = (F.col("a.polarity") != F.col("b.polarity")) & (difference <= F.least(F.col("a.tol"), F.lit(1e-9)) + EPSILON)
    apart = difference > F.col("a.tol") + EPSILON
    both = pairs(absolute, [("context_id", None), ("low", F.lower("subject")), ("metric", None)], lambda a, b: opposed | apart)
    return both.select(_two({"context_id": F.col("a.context_id"), "subject": F.col("a.low"), "metric": F.col("a.metric"), "difference": F.round(difference, 6), "reason": F.when(opposed, "polarity_opposition").otherwise("value_divergence")}))


def mean_of(value: Column) -> Column:
    """Mean to six places, half up, over whole millionths: does not depend on the order of summing."""
    whole = F.round(value * 1000000).cast("decimal(30,0)")
    twice = F.sum(whole) * 2 + F.count(value)
    return F.call_function("div", twice, F.count(value) * 2) / 1000000


def performance_variance(claims: DataFrame) -> DataFrame:
    out = claims.where("subtype = 'absolute'").groupBy("context_id", "metric").agg(
        F.count("*").alias("n"), F.countDistinct(F.lower("subject")).alias("subjects"), F.min("value").alias("value_min"), F.max("value").alias("value_max"), mean_of(F.col("value")).alias("value_mean"), F.round(F.max("value") - F.min("value"), 6).alias("value_range")
    )
    return out.where("n >= 2 and subjects >= 2")


def conditional_divergence(claims: DataFrame) -> DataFrame:
    """The same subject and metric in different contexts (null is a context of its own)."""
    both = pairs(claims.where("subtype = 'absolute'"), [("low", F.lower("subject")), ("metric", None)], lambda a, b: ~F.col("a.context_id").eqNullSafe(F.col("b.context_id")))
    return both.select(_two({"subject": F.col("a.low"), "metric": F.col("a.metric"), "context_a": F.col("a.context_id"), "context_b": F.col("b.context_id")}))


def legacy_contradictions(claims: DataFrame) -> DataFrame:
    """Any two claims of one context and metric, whatever their subjects and subtypes."""
    difference = F.abs(F.col("a.value") - F.col("b.value"))
    opposed = F.col("a.polarity") != F.col("b.polarity")
    both = pairs(claims, [("context_id", None), ("metric", None)], lambda a, b: opposed | (difference > DEFAULT_TOLERANCE))
    return both.select(_two({"context_id": F.col("a.context_id"), "metric": F.col("a.metric"), "reason": F.when(opposed, "polarity_opposition").otherwise("value_divergence")}))


def close_pairs(claims: DataFrame, keys: list[str], within: float) -> DataFrame:
    """``keys`` and close: number of unordered pairs of rows of a key whose values differ by ``within`` at most, in double
    arithmetic, without making the pairs: equal values are one row, and two range windows over them in order count those
    that are surely near and the few at the very edge. Null values are in no pair."""
    edge = min(1e-9, within)
    part = ", ".join(f"`{k}`" for k in keys)
    each = claims.where("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("n"))
    sure = F.expr(f"sum(n) over (partition by {part} order by value range between {within - edge!r}D preceding and current row)")
    rim = F.expr(f"collect_list(struct(value as v, n as m)) over (partition by {part} order by value range between {within + edge!r}D preceding and {within - edge!r}D preceding)")
    seen = each.withColumns({"_sure": sure, "_rim": rim})
    at_rim = F.aggregate("_rim", F.lit(0).cast("long"), lambda k, r: k + F.when((r.v < F.col("value") - (within - edge)) & (F.col("value") - r.v <= within), r.m).otherwise(0))
    pairs_ = F.col("n") * (F.col("_sure") - F.col("n") + at_rim) + F.floor(F.col("n") * (F.col("n") - 1) / 2)
    return seen.groupBy(*keys).agg(F.sum(pairs_).cast("long").alias("close"))


def _all_pairs(n: Column) -> Column:
    return F.floor(n * (n - 1) / 2)


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that takes null keys for equal."""
    other = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    return left.join(other, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left").drop(*(f"_{k}" for k in keys))


def contradiction_counts(claims: DataFrame) -> DataFrame:
    """context_id, metric and contradictions: how many rows contradictions() has, counted without making them."""
    keys = ["context_id", "low", "metric"]
    first = Window.partitionBy("context_id", F.lower("subject"), "metric").orderBy("ord")
    absolute = claims.where("subtype = 'absolute'").withColumn("low", F.lower("subject"))
    found = []
    for tol in sorted({DEFAULT_TOLERANCE, *TOLERANCES.values()}):
        own = absolute if not TOLERANCES else absolute.withColumn("tol", _tolerance(F.first("unit").over(first))).where(F.col("tol") == tol)
        equal = min(tol, 1e-9) + EPSILON
        total = own.groupBy(*keys).agg(_all_pairs(F.count("value")).alias("pairs"))
        known = own.where("polarity is not null")
        same = close_pairs(known, [*keys, "polarity"], equal).groupBy(*keys).agg(F.sum("close").alias("same"))
        both = _joined(_joined(_joined(total, close_pairs(own, keys, tol + EPSILON), keys), close_pairs(known, keys, equal).withColumnRenamed("close", "level"), keys), same, keys)
        n = F.col("pairs") - F.coalesce("close", F.lit(0)) + F.coalesce("level", F.lit(0)) - F.coalesce("same", F.lit(0))
        found.append(both.groupBy("context_id", "metric").agg(F.sum(n).alias("contradictions")))
    return reduce(DataFrame.unionByName, found).groupBy("context_id", "metric").agg(F.sum("contradictions").cast("long").alias("contradictions")).where("contradictions > 0")


def legacy_counts(claims: DataFrame) -> DataFrame:
    """context_id, metric and contradictions: how many rows legacy_contradictions() has. Two claims of known, different
    polarities always contradict; others if their values are apart."""
    keys = ["context_id", "metric"]
    n = claims.groupBy(*keys, "polarity").agg(F.count("*").alias("n"), F.count("value").alias("valued"))
    known = n.where("polarity is not null").groupBy(*keys).agg((_all_pairs(F.sum("n")) - F.sum(_all_pairs(F.col("n")))).alias("opposed"))
    alike = n.groupBy(*keys).agg((F.sum(F.when(F.col("polarity").isNotNull(), _all_pairs(F.col("valued"))).otherwise(0)) + _all_pairs(F.sum(F.when(F.col("polarity").isNull(), F.col("valued")).otherwise(0))) + F.sum(F.when(F.col("polarity").isNull(), F.col("valued")).otherwise(0)) * F.sum(F.when(F.col("polarity").isNotNull(), F.col("valued")).otherwise(0))).alias("alike"))
    near = close_pairs(claims, [*keys, "polarity"], DEFAULT_TOLERANCE).groupBy(*keys).agg(F.sum("close").alias("near"))
    unknown = claims.where("polarity is null").select(*keys).distinct()
    if unknown.limit(1).count():  # rows without polarity are compared with all others by value alone
        every, split = close_pairs(claims, keys, DEFAULT_TOLERANCE), close_pairs(claims.where("polarity is not null"), keys, DEFAULT_TOLERANCE).withColumnRenamed("close", "known")
        own = close_pairs(claims.where("polarity is not null"), [*keys, "polarity"], DEFAULT_TOLERANCE).groupBy(*keys).agg(F.sum("close").alias("own"))
        near = _joined(_joined(every, split, keys), own, keys).select(*keys, (F.col("close") - F.coalesce("known", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("near"))
    both = _joined(_joined(alike, known, keys), near, keys)
    total = F.coalesce("opposed", F.lit(0)) + F.col("alike") - F.coalesce("near", F.lit(0))
    return both.select(*keys, total.cast("long").alias("contradictions")).where("contradictions > 0")


def consensus(claims: DataFrame) -> DataFrame:
    keys = ["context_id", "metric"]
    groups = claims.groupBy(*keys).agg(F.count("*").alias("n"), mean_of(F.col("value")).alias("value_mean"), F.min("value").alias("value_min"), F.max("value").alias("value_max")).where("n >= 2")
    density = F.round(F.coalesce("contradictions", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2), 6)
    return _joined(groups, legacy_counts(claims), keys).select(*keys, "n", "value_mean", "value_min", "value_max", density.alias("density"))


def members(groups: DataFrame, claims: DataFrame, only: str | None = None) -> DataFrame:
    """context_id, metric, claim_id and subject of the claims of each group: its ids, as rows and not as one array, as a
    hot group may hold any number."""
    own = claims.where(only) if only else claims
    flagged = _joined(own.select("context_id", "metric", "claim_id", F.lower("subject").alias("subject")), groups.select("context_id", "metric", F.lit(True).alias("grouped")), ["context_id", "metric"])
    return flagged.where("grouped").drop("grouped")


def divergence_classes(claims: DataFrame, keys: dict[str, Column] | None = None, only: str | None = "subtype = 'absolute'") -> DataFrame:
    """Per subject and metric that hold in several contexts: contexts, claims, and the number of pairs across contexts that
    the pair form would give."""
    keys = keys or {"subject": F.lower("subject"), "metric": F.col("metric")}
    own = (claims.where(only) if only else claims).select("context_id", *(c.alias(k) for k, c in keys.items()))
    own = own.where(reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in keys)))
    each = own.groupBy(*keys, "context_id").agg(F.count("*").alias("n"))
    out = each.groupBy(*keys).agg(F.count("*").alias("contexts"), F.sum("n").alias("claims"), (F.floor((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2)).alias("links"))
    return out.where("contexts >= 2")


def group_contradictions(pairs_: DataFrame, claims: DataFrame) -> DataFrame:
    """context_id, metric and n: pairs (claim_a, claim_b) both of whose ids are in the group, whatever made the pair."""
    own = claims.select(F.col("context_id").alias("c"), F.col("metric").alias("m"), "claim_id").distinct()
    at = lambda side: own.select(F.col("c").alias(f"c_{side}"), F.col("m").alias(f"m_{side}"), F.col("claim_id").alias(f"claim_{side}"))
    both = pairs_.select("claim_a", "claim_b").join(at("a"), "claim_a").join(at("b"), "claim_b")
    same = F.col("c_a").eqNullSafe(F.col("c_b")) & F.col("m_a").eqNullSafe(F.col("m_b"))
    return both.where(same).groupBy(F.col("c_a").alias("context_id"), F.col("m_a").alias("metric")).agg(F.count("*").alias("n"))


def proposition_ids(groups: DataFrame) -> DataFrame:
    """proposition_id: digest of the compact JSON of context and metric, with other than ASCII characters escaped."""

    @F.pandas_udf("string")
    def digest(context: pd.Series, metric: pd.Series) -> pd.Series:
        text = [json.dumps({"context_id": c, "metric": m}, separators=(",", ":")) for c, m in zip(context.astype(object).where(context.notna(), None), metric.astype(object).where(metric.notna(), None), strict=True)]
        return pd.Series([hashlib.sha256(t.encode()).hexdigest() for t in text])

    return groups.withColumn("proposition_id", digest("context_id", "metric"))


def comparable_contradictions(claims: DataFrame, contexts: DataFrame) -> DataFrame:
    """claim_a, claim_b: claims of one subject and predicate, one for and one against, from comparable contexts (the same
    one is comparable to itself); claims of unknown contexts are in no pair."""
    from .contexts import compared, versions_agree

    same = compared()
    known = claims.join(contexts.select("context_id", *(c.alias(n) for n, c in same.items()), F.lower("dataset_version").alias("version")), "context_id")
    keys = ["low", "verb", *same]
    known = known.withColumns({"low": F.lower("subject"), "verb": F.lower("predicate")})
    side = lambda p, x: known.where(F.col("polarity") == p).select(F.col("claim_id").alias(f"claim_{x}"), F.col("ord").alias(f"ord_{x}"), F.col("version").alias(f"version_{x}"), *(F.col(k).alias(f"{k}_{x}") for k in keys))
    on = reduce(lambda x, y: x & y, (F.col(f"{k}_s").eqNullSafe(F.col(f"{k}_r")) for k in keys))
    both = side("supports", "s").join(side("refutes", "r"), on & versions_agree(F.col("version_s"), F.col("version_r")))
    first = F.col("ord_s") < F.col("ord_r")
    return both.select(F.when(first, F.col("claim_s")).otherwise(F.col("claim_r")).alias("claim_a"), F.when(first, F.col("claim_r")).otherwise(F.col("claim_s")).alias("claim_b"))


def conditions_overlap(claims: DataFrame) -> DataFrame:
    """The same without contexts, by conditions: claims that name equal data sets; or none of them names a data set, and
    equal domains or no domain at all. Equal conditions are a key, so only such pairs meet."""
    kind = F.when(F.coalesce("dataset", F.lit("")) != "", F.concat(F.lit("d:"), F.lower("dataset"))).when(F.coalesce("domain", F.lit("")) != "", F.concat(F.lit("o:"), F.lower("domain"))).otherwise("")
    known = claims.withColumns({"low": F.lower("subject"), "verb": F.lower("predicate"), "kind": kind})
    side = lambda p, x: known.where(F.col("polarity") == p).select("low", "verb", "kind", F.col("claim_id").alias(f"claim_{x}"), F.col("ord").alias(f"ord_{x}"))
    both = side("supports", "s").join(side("refutes", "r"), ["low", "verb", "kind"])
    first = F.col("ord_s") < F.col("ord_r")
    return both.select(F.when(first, F.col("claim_s")).otherwise(F.col("claim_r")).alias("claim_a"), F.when(first, F.col("claim_r")).otherwise(F.col("claim_s")).alias("claim_b"))


def legacy_divergence(claims: DataFrame) -> DataFrame:
    both = pairs(claims, [("low", F.lower("subject")), ("verb", F.lower("predicate")), ("metric", None)], lambda a, b: ~F.col("a.context_id").eqNullSafe(F.col("b.context_id")))
    return both.select(_two({"subject": F.col("a.low"), "metric": F.col("a.metric")}))


def context_boost(claims: DataFrame) -> DataFrame:
    """Subjects (case-sensitive) and metrics that hold in several contexts without any claim against them."""
    out = claims.groupBy("subject", "metric").agg(F.countDistinct("context_id").alias("contexts"), F.bool_and(F.col("polarity") == "supports").alias("supported"))
    return out.where("contexts >= 2 and supported").select("subject", "metric", "contexts")


def beliefs(claims: DataFrame) -> DataFrame:
    """One belief state per context and metric."""
    keys = ["context_id", "metric"]
    absolute = F.col("subtype") == "absolute"
    value = lambda f: F.coalesce(f(F.when(absolute, F.col("value"))), f("value"))
    groups = claims.groupBy(*keys).agg(
        F.count("*").alias("total"), value(F.min).alias("value_min"), value(F.max).alias("value_max"), value(lambda v: mean_of(F.col(v) if isinstance(v, str) else v)).alias("value_mean"),
        F.count_if(F.col("polarity") == "supports").alias("supporting"), F.count_if(F.col("polarity") == "refutes").alias("refuting"),
    )
    boosted = claims.join(context_boost(claims), ["subject", "metric"], "left_semi").select(F.col("context_id").alias("bc"), F.col("metric").alias("bm")).distinct().withColumn("boosted", F.lit(True))
    found = contradiction_counts(claims).select(F.col("context_id").alias("cc"), F.col("metric").alias("cm"), F.col("contradictions").alias("c"))
    same = lambda context, metric: F.col("context_id").eqNullSafe(F.col(context)) & F.col("metric").eqNullSafe(F.col(metric))
    joined = groups.join(found, same("cc", "cm"), "left").join(boosted, same("bc", "bm"), "left").withColumns({"contradictions": F.coalesce("c", F.lit(0)), "boost": F.coalesce("boosted", F.lit(False))})
    density = F.when(F.col("total") > 1, F.col("contradictions") / (F.col("total") * (F.col("total") - 1) / 2)).otherwise(0.0)
    ratio = F.when(F.col("supporting") + F.col("refuting") > 0, F.col("supporting") / (F.col("supporting") + F.col("refuting"))).otherwise(0.0)
    confidence = F.when((F.col("supporting") >= 3) & (ratio >= 0.75) & (density <= 0.2), "high").when((F.col("supporting") >= 2) & (ratio >= 0.6), "medium").when(F.col("boost"), "medium").otherwise("low")
    status = F.when(F.col("supporting") + F.col("refuting") == 0, "insufficient_evidence").when(F.col("refuting") == 0, "supported").when(F.col("refuting") > F.col("supporting"), "contested").otherwise("weakly_supported")
    return joined.select(*keys, "total", "value_min", "value_max", "value_mean", "supporting", "refuting", "contradictions", F.round(density, 6).alias("density"), (F.col("supporting") - F.col("refuting")).alias("strength"), confidence.alias("confidence"), status.alias("status"))


def duplicate_ids(claims: DataFrame, key: str = "claim_id") -> DataFrame:
    return claims.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in order; rows without a key all stay."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.where((F.col("_n") == 1) | F.col(key).isNull()).drop("_n")


def tool_metrics(traces: DataFrame) -> DataFrame:
    """Per session and tool, per session, and over all: calls, errors, cache hits, tokens and mean duration. The mean is taken
    over whole ten-thousandths, half rounded up, so that it does not depend on the order of summing."""
    mean = F.expr("(2 * sum(cast(round(duration * 10000) as bigint)) + count(*)) div (2 * count(*)) / 10000")
    return traces.rollup("session_id", "tool").agg(
        F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), mean.alias("mean_duration"),
        F.round(F.count_if(F.col("status") == "error") / F.count("*"), 6).alias("error_rate"), F.round(F.count_if("cache_hit") / F.count("*"), 6).alias("cache_rate"),
    )


def ratios(rows: DataFrame) -> DataFrame:
    """Five ratios of sums over all rows; 0 where there is nothing to divide by."""
    of = lambda a, b, name: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0).alias(name)
    return rows.agg(
        of("extracted_claims", "expected_claims", "claim_extraction_yield"), of("truly_equivalent_collapses", "collapsed_claim_pairs", "normalization_precision"),
        of("contradictions_found", "known_contradictions", "contradiction_recall"), of("hypotheses_grounded", "hypotheses_generated", "hypothesis_grounding_rate"),
        of("proposals_complete", "proposals_generated", "proposal_completeness"),
    )
