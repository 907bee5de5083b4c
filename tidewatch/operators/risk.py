"""Risk per target from its deduplicated findings: one grouped aggregation, then expressions.

Every aggregation is by target with map-side partials; targets without findings come from the targets table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .findings import severity_rank
from .rulebook import CAPABILITIES, SEVERITIES

# Score of the highest severity, info to critical.
BASE_SCORES = (0, 8, 28, 58, 88)
ADVICE = {"critical": "do_not_run", "high": "do_not_run_unless_trusted", "medium": "review_first", "low": "review_indicators", "info": "usual_care"}
# Categories of findings about the rights of workflows.
WORKFLOW_RIGHTS = ["workflow_permission", "workflow_privilege"]
CHAIN_REASONS = ("Environment is read and data may be posted to an unknown place.", "Fetched content may be run unseen.", "Raised rights may be joined with lasting changes.")


def _has(capability: str) -> Column:
    return F.bool_or(F.array_contains("capabilities", capability))


def _evidence_key() -> Column:
    return F.struct("rule_id", "path", F.coalesce("line", F.lit(-1)))


def aggregates(findings: DataFrame, *more: Column) -> DataFrame:
    """What risk needs of each target's findings, in one shuffle, and more aggregates where they are asked for.

    Two different pieces of evidence for rights and persistence exist unless both have only one and the same; so the
    smallest and largest evidence of each are enough, and no set of evidence is built.
    """
    priv, pers = (F.array_contains("capabilities", c) for c in ("privilege_escalation", "persistence"))
    post = (F.upper("method") == "POST") & (F.col("destination") == "unknown")
    return findings.groupBy("target_id").agg(
        F.count("*").alias("n_findings"),
        F.max(severity_rank(F.col("severity"))).alias("top"),
        F.collect_set("category").alias("categories"),
        *[F.coalesce(_has(c), F.lit(False)).alias(c) for c in CAPABILITIES],
        F.coalesce(F.bool_or(post), F.lit(False)).alias("unknown_post"),
        F.min(F.when(priv, _evidence_key())).alias("priv0"),
        F.max(F.when(priv, _evidence_key())).alias("priv1"),
        F.min(F.when(pers, _evidence_key())).alias("pers0"),
        F.max(F.when(pers, _evidence_key())).alias("pers1"),
        *more,
    )


def observed() -> Column:
    """Observed capabilities in declaration order."""
    return F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in CAPABILITIES]))


def base_score() -> Column:
    base = F.element_at(F.array(*[F.lit(b) for b in BASE_SCORES]), F.col("top") + 1)
    return base + F.least(F.lit(15), F.greatest(F.lit(0), F.size("categories") - 1) * 3) + F.least(F.lit(10), F.size(observed()) * 2)


def chains() -> tuple[Column, Column, Column]:
    """Environment and unknown post; download and execute; raised rights and persistence in different evidence."""
    both = F.col("priv0").isNotNull() & F.col("pers0").isNotNull()
    same = (F.col("priv0") == F.col("priv1")) & (F.col("pers0") == F.col("pers1")) & (F.col("priv0") == F.col("pers0"))
    return F.col("environment_read") & F.col("network_access") & F.col("unknown_post"), F.col("download_execute"), both & ~F.coalesce(same, F.lit(False))


def level_of(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 50, "high").when(score >= 20, "medium").when(score >= 5, "low").otherwise("info")


def _scored(agg: DataFrame, *more: str) -> DataFrame:
    """The scores of targets from their aggregates."""
    posted, downloaded, persisted = chains()
    score = base_score()
    score = F.when(posted, F.greatest(F.lit(55), score + 25)).otherwise(score)
    score = F.when(downloaded, F.greatest(F.lit(55), score)).otherwise(score)
    score = F.when(persisted, F.greatest(F.lit(65), score + 15)).otherwise(score)
    return agg.select("target_id", "n_findings", *CAPABILITIES, observed().alias("observed"), F.least(F.lit(100), score).alias("score"), *[c.alias(f"chain{i}") for i, c in enumerate((posted, downloaded, persisted))], *more)


def _explained(joined: DataFrame, reasons: int, *more: str) -> DataFrame:
    """What is said of every target; those without findings have no scores and no names."""
    said = F.array_compact(F.array(*[F.when(F.col(f"chain{i}"), F.lit(r)) for i, r in enumerate(CHAIN_REASONS)]))
    all_reasons = F.slice(F.concat(said, F.coalesce("named", F.array().cast("array<string>"))), 1, reasons)
    return joined.select(
        "target_id", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.coalesce("score", F.lit(0)).alias("score"), level_of(F.coalesce("score", F.lit(0))).alias("level"),
        all_reasons.alias("primary_reasons"), F.coalesce("observed", F.array().cast("array<string>")).alias("observed"), *[F.coalesce(c, F.lit(False)).alias(c) for c in CAPABILITIES], *more,
    )


def assess(findings: DataFrame, targets: DataFrame, reasons: int = 5) -> DataFrame:
    """One row per target: score, level, primary_reasons, observed and one column per capability."""
    scored, texts = _scored(aggregates(findings)), primary_names(findings, reasons)
    return _explained(targets.select("target_id").join(scored, "target_id", "left").join(texts, "target_id", "left"), reasons)


def assess_listed(findings: DataFrame, targets: DataFrame, entry: Column, reasons: int = 5) -> DataFrame:
    """assess, and the sorted entries of a target's findings as `findings`, null where there are none: one aggregation for all.

    For targets whose findings are bounded, as a list of them is; names are a set beside it. What is collected is a column before,
    as an aggregate interprets what it is given.
    """
    findings = findings.select("*", _said().alias("__said"), entry.alias("__entry"))
    agg = aggregates(findings, F.collect_set("__said").alias("said"), F.sort_array(F.collect_list("__entry")).alias("findings"))
    agg = agg.withColumn("named", F.slice(F.sort_array("said", asc=False), 1, reasons)["text"])
    return _explained(targets.select("target_id").join(_scored(agg, "named", "findings"), "target_id", "left"), reasons, "findings")


def _said() -> Column:
    """A finding's name as a reason, after what orders it."""
    return F.struct(severity_rank(F.col("severity")).alias("r"), F.lower("name").alias("n"), F.concat(F.upper("severity"), F.lit(": "), F.col("name"), F.lit(".")).alias("text"))


def primary_names(findings: DataFrame, most: int = 5) -> DataFrame:
    """(target_id, named): "SEVERITY: name." by severity and name, both falling; the first `most` different ones.

    Distinct pairs first (few per target), then a bounded list: no list of all findings is built.
    """
    said = findings.select("target_id", *[_said()[k].alias(k) for k in ("r", "n", "text")]).distinct()
    top = said.withColumn("k", F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("r"), F.desc("n"), F.desc("text")))).where(F.col("k") <= most)
    return top.groupBy("target_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("named"))


def capability_matrix(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """12 rows per target: YES, NO, or UNKNOWN instead of NO when its coverage is partial (targets: target_id, status)."""
    agg = findings.groupBy("target_id").agg(*[F.coalesce(_has(c), F.lit(False)).alias(c) for c in CAPABILITIES])
    joined = targets.select("target_id", "status").join(agg, "target_id", "left")
    long = joined.select("target_id", "status", F.expr(f"stack({len(CAPABILITIES)}, {', '.join(f'{chr(39)}{c}{chr(39)}, {c}' for c in CAPABILITIES)}) as (capability, seen)"))
    answer = F.when(F.coalesce("seen", F.lit(False)), "YES").when(F.col("status") == "partial", "UNKNOWN").otherwise("NO")
    return long.select("target_id", "capability", answer.alias("answer"))


def coverage(targets: DataFrame, skipped: DataFrame, recorded: int = 100) -> DataFrame:
    """One row per target: status, skipped_count, and the first `recorded` skipped paths with reasons."""
    n = skipped.groupBy("target_id").agg(F.count("*").alias("skipped_count"))
    first = skipped.withColumn("__n", F.row_number().over(Window.partitionBy("target_id").orderBy("path", "reason"))).where(F.col("__n") <= recorded)
    listed = first.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("path", "reason"))).alias("skipped_paths"))
    joined = targets.select("target_id").join(n, "target_id", "left").join(listed, "target_id", "left")
    count = F.coalesce("skipped_count", F.lit(0))
    return joined.select("target_id", F.when(count > 0, "partial").otherwise("complete").alias("status"), count.alias("skipped_count"), F.coalesce("skipped_paths", F.array().cast("array<struct<path:string,reason:string>>")).alias("skipped_paths"))


def files_scanned(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """(target_id, files_scanned, rejected): a target without any source is rejected."""
    n = sources.groupBy("target_id").agg(F.count("*").alias("n"))
    return targets.select("target_id").join(n, "target_id", "left").select("target_id", F.coalesce("n", F.lit(0)).alias("files_scanned"), F.coalesce("n", F.lit(0)).eqNullSafe(F.lit(0)).alias("rejected"))


def advice(assessed: DataFrame, status: Column) -> DataFrame:
    """Adds codes: recommendation by level and coverage, and why (the first thing that holds).

    A partial scan says review_skipped, and from medium on also what its level says, after a plus sign.
    """
    by_level = F.element_at(F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair]), F.col("level"))
    partial = F.when(F.col("level").isin("info", "low"), "review_skipped").otherwise(F.concat(F.lit("review_skipped+"), by_level))
    recommendation = F.when(status == "partial", partial).otherwise(by_level)
    why = F.when(status == "partial", "partial").when(F.col("download_execute"), "download").when(F.col("shell_execution"), "shell").when(F.col("sensitive_data_access"), "sensitive").when(F.col("n_findings") > 0, "any").otherwise("none")
    return assessed.withColumn("recommendation", recommendation).withColumn("why", why)


def bounded_checks(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """Statements that a complete scan allows (targets: target_id, status); null when it is partial."""
    seen = findings.groupBy("target_id").agg(_has("persistence").alias("persistence"), F.bool_or(F.col("category") == "secret_exposure").alias("secret"), F.bool_or(F.col("category").isin(WORKFLOW_RIGHTS)).alias("workflow"))
    joined = targets.select("target_id", "status").join(seen, "target_id", "left")
    complete = F.col("status") == "complete"
    return joined.select("target_id", *[F.when(complete, ~F.coalesce(c, F.lit(False))).alias(f"no_{c}") for c in ("persistence", "secret", "workflow")])


assert len(BASE_SCORES) == len(SEVERITIES)
