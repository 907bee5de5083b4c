"""The findings table: union, limits, dedupe, ranking.

Columns: target_id, path, rule_id, name, severity, category, language, line, snippet, capabilities, confidence, method,
destination, metadata, scanner_seq, emit_seq. Caps and dedupe are windows by target and path, so a large target is no hot key;
ranks are taken in ranges of their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .rulebook import SEVERITIES

SCHEMA = (
    "target_id string, path string, rule_id string, name string, severity string, category string, language string, line int, snippet string, "
    "capabilities array<string>, confidence string, method string, destination string, metadata map<string,string>, scanner_seq int, emit_seq long"
)
MAX_FINDINGS, MAX_DEPENDENCIES = 10_000, 50_000


def severity_rank(severity: Column) -> Column:
    """0 for info to 4 for critical; null for others."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)
    return F.when(rank > 0, (rank - 1).cast("int"))


def union_findings(*parts: DataFrame) -> DataFrame:
    """All scanners' findings in scanner order; missing columns are null."""
    columns = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    types = dict(f.split(" ", 1) for f in SCHEMA.split(", "))
    out = None
    for seq, part in enumerate(parts):
        have = part.columns
        row = part.select(*[(F.lit(seq) if c == "scanner_seq" else part[c] if c in have else F.lit(None)).cast(types[c]).alias(c) for c in columns])
        out = row if out is None else out.unionByName(row)
    return out


def cap_per_rule(findings: DataFrame, most: int = 100) -> DataFrame:
    """The first lines of each rule and file."""
    w = Window.partitionBy("target_id", "path", "rule_id").orderBy("line")
    return findings.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def cap_per_file(findings: DataFrame, most: int = 1_000) -> DataFrame:
    """The first findings of each file and scanner, in order of emission."""
    w = Window.partitionBy("target_id", "path", "scanner_seq").orderBy("emit_seq")
    return findings.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def suppress_shell_download(findings: DataFrame) -> DataFrame:
    """A plain download is not reported where the same line is already reported as piped into a shell."""
    w = Window.partitionBy("target_id", "path", "line")
    piped = F.max(F.col("rule_id").isin("SI-SH-001", "SI-SH-002").cast("int")).over(w)
    return findings.withColumn("__piped", piped).where(~((F.col("rule_id") == "SI-SH-006") & (F.col("__piped") == 1))).drop("__piped")


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One finding per target, rule, path, line and name: the last emitted, at the place of the first."""
    w = Window.partitionBy("target_id", "path", "rule_id", "line", "name").orderBy("scanner_seq", "emit_seq")
    first = F.first(F.struct("scanner_seq", "emit_seq")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = findings.withColumns({"__more": F.lead(F.lit(True)).over(w), "__first": first}).where("__more is null")
    return kept.withColumn("first_seq", F.col("__first.scanner_seq")).withColumn("first_emit", F.col("__first.emit_seq")).drop("__more", "__first")


def ranking() -> list[Column]:
    """The order of a target's findings."""
    return [F.desc(severity_rank(F.col("severity"))), F.lower("path").asc(), F.coalesce("line", F.lit(0)).asc(), F.col("rule_id").asc(), F.col("first_seq").asc(), F.col("first_emit").asc()]


def ranked_within(rows: DataFrame, group: str, order: list[Column], name: str = "rank", counted: DataFrame | None = None) -> DataFrame:
    """Adds the place of each row in its group, from 1, as long; a group may hold all rows.

    Groups are counted first. Fewer of them than there are partitions hold more than a partition's share of the rows: these are
    ranked in ranges of their order, all others by one window. Where rows are dear to compute, `counted` may be given: a cheaper
    table with the same groups and no fewer rows of each.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = (rows if counted is None else counted).groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__n"))
    total, most = sizes.agg(F.sum("__n"), F.max("__n")).first()
    share = (total or 0) // ranges
    alone = lambda part: part.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    if (most or 0) <= share:
        return alone(rows)
    large, same = F.broadcast(sizes.where(F.col("__n") > share).select("__group")), F.col(group).eqNullSafe(F.col("__group"))
    wide = ranked_in_ranges(rows if most == total else rows.join(large, same, "left_semi"), group, order, name, ranges)
    return wide if most == total else wide.unionByName(alone(rows.join(large, same, "left_anti")))


def ranked_in_ranges(rows: DataFrame, group: str, order: list[Column], name: str, ranges: int) -> DataFrame:
    """ranked_within for groups that are too large for one task.

    Rows are dealt by ranges of (group, order) and written; a piece is what a range has of a group. A row's place is the number
    of rows in its group's earlier pieces, which are summed from one count per piece, and its place in its own piece. Rows that
    agree in the whole order are in one piece, so it should tell rows apart.
    """
    pieces = written(rows.repartitionByRange(ranges, F.col(group), *order).withColumn("__piece", F.spark_partition_id()), "ranges")
    sizes = pieces.groupBy(F.col(group).alias("__group"), F.col("__piece").alias("__of")).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("__group").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    known = pieces.join(sizes, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__piece") == F.col("__of")))
    own = F.row_number().over(Window.partitionBy(group, "__piece").orderBy(*order))
    return known.withColumn(name, F.col("__base") + own).drop("__piece", "__group", "__of", "__n", "__base")


def rank_findings(deduped: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Adds `rank` per target: severity, path, line, rule, then first emission. `found`: the findings before dedupe, to be counted
    in place of deduped ones that are not written."""
    return ranked_within(deduped, "target_id", ranking(), counted=found)


def top_findings(deduped: DataFrame, n: int = 5) -> DataFrame:
    """The first n of the ranking; the limit is pushed below the shuffle, so of each target a task sends n rows."""
    return deduped.withColumn("rank", F.row_number().over(Window.partitionBy("target_id").orderBy(*ranking()))).where(F.col("rank") <= n)


def limit_check(findings: DataFrame, dependencies: DataFrame | None = None, most_findings: int = MAX_FINDINGS, most_dependencies: int = MAX_DEPENDENCIES) -> DataFrame:
    """(target_id, reason) of targets with too many findings or dependencies, counted before any dedupe."""

    def over(df: DataFrame, most: int, reason: str) -> DataFrame:
        return df.groupBy("target_id").count().where(F.col("count") > most).select("target_id", F.lit(reason).alias("reason"))

    rejected = over(findings, most_findings, "too_many_findings")
    return rejected if dependencies is None else rejected.unionByName(over(dependencies, most_dependencies, "too_many_dependencies"))
