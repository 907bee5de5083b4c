"""The whole scan of a corpus of projects, from raw files to risk: one call for all targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..sources import files as sources_
from ..sources.shared import written
from . import components, detectors, manifests, python_code, risk, syntax, workflows
from . import findings as fd
from .reports import Scanners


def named_files(sources: DataFrame) -> DataFrame:
    """Manifests and component files, written by file_name: their readers take a few names out of a few languages."""
    names = [*paths.MANIFESTS, *components.COMPONENTS]
    languages = sorted({paths.NAMES.get(n, paths.LANGUAGES.get("." + n.rsplit(".", 1)[-1])) for n in names})
    files = sources.where(F.col("language").isin(languages)).withColumn("file_name", paths.file_name(F.col("path"))).where(F.col("file_name").isin(names))
    return written(files, "named-files", partition_by=("file_name",))


def all_findings(sources: DataFrame, named: DataFrame, dependencies: DataFrame, user: Scanners | None = None) -> DataFrame:
    """Findings of all scanners in their fixed order, then of manifests, then of user scanners.

    All scanners of lines share one pass over the sources, whose hits are written; Python files are parsed once into a written
    table of facts; the other scanners read the partitions of their language, or of the files that they know by name.
    """
    hits = written(detectors.line_hits(sources, detectors.line_scans()), "line-hits", partition_by=("scan",))
    facts = written(python_code.python_facts(sources.where(F.col("language") == "python")), "python-facts")
    parts = (
        detectors.detect_secrets(sources, hits), python_code.scan_python_calls(sources, facts), python_code.scan_python_behavior(sources, facts), detectors.detect_sensitive_paths(sources, hits),
        detectors.detect_shell(sources, hits), syntax.scan_javascript(sources), syntax.detect_powershell(sources), detectors.detect_batch(sources, hits), workflows.scan_workflows(sources),
        detectors.detect_prompts(sources, hits), components.scan_components(named), python_code.scan_mcp_python(sources, facts), detectors.detect_installers(sources), detectors.detect_docker(sources, hits),
        manifests.npm_lifecycle_scripts(named), manifests.dependency_findings(dependencies),
    )
    return fd.union_findings(*parts, *([user.scan(sources)] if user else []))


def scan_corpus(raw_files: DataFrame, max_bytes: int = sources_.MAX_FILE_BYTES, user: Scanners | None = None, limits: bool = True) -> dict[str, DataFrame]:
    """Tables of a scan by name: targets, findings (ranked), dependencies (ranked), risk, coverage, rejected.

    raw_files: target_id, path, length, content. A target beyond a limit (unless limits is false: then its tables are whole,
    however large it is), or without any file that can be read, is in `rejected` with its first reason and in no other table. Discovered files are written by language, so that content is read
    once by the scanners of lines and once by those of its language; findings and dependencies are each written once, since
    several results read them. Every window is by target and path, or by target after the limits; ranks are taken in ranges.
    """
    found = written(sources_.discover(raw_files, max_bytes), "discovered", partition_by=("language",))
    sources, skipped = sources_.split_discovered(found)
    named = named_files(sources)
    dependencies = written(manifests.all_dependencies(named), "dependencies")
    findings = written(all_findings(sources, named, dependencies, user), "findings")
    everyone = raw_files.select("target_id").distinct()
    scanned = risk.files_scanned(everyone, sources)
    reasons = [scanned.where("rejected").select("target_id", F.lit(1).alias("place"), F.lit("no_readable_file").alias("reason"))]
    if limits:
        reasons += [
            sources_.discovery_limits(raw_files, found).select("target_id", F.lit(0).alias("place"), "reason"),
            fd.limit_check(findings, dependencies).select("target_id", F.lit(2).alias("place"), "reason"),
        ]
    rejected = reduce(DataFrame.unionByName, reasons).groupBy("target_id").agg(F.min_by("reason", F.struct("place", "reason")).alias("reason"))
    rejected = written(rejected, "rejected")
    allowed = lambda df: df.join(rejected.select("target_id"), "target_id", "left_anti")
    targets = allowed(scanned).select("target_id", "files_scanned")
    deduped = fd.dedupe_findings(allowed(findings))
    return {
        "targets": targets, "findings": fd.rank_findings(deduped), "dependencies": manifests.sort_dependencies(allowed(dependencies)), "risk": risk.assess(deduped, targets),
        "coverage": risk.coverage(targets, allowed(skipped)), "rejected": rejected,
    }
