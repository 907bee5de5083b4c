"""Workflow files: a helper reads the YAML and returns its entries as rows, with the line each stands on; the rules
are columns over the entries. A file that goes beyond the reader's limits has no entries; workflow_status tells which."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.patterns import java
from ..functions.search import first_lines
from .by_file import file_rows
from .python_code import MAX_PER_FILE, hit, labels, reported, strings, with_snippets
from .safe_yaml import YamlFault, read_yaml

ENTRIES = "kind string, seq long, line int, value string, raw string"


def workflow_entries(content: str) -> list[tuple[str, str, int, str]]:
    """(kind, value, line, text of the line): trigger, rights, uses and run entries of all mappings, then all strings as text.

    Deeper entries come level by level from the end of the file, as a stack gives them. An entry stands on the line of the
    first 80 characters of its value's first line, else of its kind's mark, else on the first; all are looked up in one scan.
    """
    document = read_yaml(content)
    if not isinstance(document, dict):
        return []
    out, texts = [], []
    trigger = document.get("on")
    if trigger == "pull_request_target" or (isinstance(trigger, dict) and "pull_request_target" in trigger):
        out.append(("trigger", "pull_request_target", "", "pull_request_target"))
    anchor = {"permissions": ("rights", "permissions: write-all"), "uses": ("uses", "uses:"), "run": ("run", "run:")}
    rest: list[object] = [document]
    while rest:
        match rest.pop():
            case str(value):
                texts.append(value)
            case list(items):
                rest += items
            case dict(entry):
                for key, (kind, mark) in anchor.items():
                    value = entry.get(key)
                    if isinstance(value, str):
                        out.append((kind, value, "" if kind == "rights" else value, mark))
                rest += entry.values()
    out += [("text", t, t, "secrets.") for t in texts if "secrets." in t]
    leads = [next(iter(shown.strip().splitlines()), "")[:80] for _, _, shown, _ in out]
    at = first_lines(content, {*leads, *(mark for *_, mark in out)})
    lines = content.splitlines()
    found = [(kind, value, at.get(lead) or at.get(mark, 1)) for (kind, value, _, mark), lead in zip(out, leads)]
    return [(kind, value, line, lines[line - 1] if line <= len(lines) else "") for kind, value, line in found]


def _entries(files: DataFrame) -> DataFrame:
    def rows(_: str, content: str) -> list[tuple]:
        try:
            found = workflow_entries(content)
        except YamlFault:
            return []
        return [(kind, seq, line, value, raw) for seq, (kind, value, line, raw) in enumerate(found)]

    return file_rows(files, rows, ENTRIES)


@F.udf(StringType(), useArrow=False)
def _fault(content: str | None) -> str | None:
    try:
        read_yaml(content or "")
    except YamlFault as e:
        return str(e)
    return None


def workflow_status(sources: DataFrame) -> DataFrame:
    """(target_id, path, parse_ok, reason) of workflow files: which could not be read within the limits, and why."""
    files = sources.where(F.col("language") == "github-actions").select("target_id", "path", _fault(F.col("content")).alias("reason"))
    return files.select("target_id", "path", F.col("reason").isNull().alias("parse_ok"), "reason")


def scan_workflows(sources: DataFrame) -> DataFrame:
    """SI-GHA-001 to 009; one finding per rule, line and metadata, by line and rule, at most MAX_PER_FILE of a file."""
    kind, value = F.col("kind"), F.col("value")
    published = (kind == "uses") & ~value.startswith("./") & ~value.startswith("docker://") & value.contains("@")
    reference = F.substring_index(value, "@", -1)
    action = F.regexp_replace(value, r"@[^@]*\z", "")
    owner, low = F.lower(F.substring_index(action, "/", 1)), F.lower(action)
    moved = F.when(low == "actions/download-artifact", "download").when(low == "actions/upload-artifact", "upload")
    known = labels(action=action, reference=reference)
    hits = [
        hit(kind == "trigger", "SI-GHA-001", "Trigger with the rights of the base", "high", "workflow_privilege", strings("privilege_escalation")),
        hit((kind == "rights") & (value == "write-all"), "SI-GHA-002", "All rights to write", "high", "workflow_permission", strings("privilege_escalation")),
        hit(published & ~owner.isin("actions", "github"), "SI-GHA-003", "Action of another publisher", "info", "third_party_action", strings(), metadata=known),
        hit(published & ~reference.rlike(r"\A[0-9a-fA-F]{40}\z"), "SI-GHA-004", "Action is not pinned to a commit", "medium", "supply_chain", strings(), metadata=known),
        hit((kind == "run") & value.rlike(java(r"\b(?:curl|wget)\b[^|\n]*\|\s*(?:bash|sh)\b")), "SI-GHA-005", "Step runs a fetched script", "high", "download_and_execute", strings("network_access", "download_execute", "shell_execution")),
        hit((kind == "run") & value.rlike(java(r"\$\{\{\s*github\.event\.pull_request\.")), "SI-GHA-006", "Text of a stranger in a shell step", "high", "command_injection", strings("shell_execution")),
        hit((kind == "text") & value.rlike(java(r"\$\{\{\s*secrets\.[A-Za-z_][A-Za-z0-9_]*\s*\}\}")), "SI-GHA-007", "Secret handed to a step", "medium", "sensitive_data_access", strings("sensitive_data_access")),
        hit(published & moved.isNotNull(), "SI-GHA-008", F.concat(F.lit("Artifact "), moved), "info", "artifact_handling", F.when(moved == "download", strings("filesystem_write")).otherwise(strings("filesystem_read")), metadata=labels(action=action, reference=reference, operation=moved)),
        hit(kind == "run", "SI-GHA-009", "Shell step", "info", "command_execution", strings("shell_execution")),
    ]
    found = reported(_entries(sources.where(F.col("language") == "github-actions")), hits, "seq")
    about = F.concat_ws("@", F.col("metadata")["action"], F.col("metadata")["reference"])
    same = Window.partitionBy("target_id", "path", "rule_id", "line", about).orderBy("seq")
    unique = found.withColumn("n", F.row_number().over(same)).where("n = 1")
    order = Window.partitionBy("target_id", "path").orderBy("line", "rule_id", "seq")
    ranked = unique.withColumn("emit_seq", F.row_number().over(order).cast("long")).where(F.col("emit_seq") <= MAX_PER_FILE)
    return with_snippets(ranked).drop("k", "seq", "n")
