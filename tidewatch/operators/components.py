"""Components of assistants: skills, plugin manifests and server configurations. A helper returns what a file declares
as arrays; capabilities and severities are columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.patterns import java
from .by_file import file_rows
from .python_code import capability_severity, hit, in_order, labels, reported, strings, with_snippets
from .safe_yaml import YamlFault, read_yaml

# Parts of tool names and what they allow.
TOOL_WORDS = {
    "filesystem_read": ["read"], "filesystem_write": ["edit", "write"], "shell_execution": ["bash", "command", "exec", "powershell", "shell"],
    "network_access": ["browser", "fetch", "http", "network", "web"], "environment_read": ["env"],
}
# Files that declare what an assistant's component may do.
COMPONENTS = ("skill.md", "plugin.json", "mcp.json")
DECLARED = "kind string, line int, raw string, spaced boolean, tools array<string>, servers array<string>, commands array<string>, urls array<string>, keys array<string>"


def tool_names(tools: Column, spaced: Column) -> Column:
    """Names of tools: of a list its entries, of one text (spaced) what commas and white space part; at most 100 characters each."""
    items = F.when(spaced, F.split(F.array_join(tools, " "), java(r"[,\s]+"))).otherwise(tools)
    return F.transform(F.filter(items, lambda t: t != ""), lambda t: F.substring(t, 1, 100))


def tool_capabilities(names: Column) -> Column:
    """What tools of these names allow, in the order of output; names are told by their parts, whatever the case."""
    holds = lambda words: F.exists(names, lambda t: F.lower(t).rlike("|".join(words)))
    return in_order({c: F.coalesce(holds(words), F.lit(False)) for c, words in TOOL_WORDS.items()})


def _front_matter(content: str) -> object:
    """allowed-tools of a skill's front matter, which ends within the first 200 lines."""
    lines = content.splitlines()[:200]
    marks = [i for i, line in enumerate(lines) if line.strip() == "---"][:2]
    if len(marks) < 2 or marks[0]:
        return None
    try:
        head = read_yaml("\n".join(lines[1 : marks[1]]))
    except YamlFault:
        return None
    return head.get("allowed-tools") if isinstance(head, dict) else None


def declared(name: str, content: str) -> dict | None:
    """What a component's file declares: kind, the word whose line is shown, and lists of texts; None if it is none."""
    if name == "skill.md":
        value, out = _front_matter(content), {"kind": "skill", "mark": "allowed-tools"}
    else:
        try:
            config = json.loads(content)
        except (ValueError, RecursionError):
            return None
        if not isinstance(config, dict):
            return None
        if name == "mcp.json":
            return _servers(config)
        value, out = config.get("permissions"), {"kind": "plugin", "mark": "permissions"}
    return out | {"spaced": isinstance(value, str), "tools": [value] if isinstance(value, str) else [t for t in value if isinstance(t, str)] if isinstance(value, list) else []}


def _servers(config: dict) -> dict:
    """Names and keys of configured servers, never values of their environment."""
    out: dict = {"kind": "mcp", "servers": [], "commands": [], "urls": [], "keys": []}
    servers = config.get("mcpServers", config.get("servers"))
    for name, entry in (servers if isinstance(servers, dict) else {}).items():
        entry = entry if isinstance(entry, dict) else {}
        found = {"commands": [entry.get("command")], "urls": [entry.get("url")], "keys": list(entry["env"]) if isinstance(entry.get("env"), dict) else []}
        found = {k: [t for t in v if isinstance(t, str)] for k, v in found.items()}
        if any(found.values()):
            out["servers"].append(name)
            for k, v in found.items():
                out[k] += v
    return out | {"mark": "command" if out["commands"] else "url" if out["urls"] else "env"}


def _declared(files: DataFrame) -> DataFrame:
    def rows(path: str, content: str) -> list[dict]:
        found = declared(path.replace("\\", "/").rsplit("/", 1)[-1].lower(), content)
        if found is None:
            return []
        lines = content.splitlines() or [""]
        at = next((i for i, line in enumerate(lines) if found["mark"] in line.casefold()), 0)
        return [{"line": at + 1, "raw": lines[at]} | found]

    return file_rows(files, rows, DECLARED)


def _cut(values: Column, most: int) -> Column:
    return F.when(F.size(values) > 0, F.to_json(F.transform(values, lambda v: F.substring(v, 1, most))))


def scan_components(sources: DataFrame) -> DataFrame:
    """SI-AI-001 to 004 and SI-MCP-001, by file name: skill.md, plugin.json, mcp.json."""
    files = sources.where(paths.named(sources, *COMPONENTS))
    facts = _declared(files).withColumn("names", F.coalesce(tool_names(F.col("tools"), F.col("spaced")), F.array().cast("array<string>")))
    kind, some = F.col("kind"), lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    listed = in_order({"shell_execution": some("commands"), "network_access": some("urls"), "environment_read": some("keys")})
    able = F.when(kind == "mcp", listed).otherwise(tool_capabilities(F.col("names")))
    rule = F.when(kind == "skill", "SI-AI-002").when(kind == "plugin", "SI-AI-004").otherwise("SI-MCP-001")
    title = F.when(kind == "mcp", "What configured servers may do").otherwise(F.concat(F.lit("What a "), kind, F.lit(" may do")))
    known = labels(component_type=kind, declared=_cut(F.col("names"), 100), servers=F.when(kind == "mcp", F.to_json(F.transform("servers", lambda v: F.substring(v, 1, 200)))), commands=_cut(F.col("commands"), 200), urls=_cut(F.col("urls"), 500), environment_keys=_cut(F.col("keys"), 100))
    there = F.when(kind == "skill", "SI-AI-001").otherwise("SI-AI-003")
    hits = [
        hit(kind != "mcp", there, F.initcap(F.concat(kind, F.lit(" for an assistant"))), "info", "ai_component", strings(), metadata=labels(component_type=kind)),
        hit(F.size(able) > 0, rule, title, capability_severity(able), "ai_component_capability", able, metadata=known),
    ]
    found = reported(facts, hits).withColumn("emit_seq", F.col("k").cast("long"))
    bare = F.col("k") == 0
    found = found.withColumn("line", F.when(bare, 1).otherwise(F.col("line"))).withColumn("raw", F.when(~bare, F.col("raw")))
    return with_snippets(found).drop("k")
