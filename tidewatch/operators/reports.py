"""Report per target, review payload, rule packs and user scanners."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import paths, text
from . import findings as fd
from . import risk
from .rulebook import CAPABILITIES, SEVERITIES
from .safe_yaml import read_yaml

SCHEMA_VERSION = "1.1"
MAX_PACK = 1_000_000
# Grammars of identifiers.
RULE_ID, CATEGORY, LANGUAGE = r"^SI-[A-Z0-9]+(?:-[A-Z0-9]+)+\z", r"^[a-z][a-z0-9_]*\z", r"^[a-z][a-z0-9_-]*\z"
SCANNER_NAME = r"[a-z][a-z0-9-]{1,63}"
FIELDS = ("id", "name", "description", "severity", "category", "language", "pattern", "explanation", "recommendation")
RULES = ", ".join(f"{f} string" for f in FIELDS) + ", capabilities array<string>"


ENTRY = ("rank", "rule_id", "name", "severity", "category", "path", "line", "snippet", "capabilities")


def assemble_report(targets: DataFrame, assessed: DataFrame, coverage: DataFrame, ranked: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One nested row per target. Findings and dependencies of a target are bounded by limit_check before this."""
    listed = ranked.groupBy("target_id").agg(F.sort_array(F.collect_list(F.struct(*ENTRY))).alias("findings"))
    return _joined(targets.select("target_id").join(_risk(assessed), "target_id", "left"), coverage, dependencies, listed)


def reports_of(targets: DataFrame, findings: DataFrame, coverage: DataFrame, dependencies: DataFrame) -> DataFrame:
    """assemble_report of findings as the scanners emit them, within the limits: a target's are deduplicated, ranked, assessed and
    listed where they lie.

    Where findings and dependencies lie by target, they are neither shuffled nor written again.
    """
    alone = F.row_number().over(Window.partitionBy("target_id").orderBy(*fd.ranking())).cast("long")
    ranked = fd.dedupe_findings(findings).withColumn("rank", alone)
    return _joined(_risk(risk.assess_listed(ranked, targets, F.struct(*ENTRY)), "findings"), coverage, dependencies)


def _risk(assessed: DataFrame, *more: str) -> DataFrame:
    return assessed.select("target_id", F.struct("level", "score", "primary_reasons", F.col("observed").alias("capabilities")).alias("risk"), *more)


def _joined(reports: DataFrame, coverage: DataFrame, dependencies: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    entries = dependencies.select("target_id", F.struct("ecosystem", "name", "source_file", "scope", "specifier", "pinned", "source_type").alias("entry"))
    declared = entries.groupBy("target_id").agg(F.sort_array(F.collect_list("entry")).alias("dependencies"))
    covered = coverage.select("target_id", F.struct("status", "skipped_count", "skipped_paths").alias("coverage"))
    whole = reports.join(covered, "target_id", "left")
    whole = whole if listed is None else whole.join(listed, "target_id", "left")
    return whole.join(declared, "target_id", "left").select("target_id", "risk", "coverage", "findings", "dependencies")


def json_reports(reports: DataFrame) -> DataFrame:
    """(target_id, json); all texts are redacted once more at the border, before they are JSON."""
    body = [text.redact_data(F.col(f.name), f.dataType).alias(f.name) for f in reports.schema.fields]
    return reports.select("target_id", F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), *body)).alias("json"))


def review_payload(ranked: DataFrame, sources: DataFrame, findings: int = 20, files: int = 3, chars: int = 4_000) -> DataFrame:
    """(target_id, payload): the first findings and the beginnings of the first prompt files, redacted, as JSON."""
    top = ranked.where(F.col("rank") <= findings).groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("rank", "rule_id", "severity", "path", "line", "snippet"))).alias("findings"))
    prompts = sources.where(paths.roles(F.col("path"), F.col("language"))["is_prompt"]).withColumn("__n", F.row_number().over(Window.partitionBy("target_id").orderBy("path"))).where(F.col("__n") <= files)
    shown = prompts.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("path", F.substring(text.redact_text(F.col("content")), 1, chars).alias("text")))).alias("files"))
    return top.join(shown, "target_id", "full_outer").select("target_id", F.to_json(F.struct("findings", "files")).alias("payload"))


def load_rule_pack(spark: SparkSession, pack: str) -> DataFrame:
    """Rules table of a YAML text: one mapping or a list of mappings with exactly the known fields; configuration-sized.

    Texts beyond MAX_PACK bytes or the limits of the YAML reader (aliases, tags, size, depth) are a ValueError.
    """
    if len(pack.encode()) > MAX_PACK:
        raise ValueError("rule pack is too large")
    document = read_yaml(pack)
    items = document if isinstance(document, list) else [document]
    if not items or not all(isinstance(i, dict) for i in items):
        raise ValueError("a rule pack is a mapping or a non-empty list of mappings")
    for i in items:
        if set(i) - {*FIELDS, "capabilities"} or set(FIELDS) - set(i):
            raise ValueError(f"fields of a rule must be {', '.join(FIELDS)} and capabilities")
    for i in items:
        listed = i.get("capabilities") or []
        if not all(isinstance(i[f], str) for f in FIELDS) or not isinstance(listed, list) or not all(isinstance(c, str) for c in listed):
            raise ValueError("fields of a rule are texts, capabilities a list of texts")
    if len({i["id"] for i in items}) < len(items):
        raise ValueError("duplicate rule id")
    return spark.createDataFrame([(*(i[f] for f in FIELDS), i.get("capabilities") or []) for i in items], RULES)


_OTHERS = 1 << 128  # stands for all characters beyond ASCII
_ANY = (1 << 129) - 1


def _mask(test: Callable[[str], bool]) -> int:
    return sum(1 << i for i in range(128) if test(chr(i)))


#: Sets of first characters as bits: one for each ASCII character, one for all others.
_CLASSES = {
    f"CATEGORY_{name}": mask
    for kind, letter in (("DIGIT", "d"), ("SPACE", "s"), ("WORD", "w"))
    for own in [_mask(re.compile(f"(?a:\\{letter})").match if letter != "s" else " \t\n\r\v\f".__contains__)]
    for name, mask in ((kind, own | _OTHERS), (f"NOT_{kind}", _ANY & ~own))
}
_REPEATS = ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT")


def _literal(code: int) -> int:
    """A character in either case."""
    return _OTHERS if code > 127 else _mask(lambda c: c.lower() == chr(code).lower())


def _members(items: list) -> int:
    """Characters of a class."""
    out = 0
    for op, arg in items:
        match str(op):
            case "LITERAL":
                out |= _literal(arg)
            case "RANGE":
                low, high = arg
                for code in range(low, min(high, 127) + 1):
                    out |= _literal(code)
                out |= _OTHERS if high > 127 else 0
            case "CATEGORY":
                out |= _CLASSES.get(str(arg), _ANY)
    return (_ANY & ~(out & ~_OTHERS)) | _OTHERS if str(items[0][0]) == "NEGATE" else out


def _begins(sequence) -> tuple[int, bool]:
    """(characters with which a sequence may begin, whether it may be empty)."""
    out = 0
    for op, arg in sequence:
        name = str(op)
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        inner = [_begins(s) for s, _ in _inside(name, arg)]
        empty = any(e for _, e in inner) or (name in _REPEATS and arg[0] == 0)
        if inner:
            for chars, _ in inner:
                out |= chars
        elif name == "LITERAL":
            out |= _literal(arg)
        elif name == "NOT_LITERAL":
            out |= _ANY & ~(_literal(arg) & ~_OTHERS)
        elif name == "IN":
            out |= _members(arg)
        else:
            out |= _ANY
        if not empty:
            return out, False
    return out, True


def _inside(name: str, arg) -> list[tuple]:
    """(sequence, whether it may run twice or more) of the sequences that a node holds; None: as the node itself."""
    if name in _REPEATS:
        return [(arg[2], arg[1] > 1)]
    if name == "BRANCH":
        return [(s, None) for s in arg[1]]
    if name in ("SUBPATTERN", "ASSERT", "ASSERT_NOT", "ATOMIC_GROUP"):
        return [(arg if name == "ATOMIC_GROUP" else arg[-1], None)]
    return []


def pattern_fault(pattern: str) -> str | None:
    """Why a pattern may not be used: it does not compile, or could backtrack without bound.

    All sequences of the syntax tree are listed with whether they repeat; each kind of fault is then looked for in the list.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(pattern)
            todo = [(re._parser.parse(pattern), False)]
    except (re.error, OverflowError, RecursionError):
        return "invalid_pattern"
    nodes, neighbours = [], []
    for sequence, repeated in todo:
        own = [(str(op), arg) for op, arg in sequence]
        nodes += [(name, repeated) for name, _ in own]
        neighbours += [(x[1], y[1]) for x, y in zip(own, own[1:]) if x[0] in _REPEATS and y[0] in _REPEATS]
        todo += [(s, repeated if again is None else again) for name, arg in own for s, again in _inside(name, arg)]
    found = {
        "backreference": any(name.startswith("GROUPREF") for name, _ in nodes),
        "nested_repetition": any(repeated and name in _REPEATS for name, repeated in nodes),
        "repeated_alternatives": any(repeated and name == "BRANCH" for name, repeated in nodes),
        "overlapping_repetition": any(_begins(x[2])[0] & _begins(y[2])[0] for x, y in neighbours),
    }
    return next((fault for fault, holds in found.items() if holds), None)


@F.pandas_udf(StringType())
def _pattern_fault(patterns: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else pattern_fault(p) for p in patterns], dtype=object)


def validate_rules(rules: DataFrame) -> DataFrame:
    """Adds `reason` (null: fine) to a rules table: fields, then pattern, then duplicates."""
    length = lambda c, n: F.col(c).isNull() | (F.length(c) < 1) | (F.length(c) > n)
    bad_field = (
        F.when(~F.coalesce(F.col("id").rlike(RULE_ID) & F.length("id").between(7, 64), F.lit(False)), "id")
        .when(~F.coalesce(F.col("category").rlike(CATEGORY) & F.length("category").between(2, 64), F.lit(False)), "category")
        .when(~F.coalesce(F.col("language").rlike(LANGUAGE) & (F.length("language") <= 32), F.lit(False)), "language")
        .when(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), "severity")
        .when(F.exists(F.coalesce("capabilities", F.array().cast("array<string>")), lambda c: ~c.isin(*CAPABILITIES)), "capabilities")
        .when(length("name", 160) | length("description", 2_000) | length("pattern", 1_000) | length("explanation", 4_000) | length("recommendation", 4_000), "text_length")
    )
    n = F.count("*").over(Window.partitionBy("id"))
    return rules.withColumn("__n", n).withColumn("reason", F.coalesce(bad_field, _pattern_fault(F.col("pattern")), F.when(F.col("__n") > 1, "duplicate_id"))).drop("__n")


class Scanners:
    """User scanners by name: a predicate on sources and a function from sources to findings."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[Column, Callable[[DataFrame], DataFrame]]] = {}

    def register_scanner(self, name: str, supports: Column, scan: Callable[[DataFrame], DataFrame]) -> None:
        if not re.fullmatch(SCANNER_NAME, name):
            raise ValueError("a scanner's name has 2 to 64 lower-case letters, digits and dashes")
        if name in self._known:
            raise ValueError(f"scanner {name} is known already")
        self._known[name] = (supports, scan)

    def scan(self, sources: DataFrame) -> DataFrame:
        """Findings of all scanners in order of name, cast to the findings columns; errors are not swallowed."""
        parts = [scan(sources.where(supports)) for _, (supports, scan) in sorted(self._known.items())]
        return fd.union_findings(*parts) if parts else sources.sparkSession.createDataFrame([], fd.SCHEMA)
