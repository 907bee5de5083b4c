"""Dependencies declared in package manifests. JSON is read as variants inside the JVM; Python reads TOML and finds lines,
one pass over a file for all of its entries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import paths, text
from ..functions.patterns import java
from ..functions.search import first_lines
from . import findings as fd

DEPENDENCIES = "target_id string, ecosystem string, name string, specifier string, scope string, source_file string, pinned boolean, source_type string"
MOST = 20_000
# Sections and scripts of a package file, in reading order.
SECTIONS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
LIFECYCLE = ("preinstall", "install", "postinstall", "prepare")
# Exact versions, in Python's syntax.
EXACT_NPM = r"^(?:v)?\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?$"
EXACT_PYTHON = r"^={2,3}[^,;*\s]+$"
COMMIT = r"[0-9a-fA-F]{40}(?:[#?]|$)"
_KEY = re.compile(r'[ \t]*"((?:[^"\\]|\\.)*)"[ \t]*:')
PYTHON_NAME = r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]+\])?"
EGG = r"[#&]egg=([A-Za-z0-9._-]+)"


def npm_source_type(specifier: Column) -> Column:
    low = F.lower(specifier)
    return F.when(low.rlike(r"^(?:git\+|git://|github:|https?://)"), "git").when(low.rlike(r"^(?:file:|link:|workspace:)"), "local").otherwise("registry")


def is_exact_npm(version: Column) -> Column:
    return version.rlike(java(EXACT_NPM))


@F.pandas_udf(ArrayType(IntegerType()))
def key_lines(content: pd.Series, keys: pd.Series) -> pd.Series:
    """For each key the first line that begins with "key":, or 1; the lines of a file are looked through once."""

    def one(text_: str | None, wanted: list | None) -> list[int] | None:
        if wanted is None:
            return None
        first: dict[str, int] = {}
        for number, line in enumerate((text_ or "").splitlines(), 1):
            if m := _KEY.match(line):
                first.setdefault(m[1], number)
        return [first.get(k, 1) for k in wanted]

    return pd.Series([one(c, k) for c, k in zip(content, keys)], dtype=object)


@F.pandas_udf(ArrayType(IntegerType()))
def lines_containing(content: pd.Series, values: pd.Series) -> pd.Series:
    """For each value the first line that holds it, whatever the case, or 1; one scan over a file for all of its values."""

    def one(text_: str | None, wanted: list | None) -> list[int] | None:
        if wanted is None:
            return None
        low = [(v or "").lower() for v in wanted]
        lines = first_lines((text_ or "").lower(), low)
        return [lines.get(v, 1) for v in low]

    return pd.Series([one(c, v) for c, v in zip(content, values)], dtype=object)


def _manifests(sources: DataFrame, name: str) -> DataFrame:
    return sources.where(paths.named(sources, name)).select("target_id", "path", "language", "content")


def _objects(sources: DataFrame, name: str) -> DataFrame:
    """Files of that name whose content is a JSON object, with the parsed `v`."""
    parsed = _manifests(sources, name).withColumn("v", F.try_parse_json("content"))
    return parsed.where(F.schema_of_variant("v").startswith("OBJECT"))


def _entries(v: str, path: str, kind: str) -> Column:
    """Entries (key, value) of an object inside a variant whose values are of a kind; an empty array where there is none."""
    entries = F.map_entries(F.try_variant_get(v, path, "map<string,variant>"))
    return F.coalesce(F.filter(entries, lambda e: F.schema_of_variant(e["value"]).startswith(kind)), F.array().cast("array<struct<key:string,value:variant>>"))


def _one_row_each(files: DataFrame, entries: Column, lines: Column, *keep: str) -> DataFrame:
    """Explodes entries with their lines; the files' contents stay behind."""
    zipped = files.select("target_id", "path", *keep, F.posexplode(F.arrays_zip(entries.alias("e"), lines.alias("line"))).alias("pos", "z"))
    return zipped.select("target_id", "path", *keep, "pos", "z.e.*", "z.line")


def npm_manifest_deps(sources: DataFrame) -> DataFrame:
    """Dependencies of package.json files: dependency columns, place (section, then key), and the line of the key.

    A file is parsed once; its sections become one array of entries, whose lines are looked up before the explode.
    """
    def section(name: str) -> Column:
        return F.transform(_entries("v", f"$.{name}", "STRING"), lambda e: F.struct(F.lit(name).alias("scope"), e["key"].alias("name"), e["value"].cast("string").alias("raw")))

    files = _objects(sources, "package.json").withColumn("es", F.concat(*[section(s) for s in SECTIONS])).where(F.size("es") > 0)
    rows = _one_row_each(files, F.col("es"), key_lines(F.col("content"), F.transform("es", lambda e: e["name"])))
    kind = npm_source_type(F.col("raw"))
    return rows.select(
        "target_id", F.lit("npm").alias("ecosystem"), "name", text.redact_text(F.col("raw")).alias("specifier"), "scope", F.col("path").alias("source_file"),
        ((kind == "registry") & is_exact_npm(F.col("raw"))).alias("pinned"), kind.alias("source_type"), F.col("pos").cast("long").alias("place"), "line",
    )


def npm_lifecycle_scripts(sources: DataFrame) -> DataFrame:
    """Findings for scripts that an installation runs."""
    wanted = F.filter(_entries("v", "$.scripts", "STRING"), lambda e: e["key"].isin(*LIFECYCLE))
    files = _objects(sources, "package.json").withColumn("es", F.transform(wanted, lambda e: F.struct(e["key"].alias("key"), e["value"].cast("string").alias("command")))).where(F.size("es") > 0)
    files = files.withColumn("at", key_lines(F.col("content"), F.transform("es", lambda e: e["key"])))
    files = files.withColumn("raws", F.transform("at", lambda n: F.try_element_at(text.split_lines(F.col("content")), n)))
    zipped = files.select("target_id", "path", F.posexplode(F.arrays_zip("es", "at", "raws")).alias("pos", "z")).select("target_id", "path", "pos", "z.es.*", F.col("z.at").alias("line"), F.col("z.raws").alias("raw"))
    return zipped.select(
        "target_id", "path", F.lit("javascript").alias("language"), "line", F.lit("SI-NPM-001").alias("rule_id"), F.concat(F.lit("Script at "), F.col("key")).alias("name"), F.lit("high").alias("severity"),
        F.lit("install_script").alias("category"), F.array(F.lit("shell_execution")).alias("capabilities"), F.lit("observed").alias("confidence"), F.col("pos").cast("long").alias("emit_seq"), text.snippet(F.col("raw")).alias("snippet"),
        F.create_map(F.lit("lifecycle"), F.col("key"), F.lit("command"), F.substring(text.redact_text(F.col("command")), 1, 500)).alias("metadata"),
    )


def npm_lock_deps(sources: DataFrame) -> DataFrame:
    """Resolved packages of package-lock.json files."""
    entries = F.filter(_entries("v", "$.packages", "OBJECT"), lambda e: e["key"].contains("node_modules/"))

    def resolved(e: Column) -> Column:
        version, source = (F.try_variant_get(e["value"], f"$.{k}", "variant") for k in ("version", "resolved"))
        said = lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string"))
        return F.struct(e["key"].alias("key"), said(version).alias("version"), F.coalesce(said(source), F.lit("")).alias("resolved"))

    files = _objects(sources, "package-lock.json").withColumn("es", F.filter(F.transform(entries, resolved), lambda e: e["version"].isNotNull())).where(F.size("es") > 0)
    rows = _one_row_each(files, F.col("es"), lines_containing(F.col("content"), F.transform("es", lambda e: e["key"])))
    git = F.lower("version").startswith("git+") | F.lower("resolved").startswith("git+")
    return rows.select(
        "target_id", F.lit("npm").alias("ecosystem"), F.substring_index("key", "node_modules/", -1).alias("name"), text.redact_text(F.col("version")).alias("specifier"), F.lit("lockfile").alias("scope"),
        F.col("path").alias("source_file"), F.when(git, F.concat("version", "resolved").rlike(java(COMMIT))).otherwise(is_exact_npm(F.col("version"))).alias("pinned"), F.when(git, "git").otherwise("registry").alias("source_type"),
        F.col("pos").cast("long").alias("place"), "line",
    )


def requirement_name(declaration: Column) -> Column:
    """The name of parse_requirements alone, without nested lambdas: Spark can't hand those to a Python function."""
    d = text.strip(F.substring_index(declaration, ";", 1))
    name = F.regexp_extract(d, java(PYTHON_NAME), 1)
    return F.when(name != "", name).otherwise(F.nullif(F.regexp_extract(d, EGG, 1), F.lit("")))


def parse_requirements(declared: DataFrame, *keep: str) -> DataFrame:
    """name, specifier, source_type, pinned of each `declaration` of one Python requirement; those without a name are left out.

    Each step is columns of their own, not lambdas, which are interpreted for every line. What a declaration says is generated as
    a row, so that nothing above, such as a filter, parses it again.
    """
    d, name, rest, target, egg = (F.col(f"__{c}") for c in ("d", "name", "rest", "target", "egg"))
    steps = declared.select(*keep, F.substring_index("declaration", ";", 1).alias("__told")).withColumn("__d", text.strip_named(F.col("__told")))
    steps = steps.withColumns({"__name": F.regexp_extract(d, java(PYTHON_NAME), 1), "__after": F.regexp_replace(d, java(PYTHON_NAME), "")})
    steps = steps.withColumns({"__rest": text.strip_named(F.col("__after")), "__egg": F.when(name == "", F.nullif(F.regexp_extract(d, EGG, 1), F.lit("")))})
    at, git = rest.startswith("@"), F.lower(target).startswith("git+")
    steps = steps.withColumn("__target", F.when(at, text.strip(F.substring(rest, 2, 1_000_000))))
    said = F.struct(
        F.when(name != "", name).otherwise(egg).alias("name"), F.when(name == "", d).when(rest == "", "*").otherwise(rest).alias("specifier"),
        F.when(name == "", F.when(F.lower(d).contains("git+"), "git").otherwise("url")).when(~at, "registry").when(git, "git").otherwise("url").alias("source_type"),
        F.when(name == "", False).when(at, git & target.rlike(java("@" + COMMIT))).otherwise(rest.rlike(java(EXACT_PYTHON))).alias("pinned"),
    )
    return steps.select(*keep, F.inline(F.array(said))).where("name is not null")


def _python_deps(declared: DataFrame) -> DataFrame:
    """declared: target_id, path, scope, place, line, declaration."""
    p = parse_requirements(declared, "target_id", "path", "scope", "place", "line")
    return p.select(
        "target_id", F.lit("pypi").alias("ecosystem"), "name", text.redact_named(F.col("specifier")).alias("specifier"), "scope", F.col("path").alias("source_file"),
        "pinned", "source_type", "place", "line",
    )


def requirement_lines(sources: DataFrame) -> DataFrame:
    """Lines that declare something; a line is stripped once, as what is left of it is generated as a row."""
    b = F.col("__bare")
    told = F.when(~b.startswith("#"), F.when(b.rlike(r"^(?:-e|--editable) "), F.regexp_replace(b, r"^\S+\s+", "")).otherwise(b))
    lines = _manifests(sources, "requirements.txt").select("target_id", "path", F.posexplode(text.split_lines(F.col("content"))).alias("pos", "__raw")).withColumn("__bare", text.strip_named(F.col("__raw")))
    lines = lines.select("target_id", "path", "pos", F.inline(F.array(F.struct(told.alias("declaration")))))
    lines = lines.where((F.col("declaration") != "") & ~F.col("declaration").startswith("-"))
    return lines.select("target_id", "path", F.lit("requirements").alias("scope"), F.col("pos").cast("long").alias("place"), (F.col("pos") + 1).cast("int").alias("line"), "declaration")


def requirements_deps(sources: DataFrame) -> DataFrame:
    return _python_deps(requirement_lines(sources))


def _read_toml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import tomllib

    for batch in batches:
        rows = []
        for target, path, content in zip(batch["target_id"], batch["path"], batch["content"]):
            try:
                raw = tomllib.loads(content)
            except (ValueError, RecursionError):
                continue
            table = lambda *keys: next((raw[k] for k in keys if isinstance(raw.get(k), dict)), {})  # noqa: B023, E731
            groups = table("project").get("optional-dependencies")
            lists = {"project": table("project").get("dependencies")} | {f"project.optional:{g}": v for g, v in (groups.items() if isinstance(groups, dict) else ())} | {"build-system": table("build-system").get("requires")}
            found = [(scope, d) for scope, items in lists.items() if isinstance(items, list) for d in items if isinstance(d, str)][:MOST]
            rows.append((target, path, content, [s for s, _ in found], [d for _, d in found]))
        yield pd.DataFrame(rows, columns=["target_id", "path", "content", "scopes", "declared"])


def pyproject_deps(sources: DataFrame) -> DataFrame:
    """Dependencies of pyproject.toml files; a file that is no TOML has none."""
    files = _manifests(sources, "pyproject.toml").select("target_id", "path", "content").mapInPandas(_read_toml, "target_id string, path string, content string, scopes array<string>, declared array<string>").where(F.size("declared") > 0)
    names = F.transform("declared", lambda d: F.coalesce(requirement_name(d), F.lit("")))
    entries = F.zip_with("scopes", "declared", lambda s, d: F.struct(s.alias("scope"), d.alias("declaration")))
    rows = _one_row_each(files, entries, lines_containing(F.col("content"), names))
    return _python_deps(rows.withColumn("place", F.col("pos").cast("long")))


def manifest_caps(dependencies: DataFrame, most: int = MOST) -> DataFrame:
    """The first `most` dependencies of each manifest, in reading order."""
    w = Window.partitionBy("target_id", "source_file").orderBy("place")
    return dependencies.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def dependency_findings(dependencies: DataFrame) -> DataFrame:
    """Findings of dependency rows: git sources, else unpinned ones; plain lock entries are never flagged."""
    flagged = (F.col("source_type") == "git") | (~F.col("pinned") & (F.col("scope") != "lockfile"))
    git = F.col("source_type") == "git"
    return dependencies.where(flagged).select(
        "target_id", F.col("source_file").alias("path"), F.when(git, "SI-DEP-002").otherwise("SI-DEP-001").alias("rule_id"), F.when(git, "Dependency from a repository").otherwise("Dependency without a fixed version").alias("name"),
        F.when(git, "medium").otherwise("low").alias("severity"), F.lit("supply_chain").alias("category"), "line", F.array().cast("array<string>").alias("capabilities"), F.lit("observed").alias("confidence"),
        F.col("place").alias("emit_seq"), F.create_map(F.lit("dependency"), F.col("name"), F.lit("specifier"), F.col("specifier")).alias("metadata"),
    )


def all_dependencies(sources: DataFrame) -> DataFrame:
    parts = (npm_manifest_deps(sources), npm_lock_deps(sources), requirements_deps(sources), pyproject_deps(sources))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return manifest_caps(out)


def sort_dependencies(dependencies: DataFrame) -> DataFrame:
    """Adds `rank` per target: ecosystem, name, file, scope. No dedupe; a target may hold all rows."""
    return fd.ranked_within(dependencies, "target_id", [F.col("ecosystem"), F.lower("name"), F.col("source_file"), F.col("scope"), F.col("place")])
