"""Native detectors: rules over the lines of source files.

A file is tested once for texts that the patterns of its language need before its lines are exploded; only then are the
unrolled patterns run line by line. Patterns are in Python's syntax and have its sense. Scanners of lines can share one pass:
`line_hits` reads and splits each file once for all of them. Everything is Column expressions; the caps per rule and file are
windows, so they are for tables, not for streams.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.patterns import java, low_prefilter, needs, prefilter
from . import findings as fd
from .rulebook import BUILTIN, SECRETS, SENSITIVE_PATHS, Rule

#: Characters of a line that rules look at, lines that a rule reports of a file, characters of a pack.
MAX_LINE, MAX_LINES, MAX_PACK = 20_000, 100, 1_000_000


@dataclass(frozen=True)
class LineScan:
    """A scanner of lines: the files that it reads, what of a line (raw, language) it looks at, null for nothing, and the numbers
    of the rules that this breaks."""

    name: str
    files: Column
    subject: Callable[[Column, Column], Column]
    hits: Callable[[Column], Column]


def _numbered(sources: DataFrame, *keep: str) -> DataFrame:
    lines = sources.select("target_id", "path", "language", *keep, F.posexplode(text.split_lines(F.col("content"))).alias("pos", "raw"))
    return lines.select("target_id", "path", "language", *keep, (F.col("pos") + 1).cast("int").alias("line"), "raw")


def line_hits(sources: DataFrame, scans: Sequence[LineScan]) -> DataFrame:
    """(target_id, path, language, line, raw, scan, i): what all scans find, in one pass over the files that any of them reads."""
    on, seen = [f"on{k}" for k in range(len(scans))], [f"seen{k}" for k in range(len(scans))]
    files = sources.select("target_id", "path", "language", "content", *[F.coalesce(s.files, F.lit(False)).alias(c) for s, c in zip(scans, on)])
    files = files.where(" or ".join(on))
    lines = _numbered(files, *on).withColumns({c: F.when(F.col(o), s.subject(F.col("raw"), F.col("language"))) for s, o, c in zip(scans, on, seen)})

    def named(scan: LineScan, broken: Column) -> Column:
        return F.transform(F.coalesce(broken, F.array().cast("array<int>")), lambda i: F.struct(F.lit(scan.name).alias("scan"), i.alias("i")))

    found = [named(s, s.hits(F.col(c))) for s, c in zip(scans, seen)]
    return lines.select("target_id", "path", "language", "line", "raw", F.explode(F.concat(*found)).alias("hit")).select("target_id", "path", "language", "line", "raw", "hit.*")


def _found(sources: DataFrame, scan: LineScan, hits: DataFrame | None) -> DataFrame:
    """A scan's own hits: of the shared pass if there was one."""
    return line_hits(sources, [scan]) if hits is None else hits.where(F.col("scan") == scan.name)


def anywhere(content: Column, patterns: list[str]) -> Column:
    """Whether a file may hold a line in which one of the patterns matches: one of the texts that every match holds is there.

    The texts come from the patterns' syntax trees, so no anchor, lookaround or cut of a line makes the test miss a line. Where
    a pattern has no such text, all files pass. ASCII texts are looked for in the content's lower case; only a content with
    another case of their letters that lower case leaves apart is left to the pattern for all cases.
    """
    test = prefilter(patterns)
    if test is None:
        return F.lit(True)
    found = low_prefilter(tuple(patterns))
    if found is None:
        return content.rlike(test)
    low_test, others = found
    plain = F.lower(content).rlike(low_test)
    return plain | (reduce(Column.__or__, [F.lower(content).contains(c) for c in others]) & content.rlike(test)) if others else plain


def is_comment(line: Column, language: Column, javascript: bool = False) -> Column:
    """Lines that are nothing but a comment."""
    bare = F.ltrim(line, F.lit(text.BLANKS))
    out = ((language == "shell") & bare.startswith("#")) | ((language == "batch") & (bare.startswith("::") | F.lower(bare).startswith("rem ")))
    if javascript:
        out = out | ((language == "powershell") & bare.startswith("#")) | ((language == "javascript") & (bare.startswith("//") | bare.startswith("/*") | bare.startswith("*")))
    return out


def masked_comment(line: Column, language: Column) -> Column:
    return F.when(is_comment(line, language), "").otherwise(line)


def mask_comment_lines(lines: DataFrame) -> DataFrame:
    """Blanks comment lines of shell and batch files in `masked`; numbers stay."""
    return lines.withColumn("masked", masked_comment(F.col("raw"), F.col("language")))


def _all_broken(tests: list[Column]) -> Column:
    return F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]))


def matches(line: Column, pattern: str) -> Column:
    """Whether a pattern matches a part of a line. It runs only where all texts that its matches hold are there: a pattern such as
    (?=.*x) reads the rest of the line from every place of it, where it can't match."""
    return reduce(Column.__and__, [*[line.rlike(text_) for text_ in needs(pattern)], line.rlike(java(pattern))])


def rule_scan(name: str, rules: Sequence[Rule], files: Column, plain: bool = False) -> LineScan:
    """The scan of line rules on files; comment lines of shell and batch are blank unless `plain`."""
    subject = lambda raw, language: F.substring(raw if plain else masked_comment(raw, language), 1, MAX_LINE)
    return LineScan(name, files & anywhere(F.col("content"), [r.pattern for r in rules]), subject, lambda line: _all_broken([matches(line, r.pattern) for r in rules]))


def _rule_findings(hits: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings of a scan's hits, capped; snippets come from the unmasked line."""
    out = hits.select("*", *_described(rules, F.col("i"))).withColumn("emit_seq", F.col("i").cast("long") * 10_000_000 + F.col("line"))
    return fd.cap_per_rule(out, MAX_LINES).withColumn("snippet", text.snippet(F.substring("raw", 1, MAX_LINE))).drop("raw", "i", "scan")


def scan_rules(sources: DataFrame, rules: Sequence[Rule] = BUILTIN, plain: bool = False, hits: DataFrame | None = None) -> DataFrame:
    """Findings of line rules on files of the rules' languages; one pass over the files of all languages."""
    scans = {language: [r for r in rules if r.language == language] for language in sorted({r.language for r in rules})}
    if hits is None:
        hits = line_hits(sources, [rule_scan(language, own, F.col("language") == language, plain) for language, own in scans.items()])
    out = None
    for language, own in scans.items():
        part = _rule_findings(hits.where(F.col("scan") == language), own)
        out = part if out is None else out.unionByName(part)
    return out


def _described(rules: Sequence[Rule], i: Column) -> list[Column]:
    def pick(values: list) -> Column:
        return F.element_at(F.array(*values), i + 1)

    return [
        pick([F.lit(r.id) for r in rules]).alias("rule_id"),
        pick([F.lit(r.title) for r in rules]).alias("name"),
        pick([F.lit(r.severity) for r in rules]).alias("severity"),
        pick([F.lit(r.category) for r in rules]).alias("category"),
        pick([F.array(*[F.lit(c) for c in r.capabilities]).cast("array<string>") for r in rules]).alias("capabilities"),
        F.lit("observed").alias("confidence"),
    ]


def scan_rule_table(sources: DataFrame, rules: DataFrame, most: int = MAX_PACK) -> DataFrame:
    """User rules as a table (id, name, severity, category, language, pattern, capabilities) on all lines of their languages.

    A pack is configuration: its size is checked before it is read, and then it is unrolled like the built-in rules, behind
    the same test of whole files. Larger tables are an error, and so is a pattern that the JVM can't say in Python's sense.
    """
    size = rules.agg(F.coalesce(F.sum(F.length("pattern") + F.length("name") + F.length("id")), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"the rules hold {size} characters; at most {most} are allowed")
    pack = tuple(Rule(r["id"], r["language"], r["severity"], r["category"], tuple(r["capabilities"] or ()), r["name"], r["pattern"]) for r in rules.orderBy("id").collect())
    if not pack:
        return sources.sparkSession.createDataFrame([], fd.SCHEMA)
    return scan_rules(sources, pack, plain=True)


SHELL, BATCH, PROMPT = (tuple(r for r in BUILTIN if r.language == language) for language in ("shell", "batch", "prompt"))


def shell_scan() -> LineScan:
    return rule_scan("shell", SHELL, F.col("language") == "shell")


def detect_shell(sources: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Shell rules; a download that is also reported as piped is reported once."""
    return fd.suppress_shell_download(_rule_findings(_found(sources, shell_scan(), hits), SHELL))


def batch_scan() -> LineScan:
    return rule_scan("batch", BATCH, F.col("language") == "batch")


def detect_batch(sources: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    return _rule_findings(_found(sources, batch_scan(), hits), BATCH)


def prompt_scan() -> LineScan:
    return rule_scan("prompt", PROMPT, paths.roles(F.col("path"), F.col("language"))["is_prompt"], plain=True)


def detect_prompts(sources: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Prompt rules on files with a prompt role, whatever their language; always inferred."""
    found = _rule_findings(_found(sources, prompt_scan(), hits), PROMPT)
    return found.withColumn("language", F.lit("prompt")).withColumn("confidence", F.lit("inferred"))


def sensitive_path_scan() -> LineScan:
    role = paths.roles(F.col("path"), F.col("language"))["is_sensitive"]
    subject = lambda raw, language: F.when(~F.coalesce(is_comment(raw, language, javascript=True), F.lit(False)), raw)
    first = lambda line: F.array_compact(F.array(F.coalesce(*[F.when(line.rlike(java(p)), F.lit(i)) for i, (_, _, p) in enumerate(SENSITIVE_PATHS)])))
    return LineScan("sensitive path", role & anywhere(F.col("content"), [p for _, _, p in SENSITIVE_PATHS]), subject, first)


def detect_sensitive_paths(sources: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """References to sensitive places, at most one per line: the first class that matches."""
    hit = _found(sources, sensitive_path_scan(), hits)
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in SENSITIVE_PATHS]), F.col("i") + 1)
    out = hit.select(
        "target_id", "path", "language", "line", F.lit("SI-FS-002").alias("rule_id"), F.lit("Reference to a sensitive place").alias("name"), pick(1).alias("severity"),
        F.lit("sensitive_filesystem_access").alias("category"), F.array(F.lit("filesystem_read"), F.lit("sensitive_data_access")).alias("capabilities"),
        F.lit("inferred").alias("confidence"), F.create_map(F.lit("path_class"), pick(0)).alias("metadata"), F.col("line").cast("long").alias("emit_seq"), F.lit(0).alias("scanner_seq"), "raw",
    )
    return fd.cap_per_file(out).withColumn("snippet", text.snippet(F.col("raw"))).drop("raw")


SECRET_PATTERNS = {
    "assignment": rf"(?i){text.ASSIGNED}[^\s#,;]",
    "api_key": text.API_KEY,
    "git_token": text.GIT_TOKEN,
    "private_key": r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----",
    "cloud_key": text.CLOUD_KEY,
    "bearer": text.BEARER,
    "url_login": text.URL_LOGIN,
}


def secret_scan() -> LineScan:
    maybe = java(text.MAYBE_SECRET)
    tests = lambda line: _all_broken([line.rlike(java(SECRET_PATTERNS[kind])) for _, _, _, kind in SECRETS])
    content = F.col("content")
    files = anywhere(content, [text.SECRET_TEXTS]) | (content.contains("://") & content.rlike(java(text.MAYBE_LOGIN)))
    return LineScan("secret", files, lambda raw, _: F.when(raw.rlike(maybe), raw), tests)


def detect_secrets(sources: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """One finding per line and kind of secret, however many a file holds, snippet redacted; files named .env* are a finding of their own."""
    hit = _found(sources, secret_scan(), hits)
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in SECRETS]), F.col("i") + 1)
    found = hit.select(
        "target_id", "path", "language", "line", pick(0).alias("rule_id"), pick(2).alias("name"), pick(1).alias("severity"), F.lit("secret_exposure").alias("category"),
        F.array(F.lit("sensitive_data_access")).alias("capabilities"), F.lit("observed").alias("confidence"), (F.col("i").cast("long") * 10_000_000 + F.col("line")).alias("emit_seq"), "raw",
    )
    found = found.withColumn("snippet", text.snippet(F.substring("raw", 1, MAX_LINE))).drop("raw")
    name = paths.file_name(F.col("path"))
    files = sources.where((name == ".env") | name.startswith(".env.")).select(
        "target_id", "path", "language", F.lit(1).alias("line"), F.lit("SI-SEC-008").alias("rule_id"), F.lit("Environment file").alias("name"), F.lit("medium").alias("severity"),
        F.lit("sensitive_file").alias("category"), F.array(F.lit("sensitive_data_access")).alias("capabilities"), F.lit("observed").alias("confidence"), F.lit(0).cast("long").alias("emit_seq"),
        F.lit(None).cast("string").alias("snippet"),
    )
    return found.unionByName(files)


DOCKER = (
    Rule("SI-SC-003", "dockerfile", "low", "supply_chain", (), "Base image is not pinned", ""),
    Rule("SI-SC-002", "dockerfile", "high", "download_and_execute", ("network_access", "download_execute", "shell_execution"), "Build step runs a fetched script", r"\b(?:curl|wget)\b[^|\n]*\|\s*(?:bash|sh)\b"),
)


def docker_scan() -> LineScan:
    def subject(raw: Column, _: Column) -> Column:
        bare = text.strip(raw)
        return F.when((bare != "") & ~bare.startswith("#"), bare)

    def broken(bare: Column) -> Column:
        image = F.try_element_at(F.filter(F.slice(F.split(bare, java(r"\s+")), 2, 1_000_000), lambda w: ~w.startswith("--")), F.lit(1))
        low = F.lower(image)
        unpinned = F.lower(bare).startswith("from ") & image.isNotNull() & ~low.contains("@sha256:") & (~F.substring_index(image, "/", -1).contains(":") | low.endswith(":latest"))
        return _all_broken([F.coalesce(unpinned, F.lit(False)), bare.rlike(java(DOCKER[1].pattern))])

    return LineScan("docker", F.col("language") == "dockerfile", subject, broken)


def detect_docker(sources: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Unpinned base images and downloads piped into a shell."""
    hit = _found(sources, docker_scan(), hits)
    out = hit.select("*", *_described(DOCKER, F.col("i"))).withColumn("emit_seq", F.col("line").cast("long") * 10 + F.col("i")).withColumn("scanner_seq", F.lit(0))
    return fd.cap_per_file(out).withColumn("snippet", text.snippet(F.col("raw"))).drop("raw", "i", "scan")


def line_scans() -> list[LineScan]:
    """The scans of all detectors of this module."""
    return [secret_scan(), sensitive_path_scan(), shell_scan(), batch_scan(), prompt_scan(), docker_scan()]


def detect_installers(sources: DataFrame) -> DataFrame:
    """Install entry points by file name; content is not read."""
    capability = F.when(F.col("language") == "python", "code_execution").otherwise("shell_execution")
    return sources.where(paths.roles(F.col("path"), F.col("language"))["is_installer"]).select(
        "target_id", "path", "language", F.lit(1).alias("line"), F.lit("SI-SC-001").alias("rule_id"), F.lit("Install script").alias("name"), F.lit("medium").alias("severity"),
        F.lit("install_script").alias("category"), F.array(capability).alias("capabilities"), F.lit("observed").alias("confidence"), F.lit(0).cast("long").alias("emit_seq"),
        F.lit(None).cast("string").alias("snippet"),
    )
