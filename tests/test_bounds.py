"""What scanners of files take in time and memory: it follows the files."""

import time

import pytest
import yaml
from pyspark.sql import functions as F

from tidewatch.functions import patterns
from tidewatch.jobs import catalog
from tidewatch.operators import components, detectors, python_code, safe_yaml, syntax, workflows
from tidewatch.operators import findings as fd
from tidewatch.operators.rulebook import Rule
from tidewatch.sources.shared import written

SOURCES = "target_id string, path string, language string, content string"


def test_yaml_reader_is_fast_and_agrees(monkeypatch):
    texts = ["a: 1\n", "on: [push\n", "a:\tb", "# c\n\ta: b", "%FOO\n---\na: b", "># c\n\n  x", "[\n  ? ]", "? a\n: b", "a: |\n  # kept\n  x", "\ufeffa: b", "a: b\ufeff", "'it''s': \"\\u00e9\"", "{a: b, c: [d, e]}", "a: &k [b]\nc: *k", "\x07", "a\x85b: c"]

    def read(text):
        try:
            return safe_yaml.read_yaml(text)
        except safe_yaml.YamlFault:
            return "fault"

    found = [read(t) for t in texts]
    began = time.perf_counter()
    assert safe_yaml.read_yaml("# a comment of a workflow, word by word\n" * 20_000 + "on: push\n") == {"on": "push"}
    assert time.perf_counter() - began < 2
    monkeypatch.setattr(safe_yaml, "_loader", lambda text: yaml.BaseLoader)
    assert found == [read(t) for t in texts]


@pytest.mark.parametrize("scan", [workflows.scan_workflows, syntax.scan_javascript, components.scan_components, python_code.scan_python_behavior, python_code.scan_mcp_python])
def test_helpers_get_few_files_at_a_time(spark, scan):
    files = spark.createDataFrame([("t", f"{k}/mcp.json", "python", "x = 1") for k in range(3)], SOURCES)
    plan = scan(files)._jdf.queryExecution().toString()
    assert "BatchEvalPython" in plan and "MapInPandas" not in plan and "ArrowEvalPython" not in plan


def test_rules_skip_lines_without_their_texts(spark):
    pattern = r"(?=.*\bwords\b)(?=.*\bnothing\b)"
    assert patterns.needs(pattern) == ("words", "nothing") and patterns.needs(r"\w+") == ()
    # Every place of such a line would read the rest of it.
    long = "\n".join(["plain word " * 1_800] * 60)
    files = spark.createDataFrame([("t", "a", "text", f"{long}\nplain words and nothing else\nnothing\nnothings and words")], SOURCES)
    rules = (Rule("SI-X-001", "text", "low", "user_rule", (), "x", pattern), Rule("SI-X-002", "text", "low", "user_rule", (), "x", r"(?i)(?:WORD|other) and"))
    began = time.perf_counter()
    assert [(r.rule_id, r.line) for r in detectors.scan_rules(files, rules, plain=True).orderBy("rule_id", "line").collect()] == [("SI-X-001", 61)]
    assert time.perf_counter() - began < 15


def test_javascript_is_read_fast():
    # Each pattern used to try every place of the file, comments included.
    code = "// a comment of some words, one after the other\n" * 60_000 + "fs.rm(x); child_process.exec(y); newfetch(z)\nnew WebSocket(u); https.get(v); new Function(w); process.env.A; fs.readFile(b)"
    began = time.perf_counter()
    found = syntax.scan_javascript_text("a.js", code)
    assert [(r["rule_id"], r["line"]) for r in found] == [("SI-JS-003", 60_001), ("SI-JS-001", 60_001), ("SI-JS-005", 60_002), ("SI-JS-005", 60_002), ("SI-JS-002", 60_002), ("SI-JS-006", 60_002), ("SI-JS-007", 60_002)]
    assert time.perf_counter() - began < 0.9


def test_small_targets_are_ranked_without_ranges(spark, monkeypatch):
    """Ranges take a sample, a second pass over the rows and a written table; targets below a partition's share need none."""
    monkeypatch.setattr(fd, "written", lambda *_: pytest.fail("written for small targets"))
    rows = [(None if i % 40 == 0 else f"t{i % 40}", i * 7919 % 1009, i) for i in range(4000)]
    ranked = fd.ranked_within(spark.createDataFrame(rows, "target_id string, k int, i int"), "target_id", [F.desc("k"), F.col("i")])
    assert dict(ranked.dtypes)["rank"] == "bigint"
    got = {(r.target_id, r.i): r["rank"] for r in ranked.collect()}
    for target in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == target), key=lambda r: (-r[1], r[2]))
        assert [got[target, r[2]] for r in own] == list(range(1, len(own) + 1))


def test_dedupe_is_one_window(spark):
    """Nulls in the order of emission are the first; the last row stays, with the place of the first."""
    schema = "target_id string, path string, rule_id string, line int, name string, scanner_seq int, emit_seq long, severity string"
    rows = [(t, None, "R", None, "n", s, e, f"{s}/{e}") for t in ("a", None) for s, e in ((1, 2), (None, 9), (0, None), (1, 7), (0, 3))]
    kept = fd.dedupe_findings(spark.createDataFrame(rows, schema).repartition(7))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
    assert sorted((str(r.target_id), r.severity, r.first_seq, r.first_emit) for r in kept.collect()) == [("None", "1/7", None, 9), ("a", "1/7", None, 9)]


def test_packs_of_pages_are_no_arrow_batches(spark, sf_dir, monkeypatch):
    """A batch of Arrow's is 10,000 packs, whose texts grow with the table; a plain function gets 100."""
    plans = []
    monkeypatch.setattr(catalog, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    assert catalog.QUERIES["s3_archive_members"](spark, sf_dir).count() > 0
    assert "BatchEvalPython" in plans[0] and not any(x in plans[0] for x in ("MapInPandas", "MapInArrow", "ArrowEvalPython"))
