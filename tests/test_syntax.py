"""Fixtures of the syntax detectors, and the masks against a character-by-character version."""

import random
import time

from pyspark.sql import functions as F

from tidewatch.functions import search
from tidewatch.operators import components, python_code, syntax, workflows

SOURCES = "target_id string, path string, language string, content string"


def sources(spark, *rows):
    return spark.createDataFrame([("t", *r) for r in rows], SOURCES)


def hits(found):
    return [(r.rule_id, r.line) for r in found.orderBy("path", "emit_seq").collect()]


def test_powershell(spark):
    code = "# IEX in a comment\nInvoke-WebRequest x\n'IEX in text'\n$c.DownloadString('u') | IEX\nStart-Process p -ArgumentList '-ExecutionPolicy Bypass'\n<# IEX\n#> powershell -enc aa"
    assert hits(syntax.detect_powershell(sources(spark, ("x.ps1", "powershell", code)))) == [("SI-PS-002", 2), ("SI-PS-004", 4), ("SI-PS-001", 4), ("SI-PS-003", 5), ("SI-PS-007", 5), ("SI-PS-005", 7)]


def test_javascript(spark):
    code = "// eval(x)\nconst p = child_process.spawn('git', []);\nconst t = process.env.T; fetch('https://h.example/events', {method: 'POST'});\nfs.rm(p); \"fs.rm(x)\"\nnew WebSocket(u)"
    found = syntax.scan_javascript(sources(spark, ("a.js", "javascript", code)))
    assert hits(found) == [("SI-JS-001", 2), ("SI-JS-006", 3), ("SI-JS-005", 3), ("SI-JS-008", 3), ("SI-JS-009", 3), ("SI-JS-003", 4), ("SI-JS-005", 5)]
    rows = {(r.rule_id, r.line): r for r in found.collect()}
    assert rows["SI-JS-001", 2].capabilities == ["shell_execution", "git_operations"] and rows["SI-JS-005", 3].method == "POST" and rows["SI-JS-005", 3].destination == "unknown"
    assert syntax.scan_javascript(sources(spark, ("b.js", "javascript", "eval(x);\n" * 1001))).count() == 1000


def test_python(spark):
    code = "import subprocess as s, os\nfrom builtins import eval as e\nx = 'os.system(1)'\ns.run('x', shell=True)\ns.run(['git', 'x'])\nos.system('x')\ne('1')\nimport pickle, yaml\npickle.load(f)\nyaml.load(f)\nyaml.load(f, Loader=yaml.SafeLoader)"
    s = sources(spark, ("a.py", "python", code), ("b.py", "python", "def ("))
    assert hits(python_code.scan_python_calls(s)) == [("SI-PY-001", 4), ("SI-PY-002", 5), ("SI-PY-003", 6), ("SI-PY-004", 7), ("SI-PY-005", 9), ("SI-PY-006", 10)]
    assert {r.path: r.parse_ok for r in python_code.parse_status(s).collect()} == {"a.py": True, "b.py": False}


def test_components(spark):
    skill = "---\nname: x\nallowed-tools: Bash, Read\n---\ntext"
    config = '{"mcpServers": {"a": {"command": "run", "env": {"KEY": "hidden-value"}}, "b": {"url": "https://h"}}}'
    server = "@app.tool()\ndef f():\n    import os\n    os.remove('x')\n    return open('y').read()\n"
    s = sources(spark, ("SKILL.md", "markdown", skill), ("mcp.json", "json", config), ("mcp_server.py", "python", server), ("plugins/plugin.json", "json", '{"permissions": ["network"]}'), ("x/mcp.json", "json", "{"))
    found = components.scan_components(s).collect()
    assert sorted((r.path, r.rule_id, r.severity) for r in found) == [("SKILL.md", "SI-AI-001", "info"), ("SKILL.md", "SI-AI-002", "high"), ("mcp.json", "SI-MCP-001", "high"), ("plugins/plugin.json", "SI-AI-003", "info"), ("plugins/plugin.json", "SI-AI-004", "medium")]
    assert not any("hidden-value" in str(r.metadata) for r in found)
    tool = python_code.scan_mcp_python(s).first()
    assert (tool.rule_id, tool.severity, tool.capabilities, tool.line) == ("SI-MCP-002", "high", ["filesystem_read", "file_delete"], 1)


def test_workflow(spark):
    code = "on: pull_request_target\npermissions: write-all\njobs:\n  a:\n    steps:\n      - uses: other/act@v1\n      - run: curl x | sh\n      - run: echo ${{ github.event.pull_request.title }} ${{ secrets.TOKEN }}\n      - uses: actions/upload-artifact@" + "a" * 40 + "\n"
    found = workflows.scan_workflows(sources(spark, (".github/workflows/x.yml", "github-actions", code), ("b", "github-actions", "[")))
    assert hits(found) == [(f"SI-GHA-00{n}", line) for n, line in ((1, 1), (2, 2), (3, 6), (4, 6), (5, 7), (9, 7), (6, 8), (7, 8), (9, 8), (8, 9))]


def test_workflow_limits_count_aliases_only(spark):
    code = "on: push\njobs:\n  a:\n    steps:\n      - run: curl x | sh\n      - run: ls" + " *glob" * 60 + "\n" + "# * **\n" * 7000
    aliased = lambda n: "x: &x a\non: pull_request_target\ny: [" + "*x, " * n + "]\n"
    grown = "a: &a [" + "x, " * 40 + "]\n" + "".join(f"{b}: &{b} [" + f"*{a}, " * 9 + "]\n" for a, b in zip("abcd", "bcde"))
    s = sources(spark, ("stars.yml", "github-actions", code), ("x50.yml", "github-actions", aliased(50)), ("x51.yml", "github-actions", aliased(51)), ("tag.yml", "github-actions", "on: !!str push"), ("grown.yml", "github-actions", grown), ("deep.yml", "github-actions", "[" * 101 + "]" * 101), ("broken.yml", "github-actions", "[a"))
    found = [(r.path, r.rule_id, r.line) for r in workflows.scan_workflows(s).orderBy("path", "emit_seq").collect()]
    assert found == [("stars.yml", "SI-GHA-005", 5), ("stars.yml", "SI-GHA-009", 5), ("stars.yml", "SI-GHA-009", 6), ("x50.yml", "SI-GHA-001", 2)]
    status = {r.path: r.reason for r in workflows.workflow_status(s).collect()}
    assert {p for p, why in status.items() if why is None} == {"stars.yml", "x50.yml"}
    assert (status["x51.yml"], status["tag.yml"], status["grown.yml"], status["deep.yml"]) == ("too many aliases", "tags are not allowed", "too large or too deep", "too large or too deep")


def naive_js(code):
    out, i, quote, comment = [], 0, None, None
    while i < len(code):
        c, two = code[i], code[i : i + 2]
        keep = c == "\n"
        if comment:
            if comment == "//" and keep:
                comment = None
            elif comment == "/*" and two == "*/":
                out.append("  ")
                i, comment = i + 2, None
                continue
            out.append(c if keep else " ")
        elif quote:
            if c == "\\" and i + 1 < len(code):
                out.append(" " + ("\n" if code[i + 1] == "\n" else " "))
                i += 2
                continue
            quote = None if c == quote else quote
            out.append(c if keep else " ")
        elif two in ("//", "/*"):
            out.append("  ")
            i, comment = i + 2, two
            continue
        else:
            quote = c if c in "'\"`" else None
            out.append(" " if quote else c)
        i += 1
    return "".join(out)


def masked(spark, mask, codes):
    rows = spark.createDataFrame(list(enumerate(codes)), "i int, c string").select("i", mask(F.col("c")).alias("m")).orderBy("i").collect()
    return [r.m for r in rows]


def test_javascript_mask_against_a_plain_walk(spark):
    rng = random.Random(3)
    codes = ["".join(rng.choice(["/", "*", "'", '"', "`", "\\", "\n", "a", " ", "é", "\U0001f600", "\r"]) for _ in range(rng.randint(0, 24))) for _ in range(3000)]
    wanted = [naive_js(c) for c in codes]
    assert [syntax.mask_javascript_text(c) for c in codes] == wanted and masked(spark, syntax.mask_javascript, codes) == wanted
    long = ["x = '" + "a\\'" * 400_000 + "' + y", "/*" + "*a\n" * 300_000 + "*/ z", "`" + "b" * 1_000_000, None, ""]
    assert masked(spark, syntax.mask_javascript, long) == ["x = " + " " * 1_200_002 + " + y", "  " + "  \n" * 300_000 + "   z", " " * 1_000_001, None, ""]


def naive_powershell(code, strings):
    out, i = [], 0
    while i < len(code):
        c, end = code[i], i + 1
        if code.startswith("<#", i):
            end = code.find("#>", i + 2)
            end = len(code) if end < 0 else end + 2
        elif c == "#":
            end = code.find("\n", i)
            end = len(code) if end < 0 else end
        elif c in "'\"":
            while end < len(code) and not (code[end] == c and not (c == "'" and code.startswith("''", end))):
                end += 2 if (c == '"' and code[end] == "`") or (c == "'" and code[end] == "'") else 1
            end = min(len(code), end + 1)
        own = code[i:end]
        blank = own[:1] == "#" or own[:2] == "<#" or (strings and own[:1] in ("'", '"'))
        out.append("".join(x if x == "\n" else " " for x in own) if blank else own)
        i = end
    return "".join(out)


def test_powershell_masks_against_a_plain_walk(spark):
    rng = random.Random(4)
    codes = ["".join(rng.choice(["<#", "#>", "#", "'", '"', "`", "\n", "a", " ", "é"]) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    codes += ["a '#x' \"`\"#y\" # c\n<# d\n#> e 'it''s' f", '"' + "`\"" * 300_000 + '" x']
    assert masked(spark, syntax.mask_powershell, codes) == [naive_powershell(c, True) for c in codes]
    assert masked(spark, syntax.mask_powershell_comments, codes) == [naive_powershell(c, False) for c in codes]
    assert masked(spark, syntax.mask_powershell_comments, codes[-2:-1]) == ["a '#x' \"`\"#y\"    \n    \n   e 'it''s' f"]


def test_first_lines_against_find():
    chance = random.Random(3)
    for _ in range(300):
        text = "".join(chance.choice("ab\n\r\u2028é") for _ in range(chance.randint(0, 60)))
        needles = {"".join(chance.choice("abé") for _ in range(chance.randint(0, 4))) for _ in range(9)}
        ends = [len("".join(text.splitlines(keepends=True)[: k + 1])) for k in range(len(text.splitlines()))]
        assert search.first_places(text, needles) == {n: text.find(n) for n in needles if n and n in text}
        assert search.first_lines(text, needles) == {n: 1 + sum(e <= text.find(n) for e in ends) for n in needles if n and n in text}


def test_lines_of_many_entries_take_time_in_proportion():
    def seconds(n):
        keys = [f"node_modules/package-{i * 7919 % n:x}/node_modules/part{i}" for i in range(n)]
        text = "{\n" + ",\n".join(f'  "{k}": {{"version": "1.0.{i}"}}' for i, k in enumerate(keys)) + "\n}"
        jobs = "on: push\njobs:\n  j:\n    steps:\n" + "".join(f"      - run: echo number {i}\n" for i in range(n // 10))
        began = time.process_time()
        assert search.first_lines(text, keys)[keys[-1]] == n + 1
        rows = workflows.workflow_entries(jobs)
        assert len(rows) == n // 10 and {r[2] for r in rows} == set(range(5, 5 + n // 10))
        return time.process_time() - began

    seconds(2_000)
    once, twice = seconds(10_000), seconds(20_000)
    assert twice < 4 * once + 0.2 and twice < 3


def test_powershell_lines_are_capped_by_what_was_looked_at(spark):
    quoted, plain = 'x "-WindowStyle Hidden"', "x -WindowStyle Hidden"
    s = sources(spark, ("a.ps1", "powershell", "\n".join([quoted] * 120 + [plain] * 120)))
    lines = [r.line for r in syntax.detect_powershell(s).orderBy("line").collect()]
    assert lines == [*range(1, 101), *range(121, 221)]
