"""What Python files do when run: programs, code from text, environment, network, files, tools of servers.

A helper reads each file's syntax tree once and returns facts as rows: calls with what their arguments spell out, uses
of the environment, and tool functions. Rules, caps, uniqueness and order are columns over the facts. Nothing is run.
"""

from __future__ import annotations

import ast
from collections import deque
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import paths, text
from ..functions.patterns import java
from . import findings as fd
from .by_file import file_rows
from .rulebook import CAPABILITIES

MAX_CALLS, MAX_PER_FILE = 10_000, 1_000
# Calls by what they do.
STARTS = ["subprocess.Popen", "subprocess.call", "subprocess.check_call", "subprocess.check_output", "subprocess.run"]
DYNAMIC = ["builtins.compile", "builtins.eval", "builtins.exec", "compile", "eval", "exec"]
PICKLES = ["pickle.load", "pickle.loads"]
SAFE_LOADERS = ["CSafeLoader", "FullLoader", "SafeLoader"]
ENVIRONMENT = ["os.environ.get", "os.getenv"]
# Modules and methods that reach the network.
ROOTS = ["aiohttp", "httpx", "requests", "socket", "urllib", "websocket", "websockets"]
METHODS = ["connect", "create_connection", "delete", "get", "head", "open", "patch", "post", "put", "request", "send", "sendall", "sendto", "socket", "urlopen"]
SENDING = ["PATCH", "POST", "PUT", "SEND", "SENDALL", "SENDTO"]
VERBS = ["DELETE", "GET", "HEAD", "PATCH", "POST", "PUT"]
PAYLOADS = ["body", "content", "data", "files", "json"]
KNOWN_HOSTS = ["api.github.com", "github.com"]
# File methods by what they do.
READS = ["readFile", "readFileSync", "read_bytes", "read_text"]
WRITES = ["append_text", "writeFile", "writeFileSync", "write_bytes", "write_text"]
DELETES = ["remove", "rm", "rmdir", "unlink"]
DELETE_NAMES = ["os.remove", "os.rmdir", "os.unlink", "shutil.rmtree"]
FILE_CALLS = {"open", *READS, *WRITES, *DELETES}
# Sensitive places in file calls, in the order in which the first wins.
PLACES = {
    "ssh": ["/.ssh/", "~/.ssh", ".ssh/"], "aws": ["/.aws/", "~/.aws", ".aws/"], "user_config": ["/.config/", "~/.config", ".config/", "/.env"],
    "system": ["/etc/", "windows/system32"], "browser": ["google/chrome", "mozilla/firefox", "user data/default"],
}
# Names in addresses by kind of service, in the order in which the first wins.
SERVICES = {"webhook": ["webhook", "hooks.slack"], "telemetry": ["telemetry", "analytics", "/events", "sentry.io"]}
# Modules with which a server's tool reaches the network, and what opens files there.
TOOL_ROOTS = ["aiohttp", "httpx", "requests", "socket", "urllib", "websockets"]
TOOL_OPENS = ["Path.open", "open", "pathlib.Path.open"]

FACTS = (
    "kind string, seq long, place long, line int, name string, written string, n_args int, listed boolean, program string, "
    "first string, mode string, shell boolean, loader string, method string, payload boolean, address string, host string, texts array<string>, in_tool boolean, raw string"
)


def parsed(content: str) -> ast.AST | None:
    try:
        return ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _spelled(node: ast.AST) -> str:
    """The attribute path of an expression as written; "" for what has no name. What a call returns has none either."""
    tail = ""
    while isinstance(node, ast.Attribute):
        tail, node = f".{node.attr}{tail}", node.value
    return node.id + tail if isinstance(node, ast.Name) else tail[1:]


class _File:
    """One file: its nodes level by level, whether each lies in a tool function, and the names that imports bind."""

    def __init__(self, tree: ast.AST):
        self.nodes: list[tuple[ast.AST, bool]] = []
        self.bound: dict[str, str] = {}
        self.tools: list[ast.AST] = []
        todo = deque([(tree, False)])
        while todo:
            node, inside = todo.popleft()
            match node:
                case ast.Import(names=names):
                    for n in names:
                        self.bound[n.asname or n.name.split(".", 1)[0]] = n.name
                case ast.ImportFrom(module=str(module), names=names):
                    self.bound.update({n.asname or n.name: f"{module}.{n.name}" for n in names})
                case ast.FunctionDef(decorator_list=[*marks]) | ast.AsyncFunctionDef(decorator_list=[*marks]):
                    if any(_spelled(m.func if isinstance(m, ast.Call) else m).rsplit(".", 1)[-1] == "tool" for m in marks):
                        self.tools.append(node)
                        inside = True
            self.nodes.append((node, inside))
            todo.extend((child, inside) for child in ast.iter_child_nodes(node))

    def resolved(self, written: str) -> str:
        head, dot, rest = written.partition(".")
        return self.bound.get(head, head) + dot + rest


def _call_facts(call: ast.Call, name: str) -> dict:
    """What the arguments of a call spell out; texts at any depth only where files may be used."""
    said = {k.arg: k.value for k in call.keywords}
    literal = {name: str(v.value) for name, v in said.items() if isinstance(v, ast.Constant)}
    plain = [a.value if isinstance(a, ast.Constant) else None for a in call.args]
    items = call.args[0].elts if call.args and isinstance(call.args[0], (ast.List, ast.Tuple)) else None
    head = items[0].value if items and isinstance(items[0], ast.Constant) else None if items is not None or not plain else plain[0]
    loader = said.get("Loader")
    address = [v for v in plain if isinstance(v, str) and "://" in v]
    address += [k.value.value for k in call.keywords if k.arg in ("url", "uri") and isinstance(k.value, ast.Constant) and isinstance(k.value.value, str)]
    address += [head] if items is not None and isinstance(head, str) else []
    try:
        host = urlsplit(address[0]).hostname if address else None
    except ValueError:
        host = None
    return {
        "n_args": len(call.args), "listed": items is not None, "program": head if isinstance(head, str) else None,
        "first": str(plain[0]) if call.args and isinstance(call.args[0], ast.Constant) else None,
        "mode": str(plain[1]) if len(call.args) > 1 and isinstance(call.args[1], ast.Constant) else literal.get("mode"),
        "shell": isinstance(said.get("shell"), ast.Constant) and said["shell"].value is True, "loader": getattr(loader, "id", getattr(loader, "attr", None)),
        "method": literal.get("method"), "payload": not said.keys().isdisjoint(PAYLOADS), "address": address[0] if address else None, "host": host,
        "texts": [n.value for n in ast.walk(call) if isinstance(n, ast.Constant) and isinstance(n.value, str)] if name in DELETE_NAMES or name.rsplit(".", 1)[-1] in FILE_CALLS else None,
    }


def file_facts(content: str) -> list[dict]:
    """Facts of one file: calls (place: by line and column among the first MAX_CALLS), os.environ as `item` or `attribute`, tools."""
    tree = parsed(content)
    if tree is None:
        return []
    file, out = _File(tree), []
    calls = [node for node, _ in file.nodes if isinstance(node, ast.Call)][:MAX_CALLS]
    place = {id(c): k for k, c in enumerate(sorted(calls, key=lambda c: (c.lineno, c.col_offset)))}
    for seq, (node, inside) in enumerate(file.nodes):
        fact = {"seq": seq, "line": getattr(node, "lineno", 1), "in_tool": inside}
        if isinstance(node, ast.Call) and (written := _spelled(node.func)):
            resolved = file.resolved(written) if not isinstance(_root(node.func), ast.Call) else written
            out.append(fact | {"kind": "call", "written": written, "name": resolved, "place": place.get(id(node))} | _call_facts(node, resolved))
        elif isinstance(node, (ast.Subscript, ast.Attribute)):
            written = _spelled(node.value)
            out.append(fact | {"kind": "item" if isinstance(node, ast.Subscript) else "attribute", "written": written, "name": file.resolved(written)})
    out = [f for f in out if f["kind"] == "call" or "os.environ" in (f["name"], f["written"])]
    return out + [{"kind": "tool", "seq": -1, "line": t.decorator_list[0].lineno, "place": t.lineno, "name": t.name, "in_tool": True} for t in file.tools]


def _root(node: ast.AST) -> ast.AST:
    while isinstance(node, ast.Attribute):
        node = node.value
    return node


def _is_server(content: Column) -> Column:
    """Whether a Python file may be a tool server."""
    component = paths.roles(F.col("path"), F.col("language"))["is_component"]
    shaped = (F.col("language") == "python") & content.rlike(java(r"(?m)^\s*@\w+(?:\.\w+)*\.tool\s*\("))
    return (paths.file_name(F.col("path")) == "mcp_server.py") | (component & shaped)


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of all Python files, each parsed once; a file that does not parse has none, see parse_status. The scanners below
    take the facts of a corpus where they are at hand."""

    def rows(_: str, content: str) -> list[dict]:
        lines = content.splitlines()
        return [f | {"raw": lines[f["line"] - 1] if 0 < f["line"] <= len(lines) else ""} for f in file_facts(content)]

    content = F.coalesce("content", F.lit(""))
    return file_rows(files.select("target_id", "path", "language", content.alias("content"), _is_server(content).alias("server")), rows, FACTS, "server")


def _facts(sources: DataFrame, files: Column, known: DataFrame | None) -> DataFrame:
    return python_facts(sources.where(files)) if known is None else known


@F.udf(BooleanType(), useArrow=False)
def _parses(code: str | None) -> bool:
    return code is not None and parsed(code) is not None


def parse_status(sources: DataFrame) -> DataFrame:
    """(target_id, path, parse_ok) of Python files."""
    return sources.where(F.col("language") == "python").select("target_id", "path", _parses(F.col("content")).alias("parse_ok"))


# --- columns ----------------------------------------------------------------------------------------------------------
def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def labels(**values: Column | str) -> Column:
    """A map<string,string> without its null entries."""
    full = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v) if isinstance(v, str) else v)]) if values else F.create_map()
    return F.map_filter(full.cast("map<string,string>"), lambda _, v: v.isNotNull())


def hit(test: Column, rule: Column | str, name: Column | str, severity: Column | str, category: Column | str, capabilities: Column, confidence: str = "observed", method: Column | None = None, destination: Column | None = None, metadata: Column | None = None) -> Column:
    """What a rule says about a fact, or null."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    none = F.lit(None).cast("string")
    return F.when(
        test,
        F.struct(
            lit(rule).alias("rule_id"), lit(name).alias("name"), lit(severity).alias("severity"), lit(category).alias("category"), capabilities.alias("capabilities"), F.lit(confidence).alias("confidence"),
            (none if method is None else method).alias("method"), (none if destination is None else destination).alias("destination"), (labels() if metadata is None else metadata).alias("metadata"),
        ),
    )


def reported(facts: DataFrame, hits: list[Column], *keep: str) -> DataFrame:
    """One row per hit with its number k among the rules."""
    found = facts.select("target_id", "path", "language", "line", "raw", *keep, F.posexplode(F.array(*hits)).alias("k", "h")).where("h is not null")
    return found.select("target_id", "path", "language", "line", "raw", *keep, "k", "h.*")


def with_snippets(found: DataFrame) -> DataFrame:
    return found.withColumn("snippet", text.snippet(F.col("raw"))).withColumn("metadata", text.redact_data(F.col("metadata"), "map<string,string>")).drop("raw")


def service_hint(address: Column) -> Column:
    """webhook or telemetry, by the address of a reporting service; else null."""
    low = F.lower(address)
    return F.coalesce(*[F.when(F.coalesce(*[F.when(low.contains(m), F.lit(True)) for m in marks]), F.lit(kind)) for kind, marks in SERVICES.items()])


def network_host(address: Column, host: Column) -> Column:
    """Where a call goes: the host of the address, an address without scheme itself, or `dynamic`."""
    return F.when(F.coalesce(address, F.lit("")) == "", "dynamic").when(F.coalesce(host, F.lit("")) != "", F.lower(host)).when(address.contains("://"), "dynamic").otherwise(F.lower(address))


def _last(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def _opens_to_write(mode: Column) -> Column:
    return F.coalesce(mode, F.lit("r")).rlike("[wax+]")


def scan_python_calls(sources: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Programs started, code made from text, unsafe loading: SI-PY-001 to 006."""
    facts = _facts(sources, F.col("language") == "python", facts).where("kind = 'call' and place is not null")
    name, starts = F.col("name"), F.col("name").isin(STARTS)
    git = F.when(F.col("listed"), F.lower("program").rlike(r"(?:\A|[\\/])git(?:\.exe)?\z")).otherwise(F.col("program").rlike(java(r"(?i)^\s*git(?:\.exe)?(?:\s|$)")))
    shells = F.when(F.coalesce(git, F.lit(False)), strings("shell_execution", "git_operations")).otherwise(strings("shell_execution"))
    safe = F.coalesce(F.col("loader").isin(SAFE_LOADERS), F.lit(False))
    hits = [
        hit(starts & F.col("shell"), "SI-PY-001", "Command run by a shell", "high", "command_execution", shells),
        hit(starts & ~F.col("shell"), "SI-PY-002", "Program started", "medium", "command_execution", shells),
        hit(name == "os.system", "SI-PY-003", "Command given to the system shell", "high", "command_execution", strings("shell_execution")),
        hit(name.isin(DYNAMIC), "SI-PY-004", "Code made from text", "medium", "dynamic_code_execution", strings("code_execution")),
        hit(name.isin(PICKLES), "SI-PY-005", "Pickle loaded", "high", "unsafe_deserialization", strings("code_execution")),
        hit((name == "yaml.load") & ~safe, "SI-PY-006", "YAML loaded without a safe loader", "high", "unsafe_deserialization", strings("code_execution")),
    ]
    found = reported(facts, hits, "place").withColumn("emit_seq", F.col("place")).withColumn("scanner_seq", F.lit(0))
    return with_snippets(fd.cap_per_file(found, MAX_PER_FILE)).drop("k", "place")


def _network_hits() -> list[Column]:
    name, address = F.col("name"), F.col("address")
    root, last = F.substring_index(name, ".", 1), F.upper(_last(name))
    reaches = (F.col("kind") == "call") & root.isin(ROOTS) & F.lower(_last(name)).isin(METHODS)
    asked = F.coalesce(F.upper("method"), F.when(F.upper("first").isin(VERBS), F.upper("first")), F.lit("REQUEST"))
    method = F.when(last.isin("OPEN", "REQUEST", "URLOPEN"), asked).when(last == "CREATE_CONNECTION", "CONNECT").otherwise(last)
    host = network_host(address, F.col("host"))
    place = F.when(F.coalesce(F.lower("host").isin(KNOWN_HOSTS), F.lit(False)), "github").otherwise("unknown")
    web = root.isin("websocket", "websockets") | F.coalesce(F.lower(address).rlike(r"\Awss?://"), F.lit(False))
    transport = F.when(web, "websocket").when(root == "socket", "socket").otherwise("http")
    title = F.when(web, "WebSocket opened").when(root == "socket", "Raw socket used").otherwise("Request sent")
    hint, net = service_hint(F.coalesce(address, F.lit("dynamic"))), strings("network_access")
    return [
        hit(reaches, "SI-PY-021", title, F.when(host.isin(KNOWN_HOSTS), "info").otherwise("low"), "network_access", net, method=method, destination=place, metadata=labels(method=method, destination=place, domain=host, transport=transport)),
        hit(reaches & method.isin(SENDING) & ((F.col("n_args") > 1) | F.col("payload")), "SI-PY-025", "Data may be sent out", "low", "network_upload", net, "inferred", method, place, labels(method=method, destination=place)),
        hit(reaches & hint.isNotNull(), "SI-PY-026", "Address of a reporting service", "low", "network_service_hint", net, "inferred", None, place, labels(hint=hint, destination=place)),
    ]


def _file_hits() -> list[Column]:
    name, last, call = F.col("name"), _last(F.col("name")), F.col("kind") == "call"
    opened = F.when(_opens_to_write(F.col("mode")), "write").otherwise("read")
    does = F.when(call & (last == "open"), opened).when(call & last.isin(READS), "read").when(call & last.isin(WRITES), "write").when(call & (name.isin(DELETE_NAMES) | last.isin(DELETES)), "delete")
    able = F.when(does == "read", strings("filesystem_read")).when(does == "write", strings("filesystem_write")).otherwise(strings("file_delete"))
    spelled = F.transform("texts", lambda t: F.lower(F.replace(t, F.lit("\\"), F.lit("/"))))

    def holds(marks: list[str]) -> Column:
        return F.exists(spelled, lambda t: F.coalesce(*[F.when(t.contains(m), F.lit(True)) for m in marks], F.lit(False)))

    place = F.coalesce(*[F.when(holds(marks), F.lit(kind)) for kind, marks in PLACES.items()])
    generic = does.isNotNull() & place.isNull()
    rule = F.when(does == "read", "SI-PY-022").when(does == "write", "SI-PY-023").otherwise("SI-PY-024")
    title = F.when(does == "read", "File read").when(does == "write", "File written").otherwise("File deleted")
    return [
        hit(does.isNotNull() & place.isNotNull(), "SI-FS-001", "Sensitive place used by a file call", "medium", "sensitive_filesystem_access", F.concat(able, strings("sensitive_data_access")), metadata=labels(operation=does, path_class=place)),
        hit(generic, rule, title, F.when(does == "delete", "medium").otherwise("low"), F.concat(F.lit("filesystem_"), does), able),
    ]


def scan_python_behavior(sources: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Environment, network and file use: SI-PY-020 to 026 and SI-FS-001.

    The first MAX_PER_FILE of a file in order of the tree, uses of the environment by key first; of equal rule, line and text
    the last stays; order by line and rule.
    """
    facts = _facts(sources, F.col("language") == "python", facts).where("kind in ('call', 'item')")
    by_key = (F.col("kind") == "item") & (F.col("name") == "os.environ")
    by_call = (F.col("kind") == "call") & F.col("name").isin(ENVIRONMENT)
    hits = [hit(by_key | by_call, "SI-PY-020", "Environment read", "low", "environment_access", strings("environment_read")), *_network_hits(), *_file_hits()]
    found = reported(facts, hits, "kind", "seq")
    file = Window.partitionBy("target_id", "path")
    kept = found.withColumn("n", F.row_number().over(file.orderBy(F.desc("kind"), "seq", "k"))).where(F.col("n") <= MAX_PER_FILE)
    same = Window.partitionBy("target_id", "path", "rule_id", "line").orderBy(F.desc("n"))
    unique = kept.withColumn("m", F.row_number().over(same)).where("m = 1")
    emit = F.col("line").cast("long") * 1_000 + F.substring("rule_id", -3, 3).cast("int") * F.when(F.col("rule_id") == "SI-FS-001", 0).otherwise(1)
    return with_snippets(unique.withColumn("emit_seq", emit)).drop("kind", "seq", "k", "n", "m")


def capability_severity(capabilities: Column) -> Column:
    """high where files are deleted or programs run, medium where settings, files or the network are reached, else low."""
    has = lambda *names: F.arrays_overlap(capabilities, strings(*names))
    return F.when(has("file_delete", "shell_execution"), "high").when(has("environment_read", "filesystem_write", "network_access"), "medium").otherwise("low")


def in_order(flags: dict[str, Column]) -> Column:
    """The capabilities whose flag is true, in the order of output."""
    return F.array_compact(F.array(*[F.when(flags[c], F.lit(c)) for c in CAPABILITIES if c in flags]))


def scan_mcp_python(sources: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """SI-MCP-002: what the tool functions of a Python server may do, one finding per file; names as written in the file."""
    facts = _facts(sources, _is_server(F.col("content")), facts).where("server and in_tool")
    call, name, last = F.col("kind") == "call", F.col("written"), _last(F.col("written"))
    dotted, writes = F.contains("written", F.lit(".")), _opens_to_write(F.col("mode"))
    tests = {
        "filesystem_read": call & ((name.isin(TOOL_OPENS) & ~writes) | (dotted & last.isin("read_bytes", "read_text"))),
        "filesystem_write": call & ((name.isin(TOOL_OPENS) & writes) | (dotted & last.isin("write_bytes", "write_text"))),
        "file_delete": call & name.isin(DELETE_NAMES),
        "shell_execution": call & (name.startswith("subprocess.") | (name == "os.system")),
        "network_access": call & F.substring_index(name, ".", 1).isin(TOOL_ROOTS),
        "environment_read": (call & name.isin(ENVIRONMENT)) | ((F.col("kind") == "attribute") & (name == "os.environ")),
    }
    tool = F.col("kind") == "tool"
    per_file = facts.groupBy("target_id", "path", "language").agg(
        F.min(F.when(tool, F.struct("line", "raw"))).alias("at"), F.array_sort(F.collect_list(F.when(tool, F.struct("place", "name")))).alias("tools"),
        *[F.coalesce(F.bool_or(t), F.lit(False)).alias(c) for c, t in tests.items()],
    ).where("at is not null")
    able = in_order({c: F.col(c) for c in tests})
    names = F.to_json(F.transform("tools", lambda t: t["name"]))
    found = per_file.select(
        "target_id", "path", "language", "at.line", "at.raw", F.lit("SI-MCP-002").alias("rule_id"), F.lit("What a server's tools may do").alias("name"), capability_severity(able).alias("severity"), F.lit("mcp_capability").alias("category"),
        able.alias("capabilities"), F.lit("inferred").alias("confidence"), labels(component_type="mcp", tools=names).alias("metadata"), F.lit(0).cast("long").alias("emit_seq"),
    )
    return with_snippets(found)
