"""Columns over paths and addresses: language, roles, safety, kind of target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Directories whose content is not looked at.
IGNORED_DIRECTORIES = [".git", ".hg", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "__pycache__", "build", "dist", "node_modules", "vendor", "venv"]
# Languages by suffix.
LANGUAGES = {
    ".bat": "batch", ".bash": "shell", ".cjs": "javascript", ".cmd": "batch", ".js": "javascript", ".json": "json", ".jsx": "javascript",
    ".md": "markdown", ".mjs": "javascript", ".ps1": "powershell", ".py": "python", ".sh": "shell", ".toml": "toml", ".ts": "javascript",
    ".tsx": "javascript", ".txt": "text", ".yaml": "yaml", ".yml": "yaml", ".zsh": "shell",
}
# Languages by file name.
NAMES = {"dockerfile": "dockerfile", "gemfile": "text", "makefile": "makefile", "pipfile": "toml", "procfile": "text", "requirements.txt": "text"}
# File names by role.
PROMPT_FILES = ["agent.md", "instructions.md", "mcp.json", "plugin.json", "skill.md", "system.md", "system_prompt.md"]
COMPONENT_FILES = ["mcp.json", "mcp_server.py", "plugin.json", "skill.md"]
SENSITIVE_FILES = ["mcp.json", "plugin.json", "skill.md"]
SENSITIVE_LANGUAGES = ["batch", "github-actions", "javascript", "powershell", "shell"]
INSTALL_FILES = ["install.bat", "install.cmd", "install.ps1", "install.sh", "setup.py"]
MANIFESTS = ["package-lock.json", "package.json", "pyproject.toml", "requirements.txt"]
# Archive suffixes and binaries that are refused.
ARCHIVES = [".tar", ".tar.gz", ".tgz", ".zip"]
BINARIES = [".dmg", ".exe", ".msi", ".pkg"]


def parts(path: Column) -> Column:
    """Parts of a path, with / for \\."""
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")


def file_name(path: Column) -> Column:
    return F.lower(F.element_at(parts(path), -1))


def named(files: DataFrame, *names: str) -> Column:
    """Whether a file is called so; a table that is partitioned by `file_name` is read in those partitions only."""
    return (F.col("file_name") if "file_name" in files.columns else file_name(F.col("path"))).isin(*names)


def directories(path: Column) -> Column:
    p = parts(path)
    return F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.lower)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)




def detect_language(path: Column) -> Column:
    """Language by name, suffix and place; null is unsupported, which is not a skip."""
    name, p = file_name(path), parts(path)
    by_suffix = _lookup(LANGUAGES, F.regexp_extract(name, r"[^/](\.[^.]+)$", 1))
    workflow = (F.size(p) >= 3) & (F.lower(p[0]) == ".github") & (F.lower(p[1]) == "workflows")
    return (
        F.when((name == ".env") | name.startswith(".env."), "text")
        .when(_lookup(NAMES, name).isNotNull(), _lookup(NAMES, name))
        .when((by_suffix == "yaml") & workflow, "github-actions")
        .otherwise(by_suffix)
    )


def in_ignored_directory(path: Column) -> Column:
    return F.arrays_overlap(directories(path), F.array(*[F.lit(d) for d in IGNORED_DIRECTORIES]))


def roles(path: Column, language: Column) -> dict[str, Column]:
    """Which scanners apply to a file."""
    name, dirs = file_name(path), directories(path)

    def inside(*names: str) -> Column:
        return F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names]))

    return {
        "is_prompt": name.isin(PROMPT_FILES) | name.contains("prompt") | inside("prompts", "skills"),
        "is_component": name.isin(COMPONENT_FILES) | inside("plugins", "skills"),
        "is_sensitive": F.coalesce(language.isin(SENSITIVE_LANGUAGES), F.lit(False)) | name.isin(SENSITIVE_FILES) | inside("plugins", "prompts", "skills"),
        "is_installer": name.isin(INSTALL_FILES),
        "is_manifest": name.isin(MANIFESTS),
    }


def unsafe_member_path(name: Column) -> Column:
    """Whether an archive member's name may not be extracted; null is unsafe."""
    p = F.filter(parts(name), lambda x: (x != "") & (x != "."))
    bad = F.exists(
        p,
        lambda x: (x == "..") | (F.length(x) > 255) | x.rlike(r"[ .]\z") | x.contains(":") | x.rlike(r"[\x00-\x1F\x7F]") | x.rlike(r"(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\.|\z)"),
    )
    return F.coalesce((name == "") | name.contains("\x00") | (F.length(name) > 4096) | name.rlike(r"^[/\\]") | name.rlike(r"^[A-Za-z]:") | (F.size(p) == 0) | bad, F.lit(True))


def repository_of(url: Column) -> Column:
    """owner/name of a repository address, or null."""
    owner = F.regexp_extract(url, r"^(?i:https)://(?i:github\.com)/([A-Za-z0-9_.-]{1,100})/([A-Za-z0-9_.-]{1,104}?)(?:\.git)?/?\z", 1)
    name = F.regexp_extract(url, r"^(?i:https)://(?i:github\.com)/([A-Za-z0-9_.-]{1,100})/([A-Za-z0-9_.-]{1,104}?)(?:\.git)?/?\z", 2)
    good = (owner != "") & (name != "") & ~owner.isin(".", "..") & ~name.isin(".", "..") & (F.length(name) <= 100)
    return F.when(good, F.concat_ws("/", owner, name))


def classify_target(target: Column) -> Column:
    """github, invalid_github, archive, file, unsupported_binary, unsupported_file or invalid_target."""
    value = F.trim(target)
    name = file_name(value)

    def ends(suffixes: list[str]) -> Column:
        return name.rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + r")\z")

    return (
        F.when(F.coalesce(value, F.lit("")) == "", "invalid_target")
        .when(repository_of(value).isNotNull(), "github")
        .when(F.lower(value).rlike("^https?://"), "invalid_github")
        .when(ends(ARCHIVES), "archive")
        .when(detect_language(value).isNotNull(), "file")
        .when(ends(BINARIES), "unsupported_binary")
        .otherwise("unsupported_file")
    )
