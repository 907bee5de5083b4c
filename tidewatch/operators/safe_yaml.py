"""A YAML reader with bounds, for texts of strangers: strings, lists and mappings only.

The bounds are checked on the stream of parse events, before anything is built: what an anchor stands for is measured once,
and every alias counts as much, so a document that would unfold without end is refused. It is used inside tasks and for
rule packs, and imports PyYAML where it is called.
"""

from __future__ import annotations

import re

# Limits of a document.
MAX_ALIASES, MAX_NODES, MAX_DEPTH = 50, 50_000, 100


#: What libyaml and PyYAML's own reader take differently: tabs, marks of byte order, unknown directives, a comment right behind
#: the sign of a block, an empty key in brackets.
_OWN_READER = re.compile(r"[\t\ufeff]|(?:\A|[\n\r\x85\u2028\u2029])%|[|>][-+0-9]*#|\?\s+[^\w\s]")


class YamlFault(ValueError):
    """The text is no YAML, or goes beyond a limit."""


def _loader(text: str) -> type:
    """libyaml's reader, some ten times faster, where it is there and gives the same; else PyYAML's own."""
    import yaml

    return yaml.BaseLoader if _OWN_READER.search(text) else getattr(yaml, "CBaseLoader", yaml.BaseLoader)


def _measure(text: str, loader: type) -> None:
    import yaml

    known: dict[str, tuple[int, int]] = {}
    # Open collections as [nodes so far, height so far, anchor]; the first stands for the document.
    open_: list[list] = [[0, 0, None]]
    aliases = 0

    def put(nodes: int, height: int, anchor: str | None) -> None:
        if anchor is not None:
            known[anchor] = (nodes, height)
        top = open_[-1]
        top[0] += nodes
        top[1] = max(top[1], height)
        if top[0] > MAX_NODES or len(open_) - 1 + height > MAX_DEPTH:
            raise YamlFault("too large or too deep")

    for event in yaml.parse(text, Loader=loader):
        if getattr(event, "tag", None) is not None:
            raise YamlFault("tags are not allowed")
        if isinstance(event, yaml.AliasEvent):
            aliases += 1
            if aliases > MAX_ALIASES:
                raise YamlFault("too many aliases")
            put(*known.get(event.anchor, (1, 1)), None)
        elif isinstance(event, yaml.ScalarEvent):
            put(1, 1, event.anchor)
        elif isinstance(event, yaml.CollectionStartEvent):
            open_.append([1, 0, event.anchor])
        elif isinstance(event, yaml.CollectionEndEvent):
            nodes, height, anchor = open_.pop()
            put(nodes, height + 1, anchor)


def read_yaml(text: str) -> object:
    """The document; YamlFault if it can't be read within the limits."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML on driver and executors") from e
    try:
        loader = _loader(text)
        _measure(text, loader)
        return yaml.load(text, Loader=loader)
    except (yaml.YAMLError, RecursionError) as e:
        raise YamlFault(f"no YAML: {type(e).__name__}") from e
