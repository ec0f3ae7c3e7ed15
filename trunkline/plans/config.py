"""Logging configuration: root level, appenders, masking rules; from YAML or properties text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from trunkline.schema import DEFAULT_PATTERN, LEVEL_ALIASES, LEVELS
from trunkline.sources.codec import codec_by_name

UNITS = {"": 1, "B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}
APPENDERS = (
    "name string, type string, level string, pattern string, target string, file_name string, file_pattern string, format string, "
    "compression string, trunk_size_kb int, split_by_level boolean, max_file_size_bytes long, max_archived_files int"
)


@dataclass(frozen=True)
class Appender:
    name: str
    type: str
    level: str = "TRACE"
    pattern: str = DEFAULT_PATTERN
    target: str | None = None
    file_name: str | None = None
    file_pattern: str | None = None
    format: str | None = None
    compression: str | None = None
    trunk_size_kb: int = 0
    split_by_level: bool = False
    max_file_size_bytes: int = 0
    max_archived_files: int = 0


@dataclass(frozen=True)
class LogConfig:
    level: str
    root: tuple[str, ...]
    appenders: dict[str, Appender] = field(default_factory=dict)
    content_rules: tuple[str, ...] = ()
    variable_rules: dict[str, str] = field(default_factory=dict)

    def appenders_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(vars(self.appenders[n]).values()) for n in self.root], APPENDERS)

    def masking_table(self, spark: SparkSession) -> DataFrame:
        rows = [("content", None, r) for r in self.content_rules] + [("variable", n, r) for n, r in self.variable_rules.items()]
        return spark.createDataFrame(rows, "kind string, variable string, rule string")


def size_bytes(text: object) -> int:
    """``1MB`` is 1048576; nothing is 0."""
    text = str(text or "").strip().upper()
    found = re.fullmatch(r"(\d+)\s*([KMG]?B?)", text)
    if text and (not found or found[2] not in UNITS):
        raise ValueError(f"not a size: {text}")
    return int(found[1]) * UNITS[found[2]] if found else 0


def _one_of(value: object, allowed: dict[str, str], what: str) -> str:
    key = str(value or "").strip().upper()
    if key not in allowed:
        raise ValueError(f"unknown {what}: {value}")
    return allowed[key]


def _listed(value: object) -> tuple[str, ...]:
    items = value if isinstance(value, list) else str(value or "").split(",")
    return tuple(x for x in (str(i).strip() for i in items) if x)


def _section(node: dict, key: str) -> dict:
    got = node.get(key)
    return got if isinstance(got, dict) else {}


LEVEL_NAMES = {n: n for n in LEVELS} | LEVEL_ALIASES


def _appender(name: str, node: dict) -> Appender:
    kind = _one_of(node.get("type"), {"CONSOLE": "console", "FILE": "file"}, "appender type")
    common = {"name": name, "type": kind, "level": _one_of(node.get("level", "TRACE"), LEVEL_NAMES, "level"), "pattern": str(node.get("pattern", DEFAULT_PATTERN))}
    if kind == "console":
        return Appender(**common, target=_one_of(node.get("target", "SYSTEM_OUT"), {"SYSTEM_OUT": "SYSTEM_OUT", "SYSTEM_ERR": "SYSTEM_ERR"}, "target"))
    if not str(node.get("fileName") or "").strip():
        raise ValueError(f"file appender {name} needs a fileName")
    return Appender(
        **common,
        file_name=str(node["fileName"]),
        file_pattern=node.get("filePattern"),
        format=_one_of(node.get("format", "text"), {"TEXT": "text", "TOG": "tog"}, "format"),
        compression=codec_by_name(str(node.get("compression", "gzip"))),
        trunk_size_kb=min(65_535, max(1, int(node.get("trunkSizeKb", 512)))),
        split_by_level=str(node.get("splitByLevel", False)).strip().lower() == "true",
        max_file_size_bytes=size_bytes(_section(_section(node, "policies"), "size").get("size")),
        max_archived_files=int(_section(node, "strategy").get("max", 5)),
    )


def from_tree(tree: dict, top: str) -> LogConfig:
    """``top`` is the key that holds root, appenders and masking."""
    node = _section(tree, top)
    root, masking = _section(node, "root"), _section(node, "masking")
    appenders = {n: _appender(n, a) for n, a in _section(node, "appenders").items() if isinstance(a, dict)}
    if not appenders:
        raise ValueError("no appender is configured")
    names = _listed(root.get("appenders")) or tuple(appenders)
    for n in names:
        if n not in appenders:
            raise ValueError(f"the root names an unknown appender: {n}")
    content = tuple(dict.fromkeys(r.lower() for r in _listed(masking.get("contentRules"))))
    variable = {k: str(v or "").lower() for k, v in _section(masking, "variableRules").items()}
    return LogConfig(_one_of(root.get("level", "INFO"), LEVEL_NAMES, "level"), names, appenders, content, variable)


def from_yaml(text: str, top: str) -> LogConfig:
    import yaml

    return from_tree(yaml.safe_load(text) or {}, top)


def from_properties(text: str, top: str) -> LogConfig:
    """``<top>.root.*``, ``<top>.appender.<name>.*``, ``<top>.masking.*``; other keys don't count."""
    tree: dict = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#!":
            continue
        key, _, value = (x.strip() for x in re.split(r"([=:])", line, maxsplit=1)) if re.search("[=:]", line) else (line, "", "")
        path = key.split(".")
        if path[0] != top or len(path) < 3:
            continue
        if path[1] == "appender":
            if len(path) < 4:
                raise ValueError(f"not an appender property: {key}")
            path[1] = "appenders"
        at = tree
        for step in path[:-1]:
            at = at.setdefault(step, {})
            if not isinstance(at, dict):
                raise ValueError(f"{key}: a value stands where a section is needed")
        at[path[-1]] = value
    return from_tree(tree, top)
