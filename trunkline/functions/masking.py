"""Masking of sensitive text, and message patterns, as Column expressions."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STARS = "******"
#: Patterns of sensitive content (fixed values).
PASSWORD = r"(?i)(password\s*[=:]\s*)[^\s,;]+"
MOBILE = r"(?<!\d)(1[3-9]\d)\d{4}(\d{4})(?!\d)"
EMAIL = r"(?:([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,63}|[A-Za-z0-9._%+-])@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"
CONTENT_RULES = {"password": (PASSWORD, "$1" + STARS), "mobile": (MOBILE, "$1****$2"), "email": (EMAIL, "$1***@$2")}


def mask_content(text: Column, rules: list[str]) -> Column:
    """Rules in their order; unknown names don't count."""
    for rule in rules:
        if rule.lower() in CONTENT_RULES:
            text = F.regexp_replace(text, *CONTENT_RULES[rule.lower()])
    return text


def _mobile(v: Column) -> Column:
    return F.when(F.length(v) < 7, F.lit(STARS)).otherwise(F.concat(F.substring(v, 1, 3), F.lit("****"), F.right(v, F.lit(4))))


def _email(v: Column) -> Column:
    at = F.instr(v, F.lit("@"))
    return F.when(at <= 2, F.lit("***")).otherwise(F.concat(F.substring(v, 1, 1), F.lit("***"), F.substr(v, at)))


def _partial(v: Column) -> Column:
    return F.when(F.length(v) <= 4, F.lit("****")).otherwise(F.concat(F.substring(v, 1, 2), F.lit("****"), F.right(v, F.lit(2))))


VARIABLE_RULES = {"password": lambda v: F.lit(STARS), "mobile": _mobile, "email": _email, "partial": _partial}


def mask_variable(name: str, value: Column, rules: dict[str, str]) -> Column:
    """Null is empty; empty stays; a variable without a known rule is unchanged."""
    value = F.coalesce(value, F.lit(""))
    rule = VARIABLE_RULES.get((rules.get(name) or "").lower())
    return value if rule is None else F.when(value == "", value).otherwise(rule(value))


TOKEN = re.compile(r"%(message|msg|logger|context|thread|env\{([^}]*)\}|var\{([^}]*)\})")


def placeholder(text: str) -> tuple[str, str]:
    name, _, default = text.partition(":-")
    return name, default


def render_pattern(pattern: str, message: Column, logger: Column, thread: Column, variables: Column, content_rules: list[str] = (), variable_rules: dict | None = None, environ: dict | None = None) -> Column:
    """The pattern's tokens replaced; content rules hold for the message and again for the whole body."""
    environ = os.environ if environ is None else environ
    variable_rules = variable_rules or {}
    parts, at = [], 0
    for m in TOKEN.finditer(pattern):
        if m.start() > at:
            parts.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        kind = m.group(1)
        if kind in ("message", "msg"):
            parts.append(mask_content(F.coalesce(message, F.lit("")), list(content_rules)))
        elif kind == "logger":
            parts.append(F.coalesce(logger, F.lit("")))
        elif kind in ("context", "thread"):
            parts.append(F.coalesce(thread, F.lit("")))
        elif m.group(2) is not None:
            name, default = placeholder(m.group(2))
            parts.append(mask_variable(name, F.lit(environ.get(name, default)), variable_rules))
        else:
            name, default = placeholder(m.group(3))
            parts.append(mask_variable(name, F.coalesce(F.element_at(variables, F.lit(name)), F.lit(default)), variable_rules))
    if at < len(pattern):
        parts.append(F.lit(pattern[at:]))
    return mask_content(F.concat(*parts) if parts else F.lit(""), list(content_rules))


def context_put(variables: Column, key: str, value: str | None) -> Column:
    """A null value removes the key; a null key is an error."""
    if key is None:
        raise ValueError("a context key may not be null")
    rest = F.map_filter(variables, lambda k, v: k != key)
    return rest if value is None else F.map_concat(rest, F.create_map(F.lit(key), F.lit(value)))


def context_remove(variables: Column, key: str | None) -> Column:
    return variables if key is None else F.map_filter(variables, lambda k, v: k != key)


def context_clear() -> Column:
    return F.create_map().cast("map<string,string>")


def split_by_level_path(path: str, level: Column) -> Column:
    """``%level`` replaced, or ``-level`` before the extension, or at the end."""
    low = F.lower(level)
    if "%level" in path:
        pieces = path.split("%level")
        return F.concat(*[x for i, p in enumerate(pieces) for x in ([low] if i else []) + [F.lit(p)]])
    stem, dot, ext = path.rpartition(".")
    return F.concat(F.lit(stem + "-"), low, F.lit("." + ext)) if dot and "/" not in ext and stem else F.concat(F.lit(path + "-"), low)


def archive_name(path: Column, index: Column) -> Column:
    return F.when(F.contains(path, F.lit("%i")), F.replace(path, F.lit("%i"), index.cast("string"))).otherwise(F.concat(path, F.lit("."), index.cast("string")))
