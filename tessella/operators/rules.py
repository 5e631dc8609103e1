"""Saved mappings: rule lines whose expressions are Spark SQL.

A text names a profile and, line by line, paths with values:

    Instance: concat('p', c_custkey)
    InstanceOf: Patient
    * active = c_acctbal > 0
    * name
      * family = c_name
      * given = array(c_phone)
    * identifier[mrn].value = cast(c_custkey as string)
    * (split(c_comment, ' ')).address
      * text = it

Lines are only taken apart here; every expression goes to Spark's own parser, so a saved
mapping becomes part of the plan like one written in Python.  A child is indented by two
blanks more than its parent.  In the children of a context rule ``it`` is the value.
``$name`` stands for a bound constant, ``//`` begins a comment at a line's start or after
a blank.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping as Names

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.resource import Profile, Resource

_RULE = re.compile(r"\*\s*(?:\((?P<context>.*)\)\.)?(?P<path>[A-Za-z_][\w.\[\]-]*)\s*(?:=\s*(?P<value>.*))?$")
_SLICE = re.compile(r"(?P<path>\w+)\[(?P<name>[\w-]+)\](?:\.(?P<rest>.+))?$")
_STRING = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")""")


class RuleError(ValueError):
    """A line that isn't a rule; its number and text are part of the message."""


def _lines(text: str):
    """(number, indent, line) of what isn't blank or a comment."""
    for number, line in enumerate(text.splitlines(), 1):
        bare = re.sub(r"(^|\s)//.*$", "", line).rstrip()
        if bare.strip():
            yield number, len(bare) - len(bare.lstrip()), bare.strip()


def bound_sql(expression: str, bindings: Names[str, object]) -> str:
    """An expression with ``$name`` outside of quotes replaced by the bound constant."""

    def constant(match: re.Match) -> str:
        name = match[1]
        if name not in bindings:
            raise RuleError(f"${name} is not bound")
        value = bindings[name]
        if isinstance(value, bool) or value is None:
            return str(value).lower() if value is not None else "null"
        if isinstance(value, (int, float)):
            return repr(value)
        if not isinstance(value, str):
            raise RuleError(f"${name} is no constant")
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    parts = _STRING.split(expression)
    return "".join(p if i % 2 else re.sub(r"\$(\w+)", constant, p) for i, p in enumerate(parts))


def rule_mapping(text: str, profiles: Names[str, Profile]) -> Callable[[DataFrame, Names[str, object]], Resource]:
    """A mapping from its text; ``profiles`` by type, id or canonical url."""
    profile, instance, rules = None, None, []
    base = None
    for number, indent, line in _lines(text):
        base = indent if base is None else base
        head = re.match(r"(InstanceOf|Instance):\s*(.+)$", line)
        if head and head[1] == "Instance":
            instance = head[2]
        elif head:
            if head[2] not in profiles:
                raise RuleError(f"line {number}: unknown profile {head[2]}")
            profile = profiles[head[2]]
        elif rule := _RULE.match(line):
            rules.append((number, (indent - base) // 2, rule["context"], rule["path"], rule["value"]))
        else:
            raise RuleError(f"line {number} is not a rule: {line}")
    if profile is None:
        raise RuleError("the text has no InstanceOf line")

    def mapping(docs: DataFrame, bindings: Names[str, object]) -> Resource:
        sql = lambda e: bound_sql(e, bindings)
        made = Resource(profile, None if instance is None else F.expr(sql(instance)))
        parents: list[str] = []
        slices: dict[str, dict[str, Column]] = {}
        i = 0
        while i < len(rules):
            number, depth, context, path, value = rules[i]
            i += 1
            if depth > len(parents):
                raise RuleError(f"line {number} has no parent")
            whole = ".".join([*parents[:depth], path])
            if context is not None:
                children = []
                while i < len(rules) and rules[i][1] > depth:
                    child = rules[i]
                    if child[1] != depth + 1 or child[2] is not None or child[4] is None or "." in child[3] or "[" in child[3]:
                        raise RuleError(f"line {child[0]}: children of a context rule are plain assignments")
                    children.append(f"'{child[3]}', {sql(child[4])}")
                    i += 1
                item = f"named_struct({', '.join(children)})" if children else sql(value or "it")
                made.many(whole, F.expr(f"transform(filter({sql(context)}, it -> it is not null), it -> {item})"))
                continue
            parents = [*parents[:depth], path]
            part = _SLICE.match(whole)
            if part:
                key = f"{part['path']}[{part['name']}]"
                if key not in slices:
                    slices[key] = {}
                if value is not None:
                    slices[key][part["rest"].replace(".", "__")] = F.expr(sql(value))
                last = i == len(rules) or not ".".join([*parents[: rules[i][1]], rules[i][3]]).startswith(key)
                if last:
                    made.slice(part["path"], part["name"], **slices.pop(key))
            elif value is not None:
                made.assign(whole, F.expr(sql(value)))
        return made

    return mapping
