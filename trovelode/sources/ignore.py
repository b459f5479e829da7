"""Ignore files of source trees: patterns compiled to expressions, the last that matches a path decides."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Rule:
    expression: str
    negated: bool


def _glob(pattern: str) -> str:
    """A glob as a regular expression that Python and Java read alike."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out)


def compile_rules(text: str) -> list[Rule]:
    """Rules of one ignore file, in order: ``#`` comments, ``!`` negation, leading ``/`` anchors, trailing ``/`` directories."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r\n"))
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line[1:] if line.startswith(("\\#", "\\!")) else line
        directory = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = _glob(line.lstrip("/"))
        head = "" if anchored else "(?:.*/)?"
        tail = "/.*" if directory else "(?:/.*)?"
        if body:
            rules.append(Rule(f"^{head}{body}{tail}$", negated))
    return rules


def nested(text: str, directory: str, git_semantics: bool = False) -> str:
    """An ignore file of a subdirectory, rewritten for the root.

    Each pattern gets the directory before it, which anchors it there; with ``git_semantics`` a pattern without a slash
    matches at any depth below the directory, as git has it.
    """
    out = []
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        sign, bare = ("!", bare[1:]) if bare.startswith("!") else ("", bare)
        deep = git_semantics and "/" not in bare.rstrip("/")
        out.append(f"{sign}{directory}/{'**/' if deep else ''}{bare.lstrip('/')}")
    return "\n".join(out)


def load_rules(root_ignore: str = "", own_ignore: str = "", below: dict[str, str] | None = None, git_semantics: bool = False) -> list[Rule]:
    """Rules of a tree: the root's file, those of subdirectories (directory -> text), then the index's own."""
    rules = compile_rules(root_ignore + "\n.gitignore")
    for directory in sorted(below or {}):
        rules += compile_rules(nested(below[directory], directory, git_semantics))
    return rules + compile_rules(own_ignore)


def is_ignored(path: str, rules: list[Rule]) -> bool:
    found = False
    for rule in rules:
        if re.match(rule.expression, path):
            found = not rule.negated
    return found


def ignored(path: Column, rules: list[Rule]) -> Column:
    """The same as a column expression, without Python: rules of one sign that follow each other are one pattern, and the
    last pattern that matches decides."""
    decision = F.lit(False)
    for negated, run in groupby(rules, key=lambda rule: rule.negated):
        pattern = "|".join(f"(?:{rule.expression})" for rule in run)
        decision = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(decision)
    return decision
