"""Definitions in source text: where they begin and end, of what kind, and under which name.

There is no syntax-tree library here, so each family of languages has a light extractor: brackets are matched over a stream of
strings, comments and braces; indentation gives the blocks of Python; ``end`` at the same indentation those of Ruby, Lua and
Elixir; headings, sections and top-level keys those of Markdown, TOML and YAML. Names are only resolved for TypeScript and
GraphQL, as in the engine's data model. A tree-based extractor can replace :func:`extract` without touching the assembly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from trovelode import config


@dataclass(frozen=True)
class Node:
    """A definition; rows count from 0. ``comment``: the first row of the comments right before it."""

    start: int
    end: int
    kind: str
    symbol: str = ""
    scope: str = ""
    comment: int | None = None


def extension_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name[1:] else ""


_S = r"^[ \t]*(?:(?:export|default|declare|public|private|protected|internal|static|final|abstract|async|override|readonly|sealed|pub(?:\([^)\n]*\))?|unsafe|open|data|suspend|inline|virtual|extern|partial|strictfp|synchronized)\s+)*"
_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_NO = r"(?!(?:if|for|while|switch|catch|return|else|new|do|try|throw|await|sizeof|function|match|foreach|elseif)\b)"

#: What opens a definition in each language of the brace family, with its kind. ``§`` stands for a list of
#: parameters in brackets, of any length and depth.
_BRACE: dict[str, list[tuple[str, str]]] = {
    "ts": [
        (_S + r"function\*?\s+" + _NAME, "function"),
        (_S + r"(?:abstract\s+)?class\s+" + _NAME, "class"),
        (_S + r"interface\s+" + _NAME, "interface"),
        (_S + r"(?:const\s+)?enum\s+" + _NAME, "enum"),
        (_S + r"type\s+" + _NAME + r"[^=\n]*=\s*(?=\{)", "type"),
        (_S + r"namespace\s+(?P<name>[\w.]+)", "namespace"),
        (_S + r"module\s+(?P<name>[\w.'\"]+)", "module"),
        (_S + r"(?:const|let|var)\s+" + _NAME + r"[^=\n]*=\s*(?:async\s*)?(?:function\b|\w+\s*=>)", "function"),
        (_S + r"(?:const|let|var)\s+" + _NAME + r"[^=\n]*=\s*(?:async\s*)?§\s*(?::[^=\n]+)?=>", "function"),
        (_S + r"(?:get\s+|set\s+)?" + _NO + _NAME + r"\s*(?:<[^>\n]*>)?§\s*(?::[^;{=]+)?(?=\{)", "method"),
    ],
    "js": [
        (_S + r"function\*?\s+" + _NAME, "function"),
        (_S + r"class\s+" + _NAME, "class"),
        (_S + r"(?:const|let|var)\s+" + _NAME + r"\s*=\s*(?:async\s*)?(?:function\b|\w+\s*=>)", "function"),
        (_S + r"(?:const|let|var)\s+" + _NAME + r"\s*=\s*(?:async\s*)?§\s*=>", "function"),
        (r"^[ \t]*(?:[\w$]+\.)+" + _NAME + r"\s*=\s*(?:async\s*)?function\b", "function"),
        (r"^[ \t]*(?:[\w$]+\.)+" + _NAME + r"\s*=\s*(?:async\s*)?§\s*=>", "function"),
        (_S + r"(?:get\s+|set\s+)?" + _NO + _NAME + r"§\s*(?=\{)", "method"),
    ],
    "java": [
        (_S + r"(?:class|record)\s+" + _NAME, "class"),
        (_S + r"@?interface\s+" + _NAME, "interface"),
        (_S + r"enum\s+" + _NAME, "enum"),
        (_S + r"(?:<[^>\n]*>\s*)?[\w$.<>\[\],? ]+?\s+" + _NO + _NAME + r"\s*§\s*(?:throws\s+[\w.,\s]+)?(?=\{)", "method"),
        (r"^[ \t]*(?:public|private|protected)\s+" + _NAME + r"\s*§\s*(?=\{)", "class"),
    ],
    "go": [
        (r"^func\s+" + _NAME, "function"),
        (r"^func\s+\([^)\n]*\)\s*" + _NAME, "method"),
        (r"^type\s+" + _NAME + r"\s+(?:struct|interface)\s*(?=\{)", "type"),
    ],
    "rs": [
        (_S + r"(?:const\s+)?fn\s+" + _NAME, "function"),
        (_S + r"struct\s+" + _NAME + r"", "class"),
        (_S + r"enum\s+" + _NAME, "enum"),
        (_S + r"impl\b", "fallback"),
        (_S + r"mod\s+" + _NAME + r"\s*(?=\{)", "fallback"),
    ],
    "c": [
        (r"^(?:typedef\s+)?struct\s+" + _NAME + r"\s*(?=\{)", "class"),
        (r"^(?:typedef\s+)?enum\s+" + _NAME + r"\s*(?=\{)", "enum"),
        (r"^(?!(?:return|else|typedef|case|goto)\b)[A-Za-z_][\w \t*]*?[ \t*]" + _NO + _NAME + r"\s*§\s*(?=\{)", "function"),
    ],
    "cpp": [
        (r"^[ \t]*namespace\s+(?P<name>[\w:]+)", "namespace"),
        (r"^[ \t]*(?:class|struct)\s+" + _NAME + r"", "class"),
        (r"^[ \t]*(?!(?:return|else|typedef|case|goto)\b)[A-Za-z_][\w:<>, \t*&]*?[ \t*&]" + _NO + r"(?P<name>[\w:~]+)\s*§[\w\s]*(?=\{)", "function"),
    ],
    "cs": [
        (_S + r"namespace\s+(?P<name>[\w.]+)\s*(?=\{)", "namespace"),
        (_S + r"(?:class|struct|record)\s+" + _NAME, "class"),
        (_S + r"interface\s+" + _NAME, "interface"),
        (_S + r"enum\s+" + _NAME, "enum"),
        (_S + r"[\w.<>\[\],? ]+?\s+" + _NO + _NAME + r"\s*§\s*(?=\{)", "method"),
    ],
    "php": [
        (_S + r"class\s+" + _NAME, "class"),
        (_S + r"interface\s+" + _NAME, "interface"),
        (_S + r"trait\s+" + _NAME, "interface"),
        (_S + r"enum\s+" + _NAME, "enum"),
        (r"^function\s+&?" + _NAME, "function"),
        (r"^[ \t]+(?:(?:public|private|protected|static|final)\s+)*function\s+&?" + _NAME, "method"),
    ],
    "kt": [
        (_S + r"(?:class|object)\s+" + _NAME + r"", "class"),
        (_S + r"interface\s+" + _NAME, "interface"),
        (_S + r"fun\s+(?:<[^>\n]*>\s*)?(?:[\w<>]+\.)?" + _NAME + r"\s*§[^={\n]*(?=\{)", "function"),
    ],
    "swift": [
        (_S + r"(?:class|struct|actor)\s+" + _NAME, "class"),
        (_S + r"protocol\s+" + _NAME, "interface"),
        (_S + r"enum\s+" + _NAME, "enum"),
        (_S + r"extension\s+" + _NAME, "fallback"),
        (_S + r"func\s+" + _NAME, "function"),
    ],
    "scala": [
        (_S + r"(?:case\s+)?(?:class|object)\s+" + _NAME + r"", "class"),
        (_S + r"trait\s+" + _NAME, "interface"),
        (_S + r"def\s+" + _NAME + r"[^={\n]*=?\s*(?=\{)", "function"),
    ],
    "vala": [
        (_S + r"namespace\s+(?P<name>[\w.]+)", "namespace"),
        (_S + r"(?:class|struct)\s+" + _NAME, "class"),
        (_S + r"interface\s+" + _NAME, "interface"),
        (_S + r"(?:enum|errordomain)\s+" + _NAME, "enum"),
        (_S + r"[\w.<>\[\]?]+\s+" + _NO + _NAME + r"\s*§\s*(?=\{)", "method"),
    ],
    "zig": [(_S + r"fn\s+" + _NAME, "function"), (_S + r"const\s+" + _NAME + r"\s*=\s*(?:struct|enum|union)", "type")],
    "css": [(r"^@media", "fallback"), (r"^@keyframes", "fallback"), (r"^[^\s@/}]", "fallback")],
    "sh": [(r"^[ \t]*(?:function\s+)?(?P<name>[\w:-]+)\s*\(\s*\)\s*(?=\{)", "function")],
    "graphql": [
        (r"^(?:extend\s+)?(?:type|input|union|scalar)\s+" + _NAME, "type"),
        (r"^(?:extend\s+)?interface\s+" + _NAME, "interface"),
        (r"^(?:extend\s+)?enum\s+" + _NAME, "enum"),
        (r"^(?:query|mutation|subscription|fragment)\s+" + _NAME, "function"),
        (r"^(?:extend\s+)?schema\b", "module"),
    ],
}
_SAME = {"tsx": "ts", "jsx": "js", "h": "c", "hpp": "cpp", "vapi": "vala"}
_NAMED = {"ts", "tsx", "graphql"}
_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[{}();]", re.S)
_HASH_TOKEN = re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\])*\"|'[^']*'|[{}();]", re.S)


def _compiled(source: str) -> tuple[re.Pattern, re.Pattern | None]:
    """A head, and what follows its parameters."""
    head, parameters, tail = source.partition("§")
    return re.compile(head + r"\(" if parameters else head, re.M), re.compile(tail, re.M) if parameters else None


_COMPILED = {name: [(*_compiled(p), kind) for p, kind in rules] for name, rules in _BRACE.items()}


def _row_of(content: str) -> list[int]:
    """Starts of the lines."""
    starts = [0]
    for m in re.finditer("\n", content):
        starts.append(m.end())
    return starts


def _braces(language: str, content: str, lines: list[str]) -> list[Node]:
    from bisect import bisect_right

    tokens = (_HASH_TOKEN if language == "sh" else _TOKEN).finditer(content)
    closing: dict[int, int] = {}
    rounds: dict[int, int] = {}
    stops: list[int] = []  # semicolons outside round brackets
    opens: list[tuple[str, int]] = []
    quiet: list[tuple[int, int]] = []
    for m in tokens:
        token = m.group()
        if token in "{(":
            opens.append((token, m.start()))
        elif token == "}":
            while opens and opens[-1][0] == "(":  # one that never closes
                opens.pop()
            if opens:
                closing[opens.pop()[1]] = m.start()
        elif token == ")":
            if opens and opens[-1][0] == "(":
                rounds[opens.pop()[1]] = m.end()
        elif token == ";":
            if not opens or opens[-1][0] == "{":
                stops.append(m.start())
        else:
            quiet.append(m.span())
    starts = _row_of(content)
    places = sorted(closing)
    row = lambda at: bisect_right(starts, at) - 1
    quiet_starts = [a for a, _ in quiet]
    nodes: dict[tuple[int, int], Node] = {}
    for pattern, tail, kind in _COMPILED[language]:
        taken = -1
        for m in pattern.finditer(content):
            begin = m.start() + len(m.group()) - len(m.group().lstrip())
            i = bisect_right(quiet_starts, begin) - 1
            if i >= 0 and quiet[i][1] > begin:
                continue  # inside a string or comment
            end = m.end()
            if tail is not None:
                after = rounds.get(end - 1)
                found = tail.match(content, after) if after is not None else None
                if found is None:
                    continue
                end = found.end()
            j = bisect_right(places, end - 1)
            if j >= len(places) or places[j] == taken:
                continue  # a selector over several lines begins once
            brace = places[j]
            stop = bisect_right(stops, end - 1)
            if stop < len(stops) and stops[stop] < brace:
                continue  # a declaration without body
            taken = brace
            name = m.groupdict().get("name") or ""
            key = (row(begin), row(closing[brace]))
            nodes.setdefault(key, Node(key[0], key[1], kind, name.strip("'\"")))
    return sorted(nodes.values(), key=lambda n: (n.start, -n.end))


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def _python(lines: list[str]) -> list[Node]:
    head = re.compile(r"[ \t]*(?:async[ \t]+)?(def|class)[ \t]+(\w+)")
    nodes, open_, last, brackets = [], [], 0, 0
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        depth = _indent(line)
        while open_ and brackets <= 0 and depth <= open_[-1][0]:
            nodes.append((*open_.pop(), last))
        m = head.match(line) if brackets <= 0 else None
        if m:
            start, decorated = i, False
            while start and lines[start - 1].lstrip().startswith("@") and _indent(lines[start - 1]) == depth:
                start, decorated = start - 1, True
            kind = "fallback" if decorated else "class" if m.group(1) == "class" else "function"
            open_.append((depth, start, kind, m.group(2)))
            brackets = 0
        if m or brackets > 0:  # a head may go on over several lines
            brackets += line.count("(") - line.count(")")
        last = i
    nodes += [(*block, last) for block in reversed(open_)]
    return sorted((Node(start, end, kind, name) for _, start, kind, name, end in nodes), key=lambda n: (n.start, -n.end))


def _paired(lines: list[str], head: re.Pattern, close: re.Pattern, make) -> list[Node]:
    """Blocks from a line that ``head`` matches to the next one that ``close`` matches, of the same name (the group ``tag``
    of both, if they have it) and indentation; each line is looked at once."""
    open_: dict[tuple[str, int], list[tuple[int, re.Match]]] = {}
    nodes = []
    for i, line in enumerate(lines):
        m = head.match(line)
        if m:
            open_.setdefault(((m.groupdict().get("tag") or "").lower(), _indent(line)), []).append((i, m))
        m = close.search(line)
        if m:
            waiting = open_.get(((m.groupdict().get("tag") or "").lower(), _indent(line)))
            if waiting:
                start, opening = waiting.pop()
                nodes.append(make(start, i, opening))
    return sorted(nodes, key=lambda n: (n.start, -n.end))


def _ended(lines: list[str], head: str, kinds: dict[str, str]) -> list[Node]:
    """Blocks that ``end`` closes at the indentation of their first line."""
    make = lambda a, b, m: Node(a, b, kinds[m.group("word")], m.groupdict().get("name") or "")
    return _paired(lines, re.compile(head), re.compile(r"^\s*end\b"), make)


def _sections(lines: list[str], head: str, kind: str) -> list[Node]:
    """From each line that the pattern matches to the line before the next."""
    rows = [i for i, line in enumerate(lines) if re.match(head, line)]
    nodes = []
    for a, b in zip(rows, [*rows[1:], len(lines)]):
        while b - 1 > a and not lines[b - 1].strip():
            b -= 1
        nodes.append(Node(a, b - 1, kind))
    return nodes


def _markup(lines: list[str], names: str, kind: str) -> list[Node]:
    """Elements that begin a line and end at the same indentation."""
    head = re.compile(rf"[ \t]*<(?P<tag>{names})\b", re.I)
    return _paired(lines, head, re.compile(rf"</(?P<tag>{names})\s*>", re.I), lambda a, b, m: Node(a, b, kind))


def _sql(lines: list[str]) -> list[Node]:
    kinds = {"table": "type", "view": "type", "type": "type", "index": "type", "trigger": "type", "sequence": "type", "function": "function", "procedure": "function", "schema": "namespace", "database": "module", "extension": "module"}
    nodes = []
    for i, line in enumerate(lines):
        m = re.match(r"\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|unique\s+|materialized\s+)*(\w+)\s+(?:if\s+not\s+exists\s+)?\"?([\w.]+)", line, re.I)
        if m and m.group(1).lower() in kinds:
            end = next((j for j in range(i, len(lines)) if lines[j].rstrip().endswith(";")), len(lines) - 1)
            nodes.append(Node(i, end, kinds[m.group(1).lower()], m.group(2)))
    return nodes


def _comment_start(lines: list[str], row: int) -> int | None:
    """First row of the comments before a row; blank lines between don't part them from it."""
    first, at = None, row - 1
    while at >= 0:
        line = lines[at].strip()
        if not line:
            at -= 1
        elif line.startswith(("//", "#", "--")) and not line.startswith(("#include", "#define", "#!", "#[")):
            first, at = at, at - 1
        elif line.endswith("*/"):
            top = at
            while top >= 0 and "/*" not in lines[top]:
                top -= 1
            if top < 0 or not lines[top].lstrip().startswith("/*"):
                break
            first, at = top, top - 1
        else:
            break
    return first


def extract(path: str, content: str, lines: list[str]) -> list[Node]:
    """The definitions of a file in order, with the names of those around each; none for unknown languages."""
    extension = extension_of(path)
    extension = config.ALIASES.get(extension, extension)
    language = _SAME.get(extension, extension)
    if language in _COMPILED:
        nodes = _braces(language, content, lines)
    elif language == "py":
        nodes = _python(lines)
    elif language == "rb":
        nodes = _ended(lines, r"[ \t]*(?P<word>def|class|module)\s+(?:self\.)?(?P<name>[\w:?!=]+)", {"def": "method", "class": "class", "module": "module"})
    elif language == "lua":
        nodes = _ended(lines, r"[ \t]*(?:local\s+)?(?P<word>function)\s+(?P<name>[\w.:]+)", {"function": "function"})
    elif language == "ex":
        nodes = _ended(lines, r"[ \t]*(?P<word>defmodule|defp?|defmacrop?)\s+(?P<name>[\w.?!]+)", {"defmodule": "module", "def": "function", "defp": "function", "defmacro": "function", "defmacrop": "function"})
    elif language in ("md", "markdown"):
        nodes = _sections(lines, r"#{1,6}\s", "fallback")
    elif language == "toml":
        nodes = _sections(lines, r"\[", "module")
    elif language == "yaml":
        nodes = _sections(lines, r"[\w\"'.-]+\s*:", "module")
    elif language in ("vue", "svelte"):
        nodes = _markup(lines, "script|template|style", "module")
    elif language in ("html", "htm"):
        nodes = _markup(lines, "[a-z][\\w-]*", "fallback")
    elif language == "sql":
        nodes = _sql(lines)
    else:
        return []
    placed = []
    for n, around in with_ancestors(nodes):
        scope = ".".join(o.symbol for o in around if o.symbol)
        placed.append(replace(n, scope=scope, symbol=n.symbol if extension in _NAMED else "", comment=_comment_start(lines, n.start) if language not in ("md", "markdown") else None))
    return placed


def with_ancestors(nodes: list[Node]):
    """Each node, by place, with those of strictly larger range around it, outermost first. One sweep with a stack."""
    stack: list[Node] = []
    for n in sorted(nodes, key=lambda n: (n.start, -n.end)):
        while stack and stack[-1].end < n.start:
            stack.pop()
        yield n, [o for o in stack if o.end >= n.end and (o.start, o.end) != (n.start, n.end)]
        stack.append(n)
