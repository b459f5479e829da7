"""Literal credentials in source code and configuration: finding them and making them unreadable.

A quick pattern marks the lines that could name one. Those are tokenized lexically (words, string literals, comments,
operators), with as many lines below as an assignment or call goes on for; the line of a finding is where its literal
begins. A literal counts if it is assigned or passed to a credential-named identifier, stands where a command, a URL, a
header or an account statement has its password, is told in a comment as a login, or has the form that issuers give their
keys. Placeholders, references to an environment or a store, results of calls, public keys, digests and identifiers
don't count. Private key blocks count once, at their first line.

Redacting replaces the characters of the literal by asterisks, one for one. Delimiters, escape sequences, line ends and
everything else stay, so the code keeps its form and offsets; redacting twice changes nothing.

Defined results: null contents have no credentials and stay null; a chunk delivered repeatedly counts once.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelode.tables import spread


class Finding(NamedTuple):
    """A credential: its line (from 1) and the ranges of its characters."""

    line: int
    kind: str
    spans: tuple[tuple[int, int], ...]


#: Words that end a credential's name, alone or as a pair.
_CREDENTIAL_WORDS = {
    "password", "passwd", "passphrase", "passcode", "pwd", "pw", "pass", "secret", "token", "apikey", "credential", "credentials",
    "secretkey", "accesskey", "privatekey", "authtoken", "accesstoken", "passwort", "kennwort", "contraseña", "clave", "psk",
}
_KEY_KINDS = {"api", "access", "private", "secret", "signing", "encryption", "auth", "master", "account", "shared", "deploy", "service", "client"}
#: Words after the credential's name that don't change what it is.
_TRAILING = {"value", "str", "string", "text", "prod", "production", "dev", "staging", "live", "old", "new", "current", "default", "raw", "plain"}
_CONFIG = {"yaml", "yml", "toml", "env", "ini", "cfg", "conf", "properties", "sh", "bash", "zsh", "json", "netrc"}

_PLACEHOLDER = re.compile(
    r"""^(?:<.*>|\$\{.*\}|\{\{.*\}\}|\#\{.*\}|\$\(.*\)|\$\w+|%\w+%|%\(\w+\)[sd]|\[.*\]|__.*__|@.*@|\{.*\}|-+|\.+|\*+|x+|X+|0+|\?+|_+)$
      | ^(?:env|vault|secret|secrets|ssm|sm|kms|file|ref|arn|keychain|op|sops|gcpsm|awssm|aws-sm)(?::|//)
      | ^(?:password|passwd|pass|pwd|secret|token|api[-_]?key|key|credentials?|passphrase)$
      | ^(?:todo|fixme|tbd|redacted|removed|hidden|masked|none|null|nil|undefined|true|false|n/?a|unset|empty|string|str|bytes|optional|required)$
      | ^(?:change|replace|fill|enter|insert|set|put|add)[-_ ]?(?:me|this|it|in|here|your)
      | ^(?:your|my|the|some|an?|our)[-_ ]\w+
      | (?:^|[-_ ])(?:example|placeholder|dummy|sample|redacted|changeme|goes[-_ ]here|here)(?:$|[-_ ])
      | ^(?:process\.env|os\.environ|System\.getenv|ENV\[)
      | ^(.)\1*$
    """,
    re.I | re.X,
)
#: Forms in which issuers give their keys; each is enough by itself. The general one, a short name and a long
#: run, is one if the run is of letters of both cases and digits mixed at random.
_ISSUED = re.compile(
    r"""(?<![A-Za-z0-9_/+=.-])(?:
        (?:sk|rk|pk)_live_[0-9A-Za-z]{16,} | sk-[A-Za-z0-9_-]{20,} | gh[pousr]_[0-9A-Za-z]{30,} | github_pat_\w{40,}
      | (?:AKIA|ASIA)[0-9A-Z]{16} | xox[abprs]-[0-9A-Za-z-]{10,} | AIza[0-9A-Za-z_-]{30,} | glpat-[\w-]{16,} | npm_[0-9A-Za-z]{30,}
      | eyJ[\w-]{10,}\.eyJ[\w-]{10,}\.[\w-]{10,} | SG\.[\w-]{16,}\.[\w-]{16,}
      | (?!(?:sha|md)\d+-)[a-z]{2,6}[_-](?:pat|live|prod|key)[_-][0-9A-Za-z]{16,}
      | (?P<general>(?:[a-z]{2,6}|[A-Z]{2,6})[._-](?P<random>[0-9A-Za-z]{20,}))
    )(?![0-9A-Za-z])""",
    re.X,
)
#: A key block; where its end is not in the chunk, as far as its lines go.
_BLOCK = re.compile(
    r"""-----BEGIN\ (?:[A-Z0-9]+\ )*PRIVATE\ KEY(?:\ BLOCK)?-----
        (?:((?:(?!-----).)*?)-----END\ [A-Z0-9\ ]*PRIVATE\ KEY(?:\ BLOCK)?-----|((?:[\s"'+,\\nr*#/]*[A-Za-z0-9+/]{16,}={0,2}(?=[\s"'\\]|\Z))*))""",
    re.S | re.X,
)
_IN_URL = re.compile(r"(?<=[A-Za-z0-9+.-])://([^\s:/@\"'`<>]*):([^\s/@\"'`<>]+)@[\w.\-\[\]${}]+")
_HOOK = re.compile(r"https?://(?:hooks?\.[\w.-]+|[\w.-]*/(?:hooks?|webhooks?))/(?:services/|api/)?T\w{6,}/B\w{6,}/(\w{12,})")
_AUTHORIZATION = re.compile(r"\b(Basic|Bearer|Token)\s+([A-Za-z0-9+/=._~!?*%&$@#^-]{4,})", re.I)
_COMMAND = re.compile(
    r"""(?:\bmysql(?:dump|admin)?\b[^\n]*?\s-p | \bsshpass\s+-p\s* | (?<!\S)--?(?:password|passwd|passphrase|pass|token|api-key|secret|access-key)(?:[ =]\s*)
        | \bcurl\b[^\n]*?\s(?:-u|--user)[ =]?\s*["']?[\w.@-]+: | \bPGPASSWORD=)
        (?:"([^"\n]*)"|'([^'\n]*)'|([^\s"'|;&<>]+))""",
    re.X,
)
_ACCOUNT = re.compile(
    r"""\b(?:identified\s+by|(?:with\s+)?(?:encrypted\s+)?password|set\s+password(?:\s+for\s+\S+)?\s*(?:=|to))\s+
        (?:(?:old_)?password\s*\(\s*)?('((?:[^'\\\n]|''|\\.)*)'|"((?:[^"\\\n]|\\.)*)")""",
    re.I | re.X,
)
_HEADER = re.compile(r"""["']([A-Za-z][\w-]{2,40})\s*:\s+([^\s"']{6,})["']""")
_TOLD = re.compile(
    r"""\b(?:(?:api|access|private|signing|secret|master|admin|prod|staging|deploy|auth)[\s_-]+)?
        (?:passwor[dt]|passwd|passphrase|pwd|pw|login|token|secret|credentials?|key|apikey|kennwort)
        (?:\s*[:=]+>?\s*|\s+(?:is|was|to|are|ist|use|now)\s*:?\s+|\s+)
        (?:(`)([^`\n]+)` | (")([^"\n]+)" | (')([^'\n]+)' | ([^\s`"',;()<>]+))""",
    re.I | re.X,
)
#: Lines worth a look, found without tokenizing.
_TRIGGER = re.compile(
    r"""pass(?:word|wd|phrase|code|wort)?(?![a-z])|p(?:wd|w)(?![a-z])|PASS|P(?:WD|W)\b|secret|token|credential|api[-_ ]?key|(?:access|private|signing|encryption|auth|master|account|shared|deploy|service|client)[-_ ]?key
      | ://[^\s/@:]*:[^\s/@]+@|//hook|authorization|bearer\s|basic\s|sshpass|identified\s+by|mysql|curl\s|login|authenticate|sign_?in\b|\bkey\b|connect|kennwort|contraseña|\bclave\b|\bpsk\b|\bvalue\s*:""",
    re.I | re.X,
)
#: Parts of what ``_TRIGGER`` finds; every match has one of them.
_HINTS = (
    "pass pwd pw secret token credential key ://  authorization bearer basic identified mysql curl login authenticate signin sign_in connect kennwort "
    "contraseña clave psk value"
).split()
_TOKEN_FORMS = (
    r"""(?P<comment>//[^\n]*|\#[^\n]*|/\*.*?(?:\*/|$)|<!--.*?(?:-->|$)|(?<![\w)])--\s[^\n]*)
      | (?P<string>[bBrRfFuU]{0,2}(?P<q>\"\"\"|'''|"|'|`)(?P<body>(?:\\.|(?!(?P=q)).)*)(?P=q))
      | (?P<word>\$?[A-Za-z_À-ɏ][\w$À-ɏ-]*)
      | (?P<op>:=|=>|===?|!==?|<=|>=|->|\?\?|\|\||&&|[-+*/%]=|[^\s\w])
      | (?P<number>\d[\w.]*)"""
)
#: The quotes as they stand in ``_TOKEN_FORMS``.
_QUOTES = r"""(?P<q>\"\"\"|'''|"|'|`)"""
#: The name of a call that connects.
_CONNECTS = re.compile(r"(?:connect|login|log_in|signin|sign_in|authenticate|auth)\w*\Z", re.I)
#: Types that hold a literal as it is.
_WRAPS = re.compile(r"String|Secret|Password|Credential", re.I)
#: A literal over lines, from its opening on.
_OVER_LINES = re.compile(r"(?P<q>\"\"\"|'''|`)(?P<body>(?:\\.|(?!(?P=q)).)*)(?P=q)", re.S)
_PARTS = re.compile(r"[A-ZÄÖÜÑ]+(?=[A-ZÄÖÜÑ][a-zäöüñ])|[A-ZÄÖÜÑ]?[a-zäöüñß]+|[A-ZÄÖÜÑ]+|\d+")


def names_credential(name: str) -> bool:
    """Whether an identifier, by its last words, holds a credential: ``dbPassword``, ``API_KEY``, but not ``password_hint``."""
    words = [w.lower() for w in _PARTS.findall(name)]
    while words and (words[-1].isdigit() or words[-1] in _TRAILING):
        words.pop()
    if not words:
        return False
    if words[-1] in _CREDENTIAL_WORDS:
        return not (words[-1] == "pass" and len(words) == 1)
    return words[-1] == "key" and len(words) > 1 and words[-2] in _KEY_KINDS


def is_placeholder(value: str) -> bool:
    return not value.strip() or bool(_PLACEHOLDER.search(value.strip()))


def _issued(match: re.Match) -> bool:
    """Whether a match of ``_ISSUED`` is a key: no placeholder, and at random where the form is the general one."""
    if is_placeholder(match.group()) or not re.search(r"\d", match.group()):
        return False
    run = match.group("random")
    if run is None:
        return True
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in run]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    words = re.fullmatch(r"(?:[A-Z]?[a-z]+\d{0,2})+", run)  # a name in camel case
    return len(set(kinds)) == 3 and changes >= 0.4 * len(run) and kinds.count("d") >= 2 and not words


def looks_secret(value: str) -> bool:
    """Whether a word in running text is more than a word: digits among letters, signs, or case that follows no words."""
    core = value.rstrip(".,;:)")
    if len(core) < 6 or is_placeholder(core) or re.match(r"[\w.]+\(", core):
        return False
    if (issued := _ISSUED.search(core)) and _issued(issued):
        return True
    if re.search(r"[!?#%*$^~+@=]", core) or re.search(r"[A-Za-z]\d|\d[A-Za-z]", core):
        return not re.fullmatch(r"v?\d+(\.\d+)*\w{0,3}|\d{4}-\d\d-\d\d.*|[#@]\w+", core)
    parts = _PARTS.findall(core)
    return len(parts) > 3 and len(core) < 3.4 * len(parts) and bool(re.search(r"[a-z][A-Z]", core))


def _usable(value: str) -> bool:
    """Whether the literal given to a credential is one: no placeholder, no sentence, no name of something else."""
    value = value.strip()
    return (
        len(value) >= 4
        and not is_placeholder(value)
        and not re.search(r"\s", value)
        and "-----BEGIN PUBLIC" not in value
        and not re.match(r"https?://|\.{0,2}/[\w./-]*\.\w+$|\.{0,2}/(?!(?=.*\d)(?=.*[A-Z])[\w/]{24,}$)[\w./-]*$|#[0-9a-fA-F]{3,8}$", value)
    )


def _body(match: re.Match) -> tuple[int, int]:
    return match.start("body"), match.end("body")


@lru_cache(maxsize=8)
def _tokens(unclosed: str) -> re.Pattern:
    """The pattern of tokens, where these quotes open no literal."""
    quotes = [re.escape(q) for q in ('"""', "'''", '"', "'", "`") if q not in unclosed]
    listed = "|".join(quotes) if quotes else "(?!)"
    return re.compile(_TOKEN_FORMS.replace(_QUOTES, f"(?P<q>{listed})"), re.X | re.S)


def _lexed(content: str, start: int, end: int) -> list[re.Match]:
    """The tokens between two offsets, in linear time: a quote that isn't closed once isn't closed further on either."""
    tokens: list[re.Match] = []
    unclosed, at = "", start
    while at < end:
        for token in _tokens(unclosed).finditer(content, at, end):
            tokens.append(token)
            at = token.end()
            if token.group("op") in ('"', "'", "`") and token.group("op") not in unclosed:
                unclosed += token.group("op")
                break
        else:
            break
    return tokens


class _Stream:
    """The code tokens from a line on, comments left out; lines below are read as they are asked for."""

    def __init__(self, content: str, end: int, tokens: list[re.Match], lexed: dict[int, list[re.Match]]):
        self.content, self.end, self.lexed = content, end, lexed
        self.own = len(tokens)  # tokens of the line itself
        self.tokens = list(tokens)

    def get(self, i: int) -> re.Match | None:
        """Token ``i``, also of a line below."""
        while i >= len(self.tokens) and self.end < len(self.content):
            start = self.end + 1
            end = self.content.find("\n", start)
            end = end if end >= 0 else len(self.content)
            if start not in self.lexed:
                self.lexed[start] = [t for t in _lexed(self.content, start, end) if t.group("comment") is None]
            self.tokens += self.lexed[start]
            self.end = end
        return self.tokens[i] if i < len(self.tokens) else None

    def after(self, i: int, literal: re.Match) -> int:
        """The index of the first token behind a literal that begins at token ``i``."""
        i += 1
        while (token := self.get(i)) is not None and token.start() < literal.end():
            i += 1
        return i

    def same_line(self, i: int) -> bool:
        """Whether token ``i`` follows the one before on its line."""
        return "\n" not in self.content[self.tokens[i - 1].end() : self.tokens[i].start()]

    def same_line_as_name(self, i: int, j: int) -> bool:
        return "\n" not in self.content[self.tokens[i].end() : self.tokens[j].start()]

    def op(self, i: int) -> str | None:
        token = self.get(i)
        return token.group("op") if token else None

    def word(self, i: int) -> str | None:
        token = self.get(i)
        return token.group("word") if token else None

    def arguments(self, i: int, most: int) -> tuple[list[re.Match], bool]:
        """The first literals, at most so many, among the arguments that the bracket at token ``i`` opens, and whether the last
        of them ends the arguments."""
        literals, depth, j, ends = [], 0, i, False
        while len(literals) <= most and (now := self.get(j)) is not None:
            depth += (now.group("op") in ("(", "[", "{")) - (now.group("op") in (")", "]", "}"))
            if depth <= 0:
                return literals[:most], ends
            if (literal := self.literal(j)) is not None:
                literals.append(literal)
                j, ends = self.after(j, literal), True
                continue
            ends = ends and now.group("op") == ","
            j += 1
        return literals[:most], False

    def literal(self, i: int) -> re.Match | None:
        """The string literal at token ``i``; one that is open at the end of its line goes on below."""
        token = self.get(i)
        if token is None:
            return None
        text = self.content
        if token.group() in ("`", '""', "''") and text.startswith(("`", '"""', "'''"), token.start()):
            return _OVER_LINES.match(text, token.start())
        return token if token.group("string") is not None else None


def _scheme_before(line: str, end: int) -> bool:
    """Whether the scheme of a URL, a letter at the start of a word and what may follow, ends there."""
    start = end
    while start and (line[start - 1].isascii() and line[start - 1].isalnum() or line[start - 1] in "+.-"):
        start -= 1
    return bool(re.compile(r"\b[A-Za-z]").search(line, start, end))


def _opens_call(content: str, token: re.Match) -> bool:
    """Whether a token is the first argument of a call."""
    at = token.start()
    while at and content[at - 1].isspace():
        at -= 1
    return at > 0 and content[at - 1] == "("


def _closes(stream: _Stream, i: int) -> bool:
    return stream.op(i) == ")" or stream.op(i) == "," and stream.op(i + 1) == ")"


def _line_findings(content: str, at: int, end: int, number: int, extension: str, previous: str, lexed: dict[int, list[re.Match]]) -> list[Finding]:
    """Credentials named or standing on the line between two offsets (without its end); values may be on lines below."""
    line = content[at:end]
    found: list[Finding] = []

    def add(kind: str, *spans: tuple[int, int]) -> None:
        spans = tuple((a, b) for a, b in spans if b > a)
        if spans:
            found.append(Finding(number + (content.count("\n", at, spans[0][0]) if spans[0][0] > end else 0), kind, spans))

    for m in _IN_URL.finditer(line):
        if _usable(m.group(2)) and _scheme_before(line, m.start()):
            add("url", (at + m.start(2), at + m.end(2)))
    for m in _HOOK.finditer(line):
        add("hook", (at + m.start(1), at + m.end(1)))
    named = re.search("authorization", line, re.I)
    for m in _AUTHORIZATION.finditer(line):
        kind, value = m.group(1).lower(), m.group(2)
        if not is_placeholder(value) and (named and named.end() <= m.start() or kind == "bearer"):
            if kind == "basic":
                try:
                    user, colon, word = base64.b64decode(value, validate=True).decode("utf-8").partition(":")
                except (binascii.Error, UnicodeDecodeError, ValueError):
                    continue
                if colon and _usable(word):
                    add("authorization", (at + m.start(2), at + m.end(2)))
            elif looks_secret(value) and not value.startswith("$"):
                add("authorization", (at + m.start(2), at + m.end(2)))
    for m in _COMMAND.finditer(line):
        group = m.lastindex
        if group and _usable(m.group(group)) and (extension in ("sh", "bash", "zsh", "", "md", "yaml", "yml") or group < 3):
            add("command", (at + m.start(group), at + m.end(group)))
    account = line
    if re.search(r"(?:\bby|\bto|password|=|\()\s*\Z", line[-200:], re.I):  # the literal may be on the next line
        stop = content.find("\n", content.find("\n", end) + 1) if content.find("\n", end) >= 0 else end
        account = content[at : stop if stop >= 0 else len(content)]
    for m in _ACCOUNT.finditer(account):
        if m.start() >= len(line):
            break
        group = 2 if m.group(2) is not None else 3
        if _usable(m.group(group)):
            add("account", (at + m.start(group), at + m.end(group)))

    for m in _HEADER.finditer(line):
        if names_credential(m.group(1)) and _usable(m.group(2)):
            add("header", (at + m.start(2), at + m.end(2)))

    lexed_line = _lexed(content, at, end)
    comments = [(t.start() - at, t.end() - at) for t in lexed_line if t.group("comment") is not None]
    code = [t for t in lexed_line if t.group("comment") is None]
    line_end = content.find("\n", end)
    stream = _Stream(content, line_end if line_end >= 0 else len(content), code, lexed)
    for i in range(stream.own):
        token = code[i]
        name = token.group("word") or (token.group("body") if token.group("string") is not None else None)
        if not name:
            continue
        # connect("host", "user", "password"): the literal after an account, or the one that ends the arguments
        if token.group("word") and _CONNECTS.search(name) and stream.op(i + 1) == "(":
            literals, last = stream.arguments(i + 1, 3)
            if len(literals) == 3:
                user, word = literals[1].group("body"), literals[2].group("body")
                if _usable(word) and re.fullmatch(r"[\w.-]+", user) and not re.fullmatch(r"[a-z_ -]+|[A-Z_ ]+", word):
                    add("passed", _body(literals[2]))
            elif len(literals) == 1 and last and _usable(literals[0].group("body")) and looks_secret(literals[0].group("body")):
                add("passed", _body(literals[0]))
        if not re.fullmatch(r"\$?[\w$.À-ɏ-]{2,80}", name) or not names_credential(name):
            continue
        # setName(..., literal), but not loadName(literal): what a call gives is no literal
        if re.match(r"(?:set|with|use|put|update|change|reset)(?:_|[A-Z])", name) and stream.op(i + 1) == "(":
            literals, last = stream.arguments(i + 1, 2)
            if len(literals) == 1 and last and _usable(literals[0].group("body")):
                add("passed", _body(literals[0]))
                continue
        # name [type or closing signs] = literal [+ literal ...]
        j = i + 1
        while j < stream.own and (code[j].group("word") or code[j].group("op") in (":", "*", "[", "]", "?", ")", "<", ">", "&")) and j - i <= 6:
            if code[j].group("op") == ":" and (j == i + 1 or j + 1 < stream.own) and stream.literal(j + 1):
                break
            j += 1
        if stream.op(j) not in (("=", ":", ":=", "=>", ",") if j < stream.own else ("=", ":=")):
            continue
        if stream.op(j) == ",":
            if token.group("string") is None:
                continue
            # Over lines, names in a list look the same; only the two arguments of a call are a name and its value.
            if j + 1 >= stream.own and not (_opens_call(content, token) and _closes(stream, j + 2)):
                continue
        j += 1
        if stream.word(j) == "new" and _WRAPS.search(stream.word(j + 1) or "") and stream.op(j + 2) == "(":
            j += 2  # a string made of the literal
        if stream.op(j) == "(":
            j += 1
        spans, value = [], ""
        while literal := stream.literal(j):
            spans.append(_body(literal))
            value += literal.group("body")
            j = stream.after(j, literal)
            if stream.op(j) not in ("+", ".", "..", "&") or not stream.literal(j + 1):
                break
            j += 1
        called = stream.op(j) in ("(", "[") and stream.same_line(j)
        if stream.op(j) in (":", "=") and len(spans) == 1 and j > stream.own and not stream.same_line_as_name(i, j - 1):
            continue  # the next key of a mapping, whose own value is below it
        # a name of two letters may be anything, as in minified code
        if spans and _usable(value) and not called and (len(name) > 2 or looks_secret(value)):
            add("assigned", *spans)

    if extension in _CONFIG or not extension:
        m = re.match(r"""\s*(?:export\s+|set\s+|-\s+)?["']?([\w.-]+)["']?\s*([:=])\s*([^\s"'#][^\s,]*)\s*(?:\s\#.*)?,?$""", line)
        name = m.group(1) if m else None
        if m and name.lower() == "value":
            above = re.match(r"""\s*-?\s*name\s*:\s*["']?([\w.-]+)""", previous)
            name = above.group(1) if above else None
        if m and name and names_credential(name) and _usable(m.group(3)) and not re.match(r"[|>&*!]|\w+\(|\w+\.\w+\(", m.group(3)):
            add("assigned", (at + m.start(3), at + m.end(3)))
        quoted = re.match(r"""\s*value\s*:\s*(["'])(.*)\1\s*$""", line)
        above = quoted and re.match(r"""\s*-?\s*name\s*:\s*["']?([\w.-]+)""", previous)
        if above and names_credential(above.group(1)) and _usable(quoted.group(2)):
            add("assigned", (at + quoted.start(2), at + quoted.end(2)))

    prose = comments if extension not in ("md", "markdown", "txt", "rst") else [(0, len(line))]
    if extension not in ("md", "markdown", "txt", "rst") and re.match(r"\s*(\*|/\*|<!--)", line):
        prose = [(0, len(line))]
    for start, end in prose:
        for m in _TOLD.finditer(line, start, end):
            for group in (2, 4, 6, 7):
                if m.group(group) is not None:
                    value = m.group(group)
                    trimmed = value.rstrip(".,;:") if group == 7 else value
                    if not re.search(r"\s", trimmed) and looks_secret(trimmed):
                        add("told", (at + m.start(group), at + m.start(group) + len(trimmed)))
    return found


@lru_cache(maxsize=1)
def _hints():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in _HINTS:
        automaton.add_word(word, len(word))
    automaton.make_automaton()
    return automaton


def _suspected(content: str) -> set[int]:
    """Starts of the lines that ``_TRIGGER`` matches, found by way of its hints."""
    lower = content.lower()
    if len(lower) != len(content):  # a few letters change their length
        return {content.rfind("\n", 0, m.start()) + 1 for m in _TRIGGER.finditer(content)}
    starts, seen_to = set(), -1
    for end, length in _hints().iter(lower):
        at = end + 1 - length
        if at < seen_to or length == 4 and lower.startswith("compass", at - 3):
            continue
        start = content.rfind("\n", 0, at) + 1
        stop = content.find("\n", at)
        stop = stop if stop >= 0 else len(content)
        seen_to = stop
        if _TRIGGER.search(content, start, stop):
            starts.add(start)
    return starts


def find(content: str | None, path: str | None = None) -> list[Finding]:
    """The credentials of a content, by line; ranges of different findings don't overlap."""
    if not content:
        return []
    found: list[Finding] = []
    taken: list[tuple[int, int]] = []
    for m in _BLOCK.finditer(content):
        group = 1 if m.group(1) is not None else 2
        body = m.group(group)
        letters = re.sub(r"\\[nrt]|[^A-Za-z0-9+/=]", "", body)
        if len(letters) >= 32 and not re.search(r"\.\.\.|<|\$\{|\{\{", body) and len(set(letters)) > 8:
            found.append(Finding(content.count("\n", 0, m.start()) + 1, "key block", (m.span(group),)))
        taken.append(m.span())
    base = (path or "").rsplit("/", 1)[-1].lower()
    extension = "env" if base.startswith(".env") else base.rsplit(".", 1)[-1] if "." in base else ""
    extension = re.sub(r"\W.*", "", extension)

    issued = [m for m in _ISSUED.finditer(content) if _issued(m)]
    starts = _suspected(content)
    per_line: list[Finding] = []
    lexed: dict[int, list[re.Match]] = {}
    last_start, number = 0, 1
    for start in sorted(starts):
        number += content.count("\n", last_start, start)
        last_start = start
        end = content.find("\n", start)
        line = content[start : end if end >= 0 else len(content)]
        line = line[:-1] if line.endswith("\r") else line
        above_start = content.rfind("\n", 0, max(0, start - 1)) + 1
        previous = content[above_start : start - 1] if start else ""
        per_line += _line_findings(content, start, start + len(line), number, extension, previous, lexed)
    for m in issued:
        per_line.append(Finding(content.count("\n", 0, m.start()) + 1, "issued", (m.span(),)))
    for f in per_line:
        if any(a < e and s < b for s, e in f.spans for a, b in taken):
            continue
        found.append(f)
        taken.extend(f.spans)
    found.sort()
    return found


def redact(content: str | None, findings: list[Finding]) -> str | None:
    """The content with the findings' characters replaced by asterisks; escape sequences and line ends stay."""
    if not content or not findings:
        return content
    parts, at = [], 0
    for start, end in sorted(span for f in findings for span in f.spans):
        if start >= at:
            parts.append(content[at:start])
            parts.append(re.sub(r"(\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)|\s+)|.", lambda m: m.group(1) or "*", content[start:end], flags=re.S))
            at = end
    return "".join(parts) + content[at:]


def scanned(chunks: DataFrame) -> DataFrame:
    """(segment_hash, lines array<struct<line_no, kind>>, redacted) of each row; one pass without shuffle."""
    source = spread(chunks.select("segment_hash", "file_path", "content"))
    item = T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("kind", T.StringType())])
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, texts = [], []
            for path, text in zip(batch.column("file_path").to_pylist(), batch.column("content").to_pylist()):
                findings = find(text, path)
                lines.append([{"line_no": f.line, "kind": f.kind} for f in findings])
                texts.append(redact(text, findings))
            yield pa.RecordBatch.from_arrays(
                [batch.column("segment_hash"), pa.array(lines, kind), pa.array(texts, pa.string())], ["segment_hash", "lines", "redacted"]
            )

    layout = T.StructType(
        [T.StructField("segment_hash", T.StringType()), T.StructField("lines", T.ArrayType(item)), T.StructField("redacted", T.StringType())]
    )
    return source.mapInArrow(run, layout)


def credentials(chunks: DataFrame) -> DataFrame:
    """(segment_hash, line_no int), distinct: lines of chunks on which a literal credential begins."""
    rows = scanned(chunks).select("segment_hash", F.explode("lines").alias("found"))
    return rows.where("segment_hash is not null").select("segment_hash", F.col("found.line_no").alias("line_no")).distinct()


def redacted(chunks: DataFrame) -> DataFrame:
    """(segment_hash, content, n_credentials int): each row with its credentials made unreadable."""
    return scanned(chunks).select("segment_hash", F.col("redacted").alias("content"), F.size("lines").alias("n_credentials"))
