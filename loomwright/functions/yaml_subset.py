"""The frontmatter's YAML subset: one reader from text to values, one writer back.

Values are None, bool, int, float, str, list and ``Pairs`` (a mapping as a list of pairs: order, repeated
keys and keys that are no strings all survive).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

_SPECIAL = {
    "": None, "~": None, "null": None, "Null": None, "NULL": None,
    "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False,
    ".inf": math.inf, ".Inf": math.inf, ".INF": math.inf, "+.inf": math.inf,
    "-.inf": -math.inf, "-.Inf": -math.inf, "-.INF": -math.inf,
    ".nan": math.nan, ".NaN": math.nan, ".NAN": math.nan,
}
_INT = re.compile(r"[-+]?(?:0|[1-9][0-9]*)", re.ASCII)
_FLOAT = re.compile(r"[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?", re.ASCII)
_DOUBLE = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_SINGLE = re.compile(r"'(?:[^']|'')*'", re.DOTALL)
_ESCAPE = re.compile(r"\\(.?)(.{0,4})", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "/": "/", "0": "\0", "b": "\b", "f": "\f"}
_COMMENT = re.compile(r"(?<=[ \t])#.*\Z", re.DOTALL)
_DATETIME = re.compile(r"\d{4}-\d{1,2}-\d{1,2}(?:[Tt]|[ \t]+)\d{1,2}:\d\d:\d\d(?:\.\d*)?(?:[ \t]*(?:Z|[-+]\d{1,2}(?::\d\d)?))?", re.ASCII)


#: Collections inside each other at most; a document nested deeper is reported as an error.
MAX_DEPTH = 100
TOO_DEEP = f"collections nested more than {MAX_DEPTH} deep"


class YamlError(ValueError):
    """A reading error; ``line`` counts from one within the text."""

    def __init__(self, line: int, message: str) -> None:
        super().__init__(f"YAML error at line {line}: {message}")
        self.line, self.message = line, message


@dataclass
class Pairs:
    items: list[tuple] = field(default_factory=list)

    def get(self, key: str):
        return next((v for k, v in self.items if isinstance(k, str) and k == key), None)

    def has(self, key: str) -> bool:
        return any(isinstance(k, str) and k == key for k, _ in self.items)


def lines_of(text: str) -> list[str]:
    """Split at line feeds, drop one carriage return before each and an empty last line."""
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") and (i < len(parts) - 1 or text.endswith("\n")) else p for i, p in enumerate(parts)]


def plain(text: str):
    """Type of an unquoted scalar."""
    if text in _SPECIAL:
        return _SPECIAL[text]
    if len(text) <= 20 and _INT.fullmatch(text) and -(2**63) <= int(text) < 2**63:
        return int(text)
    return float(text) if _FLOAT.fullmatch(text) else text


def _unescaped(body: str, line: int) -> str:
    out, at = [], 0
    for at_escape in iter(lambda: body.find("\\", at), -1):
        out.append(body[at:at_escape])
        kind, rest = _ESCAPE.match(body, at_escape).groups()
        at = at_escape + 2
        if kind in _ESCAPES and kind:
            out.append(_ESCAPES[kind])
        elif kind == "u":
            if len(rest) < 4:
                raise YamlError(line, "truncated Unicode escape in double-quoted string")
            if not re.fullmatch(r"\+?[0-9a-fA-F]+", rest):
                raise YamlError(line, "malformed Unicode escape in double-quoted string")
            if 0xD800 <= int(rest, 16) < 0xE000:
                raise YamlError(line, "invalid Unicode scalar value in double-quoted string")
            out.append(chr(int(rest, 16)))
            at += 4
        else:
            raise YamlError(line, f"unknown escape sequence \\{kind} in double-quoted string" if kind else "dangling escape in double-quoted string")
    return "".join([*out, body[at:]])


def _quoted(text: str, line: int, at: int = 0) -> tuple[str, int]:
    """Value and end of the quoted string that starts at ``at``."""
    double = text[at] == '"'
    m = (_DOUBLE if double else _SINGLE).match(text, at)
    if m is None:
        if double:
            _unescaped(text[at + 1 :], line)  # an escape that is wrong comes before the missing end
        raise YamlError(line, f"unterminated {'double' if double else 'single'}-quoted string")
    body = m[0][1:-1]
    return (_unescaped(body, line) if double else body.replace("''", "'")), m.end()


def scalar(text: str, line: int):
    """A whole scalar, which may be quoted and may have a comment behind it."""
    text = text.strip()
    if text[:1] in ("'", '"') and text:
        value, end = _quoted(text, line)
        tail = text[end:].lstrip()
        if tail and not tail.startswith("#"):
            raise YamlError(line, f"unexpected content after closing {'double' if text[0] == '"' else 'single'}-quoted quote")
        return value
    return plain(_COMMENT.sub("", text).rstrip())


def split_pair(text: str) -> tuple[str, str | None] | None:
    """Key and rest of ``key: rest``; None if there is no separating colon outside quotes and brackets."""
    quote, depth, i = "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            if quote == '"' and c == "\\":
                i += 1
            elif c == quote and quote == "'" and text[i + 1 : i + 2] == "'":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth = max(0, depth - 1)
        elif depth == 0 and c == "#" and text[i - 1 : i] in (" ", "\t"):
            return None
        elif depth == 0 and c == ":" and text[i + 1 : i + 2] in ("", " ", "\t"):
            rest = text[i + 1 :].strip()
            return text[:i].strip(), None if not rest or rest.startswith("#") else rest
        i += 1
    return None


class _Flow:
    """Bracketed collections, which stay on one line."""

    def __init__(self, text: str, line: int) -> None:
        self.text, self.line, self.at, self.depth = text, line, 0, 0

    def peek(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def value(self):
        c = self.peek()
        if c in ("[", "{") and c:
            return self.collection(c)
        return self.atom() if c else None

    def collection(self, opener: str):
        closer, name = ("]", "sequence") if opener == "[" else ("}", "mapping")
        self.at, self.depth = self.at + 1, self.depth + 1
        if self.depth > MAX_DEPTH:
            raise YamlError(self.line, TOO_DEEP)
        out: list = []
        while self.peek() != closer:
            if not self.peek():
                raise YamlError(self.line, f"unterminated flow {name}")
            if opener == "[":
                out.append(self.value())
            else:
                key, value = self.atom(), None
                if self.peek() == ":":
                    self.at += 1
                    value = self.value()
                out.append((key, value))
            if self.peek() == ",":
                self.at += 1
            elif self.peek() != closer:
                raise YamlError(self.line, f"expected ',' or '{closer}' in flow {name}")
        self.at, self.depth = self.at + 1, self.depth - 1
        return out if opener == "[" else Pairs(out)

    def atom(self):
        if self.peek() in ("'", '"') and self.peek():
            value, self.at = _quoted(self.text, self.line, self.at)
            return value
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in ",]}":
            after = self.text[self.at + 1 : self.at + 2]
            if self.text[self.at] == ":" and (not after or after.isspace() or after in ",[]{}"):
                break
            self.at += 1
        return plain(self.text[start : self.at].strip())


class _Reader:
    """Block structure by indentation."""

    def __init__(self, text: str) -> None:
        self.lines, self.at, self.depth = lines_of(text), 0, 0

    def fail(self, message: str) -> YamlError:
        return YamlError(self.at + 1, message)

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise self.fail(TOO_DEEP)

    def indent(self, tab: str = "tab character in indentation") -> int:
        line = self.lines[self.at]
        n = len(line) - len(line.lstrip(" "))
        if line[n : n + 1] == "\t":
            raise self.fail(tab)
        return n

    def more(self) -> bool:
        """Skip blank and comment lines; whether a line is left."""
        while self.at < len(self.lines) and self.lines[self.at].lstrip()[:1] in ("", "#"):
            self.at += 1
        return self.at < len(self.lines)

    def document(self):
        if not self.more():
            return None
        value = self.node(self.indent())
        if self.more():
            raise self.fail("unexpected trailing content")
        return value

    def node(self, indent: int):
        text = self.lines[self.at][indent:].lstrip()
        if text == "-" or text.startswith("- "):
            return self.sequence(indent)
        if split_pair(text):
            return self.mapping(indent)
        self.at += 1
        return self.folded(text, indent, self.at)

    def _level(self, indent: int, what: str) -> str | None:
        """The next line of this level, without its indentation; None at the end of the level."""
        if not self.more() or (found := self.indent()) < indent:
            return None
        if found > indent:
            raise self.fail(f"unexpected indentation in {what}")
        return self.lines[self.at][indent:]

    def mapping(self, indent: int) -> Pairs:
        out = Pairs()
        self.deeper()
        while (text := self._level(indent, "mapping")) is not None and not (text == "-" or text.startswith("- ")):
            pair = split_pair(text)
            if pair is None:
                raise self.fail("expected 'key: value' mapping entry")
            key = scalar(pair[0], self.at + 1)
            self.at += 1
            out.items.append((key, self.inline(pair[1], indent) if pair[1] else self.nested(indent)))
        self.depth -= 1
        return out

    def sequence(self, indent: int) -> list:
        out: list = []
        self.deeper()
        while (text := self._level(indent, "sequence")) is not None and (text == "-" or text.startswith("- ")):
            item = text[1:].lstrip()
            if item and item[0] not in "|>" and split_pair(item):
                offset = indent + len(text) - len(item)
                self.lines[self.at] = " " * offset + item
                out.append(self.mapping(offset))
                continue
            self.at += 1
            out.append(self.inline(item, indent) if item else self.nested(indent))
        self.depth -= 1
        return out

    def inline(self, text: str, indent: int):
        return self.block(text, indent) if text[0] in "|>" else self.folded(text, indent + 1, self.at)

    def nested(self, parent: int):
        if not self.more():
            return None
        found, text = self.indent(), self.lines[self.at][parent:]
        if found > parent:
            return self.node(found)
        return self.sequence(found) if found == parent and (text == "-" or text.startswith("- ")) else None

    def folded(self, first: str, least: int, line: int):
        """A scalar with the lines that continue it."""
        if first[:1] in ("[", "{") and first:
            flow = _Flow(first.strip(), line)
            flow.depth = self.depth
            value = flow.value()
            if flow.peek() not in ("", "#"):
                raise YamlError(line, "unexpected content after flow collection")
            return value
        parts = [first]
        quote = first[0] if first[:1] in ("'", '"') and first else ""
        ended = {'"': re.compile(r'(?:[^"\\]|\\.)*"'), "'": re.compile(r"(?:[^']|'')*'(?!')")}.get(quote)
        is_open = bool(quote) and not ended.match(first, 1)
        while self.at < len(self.lines) and self.lines[self.at].strip():
            if self.indent() < least:
                break
            text = self.lines[self.at].strip()
            if not is_open and (text[0] == "#" or text == "-" or text.startswith("- ") or split_pair(text)):
                break
            parts.append(text)
            is_open = is_open and not ended.match(text)
            self.at += 1
        return scalar(" ".join(parts), line)

    def block(self, header: str, parent: int) -> str:
        body: list[str] = []
        own = None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.strip():
                found = self.indent("tab in block scalar indentation")
                if found <= parent:
                    break
                own = found if own is None else own
                body.append(line[own:])
            else:
                body.append("")
            self.at += 1
        kept = len(body)
        while kept and not body[kept - 1]:
            kept -= 1
        blanks, body = len(body) - kept, body[:kept]
        if header[0] == "|":
            text = "\n".join(body)
        else:
            text = _fold(body)
        chomp = next((c for c in header[1:] if c in "+-"), "")
        if chomp == "+":
            return text + "\n" * (blanks + 1)
        return text if chomp == "-" or not (text or blanks) else text + "\n"


def _fold(body: list[str]) -> str:
    """Join neighbouring lines by a space; an empty line is a line feed."""
    out = ""
    for before, line in zip(["", *body], body, strict=False):
        out += "\n" if not line else (" " if before else "") + line
    return out


def parse(text: str):
    return _Reader(text).document()


def kind_of(value) -> str:
    if value is None:
        return "null"
    for kind, name in ((bool, "bool"), (int, "int"), (float, "float"), (str, "string"), (list, "list")):
        if isinstance(value, kind):
            return name
    return "map"


def is_empty(value) -> bool:
    """Empty as frontmatter counts it: 0.0 and blank strings are not."""
    if isinstance(value, float):
        return False
    return not value.items if isinstance(value, Pairs) else value in (None, False, 0, "") or value == []


def _digits(value: float) -> str:
    """Shortest digits that read back, never in scientific notation."""
    from decimal import Decimal

    text = format(Decimal(repr(value)), "f")
    return text[:-2] if text.endswith(".0") else text


def display(value) -> str | None:
    """Text of a scalar; None for null and collections."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else ("inf" if value > 0 else "-inf") if math.isinf(value) else _digits(value)
    return str(value) if isinstance(value, (int, str)) else None


def canonical(value) -> str:
    """Text that is equal for equal values only: typed, and in order."""
    if isinstance(value, Pairs):
        return "{" + ",".join(f"{canonical(k)}:{canonical(v)}" for k, v in value.items) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    text = display(value) or ""
    return f"{kind_of(value)[0]}{len(text)}={text}"


_WORDS = re.compile(r"[A-Za-z][A-Za-z0-9_./ -]*(?<! )", re.ASCII)


def _safe(text: str) -> bool:
    """Whether a string may stand unquoted."""
    if _WORDS.fullmatch(text):  # most texts; none of these characters means anything here
        return text not in _SPECIAL
    try:
        same = parse(text) == text
    except YamlError:
        same = False
    return bool(
        text and same and text == text.strip(" ") and not _DATETIME.fullmatch(text) and text[0] not in "-?:,[]{}#&*!|>'\"%@`"
        and not re.search(r"[\n\t\r]|:(?: |\Z)| #", text)
    )


def _quote(text: str) -> str:
    names = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r", "\b": "\\b", "\f": "\\f", "\0": "\\0"}
    return '"' + "".join(names.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in text) + '"'


def inline(value) -> str:
    """A scalar, or an empty collection, as written behind a key."""
    if isinstance(value, str):
        return value if _safe(value) else _quote(value)
    if isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            return ".nan" if math.isnan(value) else ".inf" if value > 0 else "-.inf"
        size = abs(value)
        if size and not 1e-5 <= size < 1e16:
            mantissa, _, power = repr(value).partition("e") if "e" in repr(value) else f"{value:e}".partition("e")
            return f"{mantissa if '.' in mantissa else mantissa + '.0'}e{int(power)}"
        return _digits(value) if "." in _digits(value) else _digits(value) + ".0"
    if value is None:
        return "null"
    return "{}" if isinstance(value, Pairs) else "[]" if isinstance(value, list) else display(value)


def emit(value, indent: int = 0) -> str:
    """Block style with two spaces a level. A list within a list is written in brackets, as it reads back."""
    pad = " " * indent
    if isinstance(value, Pairs) and value.items:
        return "".join(f"{pad}{_key(k)}:\n{emit(v, indent + 2)}" if _nests(v) else f"{pad}{_key(k)}: {inline(v)}\n" for k, v in value.items)
    if isinstance(value, list) and value:
        out = ""
        for item in value:
            if isinstance(item, Pairs) and item.items:
                out += pad + "- " + emit(item, indent + 2)[indent + 2 :]
            else:
                out += f"{pad}- {_bracketed(item)}\n"
        return out
    return pad + inline(value) + "\n"


def _key(key) -> str:
    """A key as written: quoted too where brackets or quotes in it would hide its colon."""
    text = inline(key)
    return _quote(key) if isinstance(key, str) and split_pair(f"{text}: x") != (text, "x") else text


def _nests(value) -> bool:
    return bool(value.items if isinstance(value, Pairs) else isinstance(value, list) and value)


def _bracketed(value) -> str:
    """A value in brackets; texts in it are quoted too where they hold what brackets mean something by."""
    within = lambda v: _quote(v) if isinstance(v, str) and not (_safe(v) and not re.search(r"[,\[\]{}]", v)) else _bracketed(v)
    if isinstance(value, list) and value:
        return "[" + ", ".join(map(within, value)) + "]"
    if isinstance(value, Pairs) and value.items:
        return "{" + ", ".join(f"{within(k)}: {within(v)}" for k, v in value.items) + "}"
    return inline(value)
