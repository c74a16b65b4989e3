"""What a document's body says, line by line: links, footnotes, citations and the computation block."""

from __future__ import annotations

import re

from .yaml_subset import lines_of

_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})")
_HEADING = re.compile(r"\s*(#{1,6})(?!#)(?:[ \t](.*))?", re.DOTALL)
_DEFINITION = re.compile(r"\s{0,3}\[\^([^\]]*)\]:")
_LABEL = re.compile(r"\[\^([^\[\]]*)\]")
_BRACKET = re.compile(r"\\.|[\[\]()]", re.DOTALL)


def split_document(text: str) -> tuple[str | None, str, str | None]:
    """(frontmatter text or None, body, error) of a file."""
    lines = lines_of(text)
    if not lines or lines[0].strip() != "---":
        return None, text, None
    end = next((i for i, line in enumerate(lines[1:], 1) if line.strip() == "---"), None)
    if end is None:
        return None, "", "Unterminated YAML frontmatter block"
    return "\n".join(lines[1:end]), "\n".join(lines[end + 1 :]).removeprefix("\n"), None


def percent_decoded(text: str) -> str | None:
    """Text with its valid escapes decoded; None if it has none or they give no UTF-8."""
    if not _ESCAPE.search(text):
        return None
    parts = _ESCAPE.split(text)
    raw = b"".join(bytes([int(p, 16)]) if i % 2 else p.encode() for i, p in enumerate(parts))
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


def code_free(body: str) -> list[tuple[int, str]]:
    """(line number, line) outside code fences, with inline code as spaces."""
    out, fence = [], ""
    for number, line in enumerate(lines_of(body), 1):
        mark = line.lstrip()[:3]
        if fence:
            fence = "" if mark == fence else fence
        elif mark in ("```", "~~~"):
            fence = mark
        else:
            pieces = line.split("`")
            out.append((number, " ".join(" " * len(p) if i % 2 else p for i, p in enumerate(pieces))))
    return out


class _Brackets:
    """Links of one line. One pass pairs up all its brackets, so that a line takes time in proportion to its length."""

    def __init__(self, line: str) -> None:
        self.line = line
        self.openers: list[int] = []  # of square brackets, in order
        self.closer: dict[int, int] = {}
        waiting: dict[str, list[int]] = {"]": [], ")": []}
        for m in _BRACKET.finditer(line):
            mark, at = m[0], m.start()
            if mark in ("[", "("):
                waiting["]" if mark == "[" else ")"].append(at)
                if mark == "[":
                    self.openers.append(at)
            elif mark in waiting and waiting[mark]:
                self.closer[waiting[mark].pop()] = at

    def link(self, at: int) -> tuple[str, str, int] | None:
        """(text, target, end) of the link whose bracket opens at ``at``."""
        close = self.closer.get(at, -1)
        end = self.closer.get(close + 1, -1)
        if close < 0 or end < 0 or self.line[close + 1] != "(":
            return None
        target = self.line[close + 2 : end].strip()
        if target.startswith("<") and ">" in target:
            target = target[1 : target.index(">")]
        elif m := re.match(r"([^ \t]*)[ \t]\s*[\"']", target):
            target = m[1]
        return self.line[at + 1 : close], target, end + 1


def links(body: str) -> list[tuple[str, str, str | None]]:
    """(text, target, percent-decoded target without anchor or None) of each inline link, in order."""
    out = []
    for _, line in code_free(body):
        if "](" not in line:
            continue
        brackets, done = _Brackets(line), 0
        for at in brackets.openers:
            if at >= done and (found := brackets.link(at)):
                out.append((found[0], found[1], percent_decoded(found[1].split("#")[0])))
                done = found[2]
    return out


def footnotes(body: str) -> tuple[list[tuple[str, int]], list[tuple[str, str, int]]]:
    """References (label, line) and definitions (label, text, line)."""
    refs, defs = [], []
    for number, line in code_free(body):
        m = _DEFINITION.match(line)
        if m and m[1].strip():
            defs.append((m[1].strip(), line[m.end() :].strip(), number))
            line = line[m.end() :]
        refs += [(label, number) for m in _LABEL.finditer(line) if (label := m[1].strip())]
    return refs, defs


def citations(body: str) -> list[tuple[int, str | None, str | None, str]]:
    """(number, text, target, raw) of the legacy list under a Citations heading."""
    out, inside = [], False
    for line in map(str.strip, lines_of(body)):
        if line.startswith("#"):
            if inside:
                break
            inside = line.lstrip("#").strip().lower() == "citations"
        elif inside and (m := re.match(r"\[\s*(\+?[0-9]+)\s*\]", line, re.ASCII)) and len(m[1]) < 4000 and int(m[1]) < 2**32:
            raw = line[m.end() :].strip()
            link = _Brackets(raw).link(raw.index("[")) if "[" in raw else None
            out.append((int(m[1]), link[0] if link else None, link[1] if link else None, raw))
    return out


def heading(line: str) -> tuple[int, str] | None:
    m = _HEADING.fullmatch(line)
    return (len(m[1]), (m[2] or "").strip().rstrip("#").strip()) if m else None


def _dedented(line: str, n: int) -> str:
    return line[1:] if line.startswith("\t") else line[min(n, len(line) - len(line.lstrip(" "))) :]


def computation(body: str) -> tuple[str, str | None, bool] | None:
    """(code, language, fenced) of the first block under the first Computation heading."""
    section, level = [], 0
    for line in lines_of(body):
        head = heading(line)
        if not level:
            level = head[0] if head and head[1].lower() == "computation" else 0
        elif head and head[0] <= level:
            break
        else:
            section.append(line)
    code: list[str] = []
    language, fenced = None, False
    for i, line in enumerate(section):
        mark = line.lstrip()[:3]
        if mark in ("```", "~~~"):
            fenced, language = True, line.lstrip()[3:].strip() or None
            for inner in section[i + 1 :]:
                if inner.lstrip().startswith(mark):
                    break
                code.append(_dedented(inner, len(line) - len(line.lstrip())))
            break
    if not _trimmed(code):  # an empty fence leaves it to an indented block
        code, language, fenced = [], None, False
        for line in section:
            if line.startswith(("    ", "\t")):
                code.append(_dedented(line, 4))
            elif line.strip() and code:
                break
            elif code:
                code.append("")
    code = _trimmed(code)
    return ("\n".join(code), language, fenced) if code else None


def _trimmed(lines: list[str]) -> list[str]:
    """Without blank lines at both ends."""
    full = [i for i, line in enumerate(lines) if line.strip()]
    return lines[full[0] : full[-1] + 1] if full else []


def section(body: str, title: str) -> list[str]:
    """Lines with text under each first-level heading that reads exactly ``title`` (given with its ``# ``)."""
    out, inside = [], False
    for line in lines_of(body):
        if line.strip().startswith("# "):
            inside = line.strip() == title
        elif inside and line.strip():
            out.append(line)
    return out
