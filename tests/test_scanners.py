"""Markdown scanner and dates."""

import datetime
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomwright.functions import dates
from loomwright.functions import markdown as m
from loomwright.sources.parse import parse_file


@pytest.mark.parametrize(("body", "found"), [
    ("[a](b.md)", [("a", "b.md")]), ("![alt](i.png)", [("alt", "i.png")]), (r"\[a](b.md)", []), (r"\\[a](b.md)", [("a", "b.md")]),
    ("[![i](x.png)](y.md)", [("![i](x.png)", "y.md")]), ("[a [b] c](d(e).md)", [("a [b] c", "d(e).md")]), ("[a](<my notes.md>)", [("a", "my notes.md")]),
    ('[a](b.md "title")', [("a", "b.md")]), ("[a](b c.md)", [("a", "b c.md")]), ("`[a](b.md)` [c](d.md)", [("c", "d.md")]), ("```\n[a](b.md)\n```\n[c](d)", [("c", "d")]),
    ("~~~\n```\n[a](b)\n~~~\n[c](d)", [("c", "d")]), ("[a] (b)", []), ("[a](b", []), ("    [a](b)", [("a", "b")]), ("x ` [a](b)", []), ("[](b)", [("", "b")]), ("[a]()", [("a", "")]),
])
def test_links(body, found):
    assert [(t, r) for t, r, _ in m.links(body)] == found


@pytest.mark.parametrize(("text", "decoded"), [("my%20notes.md", "my notes.md"), ("a+b%20c", "a+b c"), ("100%.md", None), ("%C3%A9", "é"), ("%C3", None), ("plain", None), ("%zz%41", "%zzA")])
def test_percent(text, decoded):
    assert m.percent_decoded(text) == decoded


def test_footnotes():
    body = "See[^a] and [^b][^a].\n\n[^a]: first [^c]\n    [^d]: too deep\n`[^x]`\n[^ ]\n"
    refs, defs = m.footnotes(body)
    assert [r[0] for r in refs] == ["a", "b", "a", "c", "d"]
    assert defs == [("a", "first [^c]", 3)]


def test_citations():
    assert m.citations("# Citations\n\n[1] [S](http://x) more\n[x] no\nplain\n[2] bare\n# Next\n[3] [T](y)") == [(1, "S", "http://x", "[S](http://x) more"), (2, None, None, "bare")]
    assert m.citations("[1] [S](x)") == []


@pytest.mark.parametrize(("body", "made"), [
    ("# Computation\n\n```sql\nSELECT 1\n```\n", ("SELECT 1", "sql", True)), ("## computation ##\n\n    a\n\n    b\n\ntext\n", ("a\n\nb", None, False)),
    ("# Computation\n```\n# note\nx\n```", None), ("# Other\n```\nx\n```", None), ("# Computation\n  ~~~ py\n  a\n    b\n  ~~~\n", ("a\n  b", "py", True)), ("# Computation\n### Sub\n```\nx\n```", ("x", None, True)),
])
def test_computation(body, made):
    if "# note" in body:  # the comment ends the section, so what is left of the fence is empty
        assert m.computation(body) is None
    else:
        assert m.computation(body) == made


@pytest.mark.parametrize(("text", "parts"), [
    ("---\na: 1\n---\n\nBody\n", ("a: 1", "Body", None)), ("no front\r\nx", (None, "no front\r\nx", None)), ("---\r\na: 1\r\n---\r\nB\r\n", ("a: 1", "B", None)),
    ("---\na: 1\n", (None, "", "Unterminated YAML frontmatter block")), ("\ufeff---\na: 1\n---\n", (None, "\ufeff---\na: 1\n---\n", None)), ("", (None, "", None)), ("---\n---\n", ("", "", None)),
])
def test_split(text, parts):
    assert m.split_document(text) == parts


def test_section():
    assert m.section("# Schema\na\n\n b\n# Other\nc\n# Schema\nd", "# Schema") == ["a", " b", "d"]


@given(st.dates(min_value=datetime.date(1, 1, 1)))
def test_days(d):
    assert dates.epoch_day(d.isoformat()) == (d - datetime.date(1970, 1, 1)).days


@pytest.mark.parametrize("text", ["2026-02-29", "2026-13-01", "2026-9-23", "2026-00-10", "x", "", "2026-09-23T00:00:00Z"])
def test_no_days(text):
    assert dates.epoch_day(text) is None


@pytest.mark.parametrize(("text", "shown", "has_time"), [
    ("2026-06-20T22:53", "2026-06-20T22:53:00", True), ("2026-06-20 22:53:05.25Z", "2026-06-20T22:53:05.25Z", True), ("2026-06-20", "2026-06-20", False), ("2026-06-20t22:53:60+02:00", "2026-06-20T22:53:60+02:00", True),
    ("2026-06-20T22:53:05,5+0530", "2026-06-20T22:53:05.5+05:30", True), ("2026-06-20T22:53:05-05", "2026-06-20T22:53:05-05:00", True), ("0000-01-01", "0000-01-01", False),
])
def test_instants(text, shown, has_time):
    got = dates.instant(text)
    assert got["text"] == shown and got["has_time"] == has_time


def test_equal_instants_and_bad_ones():
    assert dates.instant("2026-06-20T09:00:00+02:00")["second"] == dates.instant("2026-06-20T07:00:00Z")["second"]
    assert dates.instant("2026-06-20T00:00:00.123456789123Z")["nano"] == 123456789
    for bad in ("2026-06-20T25:00:00Z", "2026-06-20T22:53:05.Z", "2026-06-20X22:53", "2026-06-20T22", "2026-06-20T22:53:05+24:00", "é"):
        assert dates.instant(bad) is None


@pytest.mark.parametrize("line", ["[" * 1_000_000, "[a](" * 250_000, "[^" * 500_000, "\\" * 1_000_000, "[a](b) " * 20_000])
def test_long_lines_take_linear_time(line):
    began = time.perf_counter()
    found = m.links(line)
    m.footnotes(line)
    assert time.perf_counter() - began < 5 and len(found) == line.count("](b)")


def test_deep_frontmatter_is_an_error_not_a_crash():
    for front in ("a: " + "[" * 3000, "a: " + "[" * 3000 + "]" * 3000, "\n".join(" " * i + "a:" for i in range(1500)), "a: " + "{a: " * 300):
        row = parse_file("main", "a.md", f"---\n{front}\n---\n".encode())
        assert row["error_kind"] == "yaml" and "nested more than 100 deep" in row["error"]
    deep = parse_file("main", "a.md", f"---\na: {'[' * 90 + ']' * 90}\n---\n".encode())
    assert deep.get("error") is None and deep["serialized"]
    assert parse_file("main", "a.md", f"---\na: {'1' * 5000}\n---\n".encode())["node"]["a"]["kind"] == "string"
