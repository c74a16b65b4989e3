"""The frontmatter's YAML subset."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomwright.functions import yaml_subset as y


@pytest.mark.parametrize(("text", "value"), [
    ("42", 42), ("-7", -7), ("+7", 7), ("0", 0), ("007", "007"), ("2.5", 2.5), (".5", 0.5), ("5.", 5.0), ("1e3", "1e3"), ("1.5e3", 1500.0),
    ("99999999999999999999", "99999999999999999999"), ("~", None), ("null", None), ("", None), ("true", True), ("FALSE", False), ("yes", "yes"), ("on", "on"),
    (".inf", math.inf), ("-.INF", -math.inf), ('"42"', "42"), ("'it''s here'", "it's here"), ('"a\\nb\\u00e9"', "a\nbé"), ("plain # comment", "plain"),
    ("a#b", "a#b"), ("2026-06-20T22:53:05Z", "2026-06-20T22:53:05Z"), ("&x foo", "&x foo"), ("*x", "*x"), ("!!str y", "!!str y"), ("'a' # note", "a"),
])
def test_scalars(text, value):
    assert y.parse(f"k: {text}").get("k") == value and type(y.parse(f"k: {text}").get("k")) is type(value)


def pairs(*items):
    return y.Pairs(list(items))


@pytest.mark.parametrize(("text", "value"), [
    ("a: 1\nb: two\n", pairs(("a", 1), ("b", "two"))),
    ("tags: [sales, 'a, b', \"c\"]", pairs(("tags", ["sales", "a, b", "c"]))),
    ("tags:\n- a\n- b\nx: 1", pairs(("tags", ["a", "b"]), ("x", 1))),
    ("tags:\n  - a\n  -\n    - b", pairs(("tags", ["a", ["b"]]))),
    ("s:\n- id: 1\n  r: x\n- id: 2", pairs(("s", [pairs(("id", 1), ("r", "x")), pairs(("id", 2))]))),
    ("g: { by: human:x, at: 2026-06-20T09:00:00Z }", pairs(("g", pairs(("by", "human:x"), ("at", "2026-06-20T09:00:00Z"))))),
    ("g: {a:1}", pairs(("g", pairs(("a:1", None))))),
    ("g: {a: [1, {b: 2}], }", pairs(("g", pairs(("a", [1, pairs(("b", 2))]))))),
    ("d: first\n  second\n  third", pairs(("d", "first second third"))),
    ("d: 'first\n  second'\ne: 1", pairs(("d", "first second"), ("e", 1))),
    ("d: |\n  a\n   b\n\n  c\n", pairs(("d", "a\n b\n\nc\n"))),
    ("d: >-\n  a\n  b\n\n  c\n", pairs(("d", "a b\nc"))),
    ("d: |+\n  a\n\n", pairs(("d", "a\n\n"))),
    ("a: 1\na: 2\n42: x", pairs(("a", 1), ("a", 2), (42, "x"))),
    ("# only a comment", None), ("a:\nb:\n  c: 1", pairs(("a", None), ("b", pairs(("c", 1))))),
    ("'quoted: key': v", pairs(("quoted: key", "v"))), ("url: http://x/y", pairs(("url", "http://x/y"))), ("x: - a", pairs(("x", "- a"))),
])
def test_structures(text, value):
    assert y.parse(text) == value


@pytest.mark.parametrize(("text", "line", "message"), [
    ('k: "\\q"', 1, "unknown escape"), ('k: "\\u12"', 1, "truncated"), ('k: "\\uD800"', 1, "invalid Unicode"), ('k: "\\uzzzz"', 1, "malformed"), ("tags: [a, b", 1, "flow sequence"),
    ("k: {a: 1", 1, "flow mapping"), ("a:\n\tb: 1", 2, "tab"), ("a: 1\n  b: 2\n c: 3", 2, "unexpected"), ("k: 'x' y", 1, "after closing"), ("k: 'x", 1, "unterminated"), ("a: 1\njunk", 2, "key: value"),
])
def test_errors(text, line, message):
    with pytest.raises(y.YamlError) as e:
        y.parse(text)
    assert message in e.value.message and e.value.line == line


def test_first_of_repeated_keys_wins_and_odd_keys_hide():
    m = y.parse("a: 1\na: 2\ntrue: x")
    assert m.get("a") == 1 and m.get("true") is None and not m.has("true")


def test_empty_values():
    assert [y.is_empty(v) for v in (None, False, 0, "", [], pairs())] == [True] * 6
    assert [y.is_empty(v) for v in (0.0, " ", True, 1, "0", [None])] == [False] * 6


def test_display_and_canonical():
    assert [y.display(v) for v in (1, True, 1.0, 1e16, 1.5, "x", None, [])] == ["1", "true", "1", "10000000000000000", "1.5", "x", None, None]
    assert y.canonical(1) != y.canonical(1.0) != y.canonical("1") and y.canonical(pairs(("a", 1), ("b", 2))) != y.canonical(pairs(("b", 2), ("a", 1)))


@pytest.mark.parametrize(("value", "text"), [
    ("plain", "plain"), ("", '""'), ("a: b", '"a: b"'), ("a:", '"a:"'), ("x #y", '"x #y"'), ("42", '"42"'), ("true", '"true"'), ("- a", '"- a"'), ("2026-06-20T22:53:05Z", '"2026-06-20T22:53:05Z"'),
    ("2026-06-20", "2026-06-20"), (1.0, "1.0"), (1e16, "1.0e16"), (1e-7, "1.0e-7"), (1.5, "1.5"), (None, "null"), ([], "[]"), (pairs(), "{}"), ("a\nb", '"a\\nb"'), ("\x01\n", '"\\u0001\\n"'),
])
def test_written_scalars(value, text):
    assert y.inline(value) == text


texts = st.text(st.characters(codec="utf-8", exclude_characters="\r"), max_size=12)
values = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False) | texts, lambda c: st.lists(c, min_size=1, max_size=3) | st.lists(st.tuples(texts, c), min_size=1, max_size=3).map(lambda items: y.Pairs(items)), max_leaves=8)


@given(st.lists(st.tuples(texts, values), min_size=1, max_size=4))
def test_what_is_written_reads_back(items):
    assert y.parse(y.emit(y.Pairs(items))) == y.Pairs(items)


@given(st.text(max_size=80))
def test_any_text_reads_or_fails_cleanly(text):
    try:
        y.parse(text)
    except y.YamlError as e:
        assert e.line >= 1


def test_keys_and_texts_in_brackets_read_back():
    for key in ("0}", "a]", "{", "x, y", "[z"):
        value = y.Pairs([("k", [[y.Pairs([(key, None), ("b", key)])], [key]])])
        assert y.parse(y.emit(value)) == value
