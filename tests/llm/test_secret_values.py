"""Values in a credential context: the guess cost alone decides, and the whole value goes."""

import pytest

from loomwright.llm import secrets


@pytest.mark.parametrize("value", ["Xk!fQz-PwTrm", "qWxZrTpLmNbVcY", "qwxzrtplmnbvcy", "%&fGq!?xW-zP", "xK9#mQ2,vL7p;Zr<4>q", "kadirotuneva7"])
def test_the_whole_value_goes(value):
    for before, after in (("passphrase: ", ""), ("login: ", " and more"), ("my pwd is ", "."), ("credentials='", "'"), ("login passcode: ", "")):
        assert secrets.redact(before + value + after) == before + "[secret]" + after


def test_value_that_reaches_beyond_a_pattern():
    text = "password=Tr0ub4d/or&3xYz!9 next"
    assert secrets.redact(text) == "[secret] next"
    assert [secrets.KINDS[k] for _, k, _ in secrets.spans_of(text)[1]] == ["assign", "guess"]
    assert [secrets.KINDS[k] for _, k, _ in secrets.spans_of("password=Tr0ub4d9xYzQ next")[1]] == ["assign"]


@pytest.mark.parametrize(
    "text",
    [
        "The password is important. A login information page; token classification, token embeddings and token representations.",
        "secret: understanding, login: monday2019! passphrase: correct bearer certificates",
        "The credentials are: Administrator Secret Intelligence Service PASSWORD REQUIREMENTS token distribution",
    ],
)
def test_prose_stays(text):
    assert secrets.guessed_spans(text, []) == []
