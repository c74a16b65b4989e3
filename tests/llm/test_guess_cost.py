"""The guess cost against every segmentation of short values, and its dictionary."""

import math
import random
import re
from functools import cache

import pytest

from loomwright.llm import secrets


def span_costs(value, ranks):
    """(start, end, bits) of all that a stretch of the value can be, by definition and without sharing."""
    low = value.lower()
    plain = low.translate(secrets._LEET)
    n = len(value)
    for a in range(n):
        for b in range(a + 1, n + 1):
            part = value[a:b]
            if b - a == 1:
                yield a, b, secrets._brute_bits(part)
            if b - a >= 3 and len(set(part)) == 1:
                yield a, b, secrets._brute_bits(part[0]) + math.log2(b - a) + 1
            if b - a >= 3 and all(low[i : i + 2] in secrets._NEXT for i in range(a, b - 1)):
                yield a, b, math.log2(47) + math.log2(b - a) + 2
            for form, extra in ((low, 1), (plain, 3)):
                if b - a >= 3 and form[a:b] in ranks:
                    yield a, b, math.log2(ranks[form[a:b]]) + (part != low[a:b]) + extra
            if b - a in (4, 8, 10) and secrets._DATE.fullmatch(part):
                yield a, b, math.log2(120 * (365 if b - a > 4 else 1)) + (b - a == 10) * 2
            m = b - a
            if 2 <= m <= 8 and a >= m and value[a - m : a] == part:
                yield a, b, math.log2(8) + 1


def every_segmentation(value, ranks):
    by_start = {}
    for a, b, bits in span_costs(value, ranks):
        by_start.setdefault(a, []).append((b, bits))

    @cache
    def cheapest(at):
        return 0.0 if at == len(value) else min(bits + cheapest(b) for b, bits in by_start[at])

    return cheapest(0)


@pytest.mark.parametrize("seed", range(6))
def test_cost_is_the_cheapest_of_all_segmentations(seed):
    rng = random.Random(seed)
    ranks = secrets.ranked_words(None) | {"zed": 7, "abba": 900}
    pieces = ["pass", "word", "2019", "201", "99", "9999", "qwe", "rty", "abab", "aaa", "P4ss", "zed", "abba", "X", "!", "é", "monday", "12", "20190102"]
    for _ in range(150):
        value = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 4)))[: rng.randrange(1, 12)]
        assert secrets.guess_bits(value, ranks) == pytest.approx(every_segmentation(value, ranks)), value


@pytest.mark.parametrize("seed", range(4))
def test_long_repeats_and_walks_begin_where_it_is_cheapest(seed):
    """Values of 30 to 60 characters, whose repeats and walks can begin inside other parts."""
    rng = random.Random(seed)
    ranks = secrets.ranked_words(None) | {"lettuce": 300, "bee": 40, "asdf": 50, "eee": 5, "abcabc": 9}
    pieces = ["cheese", "lettuce", "bee", "e" * 30, "e" * 7, "x" * 20, "asdf", "qwertyuiopoiuytrewq" * 2, "asdfghjkl", "1" * 25, "2011", "9999", "abc", "É"]
    for _ in range(25):
        value = "".join(rng.choice(pieces) for _ in range(rng.randrange(3, 7)))[:60]
        assert secrets.guess_bits(value, ranks) == pytest.approx(every_segmentation(value, ranks)), value


@pytest.mark.parametrize(("value", "secret"), [("snorfeltrampling", True), ("snorfeltrampling7", True), ("dragonmonkeycheese" + "e" * 40, False), ("masterlettuce" + "e" * 30, False), ("john.smith@example.com", False), ("é#ß!éüñ", True)])
def test_values_are_judged_by_their_cost_alone(value, secret):
    assert bool(secrets.guessed_spans(f"login: {value}", [])) == secret


def test_words_come_in_the_order_of_the_vocabulary():
    ranks = secrets.ranked_words()
    assert 10_000 < len(ranks) <= secrets.MOST_WORDS and ranks["the"] == 1
    assert sorted(ranks.values()) == list(range(1, len(ranks) + 1))
    with pytest.raises(FileNotFoundError):  # results never depend unseen on which files a machine has
        secrets.ranked_words("/no/such/file")
    assert secrets.guess_bits("elephantgarden7", ranks) < 38 < secrets.guess_bits("elephantgarden7", secrets.ranked_words(None))


def test_very_long_values_take_linear_time():
    import time

    began = time.perf_counter()
    secrets.redact("token is " + "a1" * 50_000 + " passphrase: " + "x" * 100_000)
    assert time.perf_counter() - began < 30 and re.search("secret", secrets.redact("pwd: xK9#mQ2$vL7p"))
