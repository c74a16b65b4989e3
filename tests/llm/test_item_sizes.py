"""Recall of short benchmark items, whatever the other items are."""

import random

import pytest

from loomwright.llm import decontaminate


def found(texts, items):
    codes = decontaminate.item_codes(items)
    return {(t, k) for t, k, _, _ in decontaminate.find_in(texts, codes, decontaminate.size_classes(codes))}


@pytest.mark.parametrize("small,words", [(4, 5), (8, 10), (9, 11), (8, 9)])
def test_edited_items_longer_than_the_shortest_of_their_class(small, words):
    rng = random.Random(words)
    word = lambda: f"w{rng.randrange(100_000)}"
    items = [" ".join(word() for _ in range(words)) for _ in range(400)]
    texts = []
    for item in items:
        leak = item.split()
        for at in rng.sample(range(words), int(words * 0.2)):
            leak[at] = word()
        texts.append(" ".join([word() for _ in range(5)] + leak + [word() for _ in range(5)]))
    shortest = " ".join(word() for _ in range(small))
    got = found(texts, [*items, shortest])
    assert sum((k, k) in got for k in range(400)) >= 0.93 * 400
    assert got == found(texts, items)  # other items of a pass change nothing


def test_items_of_two_words_match_exactly():
    texts = ["say Golden, Gate twice", "golden x gate", "gate golden", "golden gate"]
    assert found(texts, ["golden gate", "single", ""]) == {(0, 0), (3, 0)}
