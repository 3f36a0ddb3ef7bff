"""Operator 10 against its dealt method: suffix array by external induced sorting, then common prefixes."""

import random

import pytest

from tests.llm.induced import common_prefixes, suffix_array


@pytest.mark.parametrize("text", [b"", b"a", b"aaaa", b"banana", b"mississippi", b"abcabcabc", b"ba" * 50])
def test_known_texts(text):
    assert suffix_array(text, 4) == sorted(range(len(text)), key=lambda i: text[i:])


def test_random_texts_with_spilling_queues():
    rng = random.Random(5)
    for n in (10, 50, 300, 1000):
        for letters in (2, 4, 200):
            text = bytes(rng.randrange(letters) for _ in range(n))
            assert suffix_array(text, 16) == sorted(range(n), key=lambda i: text[i:])


def test_operator_agrees_with_the_suffix_array(spark):
    from orgpulse.llm import passages
    from tests.llm.fixtures import docs, rows

    data = sorted({(i, t) for i, t, *_ in rows(n=40) if i is not None and t and len(t) < 5000})
    whole, begins = [], []
    for k, (_, text) in enumerate(data):  # every document ends in a separator of its own
        begins.append(len(whole))
        whole += [b + len(data) for b in text.encode()] + [k]
    order = suffix_array(whole, 1000)
    shared = common_prefixes(whole, order)
    repeated, group = set(), []
    for place, position in enumerate([*order, None]):
        if position is not None and shared[place] >= 100:
            group.append(position)
            continue
        repeated |= set(group) - {min(group, default=0)}
        group = [position] if position is not None else []
    gone = {p + k for p in repeated for k in range(100)}
    expected = {i: sum(1 for k in range(len(t.encode())) if b + k in gone) for (i, t), b in zip(data, begins)}
    got = passages.remove_repeats(docs(spark, [(i, t, "en", "s") for i, t in data])).collect()
    assert {r.doc_id: r.n_removed for r in got} == expected and sum(expected.values()) > 1000
