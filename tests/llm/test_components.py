from __future__ import annotations

import random

import pytest

from navloom.llm import components, ngram_join


def smallest(links):
    """Component of each node, by union and find."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {x: top(x) for x in up}


def shapes():
    r = random.Random(11)
    names = r.sample(range(1_000_000), 5000)
    path = list(zip(names, names[1:]))
    yield "path", path
    yield "ring", [*path, (names[-1], names[0])]
    yield "tree", [(names[i], names[(i - 1) // 2]) for i in range(1, 5000)]
    yield "ordered path", [(i, i + 1) for i in range(5000)]
    yield "star and forest", [(names[0], x) for x in names[1:2000]] + [(names[2000 + r.randrange(i)], names[2000 + i]) for i in range(1, 2500) if i % 50]
    yield "odd", [(1, 1), (2, 3), (3, 2), (2, 3), (5, 4)]


@pytest.mark.parametrize(("name", "links"), list(shapes()), ids=[n for n, _ in shapes()])
def test_components_of_shuffled_graphs_settle_in_few_rounds(spark, monkeypatch, name, links):
    rounds, hooked = [], components._hooked
    monkeypatch.setattr(components, "_hooked", lambda x: rounds.append(1) or hooked(x))
    random.Random(1).shuffle(links)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == smallest(links)
    assert len(rounds) < 20


def test_no_links(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_chain_of_shifted_documents_is_one_group(make_docs):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(8 * 1200 + 200)]
    texts = [" ".join(words[8 * i : 8 * i + 200]) for i in range(1200)]
    r.shuffle(texts)
    got = ngram_join.near_duplicate_classes(make_docs(texts), 3, 90).collect()
    assert {x.component_id for x in got} == {0}
