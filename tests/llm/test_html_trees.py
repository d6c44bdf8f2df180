"""The likeliest assignment without contradictions against all assignments; boosted trees against a plain walk."""

import itertools
import math
import random

import numpy as np

from cairn.llm import boosting, html_text


def likeliest(up, p):
    """By trying every state (0 boilerplate, 1 article, 2 mixed) of every node."""
    best = None
    for states in itertools.product((0, 1, 2), repeat=len(up)):
        if any(i and states[up[i]] != 2 and states[i] != states[up[i]] for i in range(len(up))):
            continue
        score = sum(math.log(q) if s == 1 else math.log(1 - q) if s == 0 else max(math.log(q), math.log(1 - q)) - 1.5 * (i > 0) for i, (s, q) in enumerate(zip(states, p, strict=True)))
        if best is None or score > best[0]:
            best = score, [s == 1 or (s == 2 and q > 0.5) for s, q in zip(states, p, strict=True)]
    return best[1]


def test_decoding_equals_an_enumeration():
    r = random.Random(1)
    mixed = 0
    for _ in range(250):
        n = r.randint(1, 7)
        up = [0] + [r.randrange(i) for i in range(1, n)]
        p = [r.choice((r.uniform(0.01, 0.99), r.uniform(0.01, 0.1), r.uniform(0.9, 0.99))) for _ in range(n)]
        got = html_text.decode(np.array(up), np.array(p))
        assert got == likeliest(up, p)
        mixed += len(set(got)) == 2
    assert mixed > 50


def test_trees_equal_a_plain_walk():
    r = np.random.default_rng(2)
    x = r.integers(0, 6, (400, 5)).astype(float)
    trees = boosting.train(x, ((x[:, 0] > 2) ^ (x[:, 3] > 3)).astype(float), trees=12, depth=3)

    def walk(row):
        total = trees.bias
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-total))

    found = trees.probability(x)
    assert np.allclose(found, [walk(row) for row in x])
    assert ((found > 0.5) == ((x[:, 0] > 2) ^ (x[:, 3] > 3))).mean() > 0.97
