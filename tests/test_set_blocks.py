"""What sets share, counted in blocks."""

import random

import numpy as np

from stagesignal.operators import setjoin


def test_shared_values_of_blocks_are_those_of_sets(monkeypatch):
    """Frequent and rare values, empty sets, values that one side lacks."""
    draw = random.Random(3)
    for often in (0, 2, 500):
        monkeypatch.setattr(setjoin, "FREQUENT", often)
        a, b = ([draw.sample(range(start, start + 60), draw.choice([0, 1, 5, 30])) for _ in range(n)] for start, n in ((0, 17), (20, 23)))
        flat = lambda sets: (np.array([v for s in sets for v in s], np.int64), np.array([k for k, s in enumerate(sets) for _ in s], np.int64))
        got = setjoin._shared(*flat(a), len(a), *flat(b), len(b))
        assert got.tolist() == [[len(set(x) & set(y)) for y in b] for x in a]
