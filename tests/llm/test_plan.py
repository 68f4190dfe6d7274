from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from heredium.llm.jaccard import least_matches
from heredium.llm.packing import plan


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_uses_every_length_once_and_never_overfills(counts):
    used = Counter()
    for pattern, m in plan(counts, 64):
        assert sum(pattern) <= 64 and m > 0
        for x in pattern:
            used[x] += m
    assert used == Counter(counts)


def test_exact_complements_come_first():
    assert plan({60: 1, 4: 1}, 64) == [((60, 4), 1)]
    assert plan({40: 2, 14: 2, 10: 2}, 64) == [((40, 14, 10), 2)]
    assert plan({30: 1, 20: 1, 9: 1, 5: 1}, 64) == [((30, 20, 9, 5), 1)]
    assert plan({}, 64) == []
    assert sum(m for _, m in plan({32: 10**9}, 64)) == 5 * 10**8


def test_posterior_bounds_never_drop_likely_pairs():
    bounds = least_matches()
    assert list(bounds) == [16, 32, 48, 64, 80, 96]
    assert all(a <= b for a, b in zip(list(bounds.values()), list(bounds.values())[1:])) and bounds[96] < 0.8 * 96
