"""Pairs that meet too late in the order to be similar don't become candidates."""

import numpy as np

from millrace.llm import set_join


def pairs(left):
    bits = np.zeros((2, set_join.BITS // 64), np.uint64)
    n = np.array([90, 90])
    got = list(set_join._compared(np.array([5, 5]), np.array([1, 2]), np.array([1, 2]), n, np.array(left), bits))
    return [(int(x), int(y)) for a, b in got for x, y in zip(a, b)]


def test_only_pairs_that_can_still_be_similar():
    assert pairs([90, 90]) == [(1, 2)]
    assert pairs([80, 90]) == pairs([90, 80]) == [(1, 2)]  # 80 of 100 is 0.8
    assert pairs([79, 90]) == pairs([90, 79]) == []


def test_similar_sets_pass_at_their_first_shared_member():
    rng = np.random.default_rng(8)
    for n in (1, 4, 5, 9, 10, 50, 333):
        for _ in range(50):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.permutation(n)[: n - n // 9]], rng.integers(0, 1 << 62, n // 12).astype(np.uint64)]))
            if set_join.similar(a, b):
                common = np.unique(np.concatenate([a[::2], b[:3]]))
                p, q = (set_join.prefix(x, common, np.arange(len(common))) for x in (a, b))
                i = next(k for k, x in enumerate(p) if x in q)
                j = list(q).index(p[i])
                assert 9 * min(len(a) - i, len(b) - j) >= 4 * (len(a) + len(b))
