"""Tables sampled for a word follow their exact posterior, whatever the number of customers."""

import numpy as np
import pytest

from emberglass.llm import hpylm


def exact_mean(c, d, theta, q, rest=0.0):
    """By the recurrence over customers, on all numbers of tables that matter."""
    most = min(c, 3000)
    s = np.full(most + 1, -np.inf)
    s[0] = 0
    for n in range(c):
        t = np.arange(1, most + 1)
        s[1:] = np.logaddexp(s[:-1], s[1:] + np.log(np.maximum(n - d * t, 1e-300)))
        s[0] = -np.inf
    t = np.arange(1, most + 1)
    w = s[1:] + np.cumsum(np.log(theta + d * (rest + np.arange(most)))) + t * np.log(q)
    p = np.exp(w - w.max())
    return float((p * t).sum() / p.sum())


@pytest.mark.parametrize("c, q", [(2, 0.3), (48, 0.01), (49, 0.01), (49, 0.5), (1000, 0.01), (1000, 0.5), (1500, 0.01), (4000, 0.05), (4000, 0.9)])
def test_tables_of_one_word(c, q, d=0.8, theta=1.0):
    rng, n = np.random.default_rng(0), 300
    got = hpylm.seat(np.full(n, c), np.arange(n), np.full(n, q), d, theta, rng)[0]  # a room each
    assert got.mean() == pytest.approx(exact_mean(c, d, theta, q), rel=0.05)
