"""A frequent context that is dealt out seats about as many tables as whole."""

import numpy as np
import pytest

from emberglass.llm import hpylm


def test_the_top_word_of_a_dealt_room(n=57):
    p = 1 / np.arange(1, 20001) ** 1.05
    p /= p.sum()
    c = np.bincount(np.random.default_rng(0).choice(20000, 400_000, p=p), minlength=20000)
    c, q = c[c > 0], p[c > 0]

    def top(part, share):
        return hpylm.seat(c[part], np.zeros(len(c[part]), np.int64), q[part], 0.8, 1.0, np.random.default_rng(1), share)[0][0]

    assert top(slice(None, None, n), 1 / n) == pytest.approx(top(slice(None), 1.0), rel=0.1)
