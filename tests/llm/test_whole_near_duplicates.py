"""keep_one() finds every pair that brute force finds."""

import hashlib
import random

from emberglass.llm import simhash


def grams(text, n=5):
    w = text.lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def alike(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows, similarity=0.8):
    """Least id of each component."""
    root = {i: i for i, _ in rows}
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if root[i] != root[j] and alike(a, b) >= similarity:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {n: new if r == old else r for n, r in root.items()}
    return sorted(set(root.values()))


def kept(spark, rows):
    return sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_pairs_in_full_buckets_are_found(spark):
    """Many texts of nearly one word set share the index's buckets; likes are not next to each other there."""
    rng = random.Random(4)
    vocab, rows = [f"v{k}" for k in range(120)], []
    for k in range(60):
        w = rng.sample(vocab, len(vocab))
        rows += [(k, " ".join([*w, f"a{k}"])), (100 + k, " ".join([*w, f"b{k}"]))]
    assert kept(spark, rows) == brute(rows) == list(range(60))


def test_members_of_one_fingerprint_are_compared_with_each_other(spark):
    """Equal word sets, so equal fingerprints; the two that are alike are not alike to the bucket's head."""
    rng, rows = random.Random(5), []
    for k in range(5):
        w = [f"w{k}x{j}" for j in range(100)]
        a, b = " ".join(w), " ".join([w[1], w[0], *w[2:]])
        head = a
        while not hashlib.md5(head.encode()).hexdigest() < min(hashlib.md5(x.encode()).hexdigest() for x in (a, b)):
            head = " ".join(rng.sample(w, len(w)))
        rows += [(k, head), (10 + k, a), (20 + k, b)]
    assert kept(spark, rows) == brute(rows) == [*range(5), *range(10, 15)]


def test_no_pair_near_the_threshold_is_lost(spark):
    """300 texts with a copy each whose likeness is 0.8 to 0.9, or just below."""
    rng, rows, near = random.Random(6), [], 0
    common = [f"c{k}" for k in range(30)]
    for k in range(300):
        w = [rng.choice(common) if rng.random() < 0.3 else f"u{rng.randrange(10**6)}" for _ in range(rng.randint(40, 160))]
        e = list(w)
        for at in rng.sample(range(len(w)), max(1, round(len(w) * rng.uniform(0.01, 0.03)))):
            e[at] = f"e{rng.randrange(10**6)}"
        rows += [(k, " ".join(w)), (1000 + k, " ".join(e))]
        near += 0.8 <= alike(rows[-2][1], rows[-1][1]) <= 0.9
    rows += [(2000, ""), (2001, " \n"), (2002, "one two"), (2003, "One  two")]
    assert near > 40 and kept(spark, rows) == brute(rows)


def test_long_texts_that_only_begin_alike_are_told_apart_by_their_parities(spark):
    """1024 parities are full at some thousand shingles; those sized to the text refuse what they can't, and lose none."""
    import numpy as np

    rng = np.random.default_rng(7)
    rows = []
    for n, changed in ((3000, 900), (3000, 0), (3000, 300), (3000, 1500), (1100, 30), (700, 500), (300, 10)):
        one = np.unique(rng.integers(-(2**62), 2**62, n))
        two = np.unique(np.concatenate([one[changed:], rng.integers(-(2**62), 2**62, changed + n // 12)]))
        rows.append((simhash._parities(one), simhash._parities(two), simhash._fine(one), simhash._fine(two), len(np.setxor1d(one, two)), len(one) + len(two)))
    df = spark.createDataFrame(rows, "oa array<long>, ob array<long>, fa array<long>, fb array<long>, apart int, sizes int")
    got = df.select(simhash._differ("oa", "ob").alias("coarse"), simhash._differ("fa", "fb").alias("fine"), "apart", "sizes").collect()
    assert all(max(r["coarse"], r["fine"]) <= r["apart"] for r in got)
    refused = [(r["coarse"] * 1.8 > r["sizes"] * 0.2, r["fine"] * 1.8 > r["sizes"] * 0.2) for r in got]
    assert refused[0] == refused[3] == (False, True)
    assert not any(any(x) for x, r in zip(refused, got) if r["apart"] * 1.8 <= r["sizes"] * 0.2)
