"""A hierarchical Pitman-Yor language model, and texts scored by it.

Every word is drawn in the restaurant of the word before it (texts begin in a restaurant of their own); all these share
one parent, whose dishes come from a uniform base. In a restaurant, customers who ate a word sit at one or more tables
with it, and each table is a customer of the parent. How many tables there are is sampled by Gibbs, given the room's
other tables, with the weights of all seatings that have so many tables: generalised Stirling numbers, from a table up
to STIRLING customers and by their saddle point beyond. Words with equally many customers (up to CLASS) are drawn at
once from the room's totals before them, the others one group after another. The tables are averaged over SAMPLES
sweeps after BURN_IN, and the predictive probabilities taken from the averages; in a context's own part they are linear
in its tables, the product with the parent's probability is taken of averages. The parent is seated once, on the
contexts' averaged tables; contexts are not seated again for it.

How it is spread out. Texts are cut into blocks; a block's words and pairs of words are packed into a file. Packed
counts of its pairs go to buckets of contexts, where all of a restaurant meets and is seated; the tables of each word
go to buckets of words, where the parent is. Both send back to each block what its own words and pairs need. No count
is cut off and nothing of the corpus goes to the driver but a few sums. Three things are approximate: words are known
by 48 bits of a hash; while it is being seated, a bucket takes the parent's probabilities from its own pairs, so scores
move a little with the number of buckets, which depends on the number of tokens alone; very frequent contexts (over one in HOT of all tokens) are dealt over many buckets, each of which takes the others to be
like itself.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberglass.llm.files import filesystem
from emberglass.llm.text import slices, texts, words
from emberglass.storage import Scratch

#: Discount and strength of the contexts' restaurants and of their parent.
DISCOUNT, STRENGTH, ROOT_DISCOUNT, ROOT_STRENGTH = 0.8, 1.0, 0.6, 1.0
BURN_IN, SAMPLES, CLASS, STIRLING = 2, 3, 48, 1024
#: Tokens of a block, tokens whose pairs or words share a bucket, share of all tokens from which a context is dealt out.
BLOCK, PAIR_BUCKET, WORD_BUCKET, HOT = 600_000, 1_000_000, 3_000_000, 1000
_ID = (1 << 48) - 1
_BEGIN, _END = 1, 2  # no word's hash can be told from these, but for one in 2**47 words
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of unsigned integers, each with the bytes that its numbers need."""
    parts = [struct.pack("<B", len(columns))]
    for values, width in columns:
        parts += [struct.pack("<QB", len(values), width), values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 1
    for _ in range(data[0]):
        n, width = struct.unpack_from("<QB", data, at)
        at += 9
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        out.append(wide.view("<u8").ravel())
        at += n * width
    return out


def _spread(ids: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = ids * _ODD
        x = (x ^ (x >> np.uint64(32))) * _ODD
    return ((x >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


class Block:
    """Some texts' tokens, as numbers of their different pairs (context, word)."""

    def __init__(self, words_: np.ndarray, n_words: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray, token: np.ndarray, docs: list):
        self.words, self.n_words, self.u, self.w, self.n, self.token, self.docs = words_, n_words, u, w, n, token, docs

    @classmethod
    def of(cls, ids: list[np.ndarray], held: list[bool], doc_ids: list[int | None]) -> Block:
        lens = np.array([len(x) for x in ids])
        tokens = np.concatenate(ids)
        context = np.concatenate([np.array([_BEGIN], np.uint64), tokens[:-1]])
        context[np.cumsum(lens)[:-1]] = _BEGIN
        train = np.repeat(~np.array(held), lens)
        found, at = np.unique(np.concatenate([tokens, np.array([_BEGIN], np.uint64)]), return_inverse=True)
        n_words = np.bincount(at[:-1][train], minlength=len(found))
        pair = np.searchsorted(found, context) * len(found) + at[:-1]
        pairs, token = np.unique(pair, return_inverse=True)
        n = np.bincount(token[train], minlength=len(pairs))
        return cls(found, n_words, pairs // len(found), pairs % len(found), n, token, list(zip(doc_ids, held, lens.tolist())))

    def dump(self) -> bytes:
        """The words and the tokens as numbers of words; pairs are made anew when it is loaded."""
        ids = [d[0] for d in self.docs]
        docs = [(np.array([i or 0 for i in ids], np.int64).view(np.uint64), 8), (np.array([(i is None) * 2 + h for i, h, _ in self.docs]), 1), (np.array([k for _, _, k in self.docs]), 8)]
        return pack((self.words, 6), (self.w[self.token], 4), *docs)

    @classmethod
    def load(cls, blob: bytes) -> Block:
        found, token, ids, flags, lens = unpack(blob)
        texts_ = np.split(found[token.astype(np.int64)], np.cumsum(lens.astype(np.int64))[:-1])
        return cls.of(texts_, [bool(f & 1) for f in flags.tolist()], [None if f & 2 else i for i, f in zip(ids.view(np.int64).tolist(), flags.tolist())])

    def word_order(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(order of the words by bucket, where each of n buckets starts)."""
        bucket = _spread(self.words, n)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(n + 1))

    def pair_order(self, n: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, w = self.words[self.u], self.words[self.w]
        with np.errstate(over="ignore"):
            bucket = _spread(np.where(np.isin(u, hot), u * _ODD + w, u), n)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(n + 1))


@lru_cache(maxsize=4)
def _log_stirling(n: int, d: float) -> np.ndarray:
    """log S(c, t) for c, t up to n: weights of the seatings of c customers at t tables."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(n):
            t = np.arange(1, c + 2)
            s[c + 1, 1 : c + 2] = np.logaddexp(s[c, : c + 1], s[c, 1 : c + 2] + np.log(np.maximum(c - d * t, 1e-300)))
    return s


def _drawn(weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each row of log weights of 1, 2, ... tables a number drawn by them."""
    return np.argmax(weights + rng.gumbel(size=weights.shape), axis=1) + 1.0


def _peak(c: np.ndarray, rest: np.ndarray, log_q: np.ndarray, d: float, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Peak and deviation of the number of tables of very many customers.

    S(c, t) is c! / t! times the coefficient of x^c in ((1 - (1 - x)^d) / d)^t. At its saddle point, with y = 1 - x, t is a
    function of y, and log S grows by log((1 - y^d) / d) - log t with each table.
    """

    def at(log_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = np.exp(log_y)
        f = -np.expm1(d * log_y) / d
        t = c * f * np.exp((1 - d) * log_y) / -np.expm1(log_y)
        return t, np.log(f) - np.log(t + 0.5) + np.log(theta + d * (rest + t)) + log_q + 0 * y

    low, high = np.full(len(c), -200.0), np.full(len(c), -1e-9)
    for _ in range(60):
        mid = (low + high) / 2
        more = at(mid)[1] > 0
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    (t0, r0), (t1, r1) = at(low - 1e-3), at(np.minimum(low + 1e-3, -1e-10))
    return at(low)[0] + 0.5, np.sqrt(np.maximum(t1 - t0, 1e-12) / np.maximum(r0 - r1, 1e-12))


def seat(c: np.ndarray, room: np.ndarray, q: np.ndarray, d: float, theta: float, rng: np.random.Generator, share: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each word and each room's tables, averaged over SAMPLES Gibbs sweeps.

    c: customers (1 at least) of the word in its room, q: the parent's probability of the word, share: the part of its
    room that is here. No words give no tables.
    """
    rooms = int(room.max()) + 1 if len(room) else 0
    share = np.broadcast_to(np.asarray(share, float), (rooms,))
    t = np.where(c > CLASS, np.rint(c * 0.6), 1.0)  # a large room comes down to its tables in fewer sweeps than up
    total = np.bincount(room, t, rooms)
    by_count = np.argsort(c, kind="stable")
    by_count = by_count[np.searchsorted(c[by_count], 2) :]
    ends = np.searchsorted(c[by_count], np.append(np.arange(2, CLASS + 2), STIRLING + 1))
    classes = [by_count[a:b] for a, b in zip(ends[:-2], ends[1:-1])]
    middle, many = by_count[ends[-2] : ends[-1]], by_count[ends[-1] :]
    groups = [middle[k : k + 256] for k in range(0, len(middle), 256)]
    sum_t, log_q = np.zeros(len(c)), np.log(q)
    weights = _log_stirling(STIRLING if len(middle) or len(many) else CLASS, d)

    def rest_of(rows: np.ndarray) -> np.ndarray:
        return np.maximum((total[room[rows]] - t[rows]) / share[room[rows]], 0)

    def by_weights(rows: np.ndarray, counts: np.ndarray | int, most: int) -> np.ndarray:
        new = np.log(theta + d * (rest_of(rows)[:, None] + np.arange(most)))
        return _drawn(weights[counts, 1 : most + 1] + np.cumsum(new, axis=1) + np.arange(1, most + 1) * log_q[rows, None], rng)

    def put(rows: np.ndarray, tables: np.ndarray) -> None:
        np.add.at(total, room[rows], tables - t[rows])
        t[rows] = tables

    for sweep in range(BURN_IN + SAMPLES):
        for k, rows in enumerate(classes, 2):
            if len(rows):
                put(rows, by_weights(rows, k, k))
        for rows in groups:  # far more tables than now are no longer likely after the first sweep
            put(rows, by_weights(rows, c[rows].astype(np.int64), min(int(c[rows[-1]]), 4 * int(t[rows].max()) + 64)))
        if len(many):
            peak, deviation = _peak(c[many].astype(float), rest_of(many), log_q[many], d, theta)
            few = peak < 16  # their weights hardly depend on the customers any more
            scale = (np.sqrt(peak**2 + 4 * deviation**2) - peak) / 2  # of a gamma distribution with this peak and deviation
            drawn = np.clip(np.rint(rng.gamma(peak / scale + 1, scale)), 1, c[many])
            if few.any():
                drawn[few] = by_weights(many[few], STIRLING, 64)
            put(many, drawn)
        if sweep >= BURN_IN:
            sum_t += t
    mean = sum_t / SAMPLES
    return mean, np.bincount(room, mean, rooms)


_ROW = [("kind", pa.int32()), ("dest", pa.int64()), ("src", pa.int64()), ("blob", pa.binary())]
_ROWS = "kind int, dest long, src long, blob binary"
_PAIRS, _WORDS, _TABLES, _CONTEXTS, _PAIR_REPLY, _WORD_REPLY, _SUMS = range(7)
_TENTHS = 1000.0  # tables are sent as thousandths


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * 4, _ROW)], [n for n, _ in _ROW])


def score(docs: DataFrame, held_out: Column, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", discount: float = DISCOUNT, seed: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is learnt from the rows where held_out is not true. Tokens are the words and an end, which the empty and
    the null text have too. score is the text's log10 probability, base_score that of the training tokens' counts plus
    one. Null ids and repeated rows stay; without any training row all counts are zero. Other columns are not looked at.
    """
    root = scratch.path("blocks")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)
        fs.create_dir(base, recursive=True)
        digest = xxhash.xxh3_64_intdigest
        ids, held, doc_ids, n = [], [], [], 0

        def done() -> pa.RecordBatch:
            block = Block.of(ids, held, doc_ids)
            name = uuid.uuid4()
            with fs.open_output_stream(f"{base}/{name}.bin") as out:
                out.write(block.dump())
            often = block.n_words * HOT * 2 >= sum(d[2] for d in block.docs)
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in ((name.int & (1 << 62) - 1, pa.int64()), (f"{root}/{name}.bin", pa.string()), (int(block.n_words.sum()), pa.int64()), (len(block.token), pa.int64()), (block.words[often].astype(np.int64), pa.list_(pa.int64())), (block.n_words[often], pa.list_(pa.int64())))], ["block", "path", "tokens", "all", "often", "times"])

        for batch in slices(batches):
            for doc_id, is_held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                tokens = np.array([digest(w) for w in words(text)] + [_END], dtype=np.uint64)
                tokens &= np.uint64(_ID)
                ids.append(tokens)
                held.append(is_held)
                doc_ids.append(doc_id)
                n += len(tokens)
                if n >= BLOCK:
                    yield done()
                    ids, held, doc_ids, n = [], [], [], 0
        if ids:
            yield done()

    made = scratch.save(rows.mapInArrow(blocks, "block long, path string, tokens long, all long, often array<long>, times array<long>"), "made")
    n_train, n_all = (x or 0 for x in made.agg(F.sum("tokens"), F.sum("all")).first())
    n_pair_buckets, n_word_buckets = max(1, math.ceil(n_all / PAIR_BUCKET)), max(1, math.ceil(n_all / WORD_BUCKET))
    often = made.select(F.explode(F.arrays_zip("often", "times")).alias("x")).groupBy("x.often").agg(F.sum("x.times").alias("n"))
    hot = np.sort(np.array([r[0] for r in often.filter(F.col("n") * HOT >= n_train).select("often").collect()], np.uint64))  # HOT words at most

    def load(path: str) -> Block:
        fs, p = filesystem(path)
        with fs.open_input_stream(p) as f:
            return Block.load(f.read())

    def dealt(kind: int) -> DataFrame:
        """Packed counts of all blocks' words, or pairs, for their buckets; one block a task or a few."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    block, out = load(path), []
                    order, starts = block.word_order(n_word_buckets) if kind == _WORDS else block.pair_order(n_pair_buckets, hot)
                    for k in range(len(starts) - 1):
                        if not len(part := order[starts[k] : starts[k + 1]]):
                            continue
                        if kind == _WORDS:
                            out.append((kind, k, name, pack((block.words[part], 6), (block.n_words[part], 4))))
                        else:
                            rooms, sizes = _runs(block.words[block.u[part]])
                            out.append((kind, k, name, pack((rooms, 6), (sizes, 4), (block.words[block.w[part]], 6), (block.n[part], 4))))
                    yield from _table(out).to_batches()

        return made.select("block", "path").repartition(max(1, n_pair_buckets), "block").mapInArrow(deal, _ROWS)

    def restaurants(table: pa.Table) -> pa.Table:
        got = [unpack(b) for b in table["blob"].to_pylist()]
        u = np.concatenate([np.repeat(g[0], g[1].astype(np.int64)) for g in got])
        w, n = np.concatenate([g[2] for g in got]), np.concatenate([g[3] for g in got])
        with np.errstate(over="ignore"):
            _, first, at = np.unique((u * _ODD) ^ _mixed(w), return_index=True, return_inverse=True)
        c = np.bincount(at, n)
        u, w = u[first], w[first]
        seen = np.flatnonzero(c > 0)
        tables = np.zeros(len(c))
        out, bucket = [], table["dest"][0].as_py()
        if len(seen):
            rooms, room = np.unique(u[seen], return_inverse=True)
            dishes, dish = np.unique(w[seen], return_inverse=True)
            q = np.bincount(dish) / len(seen)
            share = np.where(np.isin(rooms, hot), 1 / n_pair_buckets, 1.0)
            tables[seen], total = seat(c[seen], room, q[dish], discount, STRENGTH, np.random.default_rng([seed, bucket]), share)
            served = np.bincount(dish, tables[seen])
            customers = np.bincount(room, c[seen])
            for kind, ids, columns in ((_TABLES, dishes, [served * _TENTHS]), (_CONTEXTS, rooms, [customers, total * _TENTHS])):
                place = _spread(ids, n_word_buckets)
                order = np.argsort(place, kind="stable")
                starts = np.searchsorted(place[order], np.arange(n_word_buckets + 1))
                for k in range(n_word_buckets):
                    if len(part := order[starts[k] : starts[k + 1]]):
                        out.append((kind, k, bucket, pack((ids[part], 6), *[(np.rint(x[part]), 6) for x in columns])))
        a = 0
        for g, name in zip(got, table["src"].to_pylist()):
            mine = at[a : a + len(g[2])]
            a += len(g[2])
            out.append((_PAIR_REPLY, name, bucket, pack((c[mine], 5), (np.rint(tables[mine] * _TENTHS), 6))))
        return _table(out)

    seated = scratch.save(dealt(_PAIRS).groupBy("dest").applyInArrow(restaurants, _ROWS), "seated")

    def parent(table: pa.Table) -> pa.Table:
        kinds, bucket = np.array(table["kind"].to_pylist()), table["dest"][0].as_py()
        got = [unpack(b) for b in table["blob"].to_pylist()]
        of = lambda kind: [got[k] for k in np.flatnonzero(kinds == kind)]
        ids = np.unique(np.concatenate([g[0] for g in got]))
        counts, served, customers, total = (np.zeros(len(ids)) for _ in range(4))
        for g in of(_WORDS):
            counts[np.searchsorted(ids, g[0])] += g[1]
        for g in of(_TABLES):
            served[np.searchsorted(ids, g[0])] += g[1] / _TENTHS
        for g in of(_CONTEXTS):
            at = np.searchsorted(ids, g[0])
            customers[at] += g[1]
            total[at] += g[2] / _TENTHS
        known = np.flatnonzero(counts > 0)
        tables = np.zeros(len(ids))
        if len(known):
            guests = np.maximum(np.rint(served[known]), 1).astype(np.int64)
            base = np.full(len(known), 1 / (len(known) * n_word_buckets + 1))
            tables[known], _ = seat(guests, np.zeros(len(known), np.int64), base, ROOT_DISCOUNT, ROOT_STRENGTH, np.random.default_rng([seed, bucket, 1]), 1 / n_word_buckets)
        out = [(_SUMS, -1, bucket, pack((np.array([len(known), *(np.rint(x.sum() * _TENTHS) for x in (served, tables))]), 8)))]
        for k in np.flatnonzero(kinds == _WORDS):
            at = np.searchsorted(ids, got[k][0])
            columns = [(x[at] if exact else np.rint(x[at] * _TENTHS), 6) for x, exact in ((counts, True), (served, False), (tables, False), (customers, True), (total, False))]
            out.append((_WORD_REPLY, table["src"][int(k)].as_py(), bucket, pack(*columns)))
        return _table(out)

    to_parent = dealt(_WORDS).union(seated.filter(F.col("kind").isin(_TABLES, _CONTEXTS)))
    parents = scratch.save(to_parent.groupBy("dest").applyInArrow(parent, _ROWS), "parents")

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3)
        for batch in batches:
            for b in batch.column(3).to_pylist():
                total += unpack(b)[0]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], ["v", "n", "t"])

    v, guests, tables = (x or 0.0 for x in parents.filter(F.col("kind") == _SUMS).mapInArrow(sums_of, "v double, n double, t double").agg(F.sum("v"), F.sum("n"), F.sum("t")).first())
    guests, tables = guests / _TENTHS, tables / _TENTHS

    def final(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        path = next(b for k, b in zip(kinds, table["blob"].to_pylist()) if k == _SUMS).decode()
        block = load(path)
        replies: dict[tuple[int, int], list] = {(k, s): unpack(b) for k, s, b in zip(kinds, table["src"].to_pylist(), table["blob"].to_pylist()) if k != _SUMS}

        def gathered(kind: int, order: np.ndarray, n: int, width: int) -> list[np.ndarray]:
            out = [np.zeros(len(order)) for _ in range(width)]
            found = [replies[kind, k] for k in range(n) if (kind, k) in replies]
            for j in range(width):
                out[j][order] = np.concatenate([f[j] for f in found])
            return out

        count, served, seats, customers, total = gathered(_WORD_REPLY, block.word_order(n_word_buckets)[0], n_word_buckets, 5)
        c, t = gathered(_PAIR_REPLY, block.pair_order(n_pair_buckets, hot)[0], n_pair_buckets, 2)
        served, seats, total, t = (x / _TENTHS for x in (served, seats, total, t))
        root_p = (np.maximum(served - ROOT_DISCOUNT * seats, 0) + (ROOT_STRENGTH + ROOT_DISCOUNT * tables) / (v + 1)) / (ROOT_STRENGTH + guests)
        p = (np.maximum(c - discount * t, 0) + (STRENGTH + discount * total[block.u]) * root_p[block.w]) / (STRENGTH + customers[block.u])
        base = np.log10((count + 1) / (n_train + v + 1))
        ends = np.cumsum([d[2] for d in block.docs])
        per_doc = lambda x: np.add.reduceat(x[block.token], np.append(0, ends[:-1]))
        columns = [np.log10(p), base[block.w], (count > 0)[block.w].astype(float)]
        s, b, known = map(per_doc, columns)
        return pa.table({"doc_id": pa.array([d[0] for d in block.docs], pa.int64()), "held_out": pa.array([d[1] for d in block.docs]), "n_tokens": pa.array([d[2] for d in block.docs], pa.int64()), "n_known": pa.array(known.astype(np.int64)), "train_tokens": pa.array(np.full(len(ends), n_train), pa.int64()), "base_score": pa.array(b), "score": pa.array(s)})

    names = made.select(F.lit(_SUMS).alias("kind"), F.col("block").alias("dest"), F.lit(-1).cast("long").alias("src"), F.encode("path", "utf-8").alias("blob"))
    replies = seated.filter(F.col("kind") == _PAIR_REPLY).union(parents.filter(F.col("kind") == _WORD_REPLY)).union(names)
    return replies.groupBy("dest").applyInArrow(final, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _runs(sorted_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1]))
    return sorted_ids[starts], np.diff(np.append(starts, len(sorted_ids)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
