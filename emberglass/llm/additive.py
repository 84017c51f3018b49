"""Nearest neighbours by additive quantisation.

Each vector is approximated by a sum of BOOKS codewords, one of each full-dimensional codebook. The codebooks are
learnt one after another on what the ones before leave over, on a bounded sample. Encoding is a beam search: of all
extensions of the BEAM best partial sums by a codeword of the next book, the BEAM best go on. Stored per vector are its
codes and the squared norm of its approximation, so a query's squared distance to it is |q|^2 + norm - 2 * (sum of
table entries), the table holding the query's product with every codeword. The RERANK best of every query are then
ranked by their exact distances, whose k-th is a bound.

Codes tell vectors apart only as finely as their error. So the length of what an approximation leaves over is stored too: by
the triangle inequality a vector is no nearer than its approximation less that length. Whichever vector could be nearer than
the bound by this is checked exactly, in the task that holds it. Vectors are quantised about the sample's mean.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberglass.llm.files import filesystem
from emberglass.storage import Scratch

#: Codebooks, codewords in each, partial sums kept while encoding.
BOOKS, WORDS_EACH, BEAM = 24, 256, 8
#: Vectors that codebooks are learnt on at most, candidates that are reranked, queries that are scored at once.
SAMPLE, RERANK, QUERY_BLOCK = 12_288, 256, 2048
_BLOCK = 1024


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    words = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((words**2).sum(1) - 2 * x @ words.T, axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
        words[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return words


def _extended(x: np.ndarray, sums: np.ndarray, codes: np.ndarray, book: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The beam best (sums, codes) of each row of x after one more book."""
    left = x[:, None] - sums
    cost = (left**2).sum(2)[:, :, None] - 2 * left @ book.T + (book**2).sum(1)
    flat = cost.reshape(len(x), -1)
    keep = min(beam, flat.shape[1])
    best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
    source, word = best // len(book), best % len(book)
    rows = np.arange(len(x))[:, None]
    return sums[rows, source] + book[word], np.concatenate([codes[rows, source], word[:, :, None].astype(np.uint8)], axis=2)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, squared norms of the approximations, lengths left over) of the rows of x by beam search."""
    sums, codes = np.zeros((len(x), 1, x.shape[1])), np.zeros((len(x), 1, 0), np.uint8)
    for book in books:
        sums, codes = _extended(x, sums, codes, book, beam)
    left = ((x[:, None] - sums) ** 2).sum(2)
    best, rows = np.argmin(left, axis=1), np.arange(len(x))
    return codes[rows, best], (sums[rows, best] ** 2).sum(1), np.sqrt(left[rows, best])


def learn(x: np.ndarray, books: int = BOOKS, words: int = WORDS_EACH, seed: int = 0, beam: int = 4) -> np.ndarray:
    """Codebooks (books, words, dimensions) by k-means on residuals, each book going on from the beam's best sums so far."""
    rng = np.random.default_rng(seed)
    found: list[np.ndarray] = []
    blocks = [x[a : a + _BLOCK] for a in range(0, len(x), _BLOCK)]
    state = [(np.zeros((len(b), 1, x.shape[1])), np.zeros((len(b), 1, 0), np.uint8)) for b in blocks]
    left = x
    for _ in range(books):
        found.append(_kmeans(left, words, rng))
        state = [_extended(b, *s, found[-1], beam) for b, s in zip(blocks, state)]
        left = np.concatenate([b - s[np.arange(len(b)), np.argmin(((b[:, None] - s) ** 2).sum(2), axis=1)] for b, (s, _) in zip(blocks, state)])
    return np.array(found)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id long, v array<double>, in exact copies once): rows with an id and a finite vector that isn't zero.

    Where lengths differ, only vectors of the most frequent length (of equally frequent ones the least) take part. Of
    rows with the same id the least vector counts.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    rows = rows.join(F.broadcast(sizes), F.size("v") == F.col("n"), "left_semi")  # one row
    return rows.withColumn("v", F.transform("v", lambda x: x + 0.0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int = RERANK, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest others by Euclidean distance, ties to the
    smaller id; all others, if there are fewer.

    is_query is a condition on vec_id. usable() says which rows take part. All of them are indexed; equal vectors are
    one entry of the index, with the k + 1 least of their ids, so that a vector that very many rows have crowds nothing
    out. Queries lie in files of about QUERY_BLOCK in the shared folder; one stage scores all of them against all entries,
    a task taking a part of the codes (some forty bytes an entry) and one block of queries at a time.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "additive")
    rows = scratch.save(usable(vectors, id_col, vec_col), "rows")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    ids = scratch.save(rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1), "ids")
    entries = ids.groupBy("v").agg(F.min("vec_id").alias("entry"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = scratch.save(entries.select("entry", "ids", "v"), "entries")
    learnt = entries.orderBy(F.xxhash64("entry", F.lit(seed)), "entry").limit(sample).select("v").collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not learnt:
        return spark.createDataFrame([], empty)
    seen = np.array([r["v"] for r in learnt])
    mean = seen.mean(0)
    books = learn(seen - mean, seed=seed)
    flat = books.reshape(-1, books.shape[2])
    m, words = books.shape[:2]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(a, _BLOCK)
                codes, norms, left = encode(_matrix(part.column(1)) - mean, books)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(left), part.column(1)], ["entry", "codes", "norm", "left", "v"])

    coded = scratch.save(entries.select("entry", "v").mapInArrow(index, "entry long, codes binary, norm double, left double, v array<double>"), "codes")
    queries = scratch.save(rows.filter(is_query).select("vec_id", "v"), "queries")
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], empty)
    # one file a block, in the shared folder, so that every task goes through all of them without the driver holding one
    n_blocks, root = math.ceil(n_queries / QUERY_BLOCK), scratch.path("asked")

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), schema=pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))])).combine_chunks()
        if len(got):
            fs, base = filesystem(root)
            fs.create_dir(base, recursive=True)
            name = f"{base}/{uuid.uuid4().hex}.npy"
            with fs.open_output_stream(name) as out:
                out.write(got["vec_id"].combine_chunks().to_numpy(zero_copy_only=False).tobytes() + _matrix(got["v"].chunk(0)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{name.rpartition('/')[2]}"]), pa.array([len(got)], pa.int64())], ["path", "n"])

    asked = scratch.save(queries.repartition(n_blocks, F.xxhash64("vec_id", F.lit(1))).mapInArrow(stored, "path string, n long"), "asked-files")
    files = [(r["path"], r["n"]) for r in asked.collect()]  # a name for every QUERY_BLOCK queries or so

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, m), b.column(2).to_numpy().astype(np.float32)) for b in batches if b.num_rows]
        if not parts:
            return
        e, codes, norms = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(e)
        e, codes, norms = e[order], codes[order], norms[order]
        for path, n in files:
            fs, p = filesystem(path)
            with fs.open_input_stream(p) as f:
                data = f.read()
            all_ids, all_q = np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float64, offset=8 * n).reshape(n, -1)
            for at in range(0, n, QUERY_BLOCK):
                q_ids, q = all_ids[at : at + QUERY_BLOCK], all_q[at : at + QUERY_BLOCK]
                tables = np.ascontiguousarray((-2 * (q - mean) @ flat.T).T.astype(np.float32)).reshape(m, words, len(q))
                top_d, top_e = np.full((len(q), 0), np.inf, np.float32), np.zeros((len(q), 0), np.int64)
                for a in range(0, len(e), _BLOCK):
                    d = np.repeat(norms[a : a + _BLOCK, None], len(q), axis=1)
                    for j in range(m):
                        d += tables[j][codes[a : a + _BLOCK, j]]
                    d_all = np.concatenate([top_d, d.T], axis=1)
                    e_all = np.concatenate([top_e, np.broadcast_to(e[a : a + _BLOCK], (len(q), d.shape[0]))], axis=1)
                    if d_all.shape[1] > rerank:
                        pick = np.argpartition(d_all, rerank - 1, axis=1)[:, :rerank]
                        d_all, e_all = np.take_along_axis(d_all, pick, 1), np.take_along_axis(e_all, pick, 1)
                    top_d, top_e = d_all, e_all
                for i in range(0, len(q), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids[i : i + 64], top_e.shape[1])), pa.array(top_e[i : i + 64].ravel()), pa.array(top_d[i : i + 64].ravel().astype(np.float64))], ["query_id", "entry", "about"])

    found = coded.select("entry", "codes", "norm").mapInArrow(best, "query_id long, entry long, about double")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("about", "entry"))
    near = scratch.save(found.withColumn("nth", nth).filter(F.col("nth") <= rerank).select("query_id", "entry"), "candidates")
    exact = near.join(entries, "entry").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    gap = F.sqrt(F.aggregate(F.zip_with("v", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))

    def nearest(pairs: DataFrame) -> DataFrame:
        scored = pairs.select("query_id", gap.alias("score"), F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
        return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = scratch.save(nearest(exact), "first")
    # a bound for each query, with the query, in files like those above
    bound = first.groupBy("query_id").agg(F.max("score").alias("far"), F.count("*").alias("n"))
    bound = queries.join(bound, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", F.array_insert("v", 1, F.when(F.col("n") >= k, F.col("far")).otherwise(float("inf"))).alias("v"))
    bounded = scratch.save(bound.repartition(n_blocks, F.xxhash64("vec_id", F.lit(1))).mapInArrow(stored, "path string, n long"), "bounded-files")
    limits = [(r["path"], r["n"]) for r in bounded.collect()]

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k + 1 nearest of a batch for each query that one of its entries may be near to."""
        for batch in batches:
            if not batch.num_rows:
                continue
            e, left, x = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(3))
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, m)
            about = sum(books[j][codes[:, j]] for j in range(m))
            x_2 = (about**2).sum(1)
            for path, n in limits:
                fs, p = filesystem(path)
                with fs.open_input_stream(p) as f:
                    data = f.read()
                ids, rows = np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float64, offset=8 * n).reshape(n, -1)
                for at in range(0, n, _BLOCK):
                    q_ids, far, q = ids[at : at + _BLOCK], rows[at : at + _BLOCK, 0] * (1 + 1e-12), rows[at : at + _BLOCK, 1:]
                    q_c = q - mean
                    both = (q_c**2).sum(1)[:, None] + x_2
                    # rounding is far below this share of the squares
                    least = np.sqrt(np.maximum(0.0, both - 2 * q_c @ about.T - 1e-12 * both)) - left * (1 + 1e-12) - 1e-12 * np.sqrt(both)
                    may, got_q, got_e = least <= far[:, None], [], []
                    for i in np.flatnonzero(may.any(1)):
                        own = np.flatnonzero(may[i])
                        d = np.sqrt(((x[own] - q[i]) ** 2).sum(1))
                        own, d = own[d <= far[i]], d[d <= far[i]]
                        keep = own[np.lexsort((e[own], d))[: k + 1]]
                        got_q.append(np.repeat(q_ids[i], len(keep)))
                        got_e.append(e[keep])
                    if got_q:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got_q)), pa.array(np.concatenate(got_e))], ["query_id", "entry"])

    more = coded.select("entry", "codes", "left", "v").mapInArrow(checked, "query_id long, entry long")
    near = scratch.save(more, "checked")
    exact = near.join(entries, "entry").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return nearest(exact)
