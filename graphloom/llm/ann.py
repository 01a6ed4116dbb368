"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one codeword from each of several full-dimensional codebooks.
The codebooks start as residual k-means and are then refitted together by least squares
against beam-searched codes.  Every vector is encoded by beam search; its norm is stored
and scales the score, which for a query is a sum of table entries (the query's inner
products with all codewords), and so is the length of the residual, which tells how far the
score can be trusted.  The best by score and trust are ranked exactly on the original
vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import discard, fresh_path, lean, remember, small_arrow, written
from graphloom.llm.vectors import common_length, matrix, usable


@dataclass
class Codebooks:
    words: np.ndarray  # books x entries x length

    @property
    def flat(self) -> np.ndarray:
        return self.words.reshape(-1, self.words.shape[2])

    def encode(self, x: np.ndarray, beam: int = 4, block: int = 256) -> np.ndarray:
        """Codes (rows x books) by beam search over the books; single precision is enough for a choice of words."""
        books, entries, length = self.words.shape
        words = self.words.astype(np.float32)
        out = np.zeros((len(x), books), np.uint8)
        for at in range(0, len(x), block):
            rest = x[at : at + block].astype(np.float32)[:, None, :]
            n = len(rest)
            costs, codes = np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.int64)
            for m in range(books):
                grown = costs[:, :, None] + (words[m] ** 2).sum(1) - 2 * (rest.reshape(-1, length) @ words[m].T).reshape(n, -1, entries)
                flat = grown.reshape(n, -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                costs = np.take_along_axis(flat, best, 1)
                held, word = best // entries, best % entries
                codes = np.concatenate([np.take_along_axis(codes, held[:, :, None], 1), word[:, :, None]], axis=2)
                rest = np.take_along_axis(rest, held[:, :, None], 1) - words[m][word]
            out[at : at + n] = codes[np.arange(n), costs.argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))


def train(x: np.ndarray, books: int = 8, entries: int = 256, rounds: int = 8, refits: int = 2, seed: int = 7) -> Codebooks:
    rng = np.random.default_rng(seed)
    entries = max(1, min(entries, len(x)))
    rest, words = x.copy(), []
    for _ in range(books):
        centres = rest[rng.choice(len(rest), entries, replace=False)]
        for _ in range(rounds):
            near = ((centres**2).sum(1)[None, :] - 2 * rest @ centres.T).argmin(1)
            sizes = np.bincount(near, minlength=entries)
            order = np.argsort(near, kind="stable")
            starts = np.flatnonzero(np.diff(near[order], prepend=-1))
            centres[sizes > 0] = np.add.reduceat(rest[order], starts) / sizes[sizes > 0][:, None]
        near = ((centres**2).sum(1)[None, :] - 2 * rest @ centres.T).argmin(1)
        rest = rest - centres[near]
        words.append(centres)
    found = Codebooks(np.stack(words))
    for _ in range(refits):
        codes = found.encode(x) + np.arange(books)[None, :] * entries
        size = books * entries
        together = np.zeros((size, size))
        for i in range(books):
            for j in range(books):
                np.add.at(together, (codes[:, i], codes[:, j]), 1.0)
        target = np.zeros((size, x.shape[1]))
        for i in range(books):
            np.add.at(target, codes[:, i], x)
        solved = np.linalg.solve(together + 0.5 * np.eye(size), target + 0.5 * found.flat)
        found = Codebooks(solved.reshape(books, entries, -1))
    return found


def search(
    vectors: DataFrame, is_query, k: int = 20, books: int = 12, sample: int = 8_192, block_rows: int = 16_384,
    query_rows: int = 32_768, deviations: float = 2.5,
) -> DataFrame:
    """The ``k`` nearest rows, by inner product, of each row of ``vectors`` (vec_id, embedding) where ``is_query`` holds.

    Returns query_id, rank (from 1), vec_id and score (the inner product of the original
    vectors in double precision), ties to the smaller vec_id.

    Codebooks are fitted on at most ``sample`` rows (by hash of the id); every row is
    encoded.  The k-th best of a query among the sample's rows can only be raised by the
    others, so it is a floor for what belongs to its nearest.  A block of about
    ``block_rows`` rows scores all its codes by table lookups and ranks exactly those whose
    score, with ``deviations`` times the spread that their residual gives an inner product,
    reaches the floor: a row of the nearest is missed with a chance of about one in 160, and
    as many rows are ranked as the codes can't tell apart, however many lie close together.
    Of rows with the very same vector a block only needs the ``2 * k`` first (``k`` of an
    id): no other can be among the nearest.  The index is read once for every ``query_rows``
    queries, which costs little beside scoring it for them.

    Vectors that are null, zero, hold null or non-finite components, have a null id or not
    the most frequent length take no part.  Rows of a query's own id are not its
    neighbours.  Each query row has its own list, also when several share an id (their
    lists then stand under one query_id); candidate rows of one id count each by itself.
    Fewer candidates than ``k``: all.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_arrow(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(usable("embedding") & F.col("vec_id").isNotNull())
    length = common_length(rows, "embedding")
    rows = rows.filter(F.size("embedding") == length)
    drawn = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("embedding")).limit(sample).toArrow()
    path = remember(spark, fresh_path(spark, "ann-found"))
    schema = "query long, query_id long, vec_id long, score double"
    spark.createDataFrame([], schema).write.parquet(path)
    if len(drawn):
        known = matrix(drawn.column("embedding"), length)
        sent = spark.sparkContext.broadcast((train(known, books), drawn.column("vec_id").to_numpy(), known))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = sent.value[0]
            for batch in batches:
                x = matrix(batch.column(1), length)
                codes = words.encode(x)
                near = words.decode(codes)
                scale = np.linalg.norm(x, axis=1) / np.maximum(np.linalg.norm(near, axis=1), 1e-12)
                rest = np.linalg.norm(x - near * scale[:, None], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(rest)],
                                                 ["vec_id", "embedding", "asks", "codes", "norm", "rest"])

        def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, ids, x = sent.value
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    score = matrix(part.column(2), length) @ x.T
                    score[part.column(1).to_numpy()[:, None] == ids[None, :]] = -np.inf
                    floor = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(score), -np.inf)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(floor)], ["query", "vec_id", "embedding", "floor"])

        coded = rows.mapInArrow(lean(encode), "vec_id long, embedding array<double>, asks boolean, codes binary, norm double, rest double")
        index = written(coded.withColumn("row", F.monotonically_increasing_id()), "ann-index")
        total, asking = index.agg(F.count("*"), F.count_if("asks")).first()
        blocks, chunks = -(-total // block_rows), -(-asking // query_rows)
        asked = written(index.filter("asks").select(F.col("row").alias("query"), "vec_id", "embedding").mapInArrow(lean(floors), "query long, vec_id long, embedding array<double>, floor double"), "ann-queries")
        for chunk in range(chunks):
            mine = asked.filter(F.pmod(F.xxhash64("query"), F.lit(chunks)) == chunk).toArrow()
            mine = spark.sparkContext.broadcast((*(mine.column(c).to_numpy() for c in ("query", "vec_id", "floor")), matrix(mine.column("embedding"), length)))

            def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                if batches := list(batches):
                    yield from _find(pa.Table.from_batches(batches), *mine.value, sent.value[0], k, deviations, length)

            index.select("row", "vec_id", "embedding", "codes", "norm", "rest").repartition(blocks, "row").mapInArrow(lean(find), schema).write.mode("append").parquet(path)
            mine.unpersist()
        discard(index, asked)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(schema).parquet(path)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _needed(own: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The rows of a block, sorted by id, without repeats of the same vector that can't be among anyone's ``k`` nearest."""

    def place_in(groups: np.ndarray) -> np.ndarray:
        by = np.argsort(groups, kind="stable")
        first = np.flatnonzero(np.diff(groups[by], prepend=-1))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        return place

    same = np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)[1].ravel()
    keep = np.flatnonzero(place_in(np.unique(np.stack([same, own]), axis=1, return_inverse=True)[1].ravel()) < k)
    return keep[place_in(same[keep]) < 2 * k]


def _find(table: pa.Table, queries: np.ndarray, ids: np.ndarray, floors: np.ndarray, vectors: np.ndarray, books: Codebooks, k: int, deviations: float, length: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
    own, x = table.column("vec_id").to_numpy()[order], matrix(table.column("embedding"), length)[order]
    keep = _needed(own, x, k)
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(-1, len(books.words))[order][keep]
    norm, rest = (table.column(c).to_numpy()[order][keep] for c in ("norm", "rest"))
    own, x = own[keep], x[keep]
    spread = deviations * rest / np.sqrt(length) + 1e-6 * np.linalg.norm(x, axis=1)  # the last for rounding
    for begin in range(0, len(ids), 64):
        part = vectors[begin : begin + 64]
        tables = (part @ books.flat.T).reshape(len(part), len(books.words), -1)
        rough = tables[:, 0, codes[:, 0]]
        for m in range(1, codes.shape[1]):
            rough += tables[:, m, codes[:, m]]
        rough *= norm
        rough += np.linalg.norm(part, axis=1)[:, None] * spread[None, :]
        out_q, out_i, out_v, out_s = [], [], [], []
        for n, (q, may) in enumerate(zip(part, rough >= floors[begin : begin + 64, None])):
            query = ids[begin + n]
            near = np.flatnonzero(may)
            near = near[own[near] != query]
            score = (x[near] * q).sum(1)
            top = np.lexsort((own[near], -score))[:k]
            out_q.append(np.full(len(top), queries[begin + n]))
            out_i.append(np.full(len(top), query))
            out_v.append(own[near][top])
            out_s.append(score[top])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (out_q, out_i, out_v, out_s)], ["query", "query_id", "vec_id", "score"])
