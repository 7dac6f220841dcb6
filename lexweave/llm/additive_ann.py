"""Nearest neighbours by inner product with additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one of each residual codebook, found by beam search, and of one
signed byte a component for what they leave over; the norm of what the code leaves then is stored. A query's inner product
with a decoded code is a product of matrices, and |q| times the stored norm bounds the rest. A vector is passed over only
if it cannot reach the k-th best that the query has seen. The others are reranked with exact inner products in double
precision: recall is 1 for any fitted codebooks.

Every row is indexed; codebooks are fitted on a bounded sample. The stated query set meets all vectors: vectors are packed
``VECTORS`` to a row with their codes and queries ``QUERIES`` to a row. Blocks of vectors are dealt to groups of some
``HELD_BYTES`` and travel once; a copy of the queries goes to each group. A task decodes a group, keeps it, and lets the
blocks of queries pass by, so it holds one group however many queries there are. Nothing is joined, so nothing is
broadcast, and the driver gets the sample and a count a length only.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a
null vec_id; vectors of another length than the query are no candidates; rows that repeat a vec_id are candidates each,
but none of the query's own id; ties go to the smaller vec_id; with no query or no candidate there are no rows; other
columns are ignored; very long vectors are handled like others, a block of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions
from .vectors import k_means, matrix, nearest, sample_matrix, usable

NEIGHBOURS, EVERY = 20, 20
BOOKS, WORDS, BEAM, SAMPLE = 48, 64, 2, 4096
VECTORS, QUERIES = 8192, 1024
HELD_BYTES = 128 << 20
#: Rows coded at once; queries and vectors of a product of matrices; vectors that give a query its first k best.
CODED, TILE, STRIP, SEEDED = 512, 256, 4096, 2048


class AdditiveCode:
    def __init__(self, sample: np.ndarray, books: int = BOOKS, words: int = WORDS):
        self.books, rest = [], sample.copy()
        for m in range(books):
            book = k_means(rest, words, rounds=8, seed=23 + m)
            self.books.append(book)
            rest = rest - book[nearest(rest, book)]
        self.scale = np.abs(sample).max()  # the beam is searched in single precision

    def words(self, v: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes, keeping the `beam` best partial sums after each codebook."""
        out = np.zeros((len(v), len(self.books)), np.uint8)
        books = [(book / self.scale).astype(np.float32) for book in self.books]
        squares = [(book**2).sum(axis=1) for book in books]
        with np.errstate(all="ignore"):
            for at in range(0, len(v), CODED):
                rest = (v[at : at + CODED, None] / self.scale).astype(np.float32)
                n = np.arange(len(rest))
                norm, steps = (rest**2).sum(axis=2), []
                for book, square in zip(books, squares):
                    cost = rest.reshape(-1, v.shape[1]) @ book.T
                    cost *= -2
                    cost += square
                    cost = (cost.reshape(*norm.shape, -1) + norm[:, :, None]).reshape(len(n), -1)
                    best = np.empty((len(n), min(beam, cost.shape[1])), np.int64)
                    norm = np.empty(best.shape, np.float32)
                    for j in range(best.shape[1]):
                        best[:, j] = cost.argmin(axis=1)
                        norm[:, j] = cost[n, best[:, j]]
                        cost[n, best[:, j]] = np.inf
                    parent, word = best // len(book), best % len(book)
                    rest = rest[n[:, None], parent] - book[word]
                    steps.append((parent, word))
                path = (rest**2).sum(axis=2).argmin(axis=1)
                for m, (parent, word) in reversed(list(enumerate(steps))):
                    out[at : at + CODED, m] = word[n, path]
                    path = parent[n, path]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        total = np.zeros((len(codes), self.books[0].shape[1]))
        for m, book in enumerate(self.books):
            total += book[codes[:, m]]
        return total

    def encode(self, v: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the norm of what they leave over."""
        codes = self.words(v, beam)
        return codes, np.linalg.norm(v - self.decode(codes), axis=1)

    def encode_finely(self, v: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, ...]:
        """Codes, a signed byte a component for what they leave over, the step of a vector's bytes, and the norm of what is left then."""
        codes = self.words(v, beam)
        with np.errstate(all="ignore"):
            rest = v - self.decode(codes)
            step = np.abs(rest).max(axis=1) / 127
            fine = np.rint(rest / np.where(step > 0, step, 1)[:, None]).astype(np.int8)
            return codes, fine, step, np.linalg.norm(rest - fine * step[:, None], axis=1)


BLOCK = "group int, asks int, width int, ids binary, vectors binary, codes binary, fine binary, step binary, left binary"


def _pack(models: dict[int, AdditiveCode] | None, most: int, groups: int, kind: str):
    """Rows of up to `most` vectors in the components' type: coded, or with no models as queries."""
    names = [x.split()[0] for x in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made = TaskContext.get().partitionId()

        def put(width: int, ids: np.ndarray, v: np.ndarray):
            nonlocal made
            parts = (b"", b"", b"", b"")
            if models is not None:
                codes, fine, step, left = models[width].encode_finely(v)
                parts = codes.tobytes(), fine.tobytes(), step.astype("<f8").tobytes(), left.astype("<f8").tobytes()
            values = (made % groups, int(models is None), width, ids.astype("<i8").tobytes(), v.astype(kind).tobytes(), *parts)
            made += 1
            kinds = (*(pa.int32(),) * 3, *(pa.binary(),) * 6)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], names=names)

        for batch in batches:
            widths = np.asarray(batch.column("width"))
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                ids, v = np.asarray(part.column("vec_id")), matrix(part.column("v"))
                if width in held:
                    ids, v = np.concatenate((held[width][0], ids)), np.vstack((held[width][1], v))
                while len(ids) >= most:
                    yield put(width, ids[:most], v[:most])
                    ids, v = ids[most:], v[most:]
                held[width] = [ids, v]
        for width, (ids, v) in held.items():
            if len(ids):
                yield put(width, ids, v)

    return run


def exact_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed component after component."""
    total = np.zeros(len(v))
    for d in range(v.shape[1]):
        total += q[:, d] * v[:, d]
    return total


def _few(mask: np.ndarray) -> np.ndarray:
    """Flat places of the few that are true; eight are looked at together where they can be."""
    flat = mask.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64).astype(bool))
    return (8 * some[:, None] + np.arange(8))[flat.reshape(-1, 8)[some]]


class Held:
    """Vectors and their decoded codes in single precision, each with a last component that bounds, for a query of length
    one, what its code leaves over and what single precision loses."""

    def __init__(self, model: AdditiveCode, ids, v, codes, left, fine=None, step=None):
        self.ids, self.v, self.scale = ids, v, max(float(np.abs(v).max()), 1e-300)
        d = v.shape[1]
        self.upper = np.empty((len(ids), d + 1), np.float32)
        with np.errstate(all="ignore"):
            for at in range(0, len(ids), VECTORS):
                own = slice(at, at + VECTORS)
                near = model.decode(codes[own])
                if fine is not None:
                    near += fine[own] * step[own, None]
                near, over = near / self.scale, left[own] / self.scale
                self.upper[own, :d] = near
                self.upper[own, d] = over + (d + 8) * 2.0**-23 * (np.linalg.norm(near, axis=1) + over) + 1e-30

    def search(self, q_ids, q, k: int, floor: np.ndarray | None = None):
        """(query row, id, score) of each query's k best, and how many candidates were reranked; floor is what a query's k
        best reach already."""
        n, d = self.v.shape
        reach = np.full(len(q), -np.inf) if floor is None else floor.copy()
        row, column, score, reranked = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
        held, waiting = [], 0

        def least():
            """What an upper bound must reach, in the scale of the bounds; all do where that is no finite number."""
            at = reach / scale / self.scale
            at -= 1e-6 * np.abs(at) + 1e-30
            return np.where(np.isfinite(at), at, -np.inf).astype(np.float32)[:, None]

        def exact(rows, columns):
            return exact_products(q[rows], self.v[columns].astype(np.float64))

        def merge():
            nonlocal row, column, score, held, waiting
            row, column, score = (np.concatenate(c) for c in zip((row, column, score), *held))
            order = np.lexsort((self.ids[column], -score, row))
            row, column, score = row[order], column[order], score[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            last = rank == k - 1
            reach[row[last]] = np.maximum(reach[row[last]], score[last])
            row, column, score = row[rank < k], column[rank < k], score[rank < k]
            held, waiting = [], 0

        with np.errstate(all="ignore"):
            scale = np.maximum(np.abs(q).max(axis=1), 1e-300)
            turned = q / scale[:, None]
            turned = np.hstack((turned, np.linalg.norm(turned, axis=1)[:, None] * (1 + 1e-6))).astype(np.float32)
            if k < n:  # else none can be passed over for another of these
                first = turned @ self.upper[:SEEDED].T
                many = min(2 * k, first.shape[1])
                seeds = np.argpartition(first, first.shape[1] - many, axis=1)[:, -many:]
                rows = np.repeat(np.arange(len(q)), many)
                found = exact(rows, seeds.ravel())
                found[self.ids[seeds.ravel()] == q_ids[rows]] = -np.inf
                if k <= many:
                    reach = np.fmax(reach, np.partition(found.reshape(len(q), many), many - k, axis=1)[:, many - k])
            at_least, slice_of = least(), max(1, (1 << 22) // d)
            room = np.empty(len(q) * min(n, STRIP), np.float32)
            for at in range(0, n, STRIP):
                strip = self.upper[at : at + STRIP]
                bound = np.matmul(turned, strip.T, out=room[: len(q) * len(strip)].reshape(len(q), -1))
                may = _few(~(bound < at_least))
                for some in range(0, len(may), slice_of):
                    rows, columns = np.divmod(may[some : some + slice_of], len(strip))
                    columns += at
                    other = self.ids[columns] != q_ids[rows]  # a query is no candidate of its own
                    rows, columns = rows[other], columns[other]
                    held.append((rows, columns, exact(rows, columns)))
                    reranked += len(rows)
                    waiting += len(rows)
                    if waiting >= 8 * k * len(q):
                        merge()
                if at == 0 or waiting >= k * len(q):
                    merge()
                    at_least = least()
            merge()
        return row, self.ids[column], score, reranked


def search_block(model: AdditiveCode, q_ids, q, ids, v, codes, left, k: int, floor: np.ndarray | None = None):
    """(query id, query row, id, score) of each query's k best in one block, and how many candidates were reranked."""
    row, found, score, reranked = Held(model, ids, v, codes, left).search(q_ids, q, k, floor)
    return q_ids[row], row, found, score, reranked


def _search(models: dict[int, AdditiveCode], k: int, kind: str):
    """From rows by group and width, vectors before queries: each query's k best of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, held = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                width = row["width"]
                if (row["group"], width) != now:
                    now, blocks, held = (row["group"], width), [], None
                ids, v = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], kind).reshape(-1, width)
                if not row["asks"]:
                    codes, fine = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["fine"], np.int8).reshape(-1, width)
                    blocks.append((ids, v, codes, np.frombuffer(row["left"], "<f8"), fine, np.frombuffer(row["step"], "<f8")))
                    continue
                if held is None:
                    if not blocks:
                        continue
                    held = Held(models[width], *(np.concatenate(c) for c in zip(*blocks)))
                    blocks = []
                for at in range(0, len(ids), TILE):
                    asked = ids[at : at + TILE]
                    rows, found, score, _ = held.search(asked, v[at : at + TILE].astype(np.float64), k)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[rows], pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def search(embeddings: DataFrame, k: int = NEIGHBOURS, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row whose vec_id is divisible by every."""
    spark = embeddings.sparkSession
    own = usable(embeddings, "vec_id").where("vec_id is not null").withColumn("width", F.size("v"))
    kind = "<f4" if dict(own.dtypes)["v"] == "array<float>" else "<f8"
    counts = {r["width"]: r["count"] for r in own.groupBy("width").count().orderBy("width").collect()}
    models = {width: AdditiveCode(sample_matrix(own.where(F.col("width") == width), SAMPLE)) for width in counts}
    if not models:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # groups small enough to be held, and as many as there are cores twice over if the table fills them with blocks
    rows, held = sum(counts.values()), sum(n * (width + 4) * (int(kind[-1]) + 4) for width, n in counts.items())
    groups = max(1, -(-held // HELD_BYTES), min(2 * spark.sparkContext.defaultParallelism, -(-rows // VECTORS)))
    index = own.mapInArrow(_pack(models, VECTORS, groups, kind), BLOCK)
    asked = own.where(F.col("vec_id") % every == 0).coalesce(max(1, partitions(spark) // 4))
    # every query meets every vector: the query set is stated, and a row is a whole block
    queries = asked.mapInArrow(_pack(None, QUERIES, 1, kind), BLOCK).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = index.unionByName(queries).repartitionById(groups, F.col("group")).sortWithinPartitions("group", "width", "asks")
    found = met.mapInArrow(_search(models, k, kind), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
