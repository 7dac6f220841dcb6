"""Embedding near-dedup by product quantisation, without loss.

Unit vectors fall into coarse inverted lists; their residuals are coded by subspace, and list, codes and coding error are
stored. A vector probes every list that can hold a partner: a partner within distance r of x lies in a Voronoi cell whose
bisectors are at most r from x. In a probed list, asymmetric distances come from look-up tables, and the stored coding
error e gives a bound (|x - y| >= table distance - e), so a vector is passed over only if it cannot reach the cosine. What
is left is compared by exact cosine in double precision. The bounds hold for any sample the quantiser is fitted on, so
recall is 1.

Equal vectors of a label are one class with a count. The lists of a label are dealt to member blocks of bounded size (a
larger list is split), and a vector travels once to each block that holds a list it probes, so a hot label or list is
many tasks. A block emits counts of links and a spanning forest of them, not pairs, which is why it holds its members'
vectors for the exact comparison.

Defined cases: see the contract in op2 for labels and vectors that link with nothing; vectors of different lengths link
with nothing across lengths; rows that repeat a vec_id count as vectors of their own that share the id and component;
an empty table gives no rows; other columns are ignored; very long vectors are handled like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, written
from .vectors import is_usable, k_means, matrix, nearest, sample_matrix, usable

COSINE, SAMPLE = 0.98, 4096
SUBSPACES, CODES = 8, 64
MEMBERS, QUERIES = 2048, 1024
NEAR_LISTS = 8
_SLACK = 1e-5


class Quantiser:
    def __init__(self, sample: np.ndarray, lists: int):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.centres = k_means(unit, lists)
        rest = unit - self.centres[nearest(unit, self.centres)]
        self.edges = np.linspace(0, unit.shape[1], min(SUBSPACES, unit.shape[1]) + 1).astype(int)
        self.books = [k_means(rest[:, a:b], CODES, seed=11 + a) for a, b in zip(self.edges, self.edges[1:])]

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, subspace codes and coding error of each unit vector."""
        own = nearest(unit, self.centres)
        rest = unit - self.centres[own]
        codes = np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(zip(self.edges, self.edges[1:]), self.books)], axis=1)
        error = rest - np.hstack([book[codes[:, i]] for i, book in enumerate(self.books)])
        return own, codes.astype(np.uint8), np.linalg.norm(error, axis=1)

    def probes(self, unit: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (vector, list) of all lists that can hold a unit vector within radius."""
        d2 = np.maximum(1 + (self.centres**2).sum(axis=1) - 2 * unit @ self.centres.T, 0)
        apart = np.linalg.norm(self.centres[:, None] - self.centres[None], axis=2)
        apart = np.where(apart > 0, 2 * apart, np.inf)
        margin = np.full(d2.shape, -np.inf)
        for c in np.argsort(d2, axis=1)[:, :NEAR_LISTS].T:  # the bisectors with the nearest lists
            margin = np.maximum(margin, (d2 - np.take_along_axis(d2, c[:, None], axis=1)) / apart[c])
        return np.nonzero(margin <= radius + _SLACK)

    def tables(self, unit: np.ndarray, which: int) -> list[np.ndarray]:
        rest = unit - self.centres[which]
        return [((rest[:, a:b][:, None, :] - book[None]) ** 2).sum(axis=2) for (a, b), book in zip(zip(self.edges, self.edges[1:]), self.books)]


CODED = "label int, width int, id long, n long, v array<{kind}>, list int, codes binary, error double, probes array<int>"


def _coded(models: dict[int, Quantiser], radius: float):
    """Rows (label, width, id, n, v) with their list, codes, coding error and the lists they probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for width in set(whole.column("width").to_pylist()):
                of_width = whole.filter(pc.equal(whole.column("width"), width))
                for at in range(0, of_width.num_rows, 1024):
                    part = of_width.slice(at, 1024)
                    v = matrix(part.column("v"))
                    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                    own, codes, error = models[width].encode(unit)
                    who, where = models[width].probes(unit, radius)
                    ends = np.searchsorted(who, np.arange(len(v) + 1)).astype(np.int32)
                    probes = pa.ListArray.from_arrays(pa.array(ends), pa.array(where.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in ("label", "width", "id", "n", "v")), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), probes],
                        names=["label", "width", "id", "n", "v", "list", "codes", "error", "probes"],
                    )

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its component) that connect what pairs a-b connect."""
    ids, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    out = label != np.arange(len(ids))
    return ids[out], ids[label[out]]


def _linked(model: Quantiser, which: int, q: np.ndarray, m: np.ndarray, codes: np.ndarray, error: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) of one list whose cosine is at least `least`; members' codes and errors are the stored ones."""
    radius, rows, columns = np.sqrt(max(0.0, 2 - 2 * least)), [], []
    m_norm = np.linalg.norm(m, axis=1)
    for at in range(0, len(q), 256):
        qv = q[at : at + 256]
        q_norm = np.linalg.norm(qv, axis=1)
        d2 = sum(t[:, codes[:, i]] for i, t in enumerate(model.tables(qv / q_norm[:, None], which)))
        i, j = np.nonzero(np.sqrt(np.maximum(d2, 0)) <= radius + error[None] + _SLACK)
        for a in range(0, len(i), 1 << 17):
            x, y = i[a : a + (1 << 17)], j[a : a + (1 << 17)]
            good = np.einsum("ij,ij->i", qv[x], m[y]) / (q_norm[x] * m_norm[y]) >= least
            rows.append(at + x[good])
            columns.append(y[good])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *columns])


def _compare(models: dict[int, Quantiser], least: float):
    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        left, right = (block.filter(pc.equal(block.column("kind"), kind)).combine_chunks() for kind in (0, 1))
        ids, partners, counts = [], [], []
        if left.num_rows and right.num_rows:
            model = models[left.column("width")[0].as_py()]
            m, q = (matrix(t.column("v").combine_chunks()) for t in (left, right))
            m_ids, m_n, q_ids = np.asarray(left.column("id")), np.asarray(left.column("n")), np.asarray(right.column("id"))
            lists, error = np.asarray(left.column("list")), np.asarray(left.column("error"))
            codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(len(m), -1)
            probes = right.column("probes").combine_chunks()
            prober = np.repeat(np.arange(len(q)), np.diff(np.asarray(probes.offsets)))
            probed = np.asarray(probes.flatten())
            pairs = []
            for which in np.unique(lists).tolist():
                some, own = prober[probed == which], np.flatnonzero(lists == which)
                i, j = _linked(model, which, q[some], m[own], codes[own], error[own], least)
                pairs.append((some[i], own[j]))
            i, j = (np.concatenate(c) for c in zip(*pairs))
            other = q_ids[i] != m_ids[j]
            i, j = i[other], j[other]
            if len(i):
                n = np.bincount(i, weights=m_n[j], minlength=len(q_ids)).astype(np.int64)
                some = np.flatnonzero(n)
                a, b = _forest(q_ids[i], m_ids[j])
                ids, partners, counts = np.concatenate((q_ids[some], a)), np.concatenate((np.full(len(some), -1), b)), np.concatenate((n[some], np.full(len(a), -1)))
        return pa.table({"id": pa.array(ids, pa.int64()), "partner": pa.array(partners, pa.int64()), "n": pa.array(counts, pa.int64())})

    return run


def near_vectors(embeddings: DataFrame, least: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    spark = embeddings.sparkSession
    own = usable(embeddings, "vec_id", "label").where("vec_id is not null and label is not null").withColumn("width", F.size("v"))
    # a class is named by a number of its own, for vec_ids may repeat
    rows = own.groupBy("label", "width", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    classes = written(rows.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    models = {}
    for width, n in classes.groupBy("width").count().orderBy("width").collect():  # a row a vector length
        sample = sample_matrix(classes.where(F.col("width") == width), SAMPLE)
        models[width] = Quantiser(sample, lists=int(min(1024, max(8, n**0.5 / 4))))
    if not models:
        pairs = spark.createDataFrame([], "id long, partner long, n long")
    else:
        radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
        kind = dict(classes.dtypes)["v"].removeprefix("array<").removesuffix(">")
        coded = classes.select("label", "width", F.col("class").alias("id"), "n", "v").mapInArrow(_coded(models, radius), CODED.format(kind=kind))
        coded = written(coded, "vector-lists")
        # the lists of a label are dealt to as many member blocks as its size asks for
        blocks = coded.groupBy("label", "width").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
        coded = coded.join(blocks, ["label", "width"])
        block_of = lambda of: F.pmod(F.hash(of), F.col("blocks"))
        members = coded.select(F.lit(0).alias("kind"), "label", "width", block_of(F.col("list")).alias("block"), "id", "n", "v", "list", "codes", "error", F.array().cast("array<int>").alias("probes"))
        asked = coded.withColumn("block", F.explode(F.array_distinct(F.transform("probes", block_of))))
        own_probes = F.filter("probes", lambda of: block_of(of) == F.col("block"))
        asked = asked.select(F.lit(1).alias("kind"), "label", "width", "block", "id", "n", "v", "list", F.lit(None).cast("binary").alias("codes"), "error", own_probes.alias("probes"))
        place = ["label", "width", "block"]
        dealt = members.unionByName(asked)
        sizes = dealt.groupBy(*place).agg(F.sum(1 - F.col("kind")).alias("members"), F.sum("kind").alias("queries"))
        sizes = sizes.select(*place, F.ceil(F.col("members") / (2 * MEMBERS)).cast("int").alias("mb"), F.ceil(F.col("queries") / QUERIES).cast("int").alias("qb")).where("mb > 0 and qb > 0")
        told = dealt.join(sizes, place)
        own_part = lambda by: F.array(F.pmod(F.xxhash64("id"), F.col(by)).cast("int"))
        all_parts = lambda by: F.sequence(F.lit(0), F.col(by) - 1)
        of_kind = lambda member, query: F.when(F.col("kind") == 0, member).otherwise(query)
        told = told.withColumn("m", F.explode(of_kind(own_part("mb"), all_parts("mb")))).withColumn("q", F.explode(of_kind(all_parts("qb"), own_part("qb"))))
        pairs = told.select(*place, "m", "q", "kind", "id", "n", "v", "list", "codes", "error", "probes").groupBy(*place, "m", "q").applyInArrow(_compare(models, least), "id long, partner long, n long")
    found = written(pairs, "vector-links")
    links = found.where("partner = -1").groupBy("id").agg(F.sum("n").alias("links"))
    # links are between classes; a vec_id in several classes ties their components together
    named = classes.select("class", F.col("id").alias("least"))
    edges = found.where("partner >= 0").join(named.withColumnRenamed("least", "a"), F.col("id") == F.col("class")).drop("class")
    edges = edges.join(named.withColumnRenamed("least", "b"), F.col("partner") == F.col("class")).select("a", "b")
    members = own.join(classes.select("label", "width", "v", "class", F.col("n").alias("copies"), F.col("id").alias("least")), ["label", "width", "v"])
    members = written(members.select("vec_id", "class", "copies", "least"), "vector-members")
    edges = edges.unionByName(members.where("vec_id <> least").select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    groups = components(edges, "vectors")
    known = members.join(links, F.col("class") == F.col("id"), "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = embeddings.select("vec_id", "embedding", "label")
    rest = alone.withColumn("ok", is_usable("embedding")).where(~F.col("ok") | F.col("label").isNull() | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    out = known.unionByName(rest).join(groups, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

