"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Fitting: a bounded sample of labelled documents (``SAMPLE`` ids, those of smallest id hash) gives term weights, a
truncated singular value decomposition and the labelled latent vectors; together under two megabytes, sent to every task.
Scoring: for each document the exact cosine products with all labelled vectors, in blocks; the nearest ``NEIGHBOURS``
vote with their labels, weighted by similarity.

Terms are of two kinds, over the whole text: hashed pairs of neighbouring bytes, and how many words ago a word last
occurred (by powers of two, within a stretch of the text). Labels, lang, source and doc_id are no inputs of a score.

Defined cases: a null, empty or blank text has no terms, hence no near neighbours: its score is the share of label 1 in
the sample; without any usable label every score is 0.5; labels that are null are ignored and repeated ones averaged; of
rows that repeat a labelled doc_id the one with the smallest terms is learnt; repeated rows get equal scores, ties among
neighbours are settled alike for equal texts; a very long text is counted stretch by stretch; columns besides doc_id and text
are carried along by good_documents, whatever their names, and ignored otherwise; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, crc_mod, in_batches, text_slices

SAMPLE, DIMENSIONS, NEIGHBOURS, THRESHOLD = 4000, 48, 5, 0.3
PAIRS, GAPS = 1024, 16
TERMS = PAIRS + GAPS
_SLOT = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int32)
_STRETCH = 1 << 18


def _pair_counts(texts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    n = len(texts)
    joined = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8)
    ends = np.cumsum(sizes + 1)  # a text's pairs reach to the zero byte behind it
    counts = np.zeros(n * PAIRS, np.int64)
    for a in range(0, int(ends[-1]) if n else 0, _STRETCH):
        b = min(a + _STRETCH, int(ends[-1]))
        first, final = np.searchsorted(ends, (a, b - 1), side="right")
        doc = np.repeat(np.arange(first, final + 1), np.diff(np.concatenate(([a], np.minimum(ends[first : final + 1], b)))))
        pair = (joined[a:b].astype(np.int32) << 8) | joined[a + 1 : b + 1]
        inside = joined[a:b] != 0
        low, high = int(first) * PAIRS, (int(final) + 1) * PAIRS
        counts[low:high] += np.bincount((doc * PAIRS + _SLOT[pair])[inside] - low, minlength=high - low)
    return counts.reshape(n, PAIRS)


def _gap_counts(texts: list[bytes]) -> np.ndarray:
    """Words of each text by the gap to the same word before it in a stretch: none, 1, 2 to 3, 4 to 7 and so on."""
    counts = np.zeros((len(texts), GAPS), np.int64)
    for i, text in enumerate(texts):
        for a in range(0, len(text), _STRETCH):
            own = np.fromiter(map(hash, text[a : a + _STRETCH].split()), np.int64)
            order = np.argsort(own, kind="stable")
            same = own[order[1:]] == own[order[:-1]]
            gap = np.frexp((order[1:] - order[:-1])[same].astype(np.float32))[1]
            counts[i] += np.bincount(np.minimum(gap, GAPS - 1), minlength=GAPS)
            counts[i, 0] += len(own) - len(gap)
    return counts


def terms(texts: list[bytes]) -> np.ndarray:
    """Square roots of the shares of each text's terms: PAIRS hashed byte pairs, then GAPS word gaps."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pairs, gaps = _pair_counts(texts, sizes), _gap_counts(texts)
    return np.sqrt(np.hstack([pairs / np.maximum(sizes, 1)[:, None], gaps / np.maximum(gaps.sum(axis=1), 1)[:, None]])).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


class LatentVote:
    """The fitted model: term weights, projection, labelled unit vectors and their labels."""

    def __init__(self, matrix: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS):
        self.neighbours = min(neighbours, len(labels))
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        if not len(labels):
            return
        seen = (matrix > 0).sum(axis=0)
        self.weight = np.log(1 + len(matrix) / (1 + seen)).astype(np.float32)
        weighed = matrix * self.weight
        self.centre = weighed.mean(axis=0)  # all texts share most terms; without the mean the cosines tell them apart
        spread = _unit(weighed - self.centre)
        vectors = np.linalg.eigh((spread.T @ spread).astype(np.float64))[1]
        self.basis = vectors[:, ::-1][:, :dimensions].astype(np.float32)
        self.points = _unit(spread @ self.basis)

    def latent(self, texts: list[bytes]) -> np.ndarray:
        """Unit vectors of the latent space."""
        return _unit((terms(texts) * self.weight - self.centre) @ self.basis)

    def score(self, texts: list[bytes], block: int = 256) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        full = np.flatnonzero([bool(t.strip()) for t in texts])
        for at in range(0, len(full), block):
            ids = full[at : at + block]
            near = self.latent([texts[i] for i in ids]) @ self.points.T
            k = self.neighbours
            top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < near.shape[1] else np.broadcast_to(np.arange(k), near.shape)
            w = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64)
            total = w.sum(axis=1)
            out[ids] = np.where(total > 0, (w * self.labels[top]).sum(axis=1) / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0.0, 1.0)


def _rows_of_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_slices(whole, most_bytes=1 << 20):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                m = terms(as_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r.tobytes() for r in m], pa.binary())], names=["doc_id", "terms"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold: int = 5, held: int = 0) -> LatentVote:
    """Learn from labelled rows whose crc32(doc_id) mod fold is not held; at most sample of them, by smallest id hash."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null").where(crc_mod("doc_id", fold) != held)
    chosen = usable.groupBy("doc_id").agg(F.avg("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = own.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")  # at most sample ids
    one = in_batches(rows, _rows_of_terms, "doc_id long, terms binary").groupBy("doc_id").agg(F.min("terms").alias("terms"))  # so the driver gets a row an id
    found = one.join(chosen, "doc_id").orderBy("doc_id").toArrow()
    matrix = np.frombuffer(b"".join(found.column("terms").to_pylist()), np.float32).reshape(-1, TERMS)
    return LatentVote(matrix, np.array(found.column("label").to_pylist(), np.float64))


def _scores(model: LatentVote, fold: int, held: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, most_bytes=1 << 20):
                score = model.score(as_bytes(batch.column("text")))
                rest = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*rest, "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    model = fit(docs, labels, fold=fold, held=held)
    own = docs.select("doc_id", F.coalesce(crc_mod("doc_id", fold) == held, F.lit(False)).alias("held_out"), "text")
    return in_batches(own, _scores(model, fold, held, threshold), "doc_id long, held_out boolean, score double, predicted int")


def _keepers(model: LatentVote, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, most_bytes=1 << 20):
                yield batch.filter(pa.array(model.score(as_bytes(batch.column("text"))) >= threshold))

    return run


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs' rows that the classifier does not reject."""
    return in_batches(docs, _keepers(fit(docs, labels), threshold), docs.schema)
