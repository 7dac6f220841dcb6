"""Line dedup: lines held by many documents stay only in the document with the largest id.

Method: hashes of line keys are range-partitioned with a secondary sort by document (descending) and position; each
partition streams its sorted rows, meets the surviving document of a hash first, and returns what later documents
lose. Because the document id is part of the range key, a line held by a third of all documents is spread over many
partitions; runs cut by a partition edge are settled by adding up the summaries of their parts. What goes back to the
documents is one compressed keep bitmap for each document that loses lines; text is never shuffled for the decision.

Defined cases: a null or empty text is one empty line; keys shorter than the limit are never dropped; a line repeated
inside one document counts that document once; rows that repeat a doc_id count as one document and share its losses by
position; rows with a null doc_id are kept whole and count for nothing; a very long text is split in a batch of its own,
and its line places in a bitmap of a bit a line; other columns are carried along by dedup_lines and ignored otherwise;
where one of them is called n_lines or n_dropped, that count's name gets an underscore; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ASCII_SPACE, as_bytes, drop_written, free_name, in_batches, partitions, text_slices, written

MIN_CHARS, MIN_DOCS = 40, 5
_SPACE = ASCII_SPACE.encode()


def _long_lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                one, two, docs, places = [], [], [], []
                for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                    for place, line in enumerate(text.split(b"\n")):
                        if len(line) >= least:
                            key = line.strip(_SPACE).lower()
                            if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
                                d = hashlib.md5(key, usedforsecurity=False).digest()
                                one.append(d[:8])
                                two.append(d[8:])
                                docs.append(doc)
                                places.append(place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(b"".join(x), dtype="<i8")) for x in (one, two)] + [pa.array(docs, pa.int64()), pa.array(places, pa.int32())],
                    names=["k1", "k2", "doc_id", "pos"],
                )

    return run


def _stream(min_docs: int):
    """Sorted rows in, decisions out: kind 0 a line that goes, 1 a line that goes if its cut run proves long enough,
    2 the summary (documents, largest id) of a cut run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], [], []]
        key, rows, n_docs, first, last, edge = None, [], 0, None, None, True

        def put(kind, k, doc, pos, n, most):
            for column, value in zip(out, (kind, k[0], k[1], doc, pos, n if kind == 2 else most)):
                column.append(value)

        def close(at_end: bool):
            # rows holds what came before the run was known to be long; once it is, rows flow out at once
            if edge or at_end:
                put(2, key, first, 0, n_docs, 0)

        def batch_out():
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["kind", "k1", "k2", "doc_id", "pos", "n"])
            for c in out:
                c.clear()
            return b

        for batch in batches:
            for k1, k2, doc, pos in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "doc_id", "pos"))):
                if key is None or k1 != key[0] or k2 != key[1]:
                    if key is not None:
                        if edge:
                            for d, p in rows:
                                put(1, key, d, p, 0, 0)
                            close(False)
                        edge = key is None
                    key, rows, n_docs, first, last = (k1, k2), [], 0, doc, None
                if doc != last:
                    n_docs, last = n_docs + 1, doc
                if edge:
                    put(1, key, doc, pos, 0, 0)
                elif n_docs >= min_docs:
                    for d, p in rows:
                        put(1, key, d, p, 0, first)
                    rows = []
                    put(1, key, doc, pos, 0, first)
                else:
                    rows.append((doc, pos))
                if len(out[0]) >= 50_000:
                    yield batch_out()
        if key is not None:
            for d, p in rows:
                put(1, key, d, p, 0, 0)
            close(True)
        yield batch_out()

    return run


def _pack(places: list[int]) -> bytes:
    """Keep bitmap: bit p is 0 where line p goes; lines after the last bit stay."""
    bits = np.ones((max(places) // 8 + 1) * 8, np.uint8)  # whole bytes, padded with ones
    bits[places] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(_pack, batch.column("places").to_pylist()), pa.binary())], names=["doc_id", "bitmap"])


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[list[bytes], int]:
    """Lines that stay and how many there were."""
    lines = text.split(b"\n")
    if bitmap is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")
    return [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]], len(lines)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, bitmap) for each document that loses lines."""
    spark = docs.sparkSession
    lines = written(
        in_batches(docs.where("doc_id is not null").select("doc_id", "text"), _long_lines(min_chars), "k1 long, k2 long, doc_id long, pos int"), "lines"
    )
    order = ["k1", "k2", F.desc("doc_id")]
    ranged = lines.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "pos")
    told = written(in_batches(ranged, _stream(min_docs), "kind byte, k1 long, k2 long, doc_id long, pos int, n long"), "line-decisions")
    drop_written(lines)
    # Runs cut by a partition edge: two a partition at most, each with its summary; all other rows are settled.
    runs = told.where("kind = 2").groupBy("k1", "k2").agg(F.sum("n").alias("docs"), F.max("doc_id").alias("survivor"))
    losing = (
        told.where("kind = 1")
        .join(F.broadcast(runs), ["k1", "k2"], "left")
        .where(F.when(F.col("docs").isNull(), F.lit(True)).otherwise(F.col("docs") >= min_docs))
        .where(F.col("doc_id") < F.coalesce("survivor", "n"))
    )
    places = losing.groupBy("doc_id").agg(F.collect_set("pos").alias("places"))  # a document's own lines
    return in_batches(places, _bitmaps, "doc_id long, bitmap binary")


def _apply(keep_text: bool, names: list[str], bitmap_name: str, counts: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                n, lost, kept = [], [], []
                nulls = batch.column("text").is_null().to_pylist()
                for text, bitmap, null in zip(as_bytes(batch.column("text")), batch.column(bitmap_name).to_pylist(), nulls):
                    lines, count = kept_lines(text, bitmap)
                    n.append(count)
                    lost.append(count - len(lines))
                    left = b"\n".join(lines)
                    kept.append((None if null else left) if keep_text else hashlib.sha256(left).hexdigest())
                cut = pa.array(kept, pa.binary()).cast(pa.string()) if keep_text else pa.array(kept, pa.string())
                own = [cut if c == "text" else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(lost, pa.int64()), *([] if keep_text else [cut])], names=[*names, *counts])

    return run


def _with_bitmaps(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, str]:
    """docs with each document's bitmap. Bitmaps grow with the documents, so this is a merge join at every size and never a broadcast."""
    own, name = free_name("doc_id_of_bitmap", docs.columns), free_name("bitmap", docs.columns)
    maps = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias(own), F.col("bitmap").alias(name)).hint("merge")
    return docs.join(maps, docs["doc_id"] == F.col(own), "left").drop(own), name


def count_names(columns: list[str]) -> tuple[str, str]:
    """What dedup_lines calls its two counts beside these columns."""
    return free_name("n_lines", columns), free_name("n_dropped", columns)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the text that stays, and the two counts of count_names()."""
    names, counts = docs.columns, list(count_names(docs.columns))
    joined, bitmap = _with_bitmaps(docs, min_chars, min_docs)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return in_batches(joined, _apply(True, names, bitmap, counts), f"{kinds}, {counts[0]} long, {counts[1]} long")


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    joined, bitmap = _with_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs)
    return in_batches(joined, _apply(False, ["doc_id"], bitmap, ["n_lines", "n_dropped", "kept_sha256"]), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
