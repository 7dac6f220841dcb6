"""Best-fit packing of token documents into sequences of at most ``capacity`` tokens.

Lengths are integers up to the capacity, so the instance is a histogram: how many pieces there are of each length.
The driver packs that histogram (at most ``capacity`` counters however many documents there are): Martello-Toth
dominance fixes sets that provably beat all alternatives, over and over while any holds, and best-fit decreasing packs
what is left, bins of equal content being one pattern with a multiplicity. Executors then place each piece by its rank
within its length: ranks come from counts by task and length, never from a sort of the corpus or one task.

A document longer than the capacity is cut so that its first piece takes the remainder and all others are full.

Defined cases: a null or empty text is one piece holding only the end id; rows that repeat a doc_id, or hold a null one,
are packed each; a very long text is encoded in a batch of its own; pieces of equal length take their places in order of
task and row; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_batches, text_slices, written
from .tokens import encoder, public_path

CAPACITY = 1024
#: Pieces that a worker's encoder remembers.
REMEMBER = 100_000
#: Bytes of text that are encoded at once; smaller slices save little memory and cost time.
SLICE = 1 << 20
Pattern = tuple[tuple[tuple[int, int], ...], int]


def _best_pair(sizes: list[int], counts: dict[int, int], room: int) -> int:
    """The largest sum of two pieces that fit into room, 0 if none do; sizes ascend."""
    best, low, high = 0, 0, len(sizes) - 1
    while low <= high:
        total = sizes[low] + sizes[high]
        if total > room or (low == high and counts[sizes[low]] < 2):
            high -= 1
        else:
            best = max(best, total)
            low += 1
    return best


def _dominant(size: int, counts: dict[int, int], room: int) -> tuple[int, ...] | None:
    """Companions of a piece of that size that dominate all others which fit beside it, if there are such; counts are
    without that piece.

    A set dominates another if the other's pieces can be grouped so that each group fits under one of its own. So a
    single companion dominates if it fills the room, if no two fit, or if no three fit and no two are larger together;
    two dominate if no three fit, the first is the largest that fits, and of any two that fit one is no larger than the
    second.
    """
    fits = sorted(k for k, n in counts.items() if n > 0 and k <= room)
    if not fits:
        return ()
    largest = fits[-1]
    least = [k for k in fits[:3] for _ in range(min(3, counts[k]))][:3]
    if largest == room or len(least) < 2 or sum(least[:2]) > room:
        return (largest,)
    if len(least) == 3 and sum(least) <= room:
        return None
    if _best_pair(fits, counts, room) <= largest:
        return (largest,)
    beside = [k for k in fits if k <= room - largest and counts[k] > (k == largest)]
    if beside and not _best_pair([k for k in fits if k > beside[-1]], counts, room):
        return (largest, beside[-1])
    return None


def _reduce(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Martello-Toth: fix, from the largest length down, sets of up to three pieces that dominate every other set with
    that length, as often as the pieces last (fewer other pieces leave them dominant), until a pass finds none."""
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        for size in sorted(counts, reverse=True):
            while counts.get(size, 0) > 0:
                counts[size] -= 1
                companions = _dominant(size, counts, capacity - size)
                counts[size] += 1
                if companions is None:
                    break
                need: dict[int, int] = {}
                for k in (size, *companions):
                    need[k] = need.get(k, 0) + 1
                n = min(counts[k] // m for k, m in need.items())
                fixed.append((tuple(need.items()), n))
                for k, m in need.items():
                    counts[k] -= n * m
                    if counts[k] == 0:
                        del counts[k]
                again = True
    return fixed


def _best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over the histogram; groups of equal bins move together."""
    groups: dict[int, list[list]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r, g in groups.items() if r >= size and g), default=None)
            if room is None:
                items, many, room = (), (left + capacity // size - 1) // (capacity // size), capacity
            else:
                items, many = groups[room].pop()
            each = room // size
            full, rest = divmod(min(left, each * many), each)
            for bins, take in ((full, each), (1 if rest else 0, rest), (many - full - (1 if rest else 0) if items else 0, 0)):
                if bins:
                    groups.setdefault(room - take * size, []).append([(*items, (size, take)) if take else items, bins])
            left -= min(left, each * many)
    return [(tuple(items), many) for g in groups.values() for items, many in g]


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns ((length, how many), ...) with how many sequences have each."""
    left = {k: n for k, n in counts.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must lie in 1..capacity")
    return _reduce(left, capacity) + _best_fit(left, capacity)


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(path, True, REMEMBER), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in text_slices(whole, most_bytes=SLICE):
                ids, at = enc.encode_with_end(batch.column("text"))
                raw, lens = memoryview(ids.astype("<u4").tobytes()), np.diff(at)
                n = -(-lens // capacity)
                first = lens - (n - 1) * capacity
                doc = np.repeat(np.arange(len(lens)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                begin = ((at[:-1][doc] + start) * 4).tolist()
                crc = [zlib.crc32(raw[b:e]) for b, e in zip(begin, (np.array(begin) + length * 4).tolist())]
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.searchsorted(ordered, ordered) + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(rank)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
                )

    return run


def _place(patterns: list[Pattern]):
    """Tables (length, first rank) -> per bin, first sequence, offset; bounded by the histogram."""
    rows, used, sequence = [], {}, 0
    for items, many in patterns:
        offset = 0
        for length, each in items:
            rows.append((length, used.get(length, 0), each, sequence, offset))
            used[length] = used.get(length, 0) + each * many
            offset += length * each
        sequence += many
    rows.sort()
    size, low, each, base, offset = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
    key = (size << 44) + low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            i = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            nth = rank - low[i]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(base[i] + nth // each[i]), pa.array(offset[i] + nth % each[i] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row a piece."""
    path = tokenizer or public_path("byte_bpe_50k.json")
    cut = written(in_batches(docs.select("doc_id", "text"), _pieces(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = written(by_task.select("task", "length", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("shift")), "shifts")
    counts = {r["length"]: r["n"] for r in shifts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    # a row a task and length: it grows with the tasks, so it is merged and never broadcast
    ranked = cut.join(shifts.drop("n").hint("merge"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("shift"))
    return in_batches(
        ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), _place(pack_histogram(counts, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
