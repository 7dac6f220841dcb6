"""Token-id output: a binary file format with Re-Pair grammar compression.

A file is a Parquet part; a row is a shard of consecutive documents in ascending doc_id order (Spark's commit protocol
then makes the write safe when executors are lost, and any store that Spark reads will do). In a shard, frequent
neighbouring id pairs are replaced by new nonterminals until no pair is frequent. Stored: the rules (two symbols each)
with their expansion lengths, the compressed sequence, and for each document its symbols' place, so that one document
is decoded without the others. No rule crosses the end of a document.

Defined cases: a null or empty text holds only the end id; rows that repeat a doc_id stand one after another, ordered
by a hash of the text and then the text; null doc_ids come first; a very long text is a shard of its own; columns
besides doc_id and text are ignored; an empty table gives an empty folder that reads back as no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import partitions, scratch_root, text_slices
from .tokens import encoder, public_path

SHARD_IDS = 1 << 20
#: Words whose ids a worker keeps, some 70 bytes each and their place in a dict.
REMEMBER = 500_000
#: Occurrences from which a pair is frequent; a rule takes three words, its two symbols and its length.
LEAST_COUNT = 8
#: Nonterminals are numbered from here; ids of the tokenizer lie below.
FIRST_RULE = 1 << 24
FORMAT = "task int, shard int, doc_ids binary, doc_nulls binary, doc_places binary, rules binary, rule_lengths binary, symbols binary, n_ids long"


def _sorted_pairs(left: np.ndarray, right: np.ndarray, at: np.ndarray, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of symbols of so many bits in ascending order, and their places among n, ascending for equal pairs."""
    pair = left.astype(np.int64)
    pair <<= bits
    pair |= right
    low = n.bit_length()
    if 2 * bits + low > 63:
        order = np.argsort(pair, kind="stable")
        return pair[order], at[order]
    pair <<= low  # pair and place in one word: a plain sort does it
    pair |= at
    pair.sort()
    place = (pair & ((1 << low) - 1)).astype(np.int32)
    pair >>= low
    return pair, place


def repair(ids: np.ndarray, ends: np.ndarray, least: int = LEAST_COUNT):
    """Compress ids; ends marks the last id of each document. Gives (symbols, ends of documents in symbols, rules).

    Each round counts the pairs that can be frequent: at first all, then those with a new nonterminal and those frequent
    before but not replaced; other counts only fall. All frequent pairs are replaced at once; where they overlap, the more
    frequent one, in a run of one pair every other one. A pair that keeps less than half of `least` places that way waits
    for the next round. The most frequent pair keeps at least half of its places, so every round replaces some; the last
    one finds no frequent pair. The sequence is a linked list, so a round costs what changed. Inside, nonterminals are
    numbered from the largest id on, so that a pair and its place fit into one word.
    """
    n = len(ids)
    base = int(ids.max()) + 1 if n else 0
    if base > FIRST_RULE:
        raise ValueError(f"ids must be below {FIRST_RULE}")
    symbol, last, alive, begins = ids.astype(np.int32), np.zeros(n, bool), np.ones(n, bool), np.ones(n, bool)
    last[ends], begins[ends] = True, False  # begins: a pair begins here
    following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    rank, rules, made = np.zeros(n + 1, np.int32), [np.zeros((0, 2), np.int64)], 0  # before[0] reads the spare place at the end
    at = np.flatnonzero(begins).astype(np.int32)
    while len(at):
        bits = (base + made).bit_length()
        pair, place = _sorted_pairs(symbol[at], symbol[following[at]], at, bits, n)
        edge = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1], [True])))
        many = np.diff(edge)
        frequent = np.flatnonzero(many >= least)
        if not len(frequent):
            break
        edge, many = edge[frequent], many[frequent]
        order = np.argsort(-many, kind="stable")
        ranks = np.empty(len(order), np.int32)
        ranks[order] = np.arange(len(order), 0, -1)
        spots = np.repeat(edge - np.cumsum(many) + many, many)
        spots += np.arange(len(spots))
        place = place[spots]
        rank[place] = np.repeat(ranks, many)
        wide = 8 * len(place) > n  # a pass over all places is cheaper then
        p = np.flatnonzero(rank).astype(np.int32) if wide else np.sort(place)
        q, own = following[p], rank[p]
        take = own > rank[before[p]]
        run = np.flatnonzero((q[:-1] == p[1:]) & (own[1:] == own[:-1])) + 1
        if len(run):
            head = np.flatnonzero(np.concatenate(([True], np.diff(run) != 1)))
            take[run] = (run - np.repeat(run[head] - 1, np.diff(head, append=len(run)))) & 1 == 0
        take &= own >= rank[q]
        rank[p] = 0
        taken = np.flatnonzero(take)
        which = len(order) - own[taken]
        used = np.bincount(which, minlength=len(order)) >= least // 2
        stays = used[which]
        first, which = p[taken[stays]], which[stays]
        second = following[first]
        number = (base + made - 1 + np.cumsum(used)).astype(np.int32)
        chosen = pair[edge[order[used]]]
        rules.append(np.stack((chosen >> bits, chosen & ((1 << bits) - 1)), axis=1))
        made += len(chosen)
        symbol[first], last[first], alive[second] = number[which], last[second], False
        begins[first], begins[second] = begins[second], False
        after = following[second]
        following[first] = after
        inside = after < n
        before[after[inside]] = first[inside]
        near = before[first]
        if wide:
            again = np.zeros(n + 1, bool)
            again[p] = again[near] = True
            at = np.flatnonzero(again[:n] & begins).astype(np.int32)
        else:
            at = np.sort(np.concatenate((p, near[near >= 0])))
            at = at[begins[at] & np.concatenate(([True], at[1:] != at[:-1]))]
    keep = np.flatnonzero(alive)
    symbols, pairs = symbol[keep].astype(np.uint32), np.concatenate(rules).astype(np.uint32)
    for x in (symbols, pairs):
        x += (x >= base) * np.uint32(FIRST_RULE - base)
    return symbols, np.flatnonzero(last[keep]), pairs


def rule_lengths(rules: np.ndarray) -> np.ndarray:
    """How many ids each rule expands to; a rule only uses earlier ones."""
    out = []
    for a, b in rules.tolist():
        out.append((out[a - FIRST_RULE] if a >= FIRST_RULE else 1) + (out[b - FIRST_RULE] if b >= FIRST_RULE else 1))
    return np.array(out, np.uint32)


def _widths(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many ids each symbol expands to."""
    out, big = np.ones(len(symbols), np.int64), np.flatnonzero(symbols >= FIRST_RULE)
    out[big] = lengths[symbols[big] - FIRST_RULE]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids, each symbol's put where its length and those before it say; a round only touches nonterminals that are left."""
    lengths = rule_lengths(rules) if lengths is None else lengths
    left, right = np.ascontiguousarray(rules.T)
    shift = _widths(left, lengths)  # from a rule's place to that of its right symbol
    if not np.array_equal(shift + _widths(right, lengths), lengths):
        raise ValueError("a rule's length is not that of its two symbols")
    width = _widths(symbols, lengths)
    at = np.cumsum(width) - width
    out = np.empty(int(width.sum()), np.uint32)
    out[at] = symbols
    big = np.flatnonzero(symbols >= FIRST_RULE)
    at, rule = at[big], symbols[big] - FIRST_RULE
    while len(at):
        a, b, after = left[rule], right[rule], at + shift[rule]
        out[at], out[after] = a, b
        in_a, in_b = np.flatnonzero(a >= FIRST_RULE), np.flatnonzero(b >= FIRST_RULE)
        at, rule = np.concatenate((at[in_a], after[in_b])), np.concatenate((a[in_a], b[in_b])) - FIRST_RULE
    return out


def document(row: dict, k: int) -> np.ndarray:
    """Ids of the k-th document of a shard row, without decoding the others."""
    places = np.frombuffer(row["doc_places"], "<u4")
    symbols = np.frombuffer(row["symbols"], "<u4")[places[k] : places[k + 1]]
    lengths = np.frombuffer(row["rule_lengths"], "<u4") if "rule_lengths" in row else None
    return expand(symbols, np.frombuffer(row["rules"], "<u4").reshape(-1, 2), lengths)


def _shards(path: str, keeps_space: bool, shard_ids: int):
    kinds = (pa.int32(), pa.int32(), *(pa.binary(),) * 6, pa.int64())
    names = [x.split()[0] for x in FORMAT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, shard = encoder(path, keeps_space, REMEMBER), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in text_slices(whole, most_bytes=4 << 20):
                ids, at = enc.encode_with_end(batch.column("text"))
                docs = batch.column("doc_id")
                bare, null = np.asarray(docs.fill_null(0)), np.asarray(docs.is_null().to_numpy(zero_copy_only=False))
                part = (at[1:] - 1) // shard_ids
                edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                for a, b in zip(edges, edges[1:]):
                    if b > a:
                        symbols, ends, rules = repair(ids[at[a] : at[b]], at[a + 1 : b + 1] - at[a] - 1)
                        values = (task, shard, bare[a:b].astype("<i8").tobytes(), np.packbits(null[a:b]).tobytes(), np.concatenate(([0], ends + 1)).astype("<u4").tobytes(), rules.astype("<u4").tobytes(), rule_lengths(rules).astype("<u4").tobytes(), symbols.astype("<u4").tobytes(), int(at[b] - at[a]))
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)
                        shard += 1

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, keeps_space: bool = False, shard_ids: int = SHARD_IDS) -> None:
    """Write docs' token ids (an end id after each document) to folder, ascending by doc_id."""
    path = tokenizer or public_path("word_bpe_49k.json")
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    # range bounds go through the driver: the hash stands for the text there
    ordered = own.repartitionByRange(partitions(docs.sparkSession), "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    ordered.select("doc_id", "text").mapInArrow(_shards(path, keeps_space, shard_ids), FORMAT).write.option("compression", "zstd").parquet(folder)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
            places = np.frombuffer(row["doc_places"], "<u4")
            symbols = np.frombuffer(row["symbols"], "<u4")
            lengths = np.frombuffer(row["rule_lengths"], "<u4")
            at = np.concatenate(([0], np.cumsum(_widths(symbols, lengths))))[places]  # where each document's ids begin, before any decoding
            raw = memoryview(expand(symbols, rules, lengths).astype("<u4", copy=False)).cast("B")
            if len(raw) != 4 * row["n_ids"] or at[-1] != row["n_ids"]:
                raise ValueError("a shard does not expand to the length it states")
            docs = np.frombuffer(row["doc_ids"], "<i8")
            null = np.unpackbits(np.frombuffer(row["doc_nulls"], np.uint8))[: len(docs)].astype(bool)
            edges = (at * 4).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64(), mask=null), pa.array(np.full(len(docs), row["task"]), pa.int32()), pa.array(np.full(len(docs), row["shard"]), pa.int32()), pa.array(at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array([zlib.crc32(raw[a:b]) for a, b in zip(edges, edges[1:])], pa.int64())],
                names=["doc_id", "task", "shard", "at", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    shards = spark.read.schema(FORMAT).parquet(folder)
    sizes = shards.select("task", "shard", "n_ids")
    # Two short running sums: over files, and within a file over its shards; none over documents.
    files = sizes.groupBy("task").agg(F.sum("n_ids").alias("n")).select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_start"))
    inner = F.coalesce(F.sum("n_ids").over(Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("inner", inner).join(files, "task").select("task", "shard", (F.col("inner") + F.col("file_start")).alias("shard_start"))
    rows = shards.mapInArrow(_digests, "doc_id long, task int, shard int, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["task", "shard"]).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, tokenizer: str | None = None, keeps_space: bool = False) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, tokenizer, keeps_space)
    return read_tokens(spark, folder)
