"""MinHash near-dedup with SuperMinHash signatures.

1. One scan: each document's set of distinct word shingles (64-bit hashes), a 128-bit digest of the set, a SuperMinHash
   signature, and the signature's band keys. Equal sets form a class; only its smallest document goes on.
2. Band keys met twice are buckets. Pivot rounds: the members of a bucket meet one of them (the smallest, then another
   at random), and pairs are verified on the full sets. Before that, sizes and one-bit sketches (a bit of each signature
   value) rule pairs out that hardly reach the similarity; a pair ruled out wrongly is met again in step 3. Verified
   links give components; later rounds only join components, so a round's graph is what is new.
3. Members of buckets that still hold several components, however few or many, go through a prefix join of their full
   sets, which is exact: shingles are ordered rare first; two sets of the similarity share one among the first quarter of
   the larger and the first seventh of the smaller (both shares follow from 0.75), and their positions there bound the
   overlap. A frequent passage stands at the end of that order.
4. Components (union by smallest id); classes give their members their component.

Banding: 48 bands of 5 rows miss a pair at similarity 0.75 with probability (1 - 0.75^5)^48 = 2.3e-6.

Defined cases: words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; with fewer words than the shingle the whole sequence is
one; a null, empty or blank text has an empty set and is its own component; rows that repeat a doc_id with equal text
are one class, with different texts their component is the smallest id of any of them; a null doc_id forms its own
row without links; a very long text is a batch of its own, its signature in bounded pieces; other columns are ignored by
near_groups and carried along by dedup_documents, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import array_blocks, as_bytes, components, drop_written, free_name, in_batches, mix64, summed, text_slices, word_hashes, words, written

SHINGLE, SHARE = 5, 75
BANDS, ROWS = 48, 5
PIVOT_ROUNDS = 1
#: Elements whose signature draws are held at once; short sets need 2 bytes an element and signature value.
ELEMENTS = 100_000
#: Bits of the token counters of the prefix join: at least, and at most (32 MB of counters).
COUNTER_BITS = (16, 22)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    tokens = [words(t) for t in texts]
    lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
    total = int(lens.sum())
    h = mix64(word_hashes(chain.from_iterable(tokens), total)) if total else np.zeros(0, np.uint64)
    ends = np.cumsum(lens)
    with np.errstate(over="ignore"):
        factors = mix64(np.arange(1, k + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
        rolled = np.zeros(max(0, total - k + 1), np.uint64)
        for j in range(k if len(rolled) else 0):
            rolled += h[j : j + len(rolled)] * factors[j]
        rolled = mix64(rolled)
        out = []
        for n, end in zip(lens.tolist(), ends.tolist()):
            if n >= k:
                out.append(np.unique(rolled[end - n : end - k + 1]))
            elif n:
                out.append(mix64((h[end - n : end] * factors[:n]).sum(keepdims=True) ^ mix64(np.array([n], np.uint64))))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash of each non-empty set: int64 (level << 32 | fraction), all sets at once.

    Element e at level j draws a fraction and a place from j on; its places so far are a partial Fisher-Yates shuffle.
    A set stops at the first level after which its largest value lies below the next one, so a set of n >> m elements
    draws a few levels and not m.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    x = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    sig = np.full((len(sets), m), np.iinfo(np.int64).max)
    flat = sig.reshape(-1)
    active = np.ones(len(sets), bool)
    swaps: list[tuple[np.ndarray, np.ndarray]] = []
    table = None
    with np.errstate(over="ignore"):
        for j in range(m):
            draw = mix64(x + np.uint64(j + 1) * _GOLD)
            fraction = (draw & np.uint64(0xFFFFFFFF)).astype(np.int64)
            place = j + (((draw >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
            if table is None and j == 6:  # few sets are left: a whole shuffle for each element
                table = np.broadcast_to(np.arange(m, dtype=np.int16), (len(x), m)).copy()
                rows = np.arange(len(x))
                for i, (k, v) in enumerate(swaps):
                    table[rows, k] = v
            if table is not None:
                rows = np.arange(len(x))
                slot, own = table[rows, place].astype(np.int64), table[:, j].copy()
                table[rows, place] = own
            else:
                slot, own = place.copy(), np.full(len(x), j, np.int64)
                for k, v in swaps:
                    slot = np.where(k == place, v, slot)
                    own = np.where(k == j, v, own)
                swaps.append((place, own))
            np.minimum.at(flat, doc * m + slot, (j << 32) | fraction)
            live = np.flatnonzero(active)
            active[live] = sig[live].max(axis=1) >= (j + 1) << 32
            if not active.any():
                break
            keep = active[doc]
            if not keep.all():
                x, doc = x[keep], doc[keep]
                swaps = [(k[keep], v[keep]) for k, v in swaps]
                table = table[keep] if table is not None else None
    return sig


def signatures(sets: list[np.ndarray], m: int, most: int = ELEMENTS) -> np.ndarray:
    """super_minhash in groups of about `most` elements; a larger set is a group of its own and stops after a few levels."""
    group = np.cumsum([len(s) for s in sets]) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sets)]
    return np.vstack([super_minhash(sets[a:b], m) for a, b in zip(edges, edges[1:])])


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band; the band's number is in it."""
    with np.errstate(over="ignore"):
        salt = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64) * _GOLD)
        mixed = mix64(sig.astype(np.uint64)[:, : bands * rows] + salt)
        return mix64(mixed.reshape(len(sig), bands, rows).sum(axis=2, dtype=np.uint64)).astype(np.int64)


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((2, len(sets)), np.uint64)
    with np.errstate(over="ignore"):
        for i, s in enumerate(sets):
            out[0, i], out[1, i] = mix64(s).sum(dtype=np.uint64), mix64(s ^ _GOLD).sum(dtype=np.uint64)
    return out[0].astype(np.int64), out[1].astype(np.int64)


def _scan(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, most_bytes=4 << 20):
                sets = shingle_sets(as_bytes(batch.column("text")), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, words_ = np.zeros((len(sets), bands), np.int64), -(-bands * rows // 64)
                sketch = np.zeros((len(sets), words_), np.int64)
                if full:
                    sig = signatures([sets[i] for i in full], bands * rows)
                    keys[full], sketch[full] = band_keys(sig, bands, rows), _sketches(sig)
                one, two = _digests(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two), *(pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1))) for x in (keys, sketch))],
                    names=["doc_id", "n", "d1", "d2", "bands", "sketch"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, most_bytes=4 << 20):
                sets = shingle_sets(as_bytes(batch.column("text")), k)
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                values = np.concatenate(sets).astype(np.int64) if len(sets) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(values))], names=["id", "items"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Of pairs (a, b, x, y) whose sets satisfy 100 * intersection >= share * union, the components x and y, once each."""
    one = sets.select(F.col("id").alias("a"), F.col("items").alias("left"))
    two = sets.select(F.col("id").alias("b"), F.col("items").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    linked = pairs.join(two, "b").join(one, "a").where(100 * both >= share * (F.size("left") + F.size("right") - both))
    return linked.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _sketches(sig: np.ndarray) -> np.ndarray:
    """The lowest bit of each signature value, packed into longs: equal values agree, others agree half of the time."""
    bits = (sig & 1).astype(np.uint8)
    wide = np.zeros((len(sig), -(-sig.shape[1] // 64) * 64), np.uint8)
    wide[:, : sig.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<i8")


def _most_differing(m: int, share: int) -> int:
    """Bits in which a pair at the similarity differs at most, but for one in three million (five deviations)."""
    p = (1 - share / 100) / 2
    return int(m * p + 5 * (m * p * (1 - p)) ** 0.5) + 1


def _may_link(share: int, m: int):
    """Condition on rows l and r of a bucket: other component, sizes that allow the similarity, sketches near enough."""
    differing = sum((F.bit_count(F.get("l.sketch", F.lit(i)).bitwiseXOR(F.get("r.sketch", F.lit(i)))) for i in range(1, -(-m // 64))), F.bit_count(F.get("l.sketch", F.lit(0)).bitwiseXOR(F.get("r.sketch", F.lit(0)))))
    return (F.col("l.component") != F.col("r.component")) & (100 * F.least("l.n", "r.n") >= share * F.greatest("l.n", "r.n")) & (differing <= _most_differing(m, share))


def near_groups(docs: DataFrame, k: int = SHINGLE, share: int = SHARE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    own = docs.select("doc_id", "text")
    # A doc_id may stand in several rows; then a set is named by its digest as well, and rows of one id are linked.
    scan = written(in_batches(own, _scan(k, bands, rows), "doc_id long, n long, d1 long, d2 long, bands array<long>, sketch array<long>"), "signatures")
    some = scan.where("n > 0 and doc_id is not null")
    twice_named = _repeats(scan)
    classes = written(some.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("class")), "classes")
    heads = some.join(classes, ["d1", "d2", "n"]).where("doc_id = class").select(F.col("class").alias("id"), "n", "sketch", "bands")
    keys = heads.select("id", F.explode("bands").alias("key"))
    met = keys.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key")
    shared = written(keys.join(met, "key"), "bucket-keys")
    buckets = written(shared.join(heads.select("id", "n", "sketch"), "id"), "buckets")
    sets = written(in_batches(own.join(shared.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), _sets(k), "id long, items array<long>"), "sets")
    drop_written(shared)
    groups = None
    # Pivot rounds: a bucket's members meet one of them, first the smallest, then another at random. Each costs pairs in
    # the number of members; after them only what is still apart goes on.
    for turn in range(1 + PIVOT_ROUNDS):
        left = _mixed(buckets, groups)
        if turn and left.isEmpty():
            break
        order = F.col("id") if turn == 0 else F.xxhash64("id", "key", F.lit(turn))
        pivot = left.groupBy("key").agg(F.min_by(F.struct("id", "n", "sketch", "component"), order).alias("p")).select("key", "p.*")
        on = (F.col("l.key") == F.col("r.key")) & _may_link(share, bands * rows)
        groups = _merged(groups, _verified(_pairs(left.alias("l").join(pivot.alias("r"), on)), sets, share), f"pivot-{turn}")
    apart = _mixed(buckets, groups).groupBy("id").agg(F.first("component").alias("component"))
    groups = _prefix_joined(apart, sets, share, groups)
    drop_written(buckets, sets)
    if twice_named:
        twice = some.join(some.groupBy("doc_id").count().where("count > 1").select("doc_id"), "doc_id").join(classes, ["d1", "d2", "n"]).where("class <> doc_id")
        of = lambda side: groups.select(F.col("id").alias(side), F.col("component").alias(f"{side}_component"))
        ends = twice.select("class", "doc_id").distinct().join(of("class"), "class", "left").join(of("doc_id"), "doc_id", "left")
        groups = _merged(groups, ends.select(F.coalesce("class_component", "class").alias("a"), F.coalesce("doc_id_component", "doc_id").alias("b")), "named")
    by_class = classes.join(groups, F.col("class") == F.col("id"), "left").select("d1", "d2", "n", F.coalesce("component", "class").alias("component"))
    out = scan.select("doc_id", "n", "d1", "d2").join(by_class, ["d1", "d2", "n"], "left")
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _mixed(buckets: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Rows of buckets whose members are in several components, with their component."""
    if groups is None:
        return buckets.withColumn("component", F.col("id"))
    told = buckets.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = told.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    return told.join(apart, "key", "left_semi")


def _pairs(met: DataFrame) -> DataFrame:
    """Rows l and r that met, as distinct (a, b, x, y): the ids in order, and their components."""
    l, r = (F.struct(F.col(f"{side}.id").alias("id"), F.col(f"{side}.component").alias("component")) for side in "lr")
    return met.select(F.least(l, r).alias("p"), F.greatest(l, r).alias("q")).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("p.component").alias("x"), F.col("q.component").alias("y")).distinct()


def _merged(groups: DataFrame | None, edges: DataFrame, name: str) -> DataFrame:
    """groups (id, component; the smallest id of a component has no row) after edges between components joined them."""
    solved = components(edges, f"near-{name}")
    if groups is None:
        return written(solved, f"groups-{name}")
    newer = solved.select(F.col("id").alias("component"), F.col("component").alias("newer"))
    moved = groups.join(newer, "component", "left").select("id", F.coalesce("newer", "component").alias("component"))
    return written(moved.unionByName(solved), f"groups-{name}")


def _prefixes(share: int, counts: np.ndarray):
    """Rows (token, id, component, n, at, low) of each set's probing prefix, rare tokens first; low marks its indexing prefix.

    The order is (count of the token's counter, token): one order for all sets, which is all that exactness asks for.
    """
    names = ["token", "id", "component", "n", "at", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, component, items in zip(batch.column("id").to_pylist(), batch.column("component").to_pylist(), batch.column("items")):
                tokens = items.values.to_numpy()
                n = len(tokens)
                order = np.lexsort((tokens, counts[tokens & (len(counts) - 1)]))
                probe, index = n - -(-share * n // 100) + 1, n - -(-2 * share * n // (100 + share)) + 1
                at = np.arange(probe)
                yield pa.RecordBatch.from_arrays([pa.array(tokens[order[:probe]]), *(pa.array(np.full(probe, x, np.int64)) for x in (doc, component, n)), pa.array(at), pa.array(at < index)], names=names)

    return run


def _counted(counters: int):
    """Tokens by counter, summed within the task before any row leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("items").flatten().to_numpy() & (counters - 1), minlength=counters)
        yield from array_blocks(total)

    return run


def _prefix_joined(members: DataFrame, sets: DataFrame, share: int, groups: DataFrame) -> DataFrame:
    """groups after all pairs of members (id, component) across components that a prefix join leaves possible were verified."""
    own = written(members.join(sets, "id"), "prefix-sets")
    elements = own.agg(F.sum(F.size("items"))).first()[0]
    if not elements:
        return groups
    counters = 1 << int(np.clip(np.ceil(np.log2(elements)) - 3, *COUNTER_BITS))  # so that a counter holds few rare tokens
    counts = summed(in_batches(own.select("items"), _counted(counters), "block int, values binary"), counters).astype(np.float32)
    prefixes = in_batches(own.select("id", "component", "items"), _prefixes(share, counts), "token long, id long, component long, n long, at long, low boolean")
    prefixes = written(prefixes, "prefixes")
    useful = prefixes.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("low").alias("any")).where("any and x <> y").select("token")
    rows = prefixes.join(useful, "token", "left_semi")
    left, right = rows.where("low").alias("l"), rows.alias("r")
    after = (F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.id") < F.col("r.id")))
    bound = (100 + share) * F.least(F.col("l.n") - F.col("l.at"), F.col("r.n") - F.col("r.at")) >= share * (F.col("l.n") + F.col("r.n"))
    on = (F.col("l.token") == F.col("r.token")) & (F.col("l.component") != F.col("r.component")) & after & bound & (100 * F.col("l.n") >= share * F.col("r.n"))
    groups = _merged(groups, _verified(_pairs(left.join(right, on)), own, share), "prefix")
    drop_written(own, prefixes)
    return groups


def _repeats(scan: DataFrame) -> bool:
    """Whether any doc_id stands in several rows."""
    return not scan.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def dedup_documents(docs: DataFrame, **options) -> DataFrame:
    """docs' rows of which one stays for each group: the smallest doc_id. Of rows that repeat a doc_id, unlike texts are groups of their own."""
    named = docs.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = near_groups(docs, **options).where("kept and doc_id is not null").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
    row = free_name("row_number_of_dedup", docs.columns)
    numbered = written(named.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = near_groups(numbered.select(F.col(row).alias("doc_id"), "text"), **options).select(F.col("doc_id").alias(row), "component_id")
    first = numbered.select(row, "doc_id").join(groups, row).groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("first")).select(F.col(f"first.{row}").alias(row))
    return numbered.join(first, row, "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
