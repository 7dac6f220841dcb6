"""What the training-data operators share: the scratch folder, table reading, word splitting and hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}

#: The six ASCII white-space code points the contracts split and strip on.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below the shared one that spark.checkpoint.dir names; where that is unset, a temporary one, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/lexweave-{app}"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="lexweave-scratch-")
    return _LOCAL_SCRATCH[app]


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that this application's operators have written, once no plan reads their results any more."""
    _delete(spark, scratch_root(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Delete the files behind tables made by written(), once no later plan reads them."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, with underscores behind it as long as a taken column is called so (Spark ignores case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


BLOCK = 1024


def array_blocks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's array of sums as rows (block, values) of BLOCK numbers each; blocks of zeros are left out."""
    at = [i for i in range(0, len(total), BLOCK) if total[i : i + BLOCK].any()]
    yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK for i in at], pa.int32()), pa.array([total[i : i + BLOCK].astype("<f8").tobytes() for i in at], pa.binary())], names=["block", "values"])


def summed(blocks: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' arrays of that size. Each block is summed as a stream, so a task holds one sum a block however many tasks there were; the driver gets size numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, values in zip(batch.column("block").to_pylist(), batch.column("values").to_pylist()):
                new = np.frombuffer(values, "<f8")
                held[block] = held[block] + new if block in held else new
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["block", "values"])

    many = max(1, min(partitions(blocks.sparkSession), -(-size // BLOCK)))
    rows = blocks.repartition(many, "block").mapInArrow(run, "block int, values binary").toArrow()
    out = np.zeros(size)
    for block, values in zip(rows.column("block").to_pylist(), rows.column("values").to_pylist()):
        new = np.frombuffer(values, "<f8")
        out[block * BLOCK : block * BLOCK + len(new)] += new
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of rows after which a batch for a Python worker ends.
BATCH_BYTES = 2 << 20


def in_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) on batches of about BATCH_BYTES: ten thousand whole texts at once would be buffers of tens
    of MB in the worker and in the JVM, whose allocator keeps them. The bound is the session's from then on, as plans read
    it when they run; one that is set already stays. It ends batches, no rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def text_slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice holds much more than most_bytes of text (one longer text is a slice of its own)."""
    if batch.num_rows == 0:
        return
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0))
    part = np.cumsum(sizes.astype(np.int64)) // most_bytes
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: worker processes live on between stages and share their executor's limit."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Words of [^\\x20\\x09-\\x0D]+ with A-Z lower-cased: bytes methods touch ASCII only, which is the contract."""
    return text.lower().split()


def word_hashes(tokens: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=n)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def crc_mod(column: str, by: int):
    """crc32 of the column as decimal text, modulo by."""
    return F.crc32(F.col(column).cast("string")) % F.lit(by)


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (id, component), component the smallest id.

    Alternating large-star and small-star steps. Each step is an aggregation (combined before the shuffle) and
    an equi-join that adaptive execution can split where one id has very many edges; each round is a written
    table, so nothing is collected and a lost executor costs one round at most. Ids without edges are left out.
    """
    now = written(edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges")
    mark_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark_of(now)
    if before[0] == 0:
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))  # repeats go with those of the round
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(floor, "a").select(F.col("b").alias("x"), "m", "a")
        pairs = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        after = written(pairs.where("a <> b").distinct(), f"{name}-round")
        mark = mark_of(after)
        drop_written(now)
        now = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
