"""Helpers shared by the corpus operators: durable intermediates and components."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; if it has fewer files than there are cores, its rows are dealt out to all of them.

    That is for small tables of one file. Larger ones are read as they lie.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master may do without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="logweave-"))
    return _local[0]


#: Tables written that weren't released yet: of the process, and of the scopes one is in, innermost last.
_written: list[str] = []
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
_lock = threading.Lock()


def _own(outer: bool = False) -> list[str]:
    held = (_written, *_scopes.get())
    return held[max(0, len(held) - 1 - outer)]


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Spark's setting that deletes shuffle files as soon as the write that made them has ended, and not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, outer: bool = False) -> str:
    """Writes ``df`` to the shared folder; its path. What nobody releases goes when the driver's JVM ends.

    With ``outer`` it outlives the scope one is in, and belongs to the one around it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/logweave/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    fs, at = _at(spark, path)
    fs.deleteOnExit(at)
    with _lock:
        _own(outer).append(path)
    return path


def durable(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    This cuts the lineage with a copy every executor can reread, so a lost
    executor costs its running tasks only.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df, label))


def unreleased() -> list[str]:
    with _lock:
        return list(_own())


def release(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that were written here: the named ones, or all of the scope one is in.

    For when nothing lazy depends on them any more: frames that operators have
    returned do until they are written themselves.
    """
    for path in paths or unreleased():
        fs, at = _at(spark, path)
        fs.delete(at, True)
        with _lock:
            if path in _own():
                _own().remove(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is written within is released at the end; other threads' tables are left alone."""
    token = _scopes.set((*_scopes.get(), []))
    try:
        yield
        release(spark)
    finally:
        _scopes.reset(token)


def settled(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written; what it wrote on its way is released at once."""
    with scope(spark):
        df = make()
        path = written(df, label, outer=True)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a sieve for each wanted key, and for all of them together: 8 MB.
SPARSE, SIEVE = 32, 1 << 26


def marked(df: DataFrame, key: str, wanted: DataFrame, into: str, most: int = SIEVE) -> DataFrame:
    """``df`` with a column ``into``: false where ``key`` is surely not among those of ``wanted`` (one column, written), else true.

    Bits stand for hashes of keys, ``SPARSE`` for each but ``most`` in all, so what is broadcast is bounded; with more keys than
    that more of the others are marked too, never fewer of the wanted. ``into`` is no column of ``df``.
    """
    p = prefix(df)
    bits = max(min(1 << (SPARSE * wanted.count()).bit_length(), most), 1 << 15)
    slot = lambda name: F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(bits))
    at, bucket, held = f"{p}at", f"{p}bucket", f"{p}bits"
    table = wanted.select(slot(wanted.columns[0]).alias(at)).groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(held))
    both = df.withColumn(at, F.bitmap_bit_position(slot(key))).withColumn(bucket, F.bitmap_bucket_number(slot(key))).join(F.broadcast(table), bucket, "left")
    byte = F.conv(F.hex(F.substring(F.col(held), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    found = F.coalesce(F.getbit(byte, F.col(at).bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return both.select(*[F.col(f"`{c}`") for c in df.columns], found.alias(into))


def sieved(df: DataFrame, key: str, wanted: DataFrame, most: int = SIEVE) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among those of ``wanted`` (one column, written), and about one in ``SPARSE`` of the others.

    For ahead of an exact join by that key: rows that meet nothing aren't shuffled. See ``marked``.
    """
    into = f"{prefix(df)}found"
    return marked(df, key, wanted, into, most).where(F.col(into)).drop(into)


def prefix(*frames: DataFrame) -> str:
    """A beginning that no column of the frames has, for helper columns of one's own."""
    taken = [c.lower() for df in frames for c in df.columns]
    p = "__lw_"
    while any(c.startswith(p) for c in taken):
        p += "_"
    return p


def _trim() -> None:
    """Gives freed memory back to the system: a worker is used again by other stages, which would find it taken."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
        if trim:
            trim(0)


def mapped(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = 1000) -> DataFrame:
    """``df`` through a function from pandas frames to pandas frames, of at most ``rows`` rows each.

    Spark bounds the bytes of an Arrow batch; its rows become Python objects
    a slice at a time, so a worker's memory doesn't hang on any setting of the session.
    Whole numbers that may be null come as objects, and lose nothing.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    yield batch.slice(at, rows).to_pandas(integer_object_nulls=True)

        try:
            for out in fn(slices()):
                yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)
        finally:
            _trim()

    return df.mapInArrow(run, schema)


#: Bytes of text that a kernel over Arrow buffers takes at a time, unless one text has more.
SLICE = 4 << 20


def slices(text: pa.Array, size: int = SLICE, rows: int = 1000) -> list[tuple[int, int]]:
    """(start, length) of stretches of a text array of at most ``size`` bytes and ``rows`` rows, or of one row; at least one."""
    ends = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4) if len(text) else np.zeros(1, np.int32)
    out, at = [], 0
    while at < len(text):
        to = int(np.searchsorted(ends, int(ends[at]) + size, "right")) - 1
        to = min(max(to, at + 1), at + rows, len(text))
        out.append((at, to - at))
        at = to
    return out or [(0, 0)]


def with_kernel(df: DataFrame, inputs: list[Column], fn: Callable[..., pa.Array], kind: str, into: str) -> DataFrame:
    """``df`` with a column ``into`` that ``fn`` makes of slices of the inputs' Arrow arrays, the first of which is a text; null texts come as empty ones.

    A column called ``into`` is replaced, whatever its case; others pass through as they are. This is a step of its own in the plan,
    and not a function in a projection, so that whatever made the inputs is worked out before it.
    """
    p = prefix(df)
    kept = [c for c in df.columns if c.lower() != into.lower()]
    own = df.select(*[F.col(f"`{c}`") for c in kept], *[x.alias(f"{p}{i}") for i, x in enumerate(inputs)])
    schema = T.StructType([*own.schema.fields[: len(kept)], T.StructField(into, T._parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column(len(kept)).cast(pa.string()), "")
            rest = batch.columns[len(kept) + 1 :]
            for at, n in slices(text) if len(text) else []:
                made = fn(text.slice(at, n), *[x.slice(at, n) for x in rest])
                yield pa.RecordBatch.from_arrays([*[x.slice(at, n) for x in batch.columns[: len(kept)]], made], [*kept, into])

    return own.mapInArrow(run, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: (node, component), written.

    Alternates the large-star and small-star steps until the edge set stays
    the same; every step is one grouped minimum with its lineage cut. The component is its
    smallest node. Nodes without an edge to another node are not returned.
    Null ends and self loops are ignored; an empty list gives an empty table.
    A star's centre is found by a grouped minimum (combined map-side) and joined
    back, so a node with very many neighbours is never gathered in one task.
    """
    return settled(edges.sparkSession, "components", lambda: _components(edges, a, b))


def _components(edges: DataFrame, a: str, b: str) -> DataFrame:
    links = durable(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct(),
        "links",
    )

    def fingerprint(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        return tuple(row)

    seen = fingerprint(links)
    while seen[0]:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        centre = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(centre, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .distinct()
        )
        large = durable(large, "large-star")
        centre = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(centre, "hi")
            .select(
                F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"),
                F.col("m").alias("lo"),
            )
            .distinct()
        )
        links = durable(small, "small-star")
        now = fingerprint(links)
        if now == seen:
            break
        seen = now
    return links.groupBy("hi").agg(F.min("lo").alias("component")).select(
        F.col("hi").alias("node"), "component"
    ).unionAll(links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
