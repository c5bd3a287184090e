"""Shared helpers: written tables in the checkpoint folder, UTF-8 buffers as numpy, token hashes.

The numpy helpers run inside tasks on the batches Spark hands them.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one numpy pass inside a task takes at once (single longer texts pass alone): its arrays stay in the cache.
CHUNK_BYTES = 256 << 10
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_SYMBOL = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a temporary one is set on a local master only."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="harborline-"))
    return spark.sparkContext.getCheckpointDir()


def free(columns: Iterable[str], *names: str) -> list[str]:
    """names with as many underscores in front as it takes to be none of columns (Spark does not tell cases apart)."""
    used = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def aside(df: DataFrame, *names: str) -> DataFrame:
    """df with its own columns of these names, which an operator is about to add, kept as ``<name>_input``."""
    taken = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in taken]
    new = dict(zip(clash, free([*df.columns, *names], *(f"{c}_input" for c in clash))))
    return df.select(*[F.col(f"`{c}`").alias(new.get(c, c)) for c in df.columns]) if clash else df


def written(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    by: an integer column whose values have a folder each, which can be dropped by itself.

    The table goes when the driver ends; ``dropped`` removes it sooner.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the job's shuffle files go when the table is there
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back._harborline_path = path
    return back


def dropped(df: DataFrame, part: str = "") -> None:
    """Delete a table that ``written`` made, or one folder of it (``column=value``), once nothing reads it any more."""
    for path in getattr(df, "_harborline_path", "").split():
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def joined(parts: list[DataFrame]) -> DataFrame:
    """Tables that ``written`` made, of one schema, as one; ``dropped`` deletes them all."""
    paths = [p._harborline_path for p in parts]
    out = parts[0].sparkSession.read.schema(parts[0].schema).parquet(*paths)
    out._harborline_path = " ".join(paths)
    return out


def crc_fold(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 offsets from 0; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(col) else np.zeros(0, np.uint8)
    return raw, offsets - (offsets[0] if len(offsets) else 0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about ``most`` bytes of text; a longer single text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + most, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values of a sorted array."""
    cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])).tolist() if len(values) else []
    return list(zip(cuts[:-1], cuts[1:]))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inv = pow(_BASE, -1, 1 << 64)
        _POWERS[size] = tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64))]) for b in (_BASE, inv))
    return _POWERS[size]


#: Bytes whose spans are hashed together.
SPAN_BYTES = 1 << 20


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), in order of their starts; equal bytes hash alike wherever they lie.

    A long text is taken stretch by stretch, and a longer span piece by piece: its hash is that of its pieces put together.
    """
    size = (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
    if len(raw) <= SPAN_BYTES:
        return mix(_sums(raw, start, end) + size)
    out, i = np.empty(len(start), U64), 0
    while i < len(start):
        a = int(start[i])
        j = int(np.searchsorted(end, a + SPAN_BYTES, "right"))
        if j > i:
            out[i:j] = _sums(raw[a : int(end[j - 1])], start[i:j] - a, end[i:j] - a)
        else:
            j, total = i + 1, 0
            for k, at in enumerate(range(a, int(end[i]), SPAN_BYTES)):
                piece = raw[at : min(at + SPAN_BYTES, int(end[i]))]
                total += int(_sums(piece, np.zeros(1, np.int64), np.array([len(piece)]))[0]) * pow(_BASE, k * SPAN_BYTES, 1 << 64)
            out[i] = total & (1 << 64) - 1
        i = j
    return mix(out + size)


def _sums(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(_SYMBOL[raw] * up[: len(raw)], out=total[1:])
    return (total[end] - total[start]) * down[start]


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs outside ASCII white space: starts, ends, and each token's text number. Texts never run together."""
    ink = np.zeros(len(raw) + 2, bool)
    ink[1:-1] = ~WHITE[raw]
    starts = ink[1:] & ~ink[:-1]
    ends = ink[:-1] & ~ink[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    both = cut[ink[cut] & ink[cut + 1]]
    starts[both] = True
    ends[both] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return start, end, np.searchsorted(offsets, start, "right") - 1


def n_blocks(df: DataFrame, size: Column, target: int) -> int:
    """How many blocks of about ``target`` units df needs (one aggregated row comes to the driver)."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return max(1, -(-int(total) // target))
