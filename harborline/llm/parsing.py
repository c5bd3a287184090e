"""Document fingerprints by locally consistent parsing.

A text's code points are cut into phrases by deterministic coin tossing: each symbol is labelled by the lowest bit in which
its name differs from its left neighbour's (three rounds bring 64-bit names down to eight labels, neighbours always differ),
and a phrase begins at each local maximum. A phrase's name is a hash of the names in it; phrases are cut into phrases again,
level by level. Where to cut depends on a few neighbours only, so equal substrings get equal interior phrases at any offset.

The fingerprint is the bottom-k sketch of the phrase names of levels ``LEVELS`` (about 8 to 30 code points each).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, aside, mix, n_blocks, pieces

LEVELS, KEEP = (2, 3), 64
RANGE_BYTES, KNOTS, CHUNK_CHARS, GROUP_RANGES = 4 << 20, 1000, 1 << 18, 1024
#: Up to so many ranges their first keys are broadcast (three numbers each), beyond that joined by shuffle.
BROADCAST_RANGES = 100_000
_BITS = np.arange(128)
_DIFFERS = _BITS[:, None] ^ _BITS[None, :]
_LOW = np.where(_DIFFERS == 0, 0, np.log2(np.maximum(_DIFFERS & -_DIFFERS, 1))).astype(np.int64)
#: Label of a symbol labelled a, right of one labelled b, in a further round: entry 128 a + b.
_TOSS = (2 * _LOW + (_BITS[:, None] >> _LOW & 1)).astype(np.uint8).ravel()
_LOW16 = np.concatenate([[16], np.log2(np.arange(1, 1 << 16) & -np.arange(1, 1 << 16))]).astype(np.uint8)
_NAME16 = mix(np.arange(1, (1 << 16) + 1).astype(np.uint64))
_PLACE = mix(np.arange(1, 4097).astype(np.uint64)) | U64(1)


def _lowest_bit(x: np.ndarray) -> np.ndarray:
    """Position of the lowest set bit of each value (the width where none is)."""
    out = _LOW16[x & x.dtype.type(0xFFFF)]
    more = np.flatnonzero(out == 16)
    for shift in range(16, x.dtype.itemsize * 8, 16):
        if not len(more):
            break
        out[more] = shift + _LOW16[x[more] >> x.dtype.type(shift) & x.dtype.type(0xFFFF)]
        more = more[out[more] == shift + 16]
    return out


def phrases(names: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases of each text names[off[i]:off[i + 1]], and their offsets.

    names: 32-bit code points at the lowest level, 64-bit names above. Nothing looks across texts.
    """
    n = len(names)
    if not n:
        return names.astype(U64), off
    first = np.zeros(n + 1, bool)
    first[off] = True
    first = first[:n]
    # a run of one name becomes one symbol, so that neighbours differ; its length goes into the phrase's name
    begin = first.copy()
    begin[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(begin)
    run = np.diff(at, append=n)
    x, first = names[at], first[at]
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = ~x[first]
    low = _lowest_bit(x ^ before)
    label = ((x >> low.astype(x.dtype) & x.dtype.type(1)).astype(np.uint8) + 2 * low) & np.uint8(127)
    for _ in range(2):
        pair = label.astype(np.uint16) << 7
        pair[1:] |= label[:-1]
        pair[first] = (label[first].astype(np.uint16) << 7) | (label[first] ^ 1)
        label = _TOSS[pair]
    peak = first.copy()
    peak[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
    start = np.flatnonzero(peak)
    size = np.diff(start, append=len(x))
    place = np.arange(len(x)) - np.repeat(start, size)
    value = _NAME16[x] if x.dtype == np.uint32 and int(x.max()) < 1 << 16 else mix(x.astype(U64) + U64(1))
    value = value * _PLACE[place & 4095]
    long = np.flatnonzero(run > 1)
    value[long] = mix(value[long] + run[long].astype(U64))
    return mix(np.add.reduceat(value, start) + size.astype(U64)), np.searchsorted(at[start], off)


def sketches(texts: list[str], keep: int = KEEP, levels: tuple[int, ...] = LEVELS) -> list[np.ndarray]:
    """Each text's sorted smallest phrase names (32 bits), at most ``keep``; none for an empty text."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    off = np.concatenate([[0], np.cumsum(size)])
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    got, who = [], []
    for level in range(1, max(levels) + 1):
        names, off = phrases(names, off)
        if level in levels:
            got.append(names)
            who.append(np.repeat(np.arange(len(texts)), np.diff(off)))
    name, owner = np.concatenate(got) >> U64(32), np.concatenate(who)
    order = np.argsort(owner.astype(U64) << U64(32) | name)
    name, owner = name[order], owner[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
    name, owner = name[new], owner[new]
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    name = name.astype(np.uint32)
    return [name[a : min(b, a + keep)] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Estimated Jaccard similarity of the phrase sets behind two sketches; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:keep]
    return float(np.isin(both, a, assume_unique=True)[np.isin(both, b, assume_unique=True)].sum() / len(both))


def _hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus fingerprint (hex of the sketch) of each whole text; null counts as empty. A column fingerprint is kept as fingerprint_input."""
    docs = aside(docs, "fingerprint")
    schema = docs.withColumn("fingerprint", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(_hex, sketches(texts)), pa.string())], names=[*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(run, schema)


def ranged(rows: DataFrame, key: str, size: Column, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, int]:
    """rows plus _range, ascending with the key (nulls: -1), of about range_bytes each; and how many ranges there may be.

    At most ``KNOTS`` quantiles of the key come to the driver; between two of them ranges are of equal width.
    """
    n = n_blocks(rows, size, range_bytes)
    knots = rows.agg(F.percentile_approx(key, [i / min(n, KNOTS) for i in range(min(n, KNOTS) + 1)], 100_000)).first()[0]
    if not knots:
        return rows.withColumn("_range", F.lit(-1).cast("long")), 1
    knots = sorted(set(knots))
    each = max(1, -(-n // max(1, len(knots) - 1)))
    inner = F.array(*[F.lit(k) for k in knots[1:-1]]) if len(knots) > 2 else F.lit([]).cast("array<bigint>")
    at = F.size(F.filter(inner, lambda k: k <= F.col(key)))
    low = F.element_at(F.array(*[F.lit(k) for k in knots]), at + 1)
    high = F.element_at(F.array(*[F.lit(k) for k in [*knots[1:], knots[-1] + 1][: max(1, len(knots) - 1)]]), at + 1)
    inside = F.greatest(F.lit(0), F.least(F.lit(each - 1), F.floor((F.col(key) - low) * F.lit(float(each)) / (high - low + 1))))
    return rows.withColumn("_range", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(at * F.lit(each) + inside).cast("long")), each * max(1, len(knots) - 1) + 1


def _ranges_before(first: DataFrame) -> DataFrame:
    """(_r, _id, _h, _to): each range's first document, and the range before it (before the first one: the last).

    first: _range, f. Ranges look for their neighbour within groups of them; between groups only their ends meet.
    """
    first = first.withColumn("_group", F.floor(F.col("_range") / GROUP_RANGES))
    inside = first.withColumn("_to", F.lag("_range").over(Window.partitionBy("_group").orderBy("_range")))
    ends = first.groupBy("_group").agg(F.max("_range").alias("_last"))
    order = Window.orderBy("_group")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(F.col("_group").alias("_g"), F.coalesce(F.lag("_last").over(order), F.last("_last").over(whole)).alias("_end"))  # a row for each GROUP_RANGES ranges
    return inside.join(ends, F.col("_group") == F.col("_g")).select(F.col("_range").alias("_r"), F.col("f.doc_id").alias("_id"), F.col("f.h").alias("_h"), F.coalesce("_to", "_end").alias("_to"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first as many (or all) of the
    next document, ascending doc_id; the last document's next is the first. A null text is empty; a null doc_id comes
    first; documents that share a doc_id follow the hash of their text, and equal rows count as one document (each row is
    returned). A lone document is its own next.

    Whole texts are shuffled once, into ranges of the key; the first document of a range also goes to the range before.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, most = ranged(rows, "doc_id", F.octet_length("text") + 16)
    rows = rows.withColumn("h", F.xxhash64("text", F.octet_length("text")))
    first = rows.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "h")).alias("f"))
    before = _ranges_before(first)
    if most <= BROADCAST_RANGES:
        before = F.broadcast(before)
    tagged = rows.join(before, (F.col("_range") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    ends = F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("edge")))).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("edge")), F.struct(F.col("_to").alias("r"), F.lit(True).alias("edge"))))
    dealt = tagged.select("doc_id", "h", "text", F.explode(ends).alias("e")).select("e.r", "e.edge", "doc_id", "h", "text")
    dealt = dealt.repartition("r").sortWithinPartitions("r", "edge", F.col("doc_id").asc_nulls_first(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []  # range, edge, id, hash, text, rows; equal rows once

        def done(chunk: list[list]) -> pa.RecordBatch:
            """Results of all but the last of the chunk; the last is the next document of the one before it."""
            own = sketches([x[4] for x in chunk])
            mine = [i for i in range(len(chunk) - 1) if not chunk[i][1]]
            texts = [chunk[i][4] for i in mine]
            edited = [t[: len(t) - len(t) // 4] + chunk[i + 1][4][: len(t) // 4] for i, t in zip(mine, texts)]
            new = sketches(edited)
            again = np.repeat(np.arange(len(mine)), [chunk[i][5] for i in mine])
            cols = [
                pa.array([chunk[i][2] for i in mine], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                pa.array([_hex(own[i]) for i in mine], pa.string()),
                pa.array(map(_hex, new), pa.string()),
                pa.array([likeness(own[i], e) for i, e in zip(mine, new)], pa.float64()),
                pa.array([likeness(own[i], own[i + 1]) for i in mine], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays([c.take(pa.array(again)) for c in cols], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        size = 0
        for batch in pieces(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:4] == tuple(held[-1][:4]):
                    held[-1][5] += 1
                    continue
                if held and row[0] != held[-1][0]:
                    yield done(held)  # the range is complete: its last row is the edge
                    held, size = [], 0
                held.append([*row, 1])
                size += len(row[4])
                if size > CHUNK_CHARS and len(held) > 1:
                    yield done(held)
                    held, size = held[-1:], len(held[-1][4])
        if held:
            yield done(held)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_likeness(docs.select(F.col("doc_id").cast("long"), "text"))
