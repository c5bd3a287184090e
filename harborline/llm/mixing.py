"""Mixing sources to target weights by Pfair scheduling.

A source's documents are cut into blocks of equal row count. With weights w out of W, block i of a source is released
at slot floor(i W / w) and due at slot ceil((i + 1) W / w); each slot goes to the released block with the earliest deadline.
The number of blocks a source has had then differs from its ideal share by less than one at every slot. Weights are the
targets themselves as exact fractions, so the bound holds at every size. When a source runs out, the others go on with their
weights among themselves (a new phase). No row is dropped or repeated.

Exact targets have no short period: the slot of every block is worked out in turn on the driver, 8 bytes each. A block has
``BLOCK_ROWS`` rows, or a ``MOST_BLOCKS``-th of the table where that is more, so the driver's work is bounded.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, free

BLOCK_ROWS, BUCKET_ROWS, GROUP_BUCKETS = 16, 2048, 1024
#: The driver works out the slot of so many blocks at most (8 bytes each, broadcast): of a larger table blocks are larger.
MOST_BLOCKS = 1 << 20
#: Slots of so many blocks of a source lie in one row of the table.
CHUNK_BLOCKS = 1024
#: Offsets of (source, bucket) up to so many are broadcast, so rows with their texts stay where the ranking put them.
BROADCAST_OFFSETS = 100_000


def fair(weights: list[int]) -> Iterator[int]:
    """The source of every slot, without end."""
    total = sum(weights)
    later = [(0, -(-total // w), s, 0) for s, w in enumerate(weights)]
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while True:
        while later and later[0][0] <= slot:
            _, deadline, s, i = heapq.heappop(later)
            heapq.heappush(ready, (deadline, s, i))
        deadline, s, i = heapq.heappop(ready)
        assert slot < deadline
        yield s
        i, w = i + 1, weights[s]
        heapq.heappush(later, (i * total // w, -(-(i + 1) * total // w), s, i))
        slot += 1


def schedule(blocks: list[int], weights: list[int]) -> list[array]:
    """Per source, the slot of each of its blocks. Sources of weight 0 come after the others, in equal parts."""
    slots, at = [array("q") for _ in blocks], 0
    while rest := [s for s, n in enumerate(blocks) if len(slots[s]) < n]:
        active = [s for s in rest if weights[s]] or rest
        for k in fair([weights[s] or 1 for s in active]):
            slots[active[k]].append(at)
            at += 1
            if len(slots[active[k]]) == blocks[active[k]]:
                break
    return slots


def exact_weights(rows: Mapping, target: Mapping | None) -> dict:
    """Targets (default: square roots of row counts) as integers in exactly their proportions; 0 for sources without one."""
    raw = {s: Fraction((target or {}).get(s, 0) if target is not None else n**0.5) for s, n in rows.items()}
    if any(w < 0 for w in raw.values()):
        raise ValueError("weights must not be negative")
    scale = math.lcm(*(w.denominator for w in raw.values()))
    return {s: int(w * scale) for s, w in raw.items()}


def mixed(docs: DataFrame, target: Mapping | None = None, block_rows: int | None = None, source: str = "source", key: str = "doc_id", names: tuple[str, str, str] = ("block", "slot", "position")) -> DataFrame:
    """docs plus block, slot and position; ordering by position gives the mixture.

    Rows of a source go to blocks by hash bucket, then key; equal rows are interchangeable. A null source is a source of its
    own; rows without a key or with one key are dealt by the rest of the row. Sources without a target follow when the others are used up; an empty table stays empty.
    Extra columns stay; one that has the name of a new column is kept as ``<name>_input``. block_rows: ``BLOCK_ROWS``, or the
    ``MOST_BLOCKS``-th part of the table where that is more. Sources are few by nature (each has a target): one row each
    comes to the driver. Their rows are ranked per (source, bucket), so a hot source is spread over many tasks.
    """
    docs = aside(docs, *names)
    bucket, tie, rank, before_, s, b, group, n_, k_, c_, slots_ = free([*docs.columns, *names], *"bucket tie rank before s b group n k c slots".split())
    order = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if c != key and "map<" not in t and t != "variant"], F.lit(1))
    total = docs.groupBy(source).agg(F.count("*")).collect()
    rows = sum(r[1] for r in total)
    block_rows = block_rows or max(BLOCK_ROWS, -(-rows // MOST_BLOCKS))
    buckets = max(1, -(-rows // BUCKET_ROWS))
    # rows that share a key, null ones too, are told apart by the hash of the whole row, so a hot key is many buckets
    docs = docs.withColumn(tie, order).withColumn(bucket, F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(tie)), F.lit(buckets)).cast("long"))
    before = _before(docs.groupBy(F.col(f"`{source}`").alias(s), F.col(bucket).alias(b)).agg(F.count("*").alias(n_)), s, b, n_, group, before_)
    if len(total) * buckets <= BROADCAST_OFFSETS:
        before = F.broadcast(before)
    place = F.row_number().over(Window.partitionBy(F.col(f"`{source}`"), bucket).orderBy(F.col(f"`{key}`").asc_nulls_first(), tie)) - 1
    ranked = docs.withColumn(rank, place).join(before, F.col(f"`{source}`").eqNullSafe(F.col(s)) & (F.col(bucket) == F.col(b)))
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(before_)).drop(bucket, tie, s, b, before_)
    known = sorted((r[0] for r in total), key=lambda x: (x is not None, x))
    n = {r[0]: r[1] for r in total}
    weights = exact_weights(n, target)
    slots = schedule([-(-n[x] // block_rows) for x in known], [weights[x] for x in known])
    chunks = [(k, at) for k, x in enumerate(slots) for at in range(0, len(x), CHUNK_BLOCKS)]
    arrays = [np.frombuffer(slots[k], np.int64)[at : at + CHUNK_BLOCKS] for k, at in chunks]
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), np.concatenate([np.zeros(0, np.int64), *arrays]))
    parts = pa.table({k_: pa.array([k for k, _ in chunks], pa.int32()), c_: pa.array([at // CHUNK_BLOCKS for _, at in chunks], pa.int64()), slots_: lists})
    spark = docs.sparkSession
    by_number = spark.createDataFrame(list(enumerate(known)), f"`{k_}` int, `{s}` {docs.schema[source].dataType.simpleString()}")
    table = F.broadcast(spark.createDataFrame(parts, f"`{k_}` int, `{c_}` long, `{slots_}` array<long>").join(F.broadcast(by_number), k_))  # 8 bytes a block
    block, slot, position = names
    out = ranked.withColumn(block, F.floor(F.col(rank) / block_rows))
    out = out.join(table, F.col(f"`{source}`").eqNullSafe(F.col(s)) & (F.floor(F.col(block) / CHUNK_BLOCKS) == F.col(c_)))
    out = out.withColumn(slot, F.element_at(slots_, (F.col(block) % CHUNK_BLOCKS + 1).cast("int")))
    out = out.withColumn(position, F.col(slot) * block_rows + F.col(rank) % block_rows)
    return out.drop(s, k_, c_, slots_, rank)


def _before(sizes: DataFrame, s: str, b: str, n: str, group: str, before: str) -> DataFrame:
    """(s, b, before): rows of a source in the buckets below b. Sums of groups of buckets come first, so no task has more
    rows than ``GROUP_BUCKETS`` or a source's groups."""
    sizes = sizes.withColumn(group, F.floor(F.col(b) / GROUP_BUCKETS))
    below = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn(before, F.coalesce(F.sum(n).over(below(Window.partitionBy(s, group).orderBy(b))), F.lit(0)))
    groups = sizes.groupBy(s, group).agg(F.sum(n).alias(n))
    lead = groups.select(F.col(s).alias(f"{s}_g"), F.col(group).alias(f"{group}_g"), F.coalesce(F.sum(n).over(below(Window.partitionBy(s).orderBy(group))), F.lit(0)).alias(f"{before}_g"))
    both = inside.join(lead, F.col(s).eqNullSafe(F.col(f"{s}_g")) & (F.col(group) == F.col(f"{group}_g")))
    return both.select(s, b, (F.col(before) + F.col(f"{before}_g")).alias(before))


def in_order(docs: DataFrame, target: Mapping | None = None, block_rows: int | None = None) -> DataFrame:
    """docs with their columns, range-partitioned and sorted into mixture order."""
    names = tuple(free(docs.columns, "block", "slot", "position"))
    out = mixed(docs, target, block_rows, names=names)
    return out.repartitionByRange(names[2]).sortWithinPartitions(names[2]).drop(*names)


def placed(docs: DataFrame) -> DataFrame:
    """docs, written by ``in_order`` and read again, plus position: rows from 0 in the order in which they were written.

    Spark packs file splits into tasks by size, so the order of files is told by their names. A position has no gaps. Rows
    that come from no files are numbered with gaps in the order of their partitions. A column named position is kept as
    position_input.
    """
    if "Relation" not in docs._jdf.queryExecution().analyzed().nodeName():
        return aside(docs, "position").withColumn("position", F.monotonically_increasing_id())
    kept = aside(docs, "position").columns
    file, row, before = free([*kept, "position"], "file", "row", "before")
    name = F.col("_metadata.file_name")
    sizes = docs.groupBy(name.alias(file)).agg(F.count("*")).collect()  # a row of each file
    part = lambda f: [int(x) for x in re.search(r"part-(\d+)\D.*?(?:-c(\d+))?\.[a-z.0-9]+\Z", f).groups("0")]
    offsets, total = [], 0
    for r in sorted(sizes, key=lambda r: part(r[0])):
        offsets.append((r[0], total))
        total += r[1]
    starts = F.broadcast(docs.sparkSession.createDataFrame(offsets, f"`{file}` string, `{before}` long"))
    numbered = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, kept)], name.alias(file), F.col("_metadata.row_index").alias(row)).join(starts, file)
    return numbered.select(*[F.col(f"`{k}`") for k in kept], (F.col(before) + F.col(row)).alias("position"))


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, source, block, slot, position under square-root weights."""
    return mixed(docs.select("doc_id", "source")).select("doc_id", "source", "block", "slot", "position")
