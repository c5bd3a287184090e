"""Sharding by extendible hashing, in DataFrame functions only.

A row's key gives 60 hash bits. A bucket is a prefix of them; one that holds more bytes than the limit splits on the next bit,
others do not, until every bucket fits. The final buckets do not depend on the order of splits: a row's bucket is its shortest
prefix that fits. The directory has 2**g entries, g a few bits above log2(bytes / limit); entries whose bucket still does
not fit are refined by a directory of all bits over their rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, free, written

LIMIT_BYTES = 1 << 20
BITS, SPARE_BITS = 60, 4


def hash_bits(key: Column) -> Column:
    """The first 60 bits of md5(key as text); a null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _directory(rows: DataFrame, bits: int, limit: int) -> DataFrame:
    """(entry, depth, bytes): the bucket of each directory entry in use; depth is null where even all ``bits`` do not fit.

    rows: h, size. Sums are made per entry before anything is multiplied by depths. Prefixes that fit are told first: entries
    look for theirs from the least depth at which any does, so no task gets the entries of a prefix that is too short.
    """
    entries = written(rows.groupBy(F.shiftright("h", BITS - bits).alias("entry")).agg(F.sum("size").alias("bytes")), "entries")
    prefix = F.expr(f"shiftright(entry, {bits} - depth)").alias("prefix")
    at = entries.select("entry", "bytes", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    fits = written(at.groupBy("depth", prefix).agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") <= limit), "fits")
    least = fits.agg(F.min("depth")).first()[0]
    near = entries.select("entry", F.explode(F.sequence(F.lit(bits if least is None else least), F.lit(bits))).alias("depth")).select("entry", "depth", prefix)
    first = near.join(fits, ["depth", "prefix"]).groupBy("entry").agg(F.min(F.struct("depth", "bytes")).alias("b"))
    return entries.select("entry").join(first, "entry", "left").select("entry", "b.depth", "b.bytes")


def _split(rows: DataFrame, limit: int, total: int, h: str, size: str, depth: str, bytes_: str) -> tuple[DataFrame, DataFrame | None]:
    """rows (with hash h and size) plus depth and bytes of their shard; and, if any, those whose bucket exceeds the limit on all bits."""
    bits = min(BITS, max(1, (total // max(1, limit)).bit_length() + SPARE_BITS))
    (entry,) = free([*rows.columns, depth, bytes_], "entry")
    done, rest = None, rows
    while True:
        directory = _directory(rest.select(F.col(h).alias("h"), F.col(size).alias("size")), bits, limit)
        told = directory.select(F.col("entry").alias(entry), F.col("depth").alias(depth), F.col("bytes").alias(bytes_))
        out = rest.withColumn(entry, F.shiftright(h, BITS - bits)).join(told, entry).drop(entry)
        fit = out.where(F.col(depth).isNotNull())
        done = fit if done is None else done.unionByName(fit)
        if not directory.where("depth is null").limit(1).count():
            return done, None
        rest = written(out.where(F.col(depth).isNull()).drop(depth, bytes_), "oversized")
        if bits == BITS:
            return done, rest
        bits = BITS


def _row_text(docs: DataFrame) -> Column:
    """A text that tells most rows apart: each column as it is hashed by Spark, or as text where that cannot be."""
    hashed = [F.xxhash64(F.col(f"`{c}`")) if "map" not in docs.schema[c].dataType.simpleString() and "variant" not in docs.schema[c].dataType.simpleString() else F.col(f"`{c}`").cast("string") for c in docs.columns]
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in hashed])


def _paged(rows: DataFrame, limit: int, h: str, n: str, whole_key: str, page: str, number: str) -> DataFrame:
    """Rows that share every hash bit, in pages of at most ``limit`` bytes: shard, depth and shard_bytes.

    A row's page is that of the bytes before it: in its part of the table, by a running sum, and in the parts before, by one row
    for each (hash, part). So no task but the one that wrote them gets equal rows together. A page takes as many rows
    as fit whatever their sizes: pages are cut at half the limit, and a row above that has a page of its own.
    """
    (part, order, before, cut) = free(rows.columns, "part", "order", "before", "cut")
    dealt = written(rows.withColumn(part, F.spark_partition_id()).withColumn(order, F.monotonically_increasing_id()), "equal")
    parts = dealt.groupBy(whole_key, h, part).agg(F.sum(n).alias(before))
    above = Window.partitionBy(whole_key, h).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn(before, F.coalesce(F.sum(before).over(above), F.lit(0)))
    inside = Window.partitionBy(whole_key, h, part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    half = max(1, limit // 2)
    at = dealt.join(parts, [whole_key, h, part]).withColumn(before, F.col(before) + F.coalesce(F.sum(n).over(inside), F.lit(0)))
    large = F.col(n) > half
    at = at.withColumn(cut, F.when(large, F.concat(F.lit("+"), F.col(order).cast("string"))).otherwise(F.floor(F.col(before) / half).cast("string")))
    sizes = at.groupBy(whole_key, h, F.col(cut).alias(page)).agg(F.sum(n).alias(number))
    told = at.withColumnRenamed(cut, page).join(sizes, [whole_key, h, page]).withColumn("shard_bytes", F.col(number)).withColumn("depth", F.lit(BITS))
    return told.withColumn("shard", F.concat(whole_key, F.lit("/"), F.lpad(F.bin(h), BITS, "0"), F.lit("#"), page))


def sharded(docs: DataFrame, limit: int = LIMIT_BYTES, key: str = "doc_id", size: Column | None = None) -> DataFrame:
    """docs plus shard (its bits as text), depth and shard_bytes; every shard holds at most ``limit`` bytes.

    size: bytes of a row, default those of its text (null: 0). Rows that share all hash bits and exceed the limit together
    are told apart by a hash of the whole row: their shard is the key's bits, a slash, and bits of that hash. Rows that are
    alike there too are numbered and go to pages (``#n`` after the bits). Rows are only ever moved, never made anew. Only a
    single row above the limit makes a larger shard, alone. A null key is a key; an empty table has no shards. Extra columns stay; one named shard, depth or shard_bytes
    is kept as ``<name>_input``.
    """
    docs = aside(docs, "shard", "depth", "shard_bytes")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    new = ("shard", "depth", "shard_bytes")
    h, n, whole_key, page, number = free([*docs.columns, *new], *"h n key page number".split())
    bytes_ = F.coalesce(F.octet_length("text") if size is None else size, F.lit(0)).cast("long")
    rows = docs.select(*columns, bytes_.alias(n), hash_bits(F.col(f"`{key}`")).alias(h))
    total = int(rows.agg(F.sum(n)).first()[0] or 0)
    done, hot = _split(rows, limit, total, h, n, "depth", "shard_bytes")
    bits = F.expr(f"substring(lpad(bin(`{h}`), {BITS}, '0'), 1, depth)")
    out = done.withColumn("shard", bits)
    if hot is not None:
        again = hot.withColumn(whole_key, F.lpad(F.bin(h), BITS, "0")).withColumn(h, hash_bits(F.concat(F.col(whole_key), _row_text(docs))))
        apart, equal = _split(again, limit, total, h, n, "depth", "shard_bytes")
        out = out.unionByName(apart.withColumn("shard", F.concat(whole_key, F.lit("/"), bits)).drop(whole_key))
        if equal is not None:
            out = out.unionByName(_paged(equal, limit, h, n, whole_key, page, number).select(*out.columns))
    return out.select(*columns, "shard", F.col("depth").cast("int").alias("depth"), F.col("shard_bytes").cast("long").alias("shard_bytes"))


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, shard, depth, shard_bytes under a limit of 1 MiB of text."""
    rows = docs.select("doc_id", F.octet_length("text").alias("n"))
    return sharded(rows, LIMIT_BYTES, "doc_id", F.col("n")).select("doc_id", "shard", "depth", "shard_bytes")


OP4_SQL = """
with d as (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h, coalesce(strlen(text), 0) as n from documents),
l as (select k::int as k, h >> (60 - k)::bigint as p, sum(n)::bigint as n from d, range(0, 61) t(k) group by all having sum(n) <= 1048576),
b as (select d.doc_id, d.h, min(l.k) as k from d join l on l.p = d.h >> (60 - l.k)::bigint group by all)
select b.doc_id, substr(lpad(bin(b.h), 60, '0'), 1, b.k) as shard, b.k as depth, l.n as shard_bytes
from b join l on l.k = b.k and l.p = b.h >> (60 - b.k)::bigint"""
