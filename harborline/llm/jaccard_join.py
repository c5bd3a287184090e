"""N-gram Jaccard join by T-occurrence search.

Two texts link when the Jaccard similarity of their sets of word n-grams reaches a threshold. Work in four steps:

1. Every text becomes its sorted set of 64-bit shingle hashes. Equal sets fall together by a 128-bit set key, so copies are
   one node from here on (the smallest doc_id stands for them).
2. Routing. Linked sets of a size band differ in at most D shingles, so of D + 1 ranges of the hash space one at least holds
   the same shingles in both (pigeonhole). Equal range signatures join into stars; their components are *candidate groups*,
   each a superset of every true component it touches. Very common lines do not open a route by themselves.
3. Within a candidate group, T-occurrence search: inverted lists of the group's sets; the longest lists are set aside
   (DivideSkip), the short ones are merged into counts, and what can still reach T is probed in the long ones by binary
   search. Sets already reached are dropped from the lists, so a tight group costs about one search.
4. A candidate group above ``chunk`` sets is dealt out: chunks are searched alone, then representatives of what they found
   are searched together, and sets that are still apart meet by their rarest shingles (``_across``). Nothing is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, U64, dropped, free, mix, n_blocks, pieces, runs, span_hashes, tokens, utf8, written

CHUNK, BUCKET_BYTES, CENTRES, MANY = 1024, 8 << 20, 3, 16
#: Ranges with fewer shingles than this on average need the sets' repeated share first.
LONG_RANGE = 8


def shingle_sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sorted distinct shingle hashes, one after the other, and n_texts + 1 offsets into them.

    Words are runs outside ASCII white space, A-Z lower-cased. Fewer than n words: the whole sequence is the one shingle.
    """
    raw, off = utf8(col)
    raw = LOWER[raw]
    start, end, doc = tokens(raw, off)
    word = span_hashes(raw, start, end)
    docs = len(off) - 1
    words = np.bincount(doc, minlength=docs)
    hashes, owner = [], []
    if len(word) >= n:
        h = np.zeros(len(word) - n + 1, U64)
        for i in range(n):
            h = h * U64(0x9E3779B97F4A7C15) + word[i : len(word) - n + 1 + i]
        same = doc[: len(h)] == doc[n - 1 :]
        hashes.append(mix(h[same]))
        owner.append(doc[: len(h)][same])
    first = np.concatenate([[0], np.cumsum(words)])
    for k in range(1, n):  # texts of k words
        short = np.flatnonzero(words == k)
        h = np.full(len(short), k, U64)
        for i in range(k):
            h = h * U64(0xD6E8FEB86659FD93) + word[first[short] + i]
        hashes.append(mix(h))
        owner.append(short)
    h, who = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    h, who = h[new], who[new]
    return h, np.searchsorted(who, np.arange(docs + 1))


def bands(num: int, den: int, most: int) -> np.ndarray:
    """Lower ends of size bands, each two steps of the threshold num / den wide: sets link within a band or the next one."""
    lo = [1]
    while lo[-1] <= most:
        lo.append((lo[-1] * den // num + 1) * den // num + 1)
    lo.append((lo[-1] * den // num + 1) * den // num + 1)
    return np.array(lo, np.int64)


def n_parts(low: int, high: int, num: int, den: int) -> tuple[int, int]:
    """Ranges for sets of low to high shingles, and how many of them at least are equal in linked sets.

    Linked sets differ in at most d shingles, so of d + m ranges m are equal. m is a little above the number of ranges
    that a set leaves empty: a set with fewer empty ones than m need not send those.
    """
    d = 2 * high * (den - num) // (den + num)
    if not d:
        return 1, 1
    best = (2.0, 1)
    for m in range(1, d + 3):
        mean = (d + m) * math.exp(-low / (d + m))  # empty ranges, nearly Poisson
        below, term = 0.0, math.exp(-mean)
        for i in range(m):
            below += term
            term *= mean / (i + 1)
        best = min(best, (1 - below, m))
        if 1 - below <= 0.005:
            return d + m, m
    return d + best[1], best[1]


def _signatures(h: np.ndarray, off: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Range signatures of each set for its own size band, and for the next if it can link there: values, set numbers."""
    size = np.diff(off)
    lo = bands(num, den, int(size.max(initial=1)))
    band = np.searchsorted(lo, size, "right") - 1
    out, who = [], []
    top = (h >> U64(32)).astype(np.int64)
    for step in (0, 1):
        b = band + step
        wanted = (size > 0) & (True if step == 0 else size * den // num >= lo[np.minimum(b, len(lo) - 1)])
        largest = np.append(lo[1:], (lo[-1] * den // num + 1) * den // num + 1)[np.minimum(b, len(lo) - 1)] - 1
        plan = {int(x): n_parts(int(lo[min(x, len(lo) - 1)]), int(y), num, den) for x, y in {(int(i), int(j)) for i, j in zip(b[wanted], largest[wanted])}}
        parts = np.zeros(len(size), np.int64)
        parts[wanted] = [plan[int(x)][0] for x in b[wanted]]
        first = np.concatenate([[0], np.cumsum(parts)])
        owner = np.repeat(np.arange(len(size)), size)
        mine = wanted[owner]
        cell = first[owner[mine]] + ((top[mine] * parts[owner[mine]]) >> 32)
        at = np.searchsorted(cell, np.arange(first[-1] + 1))
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h[mine] ^ U64(0xA5A5A5A5A5A5A5A5)))])
        value = total[at[1:]] - total[at[:-1]]
        part_of = np.repeat(np.arange(len(size)), parts)
        part = np.arange(first[-1]) - first[part_of]
        empty = at[1:] == at[:-1]
        spare = np.zeros(len(size), np.int64)
        spare[wanted] = [plan[int(x)][1] for x in b[wanted]]
        sent = ~empty | (np.bincount(part_of[empty], minlength=len(size)) >= spare)[part_of]
        value, part, part_of = value[sent], part[sent], part_of[sent]
        out.append(mix(mix(value) + b[part_of].astype(U64) * U64(0x9E3779B97F4A7C15) + part.astype(U64) * U64(0xC2B2AE3D27D4EB4F)))
        who.append(part_of)
    return np.concatenate(out), np.concatenate(who)


_FEATURES = "doc_id long, n_shingles long, k1 long, k2 long, bucket long, sigs binary, nodes binary, low long, high long"


def _repeated(dealt: DataFrame, n: int, buckets: int) -> DataFrame:
    """(block, bucket, hashes): of each block's shingles those that two documents or more have. dealt: doc_id, text, block."""

    def tell(table: pa.Table) -> pa.Table:
        every, count = np.unique(np.concatenate([shingle_sets(b.column(1), n)[0] for b in pieces(iter(table.to_batches()))] or [np.zeros(0, U64)]), return_counts=True)
        to = ((every >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
        used = runs(to)
        part = lambda x: pa.array([x[a:b].tobytes() for a, b in used], pa.binary())
        return pa.table({"bucket": pa.array([int(to[a]) for a, _ in used], pa.int64()), "block": pa.array([table.column("block")[0].as_py()] * len(used), pa.int64()), "hashes": part(every), "many": part(count > 1)})

    def answer(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, U64) for x in table.column("hashes").to_pylist()]
        many = np.concatenate([np.frombuffer(x, bool) for x in table.column("many").to_pylist()])
        every = np.concatenate(lists)
        order = np.argsort(every)
        first = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
        size = np.diff(np.append(first, len(every)))
        again = np.empty(len(every), bool)
        again[order] = np.repeat((size > 1) | np.logical_or.reduceat(many[order], first), size)
        keep = np.split(again, np.cumsum([len(x) for x in lists])[:-1])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "hashes": pa.array([x[k].tobytes() for x, k in zip(lists, keep)], pa.binary())})

    told = dealt.groupBy("block").applyInArrow(tell, "bucket long, block long, hashes binary, many binary")
    return written(told.groupBy("bucket").applyInArrow(answer, "block long, bucket long, hashes binary"), "repeated")


def features(docs: DataFrame, n: int, num: int, den: int, buckets: int) -> DataFrame:
    """Three kinds of rows: documents with n_shingles and set key (k1, k2); bucket rows with packed (signature, set key)
    pairs; and routes (low, high) between sets of one batch that share a signature.

    A batch sends one set per signature, so a signature that very many sets share weighs no more than the batches.

    At low thresholds ranges are short, and common passages would fill them. Blocks of documents then learn first which
    shingles other documents have too; a set of which a smaller share than the threshold is repeated sends nothing.
    """
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    few = max(1, buckets // 4)  # signatures are fewer than shingles, and a bucket tells a set's routes once

    def rows(count: int, **cols: pa.Array) -> pa.RecordBatch:
        kinds = {"sigs": pa.binary(), "nodes": pa.binary()}
        return pa.RecordBatch.from_arrays([cols.get(c, pa.nulls(count, kinds.get(c, pa.int64()))) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch], repeated: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            sig, node = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            first = np.ones(len(sig), bool)
            first[1:] = sig[1:] != sig[:-1]
            low = node[np.flatnonzero(first)[np.cumsum(first) - 1]]
            pair = np.unique(np.stack([low, node], 1)[~first & (low != node)], axis=0)
            if len(pair):
                yield rows(len(pair), low=pa.array(pair[:, 0]), high=pa.array(pair[:, 1]))
            sig, node = sig[first], node[first]
            to = ((sig >> U64(32)) * U64(few) >> U64(32)).astype(np.int64)
            used = runs(to)
            yield rows(len(used), bucket=pa.array([int(to[a]) for a, _ in used], pa.int64()), sigs=pa.array([sig[a:b].tobytes() for a, b in used], pa.binary()), nodes=pa.array([node[a:b].tobytes() for a, b in used], pa.binary()))

        for batch in pieces(batches):
            h, off = shingle_sets(batch.column(1), n)
            count = np.diff(off)
            keys = []
            for salt in (0x1234567, 0x7654321):
                total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h + U64(salt)))])
                keys.append(mix(total[off[1:]] - total[off[:-1]] + count.astype(U64)).view(np.int64))
            yield rows(len(count), doc_id=batch.column(0), n_shingles=pa.array(count, pa.int64()), k1=pa.array(keys[0]), k2=pa.array(keys[1]))
            if repeated is not None:
                again = np.zeros(len(h), bool)
                if len(repeated):
                    again = repeated[np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)] == h
                total = np.concatenate([[0], np.cumsum(again)])
                enough = den * (total[off[1:]] - total[off[:-1]]) >= num * count
                h, kept = h[np.repeat(enough, count)], np.where(enough, count, 0)
                off = np.concatenate([[0], np.cumsum(kept)])
            sig, who = _signatures(h, off, num, den)
            real = ~np.asarray(batch.column(0).is_null())[who]
            held.append((sig[real], keys[0][who[real]]))
            size += len(sig)
            if size > 2_000_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if (den + num) >= 2 * (den - num) * LONG_RANGE:
        return docs.mapInArrow(run, _FEATURES)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(buckets)))
    told = _repeated(dealt, n, buckets)

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes = np.sort(np.concatenate([np.zeros(0, U64), *(np.frombuffer(x, U64) for x in right.column("hashes").to_pylist())]))
        out = list(run(iter(left.select(["doc_id", "text"]).to_batches()), hashes))
        return pa.Table.from_batches(out or [rows(0)])

    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(block, _FEATURES)


def routes(packed: DataFrame) -> DataFrame:
    """(a, b): every set that shares a signature with others, to the smallest of them. packed: rows of buckets."""

    def run(table: pa.Table) -> pa.Table:
        sig = np.concatenate([np.frombuffer(x, U64) for x in table.column("sigs").to_pylist()])
        node = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("nodes").to_pylist()])
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        low = node[np.flatnonzero(first)[np.cumsum(first) - 1]]
        pair = np.unique(np.stack([low, node], 1)[~first & (low != node)], axis=0)
        return pa.table({"a": pa.array(pair[:, 0], pa.int64()), "b": pa.array(pair[:, 1], pa.int64())})

    return packed.select("bucket", "sigs", "nodes").groupBy("bucket").applyInArrow(run, "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges, root the smallest node of its component; large-star, small-star rounds.

    Each round is written to the shared folder; no edge list comes to the driver, only its count and sum.
    """
    held = written(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = held.select("u", "v").union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select("v", "m")
        down = large.groupBy("v").agg(F.min("m").alias("r"))
        small = large.join(down, "v").select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("r").alias("m")), F.struct(F.col("m").alias("v"), F.col("r").alias("m")))).alias("e")).select("e.v", "e.m")
        new = written(small.where("v <> m").select(F.col("m").alias("u"), "v").distinct(), "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(held)
        held = new
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return held.select(F.col("v").alias("node"), F.col("u").alias("root")).union(held.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def search(h: np.ndarray, off: np.ndarray, label: np.ndarray, num: int, den: int) -> np.ndarray:
    """Labels (smallest equal label wins) after T-occurrence search among the sets h[off[i]:off[i + 1]].

    Sets that share a label count as linked already. Breadth first: each reached set is one query against the lists of the
    sets not reached yet, so every link between different labels is seen from one of its ends.
    """
    m = len(off) - 1
    size = np.diff(off)
    _, label = np.unique(label, return_inverse=True)
    members = np.argsort(label, kind="stable")
    at = np.searchsorted(label[members], np.arange(label.max(initial=-1) + 2))
    free, root = np.ones(m, bool), np.full(m, -1, np.int64)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(h, kind="stable")
    sh, so = h[order], owner[order]
    built = m

    def index():
        keys, first = np.unique(sh, return_index=True)
        return keys, np.append(first, len(sh)), np.searchsorted(keys, sh) * m + so

    keys, first, code = index()
    for label_seed in range(len(at) - 1):
        seed = members[at[label_seed]]
        if not free[seed]:
            continue
        todo = list(members[at[label_seed] : at[label_seed + 1]])
        free[todo] = False
        root[todo] = seed
        left = int(free.sum())
        while todo and left:
            if left * 2 < built:
                kept = free[so]
                sh, so, built = sh[kept], so[kept], left
                keys, first, code = index()
            q = todo.pop()
            mine = h[off[q] : off[q + 1]]
            if not len(keys) or not len(mine):
                continue
            lists = np.searchsorted(keys, mine)
            lists = lists[(lists < len(keys)) & (keys[np.minimum(lists, len(keys) - 1)] == mine)]
            least = -(-num * len(mine) // den)  # overlap >= threshold * union >= threshold * |q|
            if len(lists) < least:
                continue
            length = first[lists + 1] - first[lists]
            lists = lists[np.argsort(length, kind="stable")]
            long = min(least - 1, int(least / (0.0085 * math.log(max(2, int(length.max()))) + 1)))
            short, far = lists[: len(lists) - long], lists[len(lists) - long :]
            span = first[short + 1] - first[short]
            where = np.repeat(first[short] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
            got, count = np.unique(so[where], return_counts=True)
            ok = free[got] & (count >= least - long) & (den * np.minimum(size[got], len(mine)) >= num * np.maximum(size[got], len(mine)))
            got, count = got[ok], count[ok]
            for far_part in np.array_split(far, max(1, len(far) * len(got) // 2_000_000 + 1)) if len(got) else ():
                want = (far_part[:, None] * m + got[None, :]).ravel()
                spot = np.searchsorted(code, want)
                found = (spot < len(code)) & (code[np.minimum(spot, len(code) - 1)] == want)
                count = count + found.reshape(len(far_part), -1).sum(0)
            linked = got[den * count >= num * (size[got] + len(mine) - count)]
            for new in np.unique(label[linked]):
                group = members[at[new] : at[new + 1]]
                group = group[free[group]]
                free[group] = False
                root[group] = seed
                left -= len(group)
                todo.extend(group)
        root[todo] = seed
    return root


def _sets(nodes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(node, set): the shingle sets of the texts of nodes(node), written. A node whose doc_id has several texts has a row for each."""
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("node is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h, off = shingle_sets(batch.column(1), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())], names=["node", "set"])

    # candidates grow with the corpus: a shuffled join at every size, and once only
    return written(nodes.distinct().hint("merge").join(texts, "node").select("node", "text").mapInArrow(run, "node long, set binary"), "candidates")


def _searched(rows: DataFrame, sets: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """(keys, node, label, found) for rows (keys, node, label): one search per distinct keys over the nodes' sets."""
    dealt = rows.join(sets, "node").select(*keys, "node", "label", "set")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        now = None

        def done():
            node, label = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            off = np.concatenate([[0], np.cumsum(np.concatenate([x[3] for x in held]))])
            root = search(np.concatenate([x[2] for x in held]), off, label, num, den)
            low = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(low, root, label)
            return pa.RecordBatch.from_arrays([*[pa.array([k] * len(node), pa.int64()) for k in now], pa.array(node), pa.array(label), pa.array(low[root])], names=[*keys, "node", "label", "found"])

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [np.frombuffer(x, U64) for x in batch.column(len(keys) + 2).to_pylist()]
            h, size = np.concatenate(lists), np.array([len(x) for x in lists])
            off = np.concatenate([[0], np.cumsum(size)])
            ks = np.stack([batch.column(i).to_numpy() for i in range(len(keys))], 1)
            node, label = batch.column(len(keys)).to_numpy(), batch.column(len(keys) + 1).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (ks[1:] != ks[:-1]).any(1)]))
            for a, b in zip(cuts, [*cuts[1:], len(ks)]):
                key = tuple(int(x) for x in ks[a])
                if key != now and held:
                    yield done()
                    held = []
                now = key
                held.append((node[a:b], label[a:b], h[off[a] : off[b]], size[a:b]))
        if held:
            yield done()

    return dealt.mapInArrow(run, ", ".join([*(f"{k} long" for k in keys), "node long", "label long", "found long"]))


def _across(left: DataFrame, sets: DataFrame, num: int, den: int, stars: bool) -> DataFrame:
    """(label, found): labels of a group of left(grp, node, label) that a link between two of their sets joins.

    stars: only ``CENTRES`` pairs a set, with the first sets that have its shingles: that joins most of what a large cluster
    falls into, and its pairs need not be made. Else all links are found.

    Prefix filter: in any one order of the shingles, the first |x| - ceil(num / den |x|) + 1 of a set x meet those of whatever
    links with it. Shingles that only one label has come first in the order and lead to no pair, so they are left out but
    counted; then come rare ones. A set with fewer others than a link needs sends nothing. Pairs that meet are compared.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                lists = [np.frombuffer(x, np.int64) for x in part.column(4).to_pylist()]
                size = np.array([len(x) for x in lists])
                cols = [np.repeat(part.column(i).to_numpy(), size) for i in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*cols, np.repeat(size, size), np.concatenate(lists))], names=["grp", "node", "label", "at", "size", "h"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v, U64) for v in batch.column(i).to_pylist()] for i in (2, 3))
            both = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(x, y)], np.int64)
            ok = pa.array(den * both >= num * (np.array([len(a) + len(b) for a, b in zip(x, y)], np.int64) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["label", "found"])

    told = written(left.join(sets.hint("merge"), "node").select("grp", "node", "label", F.monotonically_increasing_id().alias("at"), "set").mapInArrow(tell, "grp long, node long, label long, at long, size long, h long"), "shingles")
    mixed = told.groupBy("grp", "h").agg(F.count("*").alias("df"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("grp", "h", "df")
    own = Window.partitionBy("at")  # a node with several texts has as many sets
    ranked = told.join(mixed.hint("merge"), ["grp", "h"]).withColumns({"have": F.count("*").over(own), "rank": F.row_number().over(own.orderBy("df", "h"))})
    first = ranked.where(F.col("rank") <= F.col("have") + 1 - F.ceil(F.col("size") * num / den)).withColumn("rest", F.col("have") - F.col("rank"))
    cols = ["at", "node", "label", "size"]
    first = written(first.select("grp", "h", *cols, "rest"), "prefixes")
    dropped(told)
    a, b = (first.select("grp", "h", *[F.col(c).alias(f"{c}_{s}") for c in (*cols, "rest")]) for s in "ab")
    if stars:
        b = b.groupBy("grp", "h").agg(F.min(F.struct("node_b", "at_b", "label_b", "size_b", "rest_b")).alias("b")).select("grp", "h", "b.*")
    near = (F.least("size_a", "size_b") * den >= F.greatest("size_a", "size_b") * num) & (F.col("label_a") != F.col("label_b") if stars else F.col("label_a") < F.col("label_b"))
    met = a.join(b.hint("merge"), ["grp", "h"]).where(near).groupBy(*[f"{c}_{s}" for s in "ab" for c in cols])
    # what two prefixes share comes before all else that their sets share: beyond it, no more can be common than is left of either
    met = met.agg(F.count("*").alias("n"), F.min("rest_a").alias("rest_a"), F.min("rest_b").alias("rest_b"))
    enough = (F.col("n") + F.least("rest_a", "rest_b")) * (den + num) >= (F.col("size_a") + F.col("size_b")) * num
    if stars:
        enough = F.row_number().over(Window.partitionBy("at_a").orderBy(F.desc("n"), "at_b")) <= CENTRES
    pairs = written(met.withColumn("enough", enough).where("enough").select("node_a", "label_a", "node_b", "label_b").distinct(), "pairs")
    dropped(first)
    one, two = (sets.select(F.col("node").alias(f"node_{s}"), F.col("set").alias(f"set_{s}")).hint("merge") for s in "ab")
    shown = pairs.join(one, "node_a").join(two, "node_b").select("label_a", "label_b", "set_a", "set_b")
    out = written(shown.mapInArrow(compare, "label long, found long").distinct(), "across")
    dropped(pairs)
    return out


def _lowest(links: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (node, label, ...) with labels replaced by the roots of the components of links (label, found)."""
    roots = components(links.select(F.col("label").alias("a"), F.col("found").alias("b")))
    return rows.join(roots, rows["label"] == roots["node"], "left").select(rows["grp"], rows["node"], F.coalesce("root", "label").alias("label"))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text).

    Links: den * |intersection| >= num * |union| of the sets of word n-grams. component_id is the smallest doc_id that links
    reach. Null or blank texts have an empty set and are alone. Rows that repeat a doc_id are one document: its texts are
    joined. A null doc_id keeps its row with a null component_id and links nothing. Extra columns are ignored.
    """
    buckets = n_blocks(docs, F.coalesce(F.octet_length("text"), F.lit(0)) + 16, BUCKET_BYTES)
    made = written(features(docs, n, num, den, buckets), "sets")
    sets = made.where("n_shingles is not null").select("doc_id", "n_shingles", "k1", "k2")
    nodes = sets.where("n_shingles > 0 and doc_id is not null")
    reps = nodes.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    members = nodes.select("doc_id", "k1", "k2").join(reps, ["k1", "k2"]).select("doc_id", "rep")
    # routes run between set keys, so copies are one node
    near = routes(made.where("bucket is not null")).union(made.where("low is not null").select("low", "high"))
    groups = components(near).select(F.col("root").alias("grp"), F.col("node").alias("k1"))
    groups = groups.join(reps, "k1").select("grp", F.col("rep").alias("node"), F.col("rep").alias("label")).distinct()
    groups = written(groups, "groups")
    # chunks of large groups; a group's size is a count, its sets never meet in one task
    counted = groups.groupBy("grp").agg(F.count("*").alias("size"))
    cut = groups.join(counted, "grp").withColumn("pieces", F.ceil(F.col("size") / chunk).cast("long"))
    cut = cut.select("grp", F.pmod(F.xxhash64("node"), F.col("pieces")).alias("part"), "node", "label", "pieces")
    texts = _sets(groups.select("node"), docs, n)
    found = written(_searched(cut.select("grp", "part", "node", "label"), texts, ["grp", "part"], num, den), "found")
    links = found.select("label", "found").distinct()
    large = cut.where("pieces > 1").select("grp", "part", "node")
    if large.limit(1).count():
        at = written(large.join(found.groupBy("grp", "node").agg(F.min("found").alias("label")), ["grp", "node"]), "large")
        # one set of each label stands for it; what they join needs no further search
        rep = at.groupBy("grp", "label").agg(F.min("node").alias("node"))
        size = rep.groupBy("grp").agg(F.ceil(F.count("*") / chunk).cast("long").alias("pieces"))
        rep = rep.join(size, "grp").select("grp", F.pmod(F.xxhash64("label"), F.col("pieces")).alias("part"), "node", "label")
        more = written(_searched(rep, texts, ["grp", "part"], num, den).select("label", "found").distinct(), "more")
        links = written(links.union(more), "links")
        for stars in (True, False) if at.count() > MANY * chunk else (False,):  # few sets make few pairs
            now = written(_lowest(links, at), "apart")
            open_ = now.groupBy("grp").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("grp")
            left = now.join(open_, "grp").select("grp", "node", "label")
            if not left.limit(1).count():
                break
            links = written(links.union(_across(left, texts, num, den, stars)), "links")
    roots = components(links.union(members.select(F.col("doc_id").alias("label"), F.col("rep").alias("found"))).select(F.col("label").alias("a"), F.col("found").alias("b")))
    return sets.select("doc_id", "n_shingles").join(roots, sets["doc_id"] == roots["node"], "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def op9(docs: DataFrame) -> DataFrame:
    """The join at three words and 0.9."""
    return jaccard_components(docs, 3, 90, 100)


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component: the row of the smallest doc_id (the smallest text if that repeats).

    Rows with a null doc_id stay.
    """
    kept, place = free(docs.columns, "kept", "place")
    keep = jaccard_components(docs, n, num, den).where("doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()
    rows = docs.join(keep, docs["doc_id"] == keep[kept], "left_semi")
    others = [F.col(f"`{c}`") for c, t in docs.dtypes if c not in ("doc_id", "text") and "map<" not in t and t != "variant"]
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.xxhash64(*others, F.lit(0)))
    rows = rows.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return rows.unionByName(docs.where("doc_id is null"))
