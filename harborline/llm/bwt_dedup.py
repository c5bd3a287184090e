"""Removal of repeated passages by merging Burrows-Wheeler transforms.

Every byte covered by a 50-byte string that also starts in a document with a smaller doc_id goes. Steps:

1. Routing. Each 50-byte window has an anchor, the least hash of its 16-byte strings; equal windows have equal anchors.
   Windows whose anchor occurs in one document only have no repeat anywhere. Blocks of documents tell their anchors to the
   anchors' hash buckets and learn which occur in other documents. Windows of an anchor that more than ``HOT_BLOCKS`` blocks
   have are told apart by a second anchor (least under another hash), so that a common line is dealt to many buckets.
2. Runs of consecutive windows with such an anchor become strings, equal ones of a block once with their smallest doc_id, and
   go to the anchor's bucket: all windows that can be equal meet there.
3. In a bucket the strings form shards, each with its own sorted suffixes and Burrows-Wheeler transform (symbols of eight bytes).
   The transforms are merged by interleave refinement: pass k orders all suffixes by their first 2 k bytes by a stable
   bucket pass over the interleaved symbols, carrying the borders of equal prefixes; suffixes are not sorted again. After 25
   passes the borders enclose the intervals of common prefixes of 50 bytes or more; each takes its smallest doc_id.
4. Answers go back to the blocks, which mark covered bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, dropped, mix, n_blocks, runs, utf8, written

LENGTH, GRAM, PAD, RUN = 50, 16, 8, 2048
BLOCK_BYTES, SHARD_SUFFIXES = 3 << 20, 1 << 16
#: Blocks of text for a bucket of anchors, which are smaller: rows between blocks and buckets are the product of their numbers.
ANCHOR_BLOCKS = 4
#: An anchor that so many blocks have is dealt out by a second one.
HOT_BLOCKS = 64
#: Suffixes merged at once; an anchor with more is one part with as many shards as it takes.
PART_SUFFIXES, PIECE_BYTES = 1 << 17, 1 << 17
#: Windows answered at once.
PART_WINDOWS = 1 << 20
_LAST = np.iinfo(np.int64).max


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, big-endian; zeros past the end."""
    x = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(U64)
    for step in (1, 2, 4):
        x = (x[:-step] << U64(8 * step)) | x[step:]
    return x[: len(raw)]


def windows(raw: np.ndarray, off: np.ndarray, piece: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of all texts, found in groups of texts of about ``piece`` bytes, which stay in the cache; a longer text is taken
    in stretches. Runs of more than ``RUN`` windows are cut: equal stretches of a text that repeats itself are then one string."""
    out, at = [], 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + piece, "right")) - 1)
        first, last = int(off[at]), int(off[to])
        for a in range(first, max(last, first + 1), piece if to == at + 1 else last - first + 1):
            b = min(last, a + piece + LENGTH - 1) if to == at + 1 else last
            start, count, anchor, text = _windows(raw[a:b], off[at : to + 1] - a if to > at + 1 else np.array([0, b - a]))
            out.append((start + a, count, anchor, text + at))
        at = to
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    start, count, anchor, text = (np.concatenate(x) for x in zip(*out))
    times = -(-count // RUN)
    which = np.repeat(np.arange(len(count)), times)
    skip = (np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)) * RUN
    return start[which] + skip, np.minimum(count[which] - skip, RUN), anchor[which], text[which]


def _windows(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one anchor: first start, number of windows, anchor, and text number."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(U64), none
    x = _eights(raw)
    v = x[: n - gram + 1] * U64(0x9E3779B97F4A7C15)
    v += x[gram - 8 : n - 7] * U64(0xC2B2AE3D27D4EB4F)
    v += U64(salt)
    v ^= v >> U64(29)
    v *= U64(0xBF58476D1CE4E5B9)
    del x
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if width < span:
        v = np.minimum(v[: len(v) - (span - width)], v[span - width :])
    valid = np.ones(n - length + 2, bool)  # a window must lie in one text
    valid[-1] = False
    mark = np.zeros(n - length + 2, np.int64)
    np.add.at(mark, np.clip(off[1:-1] - length + 1, 0, len(mark) - 1), 1)
    np.add.at(mark, np.minimum(off[1:-1], len(mark) - 1), -1)
    valid &= np.cumsum(mark) <= 0
    begin = valid[:-1] & np.concatenate([[True], (v[1:] != v[:-1]) | ~valid[:-2]])
    start = np.flatnonzero(begin)
    stop = np.flatnonzero(valid[:-1] & np.concatenate([(v[1:] != v[:-1]) | ~valid[1:-1], [True]]))
    return start, stop - start + 1, v[start], np.searchsorted(off, start, "right") - 1


def _runs(table: pa.Table) -> tuple:
    raw, off = utf8(table.column("text"))
    ids = table.column("doc_id").fill_null(_LAST).to_numpy()
    return raw, off, ids, *windows(raw, off)


def _bucket(anchor: np.ndarray, n: int) -> np.ndarray:
    return ((mix(anchor) >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _hashes(byte: np.ndarray, start: np.ndarray, size: np.ndarray, piece: int = PIECE_BYTES) -> np.ndarray:
    """64-bit hashes of the strings byte[start:start + size], made for about ``piece`` bytes at a time."""
    out, upto = np.zeros(len(start), U64), np.cumsum(size)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] - size[at] + piece, "right")))
        n = size[at:to]
        first = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(first[-1]) - np.repeat(first[:-1], n)
        value = mix(byte[np.repeat(start[at:to], n) + place].astype(U64) + place.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        out[at:to] = mix(np.add.reduceat(value, first[:-1]) + n.astype(U64))
        at = to
    return out


def _strings(raw: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One run of each distinct (anchor, string), in order of bucket, anchor and string hash; each run's string; hashes."""
    h = _hashes(raw, start, count + LENGTH - 1)
    order = np.lexsort((h, anchor, _bucket(anchor, buckets)))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which, h


def _cat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum())) if len(size) else np.zeros(0, np.int64)


def _ranks(text: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Dense ranks of the eight bytes from each position on; past a string's end they count as pad."""
    key = _eights(text)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(text))
    cut = np.flatnonzero(left < PAD)
    shift = ((PAD - left[cut]) * 8).astype(U64)
    key[cut] = (key[cut] >> shift << shift) | ((U64(1) << shift) - U64(1))
    return _dense(key)


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    k = key[order]
    rank = np.empty(len(key), np.uint32)
    rank[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]), dtype=np.uint32)
    return rank


def _dense_pairs(rank: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs; where pair and position fit 64 bits together, they are sorted as one number."""
    n = len(rank)
    b, r, a = n.bit_length(), int(rank.max(initial=0)).bit_length(), int(ahead.max(initial=0)).bit_length()
    if a + b + r > 64:
        return _dense(rank.astype(U64) << U64(32) | ahead)
    key = rank.astype(U64) << U64(a + b) | ahead.astype(U64) << U64(b) | np.arange(n, dtype=U64)
    key.sort()
    at = (key & U64((1 << b) - 1)).astype(np.int64)
    key >>= U64(b)
    out = np.empty(n, np.uint32)
    out[at] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]), dtype=np.uint32)
    return out


def _stable(value: np.ndarray) -> np.ndarray:
    """Positions in stable order of 32-bit values: the position rides in the low half of what is sorted."""
    key = value.astype(U64) << U64(32) | np.arange(len(value), dtype=U64)
    key.sort()
    return (key & U64(0xFFFFFFFF)).astype(np.int64)


def suffix_order(rank: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of the padded strings off[i] to off[i + 1], sorted; equal ones by string number, position.

    rank: of the first eight bytes of each. Suffixes do not look past their string.
    """
    n = len(rank)
    number = np.repeat(np.arange(len(off) - 1, dtype=np.uint32), np.diff(off))
    left = (np.repeat(off[1:], np.diff(off)) - np.arange(n)).astype(np.int32)
    width, most = PAD, int(left.max(initial=0))
    while width < most:
        top = np.uint32(int(rank.max()) + 1)
        ahead = top + number
        goes_on = np.flatnonzero(left > width)
        ahead[goes_on] = rank[goes_on + width]
        rank = _dense_pairs(rank, ahead)
        width *= 2
        if int(rank.max()) + 1 >= n - (PAD - 1) * (len(off) - 1):  # only the pads of one string tie still
            break
    return _stable(rank)


def repeated(text: np.ndarray, off: np.ndarray, shard: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions in merged order, and the number of the interval of equal ``length``-byte prefixes each lies in.

    text: padded strings (each ends with ``PAD`` bytes 255); shard: each string's shard number, not falling. length: even.
    """
    n = len(text)
    shards = int(shard[-1]) + 1
    cuts = np.concatenate([[0], np.searchsorted(shard, np.arange(1, shards)), [len(off) - 1]])
    rank = _ranks(text, off)
    inner = (np.arange(n) - np.repeat(off[:-1], np.diff(off))).astype(np.int32)
    # each shard's sorted suffixes, and what stands before each: its transform
    source = np.concatenate([suffix_order(rank[off[a] : off[b]], off[a : b + 1] - off[a]) + off[a] for a, b in zip(cuts[:-1], cuts[1:])])
    z = np.repeat(np.arange(shards, dtype=np.uint8 if shards < 256 else np.uint16 if shards < 65536 else np.uint32), np.diff(off[cuts]))
    block = np.zeros(n, np.int32)
    last = 0
    for step in [PAD] * (length // PAD) + [2] * (length % PAD // 2):
        if step != last:
            none = inner[source] < step
            symbol = rank[source - step] if step == PAD else text[source - 2].astype(np.uint32) << 8 | text[source - 1]
            symbol[none] = 0xFFFFFFFF
            base = np.repeat(np.arange(shards, dtype=z.dtype), step * np.diff(cuts))
            inside, last = n - len(base), step
        now = symbol[_read(z, shards)] if shards > 1 else symbol
        # a stable pass by symbol; suffixes at a string's start have none and end here, the pads' suffixes come in
        order = _stable(now)[:inside]
        s, b = now[order], block[order]
        edge = np.ones(n, np.int32)
        edge[1:inside] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        edge[inside + 1 :] = 0
        z = np.concatenate([z[order], base])
        block = np.cumsum(edge, dtype=np.int32)
    return source[_read(z, shards)] if shards > 1 else source, block


def _read(z: np.ndarray, shards: int) -> np.ndarray:
    """Where each entry of the interleave stands in its shard's own order: shards are read front to back."""
    if shards == 2:
        upto = np.cumsum(z, dtype=np.int64)
        return np.where(z, len(z) - upto[-1] - 1 + upto, np.arange(len(z)) - upto)
    order = np.argsort(z, kind="stable")
    at = np.empty(len(z), np.int64)
    at[order] = np.arange(len(z))
    return at


def _anchors(dealt: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, anchors, many): a block's distinct anchors; whether two of its documents have it."""

    def run(table: pa.Table) -> pa.Table:
        _, _, ids, _, _, anchor, doc = _runs(table)
        order = np.lexsort((ids[doc], anchor))
        a, d = anchor[order], ids[doc][order]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        first = np.flatnonzero(new)
        many = np.add.reduceat(np.concatenate([[0], (d[1:] != d[:-1]) & ~new[1:]]), first) > 0 if len(first) else np.zeros(0, bool)
        a = a[first]
        to = _bucket(a, buckets)
        sort = np.argsort(to, kind="stable")
        block = table.column("block")[0].as_py() if table.num_rows else 0
        part = [sort[x:y] for x, y in runs(to[sort])]
        return pa.table({"bucket": pa.array([int(to[p[0]]) for p in part], pa.int64()), "block": pa.array([block] * len(part), pa.int64()), "anchors": pa.array([a[p].tobytes() for p in part], pa.binary()), "many": pa.array([many[p].tobytes() for p in part], pa.binary())})

    return dealt.groupBy("block").applyInArrow(run, "bucket long, block long, anchors binary, many binary")


def _shared(anchors: DataFrame) -> DataFrame:
    """(block, bucket, anchors, hot): of each block's anchors those that occur in two documents or more; in many blocks or not."""

    def run(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, U64) for x in table.column("anchors").to_pylist()]
        many = np.concatenate([np.frombuffer(x, bool) for x in table.column("many").to_pylist()])
        every = np.concatenate(lists)
        _, which, count = np.unique(every, return_inverse=True, return_counts=True)
        again = ((count > 1) | (np.bincount(which, weights=many, minlength=len(count)) > 0))[which]
        hot = (count > HOT_BLOCKS)[which]
        ends = np.concatenate([[0], np.cumsum(again)])[np.cumsum([0, *(len(x) for x in lists)])].tolist()
        every, hot = every[again], hot[again]
        part = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "anchors": part(every), "hot": part(hot)})

    return anchors.groupBy("bucket").applyInArrow(run, "block long, bucket long, anchors binary, hot binary")


def _routed(left: pa.Table, shared: pa.Table) -> tuple:
    """A block's bytes, offsets and ids; and the runs whose anchor other documents have: start, windows, anchor, text number."""
    raw, off, ids, start, count, anchor, doc = _runs(left)
    every, hot = (np.concatenate([np.zeros(0, k), *(np.frombuffer(x, k) for x in shared.column(n).to_pylist())]) for n, k in (("anchors", U64), ("hot", bool)))
    order = np.argsort(every)
    every, hot = every[order], hot[order]
    at = np.minimum(np.searchsorted(every, anchor), max(0, len(every) - 1))
    ok = np.flatnonzero(every[at] == anchor) if len(every) else np.zeros(0, np.int64)
    start, count, anchor, doc, hot = start[ok], count[ok], anchor[ok], doc[ok], hot[at[ok]] if len(every) else np.zeros(0, bool)
    if hot.any():
        n = count[hot] + LENGTH - 1
        inner = np.concatenate([[0], np.cumsum(n)])
        sub, windows_, second, which = _windows(raw[_cat(start[hot], n)], inner, salt=0x632BE59BD9B4E019)
        rest = ~hot
        begin = start[hot][which] + sub - inner[which]
        start, count, doc = np.concatenate([start[rest], begin]), np.concatenate([count[rest], windows_]), np.concatenate([doc[rest], doc[hot][which]])
        anchor = np.concatenate([anchor[rest], mix(anchor[hot][which] ^ mix(second))])
    return raw, off, ids, start, count, anchor, doc


def _sent(dealt: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, anchors, count, bytes, docs): distinct strings of runs with shared anchors and their smallest doc_id."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        raw, _, ids, start, count, anchor, doc = _routed(left, right)
        one, which, _ = _strings(raw, start, count, anchor, buckets)
        low = np.full(len(one), _LAST)
        np.minimum.at(low, which, ids[doc])
        size = count[one] + LENGTH - 1
        byte = raw[_cat(start[one], size)]
        first = np.concatenate([[0], np.cumsum(size)])
        block = left.column("block")[0].as_py() if left.num_rows else 0
        to = _bucket(anchor[one], buckets)
        span = runs(to)
        return pa.table(
            {
                "bucket": pa.array([int(to[a]) for a, _ in span], pa.int64()),
                "block": pa.array([block] * len(span), pa.int64()),
                "anchors": pa.array([anchor[one[a:b]].tobytes() for a, b in span], pa.binary()),
                "count": pa.array([count[one[a:b]].tobytes() for a, b in span], pa.binary()),
                "bytes": pa.array([byte[first[a] : first[b]].tobytes() for a, b in span], pa.binary()),
                "docs": pa.array([low[a:b].tobytes() for a, b in span], pa.binary()),
            }
        )

    return dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(run, "bucket long, block long, anchors binary, count binary, bytes binary, docs binary")


def _parts(total: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of anchors with about ``most`` suffixes each, of at least one anchor."""
    at = 0
    while at < len(total) - 1:
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield at, to
        at = to


def _least(byte: np.ndarray, start: np.ndarray, size: np.ndarray, count: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each window of the strings byte[start:start + size], in order, the smallest of low over strings that have it."""
    width = size + PAD
    off = np.concatenate([[0], np.cumsum(width)])
    text = np.full(off[-1], 255, np.uint8)
    text[_cat(off[:-1], size)] = byte[_cat(start, size)]
    shards = -(-int(off[-1]) // SHARD_SUFFIXES)
    shard = (np.cumsum(width) - 1) * shards // off[-1]
    where, block = repeated(text, off, np.cumsum(np.concatenate([[0], np.diff(shard) > 0])))
    number = np.repeat(np.arange(len(width), dtype=np.int32), width)[where]
    owned = np.flatnonzero(where - off[number] < count[number])
    where, block, number = where[owned], block[owned], number[owned]
    new = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    answer = np.empty(len(text), np.int64)
    answer[where] = np.repeat(np.minimum.reduceat(low[number], new), np.diff(np.append(new, len(where))))
    return answer[_cat(off[:-1], count)]


def _merged(sent: DataFrame) -> DataFrame:
    """(block, bucket, lows): for every window of every string of a block the smallest doc_id that has it."""

    def run(table: pa.Table) -> pa.Table:
        cols = {k: [np.frombuffer(x, t) for x in table.column(k).to_pylist()] for k, t in (("anchors", U64), ("count", np.int64), ("bytes", np.uint8), ("docs", np.int64))}
        count, low, byte = (np.concatenate(cols[k]) for k in ("count", "docs", "bytes"))
        size = count + LENGTH - 1
        first = np.concatenate([[0], np.cumsum(size)])
        # equal strings of several blocks stand once
        h = _hashes(byte, first[:-1], size)
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        del h
        best = np.full(len(one), _LAST)
        np.minimum.at(best, which, low)
        # equal windows have equal anchors, so anchors can be merged part by part: what a part needs stays in the cache
        start = np.concatenate([[0], np.cumsum(count[one])])
        answer = np.empty(start[-1], np.int64)
        order = np.argsort(np.concatenate(cols["anchors"])[one], kind="stable")
        anchor = np.concatenate(cols["anchors"])[one][order]
        # an anchor with one string has nothing to be merged with: whoever has one of its windows has this very string
        new = np.concatenate([[True], anchor[1:] != anchor[:-1], [True]])
        alone = new[:-1] & new[1:]
        lone = order[alone]
        answer[_cat(start[lone], count[one][lone])] = np.repeat(best[lone], count[one][lone])
        order, anchor = order[~alone], anchor[~alone]
        edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]])) if len(order) else np.zeros(1, np.int64)
        total = np.concatenate([[0], np.cumsum(size[one][order] + PAD)])[edge]
        for lo, hi in _parts(total, PART_SUFFIXES):
            mine = order[edge[lo] : edge[hi]]
            answer[_cat(start[mine], count[one][mine])] = _least(byte, first[:-1][one[mine]], size[one[mine]], count[one[mine]], best[mine])
        out, upto = [], np.cumsum([0, *(len(c) for c in cols["count"])])
        done = np.concatenate([[0], np.cumsum(count)])[upto]
        for lo, hi in _parts(done, PART_WINDOWS):  # blocks together: there are as many as the corpus has
            mine = slice(upto[lo], upto[hi])
            whole = answer[_cat(start[which[mine]], count[mine])]
            out += [whole[x:y].tobytes() for x, y in zip(done[lo:hi] - done[lo], done[lo + 1 : hi + 1] - done[lo])]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "lows": pa.array(out, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "block long, bucket long, lows binary")


def covered(docs: DataFrame, block_bytes: int = BLOCK_BYTES, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary, if ``texts``), kept_sha256 for every row of docs(doc_id, text).

    A null text is empty. Rows that share a doc_id do not remove from each other; rows with a null doc_id come after all
    others and do not remove from each other. Texts below 50 bytes stay whole. Very long texts are one piece of work each.
    """
    n = n_blocks(docs, F.coalesce(F.octet_length("text"), F.lit(0)) + 16, block_bytes)
    dealt = docs.select(F.col("doc_id").cast("long"), "text", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n)).alias("block"))
    shared = written(_shared(_anchors(dealt, -(-n // ANCHOR_BLOCKS))), "shared")
    answers = written(_merged(_sent(dealt, shared, n)), "answers")
    told = answers.unionByName(shared.select("block", "anchors", "hot"), allowMissingColumns=True)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answered = pc.is_valid(right.column("lows"))
        raw, off, ids, start, count, anchor, doc = _routed(left, right.filter(pc.invert(answered)))
        one, which, _ = _strings(raw, start, count, anchor, n)
        right = right.filter(answered)
        order = np.argsort(right.column("bucket").to_numpy())
        lows = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(right.column("lows")[int(i)].as_py(), np.int64) for i in order)])
        first = np.concatenate([[0], np.cumsum(count[one])])[:-1]
        low = lows[_cat(first[which], count)]
        at = _cat(start, count)
        mark = np.zeros(len(raw), bool)
        mark[at[low < np.repeat(ids[doc], count)]] = True
        upto = np.cumsum(mark, dtype=np.int32)
        gone = upto > 0
        gone[LENGTH:] = upto[LENGTH:] > upto[:-LENGTH]
        total = np.concatenate([[0], np.cumsum(gone)])
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        inside = off[:-1][(off[:-1] < len(raw)) & (off[:-1] < off[1:])]
        begin[inside] = gone[inside]
        spans = np.concatenate([[0], np.cumsum(begin)])
        kept = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        out = {"doc_id": left.column("doc_id"), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(total[off[1:]] - total[off[:-1]]), "n_spans": pa.array(spans[off[1:]] - spans[off[:-1]])}
        if texts:
            out["kept"] = pa.array(kept, pa.binary())
        return pa.table(out | {"kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})

    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, {'kept binary, ' if texts else ''}kept_sha256 string"
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)


def op7(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return covered(docs.select("doc_id", "text"), texts=False)
