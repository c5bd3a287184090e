"""Language-model scoring with a hierarchical Pitman-Yor process.

Levels: a restaurant for every word that can stand before (the context), whose parent is the restaurant of the words that end
alike (their last two bytes), whose parent is the one of single words; its base is uniform over the known words plus one place for
every unknown word. A context is told by 32 bits: 12 of its ending, 20 of its whole form, so restaurants grow in number with the
corpus, and two words share one with odds of 2**-20 where they end alike. Discounts come from counts of counts at each level.

Distribution: every occurrence of a word falls to its hash bucket, with counts per context made beforehand in blocks of
documents, so a very frequent word weighs no more than its contexts. In a bucket the seating of a word in all contexts, their
endings and the root is sampled by Gibbs, one (restaurant, word) after the other: the number of its tables given all others has
a closed form by generalized Stirling numbers. Up to ``EXACT`` customers these are tabulated, beyond that their ratios follow
from how table sizes spread given customers and tables (``leaves``, right to about 1 in 100). What context restaurants hold in all
is added up by hash parts of the contexts after each sweep and told to the buckets that ask: nothing of a size that grows meets
in one task or the driver. Within a sweep these totals are those of its beginning. Predictive probabilities are averaged over
the kept samples.

Every word of every document is scored: blocks ask the buckets for their (context, word) pairs, and add up the answers.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, crc_fold, dropped, joined, mix, n_blocks, pieces, runs, span_hashes, tokens, utf8, written

BLOCK_BYTES = 5 << 20
BURN_IN, SAMPLES, THETA, UNKNOWN, SEED = 1, 2, 1.0, 0.5, 11
EXACT, GRID = 96, 64
_END = U64(0x5DEECE66D1234567)
ENDINGS, FORM_BITS = 1 << 12, 20
#: Pairs are shuffled for so many parts of the buckets one after the other: what a shuffle holds on disk goes in between.
WAVES = 3
#: Pairs of a bucket that are answered at once.
ASKED = 1 << 18


def _tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, the context of each, and each text's number."""
    raw, off = utf8(col)
    raw = LOWER[raw]
    start, end, doc = tokens(raw, off)
    word = span_hashes(raw, start, end)
    ending = raw[end - 1].astype(U64) + U64(1) + np.where(end - start > 1, raw[np.maximum(end - 2, 0)].astype(U64) + U64(1), U64(0)) * U64(257)
    context = ((mix(ending) & U64(ENDINGS - 1)) << U64(FORM_BITS) | word >> U64(20) & U64((1 << FORM_BITS) - 1)).astype(np.uint32)
    docs = len(off) - 1
    place = np.arange(len(word)) + doc
    n = np.bincount(doc, minlength=docs) + 1
    last = np.cumsum(n) - 1
    w, c = np.full(len(word) + docs, _END), np.zeros(len(word) + docs, np.uint32)
    w[place] = word
    c[place + 1] = context
    c[np.concatenate([[0], last[:-1] + 1])[:docs]] = 0  # a text begins after nothing
    return w, c, np.repeat(np.arange(docs), n)


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct pairs, sorted by word then context: words, pairs per word, contexts; then each token's pair and text."""
    w, c, d, at = [], [], [], 0
    for batch in pieces(iter(table.to_batches())):
        x = _tokens(batch.column(batch.schema.get_field_index("text")))
        w.append(x[0])
        c.append(x[1])
        d.append((x[2] + at).astype(np.int32))
        at += batch.num_rows
    words, which = np.unique(np.concatenate(w), return_inverse=True)
    pair = which << 32 | np.concatenate(c)
    del w, c, which
    pair, token = np.unique(pair, return_inverse=True)
    return words, np.bincount(pair >> 32, minlength=len(words)), (pair & 0xFFFFFFFF).astype(np.uint32), token.astype(np.int32), np.concatenate(d)


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _of(x, kind) -> np.ndarray:
    return np.frombuffer(x.as_py() if hasattr(x, "as_py") else x, kind)


def _pairs(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, words, width, ctx, train): each block's distinct pairs and their training counts."""

    def run(table: pa.Table) -> pa.Table:
        words, width, ctx, token, doc = _block(table)
        learn = ~np.asarray(table.column("held_out").to_numpy())
        train = np.bincount(token, weights=learn[doc], minlength=len(ctx)).astype(np.uint32)
        first, bucket = np.concatenate([[0], np.cumsum(width)]), _bucket(words, buckets)
        block = table.column("block")[0].as_py()
        out = [(int(bucket[a]), block, words[a:b].tobytes(), width[a:b].astype(np.uint32).tobytes(), ctx[first[a] : first[b]].tobytes(), train[first[a] : first[b]].tobytes()) for a, b in runs(bucket)]
        return pa.table({k: pa.array([r[i] for r in out], kind) for i, (k, kind) in enumerate([("bucket", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("width", pa.binary()), ("ctx", pa.binary()), ("train", pa.binary())])})

    return docs.groupBy("block").applyInArrow(run, "bucket long, block long, words binary, width binary, ctx binary, train binary")


class Bucket:
    """A bucket's words and the restaurants that hold them: what stays as it is while seats change.

    A pair is a word in a context; an upper pair is a word in an ending, the parent of its pairs whose contexts end so.
    keys: all contexts that pairs of this bucket have, held-out ones too, in the order in which their totals are told.
    """

    def __init__(self, row: dict):
        self.words, self.width = _of(row["words"], U64), _of(row["width"], np.uint32).astype(np.int64)
        self.key, self.c, self.keys = _of(row["key"], np.uint32), _of(row["c"], np.uint32).astype(np.int64), _of(row["keys"], np.uint32)
        self.word = np.repeat(np.arange(len(self.width)), self.width)
        self.pair = self.word << 32 | self.keys[self.key]  # sorted, and so are the upper pairs: endings are the high bits
        upper = self.pair >> FORM_BITS
        first = np.ones(len(upper), bool)
        first[1:] = upper[1:] != upper[:-1]
        self.upper, self.up = upper[first], np.cumsum(first) - 1
        self.upper_word, self.upper_key = self.upper // ENDINGS, self.upper % ENDINGS

    def place(self, ctx: np.ndarray) -> np.ndarray:
        """Where these contexts stand in keys."""
        sort = np.argsort(self.keys)
        return sort[np.searchsorted(self.keys, ctx, sorter=sort)] if len(self.keys) else np.zeros(0, np.int64)

    def seats(self, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables of the pairs, the upper pairs and the words in one sample."""
        t = _of(packed, np.int32).astype(np.int64)
        a, b = len(self.c), len(self.c) + len(self.upper)
        return t[:a], t[a:b], t[b:]

    def parents(self, t: np.ndarray, te: np.ndarray, tw: np.ndarray, g: dict) -> tuple[np.ndarray, np.ndarray]:
        """Predictive probabilities of the upper pairs, and of the words in the root."""
        root = (np.bincount(self.upper_word, weights=te, minlength=len(tw)) - g["d0"] * tw + (g["theta"] + g["d0"] * g["tables"]) * g["h0"]) / (g["theta"] + g["customers"])
        own = np.bincount(self.up, weights=t, minlength=len(te)) - g["d1"] * te
        return (own + (g["theta"] + g["d1"] * g["te"][self.upper_key]) * root[self.upper_word]) / (g["theta"] + g["ce"][self.upper_key]), root

    def told(self, t: np.ndarray, te: np.ndarray, tw: np.ndarray) -> tuple[bytes, bytes, int]:
        """Tables of this bucket in each context of keys; customers and tables in each ending; tables in the root."""
        add = lambda at, x, n: np.bincount(at, weights=x, minlength=n).astype(np.int64)
        ends = add(self.upper_key, np.bincount(self.up, weights=t, minlength=len(te)), ENDINGS), add(self.upper_key, te, ENDINGS)
        return add(self.key, t, len(self.keys)).astype(np.uint32).tobytes(), np.concatenate(ends).tobytes(), int(tw.sum())


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return _bucket(mix(keys.astype(U64)), parts)


def _wave(rows: DataFrame, number: int) -> DataFrame:
    """The rows of one part of the buckets; where a table has folders of these, no others are read."""
    return rows.where(F.col("wave") == number).drop("wave") if "wave" in rows.columns else rows.where(F.pmod("bucket", F.lit(WAVES)) == number)


_FIXED = "bucket long, words binary, width binary, key binary, c binary, keys binary, stats array<long>"
_SEATS = "bucket long, keys binary, seats array<binary>, sums binary, ends binary, tables long"
_KINDS = {"long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}


def _row(schema: str, row: list) -> pa.Table:
    return pa.table({n: pa.array([v], _KINDS[k]) for (n, k), v in zip((x.split(" ") for x in schema.split(", ")), row)})


def _gathered(pairs: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: its training words, contexts per word, counts, and all contexts asked for."""

    def run(table: pa.Table) -> pa.Table:
        words = np.concatenate([np.repeat(_of(w, U64), _of(n, np.uint32)) for w, n in zip(table.column("words").to_pylist(), table.column("width").to_pylist())])
        ctx = np.concatenate([_of(x, np.uint32) for x in table.column("ctx").to_pylist()])
        train = np.concatenate([_of(x, np.uint32) for x in table.column("train").to_pylist()])
        keys = np.unique(ctx)
        keys = keys[np.lexsort((keys, _part(keys, buckets)))]
        learnt = train > 0
        vocabulary, which = np.unique(words[learnt], return_inverse=True)
        pair, at = np.unique(which << 32 | ctx[learnt], return_inverse=True)
        del words, which, ctx
        sort = np.argsort(keys)
        key = sort[np.searchsorted(keys, (pair & 0xFFFFFFFF).astype(np.uint32), sorter=sort)]
        count = np.bincount(at, weights=train[learnt], minlength=len(pair)).astype(np.int64)
        width = np.bincount(pair >> 32, minlength=len(vocabulary))
        upper, contexts = np.unique(pair >> FORM_BITS, return_counts=True)
        endings = np.bincount(upper // ENDINGS, minlength=len(vocabulary))
        stats = [len(vocabulary), int(count.sum()), *(int((x == k).sum()) for x in (count, contexts, endings) for k in (1, 2))]
        return _row(_FIXED, [table.column("bucket")[0].as_py(), vocabulary.tobytes(), width.astype(np.uint32).tobytes(), key.astype(np.uint32).tobytes(), count.astype(np.uint32).tobytes(), keys.tobytes(), stats])

    return pairs.select("bucket", "words", "width", "ctx", "train").groupBy("bucket").applyInArrow(run, _FIXED)


@lru_cache(maxsize=4)
def _stirling(d: float) -> np.ndarray:
    """log S_d(c, t) for c, t up to EXACT."""
    table = np.full((EXACT + 1, EXACT + 1), -np.inf)
    table[0, 0] = 0.0
    for n in range(EXACT):
        t = np.arange(1, n + 2)
        with np.errstate(divide="ignore"):
            stay = table[n, 1 : n + 2] + np.log(np.maximum(n - d * t, 0))
        table[n + 1, 1 : n + 2] = np.logaddexp(table[n, : n + 1], stay)
    return table


@lru_cache(maxsize=4)
def _sizes(d: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean size of tables (log) and share of tables with one customer, along the family of size distributions of discount d."""
    y = np.exp(-np.linspace(1e-4, 60, 6000))
    z = 1 - y
    return np.log(d * z * y ** (d - 1) / (1 - y**d)), d * z / (1 - y**d)


def leaves(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Probability that one of c customers at t tables sits alone: given both, sizes are nearly independent with mean c / t.

    None does where there is one table, all do where each has their own; in between the error is about 1 in 100 (see the tests).
    """
    mean, alone = _sizes(d)
    return (t - 1) / np.maximum(1, c - 1) * np.interp(np.log(c / t), mean, alone)


def seat(c: np.ndarray, others: np.ndarray, log_h: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of a dish with c customers, given the tables of all other dishes of its restaurant and the dish's base."""
    t = np.minimum(c, 1).astype(np.int64)
    log_s = _stirling(d)
    few = np.flatnonzero((c > 1) & (c <= EXACT))
    few = few[np.argsort(c[few], kind="stable")]
    for lo, hi in runs(c[few]):
        n = int(c[few[lo]])
        for rows in np.array_split(few[lo:hi], (hi - lo) * n // 1_000_000 + 1):
            tables = np.arange(n)
            p = np.cumsum(np.log(theta + d * (others[rows][:, None] + tables)), 1) + log_h[rows][:, None] * (tables + 1) + log_s[n, 1 : n + 1]
            p = np.cumsum(np.exp(p - p.max(1)[:, None]), 1)
            t[rows] = (p < rng.random(len(rows))[:, None] * p[:, -1:]).sum(1) + 1
    for rows in np.array_split(at := np.flatnonzero(c > EXACT), len(at) // 8000 + 1):
        if len(rows):
            t[rows] = _many(c[rows].astype(float), others[rows], log_h[rows], d, theta, rng)
    return t


def _many(c: np.ndarray, others: np.ndarray, log_h: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """``seat`` for many customers: the same conditional, by the ratio of t + 1 tables to t, on a grid around its mode.

    A Stirling number over the one of a table less is (1 - r) / r / (c - d (t + 1)), r being ``leaves`` of a customer and a
    table more. The grid of ``GRID`` steps spans six standard deviations to both sides; steps are of one table up to some ten
    deviations of tables, beyond that t is uniform within a step.
    """

    def rise(t: np.ndarray, at=slice(None)) -> np.ndarray:
        r = np.clip(leaves(c[at] + 1, t + 1, d), 1e-300, 1 - 1e-12)
        return np.log((1 - r) / r / (c[at] - d * (t + 1)) * (theta + d * (others[at] + t))) + log_h[at]

    low, high = np.ones(len(c)), c - 1
    for _ in range(40):
        half = (low + high) / 2
        up = rise(half) > 0
        low, high = np.where(up, half, low), np.where(up, high, half)
    near = np.maximum(1.0, 0.05 * low)
    fall = (rise(np.maximum(1.0, low - near)) - rise(np.minimum(c - 1, low + near))) / (np.minimum(c - 1, low + near) - np.maximum(1.0, low - near))
    width = np.clip(1 / np.sqrt(np.maximum(fall, 1e-12)), 4, np.maximum(4, low))
    step = np.ceil(12 * width / GRID)
    first = np.maximum(1, np.floor(low - 6 * width))
    t = first[:, None] + step[:, None] * np.arange(GRID)
    inside = np.minimum(t + (step[:, None] - 1) / 2, c[:, None] - 1)
    each = (slice(None), None)
    p = np.cumsum(np.concatenate([np.zeros((len(c), 1)), (step[:, None] * rise(inside, each))[:, :-1]], 1), 1)
    p[t > c[:, None]] = -np.inf
    p = np.cumsum(np.exp(p - p.max(1)[:, None]), 1)
    at = np.minimum((p < rng.random(len(c))[:, None] * p[:, -1:]).sum(1), GRID - 1)
    return np.minimum(first + step * at + np.floor(rng.random(len(c)) * step), c).astype(np.int64)


def _begun(fixed: DataFrame) -> DataFrame:
    """One table for each pair, to begin with."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                b = Bucket(r)
                seats = [np.ones(len(x), np.int64) for x in (b.c, b.upper, b.words)]
                yield from _row(_SEATS, [r["bucket"].as_py(), r["keys"].as_py(), [np.concatenate(seats).astype(np.int32).tobytes()], *b.told(*seats)]).to_batches()

    return fixed.select("bucket", "words", "width", "key", "c", "keys").mapInArrow(run, _SEATS)


def _customers(fixed: DataFrame) -> DataFrame:
    """(bucket, keys, sums): customers of this bucket in each context."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                b = Bucket(r)
                sums = np.bincount(b.key, weights=b.c, minlength=len(b.keys)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([r["bucket"].as_py()]), pa.array([r["keys"].as_py()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], names=["bucket", "keys", "sums"])

    return fixed.select("bucket", "words", "width", "key", "c", "keys").mapInArrow(run, "bucket long, keys binary, sums binary")


def _totals(sums: DataFrame, buckets: int) -> DataFrame:
    """(bucket, part, total): what each context that a bucket knows of holds in all buckets together. sums: bucket, keys, sums."""

    def tell(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, own = _of(batch.column(1)[i], np.uint32), _of(batch.column(2)[i], np.uint32)
                part = _part(keys, buckets)
                out = [(int(part[x]), batch.column(0)[i].as_py(), keys[x:y].tobytes(), own[x:y].tobytes()) for x, y in runs(part)]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64() if k < 2 else pa.binary()) for k in range(4)], names=["part", "bucket", "keys", "own"])

    def add(table: pa.Table) -> pa.Table:
        lists = [_of(x, np.uint32) for x in table.column("keys").to_pylist()]
        keys, at = np.unique(np.concatenate(lists), return_inverse=True)
        cut = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        total = np.bincount(at, weights=np.concatenate([_of(x, np.uint32) for x in table.column("own").to_pylist()]), minlength=len(keys)).astype(np.int64)[at]
        return pa.table({"bucket": table.column("bucket"), "part": table.column("part"), "total": pa.array([total[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())})

    told = sums.select("bucket", "keys", "sums").mapInArrow(tell, "part long, bucket long, keys binary, own binary")
    return written(told.groupBy("part").applyInArrow(add, "bucket long, part long, total binary"), "totals")


def _together(fixed: DataFrame, seats: DataFrame, totals: list[DataFrame]) -> DataFrame:
    """All that a bucket needs, in rows of one schema: what is fixed, its seats, and the totals it was told (number: which)."""
    out = fixed.drop("stats").unionByName(seats.select("bucket", "seats"), allowMissingColumns=True)
    for number, t in enumerate(totals):
        out = out.unionByName(t.withColumn("number", F.lit(number)), allowMissingColumns=True)
    return out


def _opened(table: pa.Table) -> tuple[Bucket, list[bytes], list[np.ndarray]]:
    """A bucket from its rows of ``_together``: itself, its seats in all samples, and the totals by number."""
    row = table.filter(pc.is_valid(table.column("words")))
    seats = table.column("seats").drop_null()[0].as_py()
    told = table.filter(pc.is_valid(table.column("part")))
    told = told.take(np.lexsort((told.column("part").to_numpy(), told.column("number").to_numpy())))
    totals: dict[int, list[bytes]] = {}
    for number, x in zip(told.column("number").to_pylist(), told.column("total").to_pylist()):
        totals.setdefault(number, []).append(x)
    b = Bucket({n: row.column(n)[0] for n in ("words", "width", "key", "c", "keys")})
    return b, seats, [_of(b"".join(totals[k]), np.int64) for k in sorted(totals)]


def _sweep(fixed: DataFrame, seats: DataFrame, totals: DataFrame, g: dict, keep: bool, number: int) -> DataFrame:
    """Seats after one Gibbs sweep over all buckets, given the restaurants' totals; keep: the seats before stay as a sample."""

    def run(table: pa.Table) -> pa.Table:
        b, old, (total,) = _opened(table)
        t, te, tw = b.seats(old[-1])
        bucket = table.column("bucket")[0].as_py()
        rng = np.random.default_rng([SEED, number, bucket])
        upper, root = b.parents(t, te, tw, g)
        new, more = np.ones(len(t), np.int64), np.flatnonzero(b.c > 1)
        new[more] = seat(b.c[more], (total[b.key[more]] - t[more]).astype(float), np.log(upper)[b.up[more]], g["d"], g["theta"], rng)
        customers = np.bincount(b.up, weights=new, minlength=len(te)).astype(np.int64)
        ending = seat(customers, (g["te"][b.upper_key] - te).astype(float), np.log(root)[b.upper_word], g["d1"], g["theta"], rng)
        customers = np.bincount(b.upper_word, weights=ending, minlength=len(tw)).astype(np.int64)
        top = seat(customers, (g["tables"] - tw).astype(float), np.full(len(tw), np.log(g["h0"])), g["d0"], g["theta"], rng)
        packed = np.concatenate([new, ending, top]).astype(np.int32).tobytes()
        return _row(_SEATS, [bucket, b.keys.tobytes(), [*(old if keep else []), packed], *b.told(new, ending, top)])

    return _together(fixed, seats, [totals]).groupBy("bucket").applyInArrow(run, _SEATS)


def _shared(seats: DataFrame) -> dict:
    """Customers and tables of each ending (a fixed number), and of the root."""

    def run(batches):
        ends, tables = np.zeros(2 * ENDINGS, np.int64), 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                ends += _of(x, np.int64)
            tables += sum(batch.column(1).to_pylist())
        at = np.flatnonzero(ends)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(ends[at], tables))], names=["at", "n"])

    rows = seats.select("ends", "tables").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect()
    ends, tables = np.zeros(2 * ENDINGS, np.int64), 0
    for at, n in rows:
        if at < 0:
            tables = n
        else:
            ends[at] = n
    return {"ce": ends[:ENDINGS], "te": ends[ENDINGS:], "customers": int(ends[ENDINGS:].sum()), "tables": tables}


def fit(pairs: DataFrame, buckets: int, burn_in: int = BURN_IN, samples: int = SAMPLES) -> tuple[DataFrame, DataFrame, list[DataFrame], list[dict]]:
    """The buckets' counts; their seats in the kept samples; totals of the contexts (customers, then tables in each sample);
    and each sample's few shared numbers."""
    fixed = joined([written(_gathered(_wave(pairs, w), buckets), "counts") for w in range(WAVES)])
    s = np.array([r[0] for r in fixed.select(F.array(*[F.sum(F.col("stats")[i]) for i in range(8)]).alias("s")).collect()][0], dtype=object)
    v, n, *ones_and_twos = (int(x or 0) for x in s)
    unknown = UNKNOWN if v else 1.0
    discount = [min(0.95, max(0.05, a / max(1, a + 2 * b))) for a, b in zip(ones_and_twos[::2], ones_and_twos[1::2])]
    numbers = dict(zip(("d", "d1", "d0"), discount)) | {"theta": THETA, "h0": (1 - unknown) / max(1, v), "unknown": unknown, "n": n, "v": v}
    totals, kept = [_totals(_customers(fixed), buckets)], []
    seats = written(_begun(fixed), "seats")
    for number in range(burn_in + samples + 1):
        now, told = numbers | _shared(seats), _totals(seats, buckets)
        if number > burn_in:
            kept.append(now)
            totals.append(told)
        if number == burn_in + samples:
            return fixed, seats, totals, kept
        new = written(_sweep(fixed, seats, told, now, number > burn_in, number), "seats")
        dropped(seats)
        if number <= burn_in:
            dropped(told)
        seats = new


def _answers(pairs: DataFrame, fixed: DataFrame, seats: DataFrame, totals: list[DataFrame], kept: list[dict]) -> DataFrame:
    """(block, bucket, score, known): for each pair of each block its log10 probability, for each word its training count."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b, packed, (customers, *tables) = _opened(right)
        count = np.bincount(b.word, weights=b.c, minlength=len(b.words)).astype(np.int64)
        samples = []
        for x, told, g in zip(packed, tables, kept):
            t, te, tw = b.seats(x)
            samples.append((t, told, *b.parents(t, te, tw, g), g))
        out = []
        asked = [[_of(x, k) for x in left.column(n).to_pylist()] for n, k in (("words", U64), ("width", np.uint32), ("ctx", np.uint32))]
        upto = np.cumsum([len(x) for x in asked[2]])
        lo = 0
        while lo < left.num_rows:  # blocks together: there are as many as the corpus has, and each asks a bucket for little
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + ASKED, "right")))
            mine, wide, near = (np.concatenate(x[lo:hi]) for x in asked)
            at = np.minimum(np.searchsorted(b.words, mine), max(0, len(b.words) - 1))
            known = b.words[at] == mine if len(b.words) else np.zeros(len(mine), bool)
            owner = np.repeat(np.arange(len(mine)), wide)
            key, end, word, knows = b.place(near), (near >> FORM_BITS).astype(np.int64), at[owner], known[owner]
            # the word in the context's ending, then in the context: seen there or not
            upper_at = np.minimum(np.searchsorted(b.upper, word * ENDINGS + end), max(0, len(b.upper) - 1))
            upper_seen = knows & (b.upper[upper_at] == word * ENDINGS + end) if len(b.upper) else np.zeros(len(near), bool)
            spot = np.minimum(np.searchsorted(b.pair, word << 32 | near), max(0, len(b.pair) - 1))
            seen = knows & (b.pair[spot] == word << 32 | near) if len(b.pair) else np.zeros(len(near), bool)
            p = np.zeros(len(near))
            for t, told, upper, root, g in samples:
                none = (g["theta"] + g["d0"] * g["tables"]) * g["unknown"] / (g["theta"] + g["customers"])
                here = np.where(knows, root[word], none) if len(root) else np.full(len(near), none)
                here = (g["theta"] + g["d1"] * g["te"][end]) / (g["theta"] + g["ce"][end]) * here
                if len(upper):
                    here = np.where(upper_seen, upper[upper_at], here)
                here = (g["theta"] + g["d"] * told[key]) * here
                if len(b.pair):
                    here += np.where(seen, b.c[spot] - g["d"] * t[spot], 0.0)
                p += here / (g["theta"] + customers[key])
            base = np.where(known, count[at], 0) if len(count) else np.zeros(len(mine), np.int64)
            score, base = np.log10(p / len(samples)).astype(np.float32), base.astype(np.int64)
            ends, words = (np.cumsum([0, *(len(x) for x in asked[k][lo:hi])]) for k in (2, 0))
            out += [(score[i:j].tobytes(), base[v:w].tobytes()) for i, j, v, w in zip(ends, ends[1:], words, words[1:])]
            lo = hi
        return pa.table({"block": left.column("block"), "bucket": left.column("bucket"), "score": pa.array([o[0] for o in out], pa.binary()), "known": pa.array([o[1] for o in out], pa.binary())})

    asked = pairs.select("bucket", "block", "words", "width", "ctx").groupBy("bucket")
    return asked.cogroup(_together(fixed, seats, totals).groupBy("bucket")).applyInArrow(run, "block long, bucket long, score binary, known binary")


def scored(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of docs(doc_id, text, held_out).

    Rows with held_out teach nothing. A null or blank text has its end token only. Rows that repeat a doc_id are scored one by
    one. Without training rows every probability is that of the unknown word, 1. Extra columns are ignored.
    """
    n = n_blocks(docs, F.coalesce(F.octet_length("text"), F.lit(0)) + 16, block_bytes)
    dealt = docs.select("doc_id", "text", "held_out", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n)).alias("block"))
    pairs = written(_pairs(dealt, n).withColumn("wave", F.pmod("bucket", F.lit(WAVES)).cast("int")), "pairs", "wave")
    fixed, seats, totals, kept = fit(pairs, n)
    answers = []
    for w in range(WAVES):
        answers.append(written(_answers(_wave(pairs, w), _wave(fixed, w), _wave(seats, w), [_wave(t, w) for t in totals], kept), "answers"))
        dropped(pairs, f"wave={w}")
    answers = joined(answers)
    for table in (pairs, fixed, seats, *totals):
        dropped(table)
    tokens_, vocabulary = kept[-1]["n"], kept[-1]["v"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.num_rows
        if not rows:
            return pa.table({"doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64()), "perplexity": pa.array([], pa.float64())})
        words, width, _, token, doc = _block(left)
        order = np.argsort(right.column("bucket").to_numpy())
        score = np.concatenate([_of(right.column("score")[int(i)], np.float32) for i in order]).astype(float)
        count = np.concatenate([_of(right.column("known")[int(i)], np.int64) for i in order])
        count = np.repeat(count, width)[token]
        base = np.log10((count + 0.5) / (tokens_ + 0.5 * (vocabulary + 1)))
        sums = [np.bincount(doc, weights=x, minlength=rows) for x in (np.ones(len(doc)), count > 0, base, score[token])]
        return pa.table({"doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(sums[0].astype(np.int64)), "n_known": pa.array(sums[1].astype(np.int64)), "train_tokens": pa.array(np.full(rows, tokens_, np.int64)), "base_score": pa.array(sums[2]), "score": pa.array(sums[3]), "perplexity": pa.array(10 ** (-sums[3] / sums[0]))})

    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    return out


def op1(docs: DataFrame) -> DataFrame:
    """Scores of all documents, learnt from those whose crc32(doc_id as text) mod 5 is not 1."""
    return scored(docs.select("doc_id", "text", (crc_fold("doc_id", 5) == 1).alias("held_out")))
