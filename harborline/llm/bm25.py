"""Exact top-k BM25 search with block-max WAND pruning over sharded inverted indexes.

Documents fall into shards of bounded text size; each shard's index is built in one task and written. In a shard, documents
are ordered so that similar ones are near, and cut into blocks of ``BLOCK_DOCS``. A *cell* is what a term's list has in a block:
the greatest count, the least length, and where its postings lie. Count and length bound the term's impact on the block's
documents whatever the mean length of all shards turns out to be.

A search reads the cells of the query's terms first. A query's cursor then goes through the blocks in document order to its
next pivot, the first block where the maxima of its terms sum up to its k-th best score so far; only there are postings read and
scored, and whatever lies between two pivots stays unread. The block with the largest sum goes first, as it raises the
threshold. Many queries move along together, so a block's cells are read once for all queries that stop there. Scores use the
statistics of all shards (document frequencies, mean length), so merging the shards' best k gives the exact answer.

Queries go to the shards in rounds, each a broadcast of bounded size; the query set may be any size. A round's answers are
written before the next begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, U64, dropped, joined, n_blocks, pieces, span_hashes, tokens, utf8, written

K1, B, TOP = 1.2, 0.75, 10
SHARD_BYTES, BLOCK_DOCS = 8 << 20, 16
#: Shards that one task searches one after the other, so that thresholds carry over.
TASK_SHARDS = 8
#: Terms in so large a share of the documents, and no more of them, are scored as a dense matrix.
DENSE_SHARE, DENSE_TERMS = 0.02, 1024
#: Bytes of one round's queries, text and dense row of each: bounds each broadcast.
ROUND_BYTES = 32 << 20
#: Columns of a shard's row. All but ids and terms are packed as the narrowest unsigned integers that hold them.
_COLUMNS = ("ids", "real", "length", "terms", "df", "cells", "block", "most", "least", "count", "doc", "tf")


def _packed(values: np.ndarray) -> bytes:
    """An array of counts as bytes, the first of which tells their width."""
    kind = np.min_scalar_type(int(values.max(initial=0))) if values.dtype != bool else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    kind = np.dtype(f"u{np.frombuffer(raw, np.uint8, 1)[0]}")
    return np.frombuffer(raw, np.uint8)[1:].view(kind) if kind.itemsize == 1 else np.frombuffer(bytes(memoryview(raw)[1:]), kind)


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, off = utf8(col)
    raw = LOWER[raw]
    start, end, doc = tokens(raw, off)
    return span_hashes(raw, start, end), doc


def counted(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of each text of a small piece: words, text numbers, counts."""
    w, d = _words(col)
    order = np.lexsort((w, d))
    w, d = w[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])])) if len(w) else np.zeros(0, np.int64)
    return w[first], d[first].astype(np.int32), np.diff(np.append(first, len(w))).astype(np.int32)


def indexed(w: np.ndarray, doc: np.ndarray, count: np.ndarray, ids: np.ndarray, real: np.ndarray, block: int = BLOCK_DOCS) -> dict[str, np.ndarray]:
    """The index of one shard from the distinct words of its documents; ids, real: per document its id and if it has one."""
    at = len(ids)
    length = np.bincount(doc, weights=count, minlength=at).astype(np.int64)
    terms, term = np.unique(w, return_inverse=True)
    term = term.astype(np.int32)
    df = np.bincount(term, minlength=len(terms))
    # neighbours by their first frequent term (much the same language), then by the rarest term that fills a block, then by length
    widely, common = df[term] * 10 >= at, df[term] >= block
    tongue, subject = np.full(at, len(terms)), np.full(at, len(terms) * (at + 1), np.int64)
    np.minimum.at(tongue, doc[widely], term[widely])
    np.minimum.at(subject, doc[common], (df[term[common]] * len(terms) + term[common]))
    order = np.lexsort((length, subject, tongue))
    place = np.empty(at, np.int64)
    place[order] = np.arange(at)
    doc = place[doc]
    sort = np.lexsort((doc, term))
    term, doc, count, length = term[sort], doc[sort], count[sort], length[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] // block != doc[:-1] // block)
    cell = np.flatnonzero(new)
    return {
        "ids": ids[order], "real": real[order], "length": length, "terms": terms, "df": df, "cells": np.bincount(term[cell], minlength=len(terms)),
        "block": doc[cell] // block, "most": np.maximum.reduceat(count, cell) if len(cell) else cell, "least": np.minimum.reduceat(length[doc], cell) if len(cell) else cell, "count": np.diff(np.append(cell, len(term))),
        "doc": doc % block, "tf": count,
    }


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The written index, a row per shard (see ``indexed``). docs: doc_id, text."""
    n = n_blocks(docs, F.coalesce(F.octet_length("text"), F.lit(0)) + 16, shard_bytes)
    dealt = docs.select(F.col("doc_id").cast("long"), "text", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n)).alias("shard"))

    def run(table: pa.Table) -> pa.Table:
        parts, at = [], 0
        for batch in pieces(iter(table.to_batches())):
            w, d, n = counted(batch.column(batch.schema.get_field_index("text")))
            parts.append((w, d + np.int32(at), n))
            at += batch.num_rows
        w, d, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
        del parts
        row = indexed(w, d, n, table.column("doc_id").fill_null(0).to_numpy(), ~table.column("doc_id").is_null().to_numpy())
        cols = {k: pa.array([row[k].tobytes() if k in ("ids", "terms") else _packed(row[k])], pa.binary()) for k in _COLUMNS}
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()]), **cols})

    return written(dealt.groupBy("shard").applyInArrow(run, "shard long, " + ", ".join(f"{k} binary" for k in _COLUMNS)), "index")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            raw = {n: batch.column(k)[i].as_buffer() for k, n in enumerate(batch.schema.names) if n in _COLUMNS}
            yield {n: np.frombuffer(x, np.int64 if n == "ids" else U64) if n in ("ids", "terms") else _unpacked(x) for n, x in raw.items()}


def _cat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges of ``size`` from each start, one after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum())) if len(size) else np.zeros(0, np.int64)


class Round:
    """The queries of one round: ids, term weights, and which queries have each term. Bounded by ROUND_BYTES of text."""

    def __init__(self, ids: np.ndarray, terms: list[np.ndarray], every: np.ndarray, df: np.ndarray, n: int):
        self.ids, self.every = ids, every
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        which = np.searchsorted(every, np.concatenate(terms))
        query = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
        often = np.argsort(-df, kind="stable")[:DENSE_TERMS]
        often = often[df[often] >= DENSE_SHARE * n]
        self.column = np.full(len(every), -1)
        self.column[often] = np.arange(len(often))
        self.has = np.zeros((len(ids), len(often)), bool)
        dense = self.column[which] >= 0
        self.has[query[dense], self.column[which[dense]]] = True
        order = np.argsort(which[~dense], kind="stable")
        self.query = query[~dense][order]
        self.first = np.searchsorted(which[~dense][order], np.arange(len(every) + 1))

    def spread(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sparse terms: each one's queries, one after the other, and how many each has."""
        n = self.first[term + 1] - self.first[term]
        return self.query[_cat(self.first[term], n)], n


class Best:
    """The best k so far of each query, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.score = np.full((len(queries), k), -1.0)
        self.doc = np.full((len(queries), k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        score = np.where(score > 0, np.round(score, 6), -1.0)
        hit = score.max(1) >= np.maximum(self.score[rows, -1], 0)
        rows, score = rows[hit], score[hit]
        if len(rows):
            all_s = np.concatenate([self.score[rows], score], 1)
            all_d = np.concatenate([self.doc[rows], np.where(score > 0, np.broadcast_to(ids, score.shape), np.iinfo(np.int64).max)], 1)
            order = np.lexsort((all_d, -all_s), axis=1)[:, : self.k]
            self.score[rows], self.doc[rows] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_d, order, 1)


def search_shard(row: dict, mean: float, asked: Round, best: Best, itself: bool, block: int = BLOCK_DOCS) -> dict[str, int]:
    """Let one shard improve ``best``. Returns how many (query, block) pairs were opened, of how many, and how many postings of
    asked terms were read, of how many."""
    reads = dict.fromkeys(("opened", "pairs", "read", "postings"), 0)
    at = np.minimum(np.searchsorted(row["terms"], asked.every), max(0, len(row["terms"]) - 1))
    term = np.flatnonzero(row["terms"][at] == asked.every) if len(row["terms"]) else np.zeros(0, np.int64)
    if not len(term):
        return reads
    n, blocks = len(row["length"]), -(-len(row["length"]) // block)
    norm = np.zeros(blocks * block)
    norm[:n] = K1 * (1 - B + B * row["length"] / mean)
    size, count = row["cells"].astype(np.int64), row["count"].astype(np.int64)
    cell = _cat((np.cumsum(size) - size)[at[term]], size[at[term]])
    begin, count = (np.cumsum(count) - count)[cell], count[cell]
    term, where = np.repeat(term, size[at[term]]), row["block"][cell].astype(np.int64)
    reads |= {"pairs": len(best.queries) * blocks, "postings": int(count.sum())}
    # bounds from the cells alone: greatest count at the least length
    tf = row["most"][cell].astype(float)
    most = asked.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * row["least"][cell] / mean))
    column = asked.column[term]
    often = column >= 0
    top = np.zeros((asked.has.shape[1], blocks), np.float32)
    top[column[often], where[often]] = most[often] * (1 + 1e-5)  # rounding must not lower a bound
    bound = np.concatenate([asked.has[lo : lo + 256].astype(np.float32) @ top for lo in range(0, len(asked.has), 256)])
    rare = np.flatnonzero(~often)
    times = np.cumsum(asked.first[term[rare] + 1] - asked.first[term[rare]])
    for lo, hi in _cuts(times, 250_000):
        part = rare[lo:hi]
        query, many = asked.spread(term[part])
        bound += np.bincount(query * blocks + np.repeat(where[part], many), weights=np.repeat(most[part], many), minlength=bound.size).reshape(bound.shape).astype(np.float32)
    bound = bound * np.float32(1 + 1e-4) + np.float32(1e-5)  # sums of single floats in any order, and scores rounded to six places
    del top, most, tf
    order = np.argsort(where, kind="stable")
    edge = np.searchsorted(where[order], np.arange(blocks + 1))
    ids, real = np.zeros(blocks * block, np.int64), np.zeros(blocks * block, bool)
    ids[:n], real[:n] = row["ids"], row["real"]
    place = np.full(len(best.queries), -1)

    def values(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of these cells' postings, and each one's impact: the only place where postings are read."""
        at = _cat(begin[cells], count[cells])
        reads["read"] += len(at)
        doc, tf = np.repeat(where[cells] * block, count[cells]) + row["doc"][at], row["tf"][at].astype(float)
        return doc, np.repeat(asked.idf[term[cells]], count[cells]) * tf * (K1 + 1) / (tf + norm[doc])

    def open_(b: int, rows: np.ndarray) -> None:
        cells = order[edge[b] : edge[b + 1]]
        has = asked.has[rows]
        dense = cells[often[cells]]
        dense = dense[has.any(0)[column[dense]]]
        doc, value = values(dense)
        grid = np.zeros((len(dense), block))
        grid[np.repeat(np.arange(len(dense)), count[dense]), doc - b * block] = value
        score = has[:, column[dense]].astype(float) @ grid
        sparse = cells[~often[cells]]
        place[rows] = np.arange(len(rows))
        query, many = asked.spread(term[sparse])
        wanted = place[query] >= 0
        pair_cell, pair_row = np.repeat(np.arange(len(sparse)), many)[wanted], place[query][wanted]
        place[rows] = -1
        if len(pair_cell):
            used, which = np.unique(pair_cell, return_inverse=True)
            doc, value = values(sparse[used])
            first = np.concatenate([[0], np.cumsum(count[sparse[used]])])
            many = count[sparse[used]][which]
            at = _cat(first[which], many)
            score += np.bincount(np.repeat(pair_row, many) * block + doc[at] - b * block, weights=value[at], minlength=score.size).reshape(score.shape)
        here = ids[b * block : (b + 1) * block]
        score[:, ~real[b * block : (b + 1) * block]] = -1.0
        if not itself:
            score[best.queries[rows][:, None] == here] = -1.0
        best.add(rows, score, here)
        reads["opened"] += len(rows)

    peak, done = bound.argmax(1), np.zeros(bound.shape, bool)
    for b in np.unique(peak).tolist():  # the most promising block of each query
        rows = np.flatnonzero((peak == b) & (bound[:, b] >= np.maximum(best.score[:, -1], 2e-6)))
        if len(rows):
            open_(b, rows)
            done[rows, b] = True
    for b in range(blocks):  # document order; a query stops where its summed maxima reach its threshold
        rows = np.flatnonzero((bound[:, b] >= np.maximum(best.score[:, -1], 2e-6)) & ~done[:, b])
        if len(rows):
            open_(b, rows)
    return reads


def _cuts(total: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose running total grows by about ``most`` each."""
    at = 0
    while at < len(total):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        yield at, to
        at = to


def _shares(index: DataFrame, asks: DataFrame) -> DataFrame:
    """(round, t, df): of each term that a round asks for, the number of documents that have it. asks: query_id, terms, round."""

    def told(batches):
        for batch in batches:
            for number in np.unique(batch.column(1)).tolist():
                mine = np.unique(np.frombuffer(b"".join(batch.column(0).filter(pc.equal(batch.column(1), number)).to_pylist()), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), number, np.int32)), pa.array(mine)], names=["round", "t"])

    def counts(batches):
        for row in _each(batches):
            yield pa.RecordBatch.from_arrays([pa.array(row["terms"].view(np.int64)), pa.array(row["df"].astype(np.int64))], names=["t", "df"])

    asked = asks.select("terms", "round").mapInArrow(told, "round int, t long").distinct()
    held = index.select("terms", "df").mapInArrow(counts, "t long, df long").groupBy("t").agg(F.sum("df").alias("df"))
    return asked.hint("merge").join(held, "t").select("round", "t", "df")


def search(index: DataFrame, queries: DataFrame, k: int = TOP, round_bytes: int = ROUND_BYTES, itself: bool = False) -> DataFrame:
    """query_id, rank, doc_id, score: the exact best k of all indexed documents for each row of queries(query_id, text).

    A query is the set of its distinct words (A-Z lower-cased); null and blank ones find nothing, nor do words no
    document has. Scores are rounded to 6 places, ties go to the smaller doc_id. Documents without a doc_id count in the
    statistics but are not returned; repeated rows are documents of their own. ``itself``: whether a document may answer
    the query of the same id. An empty index gives no rows.
    """
    spark = index.sparkSession

    def lengths(batches):
        for row in _each(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(row["length"])]), pa.array([int(row["length"].sum())])], names=["n", "w"])

    shards, n, w = index.select("length").mapInArrow(lengths, "n long, w long").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    mean = max(w / max(1, n), 1e-9)

    def terms(batches):
        for batch in pieces(batches):
            words, doc = _words(batch.column(1))
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            sets = [np.unique(words[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), batch.column(2)], names=["query_id", "terms", "round"])

    # what a round needs is made once for all: its queries' terms, and in how many documents of all shards each is
    texts = written(queries.where("query_id is not null").select(F.col("query_id").cast("long"), "text"), "texts")
    rounds = n_blocks(texts, F.coalesce(F.octet_length("text"), F.lit(0)) + 8 * DENSE_TERMS, round_bytes)
    asks = written(texts.withColumn("round", F.pmod(F.xxhash64("query_id"), F.lit(rounds)).cast("int")).mapInArrow(terms, "query_id long, terms binary, round int"), "asks", "round")
    dropped(texts)
    shares = written(_shares(index, asks), "shares", "round")
    parts = []
    for number in range(rounds):
        rows = asks.where(F.col("round") == number).select("query_id", "terms").collect()  # bounded by round_bytes
        if not rows:
            continue
        mine = [np.frombuffer(r[1], U64) for r in rows]
        every = np.unique(np.concatenate(mine))
        df = np.zeros(len(every), np.int64)
        got = shares.where(F.col("round") == number).select("t", "df").toPandas()
        df[np.searchsorted(every, got["t"].to_numpy().view(U64))] = got["df"].to_numpy()
        pack = spark.sparkContext.broadcast(Round(np.array([r[0] for r in rows]), mine, every, df, n))

        def answer(batches):
            asked = pack.value
            best = Best(asked.ids, k)
            for row in _each(batches):
                search_shard(row, mean, asked, best, itself)
            q, r = np.nonzero(best.score > 0)
            yield pa.RecordBatch.from_arrays([pa.array(asked.ids[q]), pa.array(best.doc[q, r]), pa.array(best.score[q, r])], names=["query_id", "doc_id", "score"])

        few = index.drop("shard", "df").coalesce(max(1, -(-shards // TASK_SHARDS)))
        parts.append(written(few.mapInArrow(answer, "query_id long, doc_id long, score double"), "answers"))
        pack.destroy()
    dropped(asks)
    dropped(shares)
    schema = "query_id long, doc_id long, score double"
    out = joined(parts) if parts else spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def op3(docs: DataFrame) -> DataFrame:
    """Best ten of all documents for each whole text whose doc_id is divisible by 100, the document itself left out."""
    queries = docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")
    index = build(docs.select("doc_id", "text"))
    out = search(index, queries)
    dropped(index)  # the answers are written
    return out


OP3_SQL = r"""
with w as (select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as ws from documents),
g as (select count(*)::double as n, sum(len(ws)) / count(*)::double as mean from w),
p as (select doc_id, t, count(*)::double as tf from (select doc_id, unnest(ws) as t from w) group by all),
f as (select t, count(*)::double as df from p group by t),
s as (select q.doc_id as query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * len(w.ws) / mean))), 6) as score
  from p q join p on p.t = q.t and p.doc_id <> q.doc_id join f on f.t = p.t join w on w.doc_id = p.doc_id, g
  where q.doc_id % 100 = 0 group by all),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s)
select query_id, rank::int as rank, doc_id, score from r where rank <= 10"""
