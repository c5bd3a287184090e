"""Exact nearest vectors without all pairs: cells around centres, and the triangle inequality to leave most of them alone.

Rows lie in the cell of their nearest centre. For unit vectors q.x <= q.c + |x - c|, so no row of a cell scores above
``weight * (q.c + radius) + (the cell's greatest bonus)``. Queries look at cells by falling bound: a first wave of cells gives each
its kth score, a second one visits those cells whose bound is not below it. In a wave, queries of near cells make packs of a bounded
size, and a pack's task streams the rows of the cells that any of its queries visits: a tile of coarse scores at a time, exact
ones where the coarse one reaches the kth so far. What is broadcast is a centre, a radius, a bonus and a number of rows for each of
at most ``MOST_CELLS`` cells. Vectors without clusters leave few cells alone; work then is queries times rows, in such tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..materialize import materialized

#: Rows (lowest hash of the id) that centres are fitted on, and sweeps of the fit.
SAMPLE_ROWS, SWEEPS = 4096, 6
#: A pack has at most so many queries and so many bytes of vectors; a tile so many queries; hits are held up to HITS, worked out CHUNK at a time.
MOST_CELLS, PACK_ROWS, PACK_BYTES, TILE_ROWS, HITS, CHUNK = 512, 16384, 32 << 20, 2048, 1 << 18, 1 << 16
#: Tasks of a wave for each core, where there are fewer packs: a pack's cells are then dealt to several.
TASKS = 3
#: Share of the cells that the first wave visits.
FIRST = 1 / 16


def _unit(rows) -> np.ndarray:
    m = np.stack([np.asarray(v, float) for v in rows]) if len(rows) else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _centres(sample: np.ndarray, k: int) -> np.ndarray:
    centres = np.unique(sample, axis=0)
    centres = centres[np.random.default_rng(1).permutation(len(centres))[:k]]
    for _ in range(SWEEPS):
        near = (sample @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, total / np.maximum(n, 1), centres)
    return centres


class _Best:
    """The k best rows so far for each query of a pack, asked(query, query_id, kind, vector, kth, visit); ``take`` sees some rows of one cell.

    Coarse scores in single precision are right to ``slack``, so a row whose coarse score is further below the kth is none of the k.
    """

    def __init__(self, asked: pd.DataFrame, k: int, weight: float, skip_own: bool):
        self.k, self.weight, self.skip_own = k, weight, skip_own
        self.query, self.ids, self.kinds = (asked[c].to_numpy() for c in ("query", "query_id", "kind"))
        self.q = np.stack(asked["vector"].tolist()).astype(float)
        self.coarse, self.slack = self.q.astype("float32"), abs(weight) * 2.5e-7 * self.q.shape[1] + 2e-6
        self.kth = asked["kth"].astype(float).fillna(-np.inf).to_numpy(copy=True)
        self.visit = np.unpackbits(np.stack([np.frombuffer(v, "uint8") for v in asked["visit"]]), axis=1).astype(bool)
        self.hits, self.held = [], 0
        self.any_kind = pd.isna(asked["kind"]).to_numpy()

    def _barred(self, who: np.ndarray, ids: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Whether a row is the query itself or of another kind than it asks for."""
        out = ~self.any_kind[who] & (self.kinds[who] != kinds) if not self.any_kind.all() else np.zeros(np.broadcast_shapes(who.shape, ids.shape), bool)
        return out | (self.ids[who] == ids) if self.skip_own else out

    def take(self, cell: int, ids: np.ndarray, kinds: np.ndarray, x: np.ndarray, bonus: np.ndarray) -> None:
        who = np.flatnonzero(self.visit[:, cell])
        for at in range(0, len(who), TILE_ROWS):
            i = who[at : at + TILE_ROWS]
            least = self.kth[i]
            j = np.flatnonzero(~(bonus + abs(self.weight) + self.slack < least.min()))  # rows that can reach any of these queries
            if not len(j):
                continue
            rough = self.coarse[i] @ x[j].astype("float32").T * np.float32(self.weight) + bonus[j].astype("float32")
            slack = self.slack + 2.5e-7 * float(np.nan_to_num(np.abs(bonus[j])).max())
            fresh = np.flatnonzero(least == -np.inf)
            if len(fresh) and len(j) >= self.k:  # these have no kth yet: that of this tile is a lower bound
                open_ = rough[fresh]
                open_[self._barred(i[fresh][:, None], ids[j], kinds[j]) | np.isnan(open_)] = -np.inf
                least[fresh] = np.partition(open_, -self.k, axis=1)[:, -self.k] - slack
            a, b = np.divmod(np.flatnonzero(rough >= (least - slack).astype("float32")[:, None]), len(j))
            for c in range(0, len(a), CHUNK):
                w, r = i[a[c : c + CHUNK]], j[b[c : c + CHUNK]]
                score = np.round(self.weight * np.einsum("ij,ij->i", self.q[w], x[r]) + bonus[r], 6) + 0.0
                kept = (score >= self.kth[w]) & ~self._barred(w, ids[r], kinds[r]) & (score > -np.inf)
                self.hits.append((w[kept], score[kept], ids[r][kept]))
                self.held += int(kept.sum())
                if self.held > HITS:
                    self._settle()
            if (self.kth[i[fresh]] == -np.inf).any():
                self._settle()
        if self.held > len(self.q):
            self._settle()

    def _settle(self) -> None:
        """Each query's k best of what is held, and its kth score."""
        if not self.hits:
            return
        who, score, ids = (np.concatenate(c) for c in zip(*self.hits))
        order = np.argsort(ids, kind="stable")
        order = order[np.lexsort((-score[order], who[order]))]
        who, score, ids = who[order], score[order], ids[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        last, kept = rank == self.k - 1, rank < self.k
        self.kth[who[last]] = score[last]
        self.hits, self.held = [(who[kept], score[kept], ids[kept])], 0

    def found(self) -> pd.DataFrame:
        self._settle()
        who, score, ids = self.hits[0] if self.hits else (np.zeros(0, int), [], [])
        return pd.DataFrame({"query": self.query[who], "query_id": self.ids[who], "kind": self.kinds[who], "id": ids, "score": score})



class Cells:
    """The index of rows(id, vector, bonus, kind); ``search`` asks it. bonus and kind are optional (0, one kind for all).

    Vectors have one length; rows with a null id or vector are left out, a null bonus is 0, a null kind a kind of its own.
    """

    def __init__(self, rows: DataFrame):
        spark = self.spark = rows.sparkSession
        bonus = F.coalesce(F.col("bonus").cast("double"), F.lit(0.0)) if "bonus" in rows.columns else F.lit(0.0)
        kind = F.coalesce(F.col("kind").cast("string"), F.lit("")) if "kind" in rows.columns else F.lit("")
        rows = rows.where("id is not null and vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"), bonus.alias("bonus"), kind.alias("kind"))
        self.id_type = rows.schema["id"].dataType.simpleString()
        n = rows.count()
        sample = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()
        unit = _unit(sample["vector"].tolist())
        self.centres = _centres(unit, min(MOST_CELLS, int(n**0.5) + 1)) if n else np.zeros((0, 1))
        cells = len(self.centres)
        self.shared = spark.sparkContext.broadcast(self.centres)
        self.rows = materialized(self._assigned(rows), "cells")
        self.radius, self.bonus, self.count = np.zeros(cells), np.zeros(cells), np.zeros(cells, int)
        for r in self.rows.groupBy("cell").agg(F.max("far"), F.max("bonus"), F.count("*")).collect():  # a row for each cell
            self.radius[r[0]], self.bonus[r[0]], self.count[r[0]] = r[1] * (1 + 1e-9) + 1e-9, r[2], r[3]
        #: (queries times cells, those visited) of each search.
        self.visits: list[tuple[int, int]] = []

    def _assigned(self, df: DataFrame) -> DataFrame:
        """df with unit vectors, each one's cell and how far it is from the cell's centre."""
        shared = self.shared

        def assign(batches):
            for b in batches:
                m, c = _unit(b["vector"].tolist()), shared.value
                cell = (m @ c.T - (c**2).sum(1) / 2).argmax(1) if len(b) else np.zeros(0, int)
                far = np.sqrt(((m - c[cell]) ** 2).sum(1)) if len(b) else []
                yield b.assign(vector=list(m), cell=cell.astype("int32"), far=far)

        return df.mapInPandas(assign, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", cell int, far double")

    def search(self, queries: DataFrame, k: int, weight: float = 1.0, skip_own: bool = True) -> DataFrame:
        """(query_id, kind, rank, id, score): the k best rows of each query by weight * cosine + bonus, to six places; ties by id.

        queries(query_id, vector, kind): rows of the query's own id are left out (unless skip_own is false), and those of another
        kind where queries have one. The result is that of comparing all pairs.
        """
        kind = F.coalesce(F.col("kind").cast("string"), F.lit("")) if "kind" in queries.columns else F.lit(None).cast("string")
        asked = queries.where("query_id is not null and vector is not null").select(F.col("query_id"), F.col("vector").cast("array<double>").alias("vector"), kind.alias("kind"))
        many = asked.count()
        if not many or not len(self.centres):
            return asked.where("false").select("query_id", "kind", F.lit(0).alias("rank"), F.lit(None).cast(self.id_type).alias("id"), F.lit(0.0).alias("score"))
        cells, (q_type, id_type) = len(self.centres), (asked.schema["query_id"].dataType.simpleString(), self.id_type)
        packs = -(-many // max(512, min(PACK_ROWS, PACK_BYTES // (8 * self.centres.shape[1]))))
        slices = min(cells, -(-TASKS * self.spark.sparkContext.defaultParallelism // packs))
        asked = materialized(self._assigned(asked.withColumn("query", F.monotonically_increasing_id())), "queries")
        counts = dict(asked.groupBy("cell").count().collect())  # a row for each cell
        sizes = np.array([counts.get(c, 0) for c in range(cells)])
        start, size = (F.element_at(F.array(*[F.lit(int(v)) for v in a]), F.col("cell") + 1) for a in (np.cumsum(sizes) - sizes, np.maximum(sizes, 1)))
        asked = asked.withColumn("pack", F.floor((start + F.pmod(F.xxhash64("query"), size)) * packs / many).cast("int")).drop("cell", "far")
        shared = self.spark.sparkContext.broadcast((self.centres, self.radius, self.bonus, self.count))
        first = max(8, int(np.ceil(cells * FIRST)))

        def visiting(first_wave: bool):
            def run(batches):
                centres, radius, bonus, count = shared.value
                for b in batches:
                    if not len(b):
                        continue
                    q = np.stack(b["vector"].tolist())
                    bound = weight * np.minimum(1.0, q @ centres.T + radius) + bonus + 1e-6 if weight >= 0 else np.full((len(q), cells), np.inf)
                    rank = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
                    visit = rank < first if first_wave else (rank >= first) & ~(bound < b["kth"].astype(float).fillna(-np.inf).to_numpy()[:, None])
                    visit &= count > 0
                    dealt = np.stack([visit[:, s::slices].any(1) for s in range(slices)], axis=1)
                    yield b.assign(visit=[v.tobytes() for v in np.packbits(visit, axis=1)], visits=visit.sum(1), slices=[np.flatnonzero(d).astype("int32") for d in dealt])

            return run

        def visited(batches):
            for b in batches:
                for pack, group in b.groupby("pack"):
                    any_ = np.bitwise_or.reduce(np.stack([np.frombuffer(v, "uint8") for v in group["visit"]]), axis=0)
                    yield pd.DataFrame({"pack": pack, "cell": np.flatnonzero(np.unpackbits(any_))}).astype("int32")

        def best(batches):
            held, pack, schema = [], None, None
            for b in batches:
                asks, rows = b.filter(pc.is_valid(b["query"])), b.filter(pc.is_null(b["query"]))
                if len(asks):
                    held.append(asks)
                if not len(rows) or not held:
                    continue
                if not pack:
                    pack = _Best(pa.Table.from_batches(held).to_pandas(), k, weight, skip_own)
                    schema = pa.schema([("query", pa.int64()), ("query_id", b.schema.field("query_id").type), ("kind", b.schema.field("kind").type), ("id", b.schema.field("id").type), ("score", pa.float64())])
                x = rows["vector"].flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                cells_, ids, kinds, bonus = (rows[c].to_numpy(zero_copy_only=False) for c in ("cell", "id", "kind", "bonus"))
                for cell in np.unique(cells_):
                    j = np.flatnonzero(cells_ == cell)
                    pack.take(int(cell), ids[j], kinds[j], x[j], bonus[j])
            if pack:
                yield pa.RecordBatch.from_pandas(pack.found(), schema, preserve_index=False)

        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        found, seen = None, 0
        for first_wave in (True, False):
            kth = asked.withColumn("kth", F.lit(None).cast("double"))
            if found is not None:
                kth = asked.join(found.where(F.col("rank") == k).select("query", F.col("score").alias("kth")), "query", "left")
            kth = kth.select("query_id", "vector", "kind", "query", "pack", "kth")
            planned = materialized(kth.mapInPandas(visiting(first_wave), f"query_id {q_type}, vector array<double>, kind string, query long, pack int, kth double, visit binary, visits long, slices array<int>"), "planned")
            seen += planned.agg(F.sum("visits")).first()[0] or 0
            wanted = planned.where("visits > 0").select("pack", "visit").mapInPandas(visited, "pack int, cell int").distinct()
            no = lambda kind, name: F.lit(None).cast(kind).alias(name)
            task = lambda s: (F.col("pack") * slices + s).cast("int").alias("task")
            asks = planned.select("*", F.explode("slices").alias("slice")).select(task(F.col("slice")), "query", "query_id", no(id_type, "id"), F.lit(-1).alias("cell"), "kind", "vector", no("double", "bonus"), "kth", "visit")
            rows = self.rows.join(wanted, "cell").select(task(F.col("cell") % slices), no("long", "query"), no(q_type, "query_id"), "id", "cell", "kind", "vector", "bonus", no("double", "kth"), no("binary", "visit"))
            tiles = asks.union(rows).repartitionById(packs * slices, F.col("task")).sortWithinPartitions("cell")  # queries first
            hits = tiles.mapInArrow(best, f"query long, query_id {q_type}, kind string, id {id_type}, score double")
            every = hits if found is None else hits.unionByName(found.drop("rank"))
            found = materialized(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "found")
            if first >= cells:
                break
        self.visits.append((many * cells, seen))
        return found.select("query_id", "kind", "rank", "id", "score")
