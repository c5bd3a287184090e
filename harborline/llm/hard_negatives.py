"""Hard negatives by exact search over k-means inverted lists.

Every row lies in the list of its nearest centre; a list knows the greatest distance of a row from its centre. By Cauchy-Schwarz no
row of a list scores above q.c + |q| r, or below q.c - |q| r, for an anchor q. An anchor visits lists by falling upper bound;
lists outside its window of scores are skipped, and it stops where the bound is strictly below its kth score (equal scores may
still win by their id). Anchors advance together in waves of lists; each wave is one join of (list, anchors that visit it)
with the list's blocks, and the kth scores of a wave steer the next.

Lists and anchors are packed: a row holds up to ``BLOCK_ROWS`` vectors or ``PACK_ROWS`` anchors, so a task holds one pair of
packs. A list is dealt to slots of about ``SLOT_ROWS`` rows by row numbers, so neither a popular list nor equal rows meet in one
task. What is broadcast is a centre, a radius and a count of slots for each of at most ``MOST_LISTS`` lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import dropped, joined, written

#: Rows that centres are fitted on (lowest hash of the id), values of such rows at most, and sweeps of the fit.
SAMPLE_ROWS, SAMPLE_VALUES, SWEEPS = 8192, 1 << 22, 8
MOST_LISTS, SLOT_ROWS, BLOCK_ROWS, PACK_ROWS, TILE_ROWS = 1024, 16384, 2048, 1024, 256
LEAST, MOST = 1 - (1 << 63), (1 << 63) - 1
#: Shares of all lists that an anchor has reached after each wave.
WAVES = (1 / 16, 1 / 4, 1)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    size = col.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(col), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(m: np.ndarray) -> tuple[str, bytes]:
    """The matrix as bytes of the narrowest type that holds it."""
    top = int(np.abs(m).max(initial=0))
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return kind, m.astype(kind).tobytes()


def _unpacked(kind: str, data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact: in doubles where those hold every partial sum, else in 64-bit integers."""
    top = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    return a.astype(float) @ b.astype(float).T if top < 1 << 53 else a.astype(np.int64) @ b.astype(np.int64).T


def _centres(sample: np.ndarray, k: int) -> np.ndarray:
    centres = np.unique(sample, axis=0)
    centres = centres[np.random.default_rng(1).permutation(len(centres))[:k]]
    for _ in range(SWEEPS):
        near = (sample @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _mapped(df: DataFrame, run, kind: str) -> DataFrame:
    """df.mapInArrow of run(batches, schema), the schema being that of the Arrow batches to make."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(kind))
    return df.mapInArrow(lambda batches: run(batches, schema), kind)


class Lists:
    """The index of rows(id, label, vector, anchor): written blocks of lists, packs of anchors, and the bounds' few numbers."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        n, anchors, dim = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("vector"))).first()
        self.dim = dim = max(1, dim or 0)
        many = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // dim))
        sample = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(many).select("vector").toArrow()
        self.centres = centres = _centres(_matrix(sample["vector"].combine_chunks(), dim).astype(float), min(MOST_LISTS, max(1, SAMPLE_VALUES // dim), int(n**0.5) + 1))
        assigned = written(self._assigned(rows), "assigned")
        count = {r[0]: r[1] for r in assigned.groupBy("list").count().collect()}  # a row for each list
        self.slots = np.array([-(-count.get(i, 0) // SLOT_ROWS) for i in range(len(centres))])
        of_list = F.element_at(F.array(*[F.lit(max(1, int(s))) for s in self.slots]), F.col("list") + 1)
        dealt = assigned.withColumn("slot", F.pmod(F.xxhash64("part", "number"), of_list).cast("int"))
        self.blocks = written(self._blocks(dealt.repartition("list", "slot").sortWithinPartitions("list", "slot", "label", "id")), "blocks")
        self.radius = np.zeros(len(centres))
        for r in self.blocks.groupBy("list").agg(F.max("radius")).collect():
            self.radius[r[0]] = r[1]
        picked = assigned.where("anchor").select("id", "label", "vector")
        self.packs = written(self._packs(picked.repartition(max(1, -(-anchors // PACK_ROWS)))), "packs")
        dropped(assigned)
        self.spark = spark

    def _assigned(self, rows: DataFrame) -> DataFrame:
        shared, dim = rows.sparkSession.sparkContext.broadcast(self.centres), self.dim

        def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            number = 0
            for b in batches:
                c = shared.value
                near = (_matrix(b["vector"], dim).astype(float) @ c.T - (c**2).sum(1) / 2).argmax(1)
                yield _batch(schema, b["id"], b["label"], b["vector"], b["anchor"], b["part"], near, np.arange(number, number + len(b)))
                number += len(b)

        return _mapped(rows.select("id", "label", "vector", "anchor", F.spark_partition_id().alias("part")), run, "id long, label long, vector array<long>, anchor boolean, part int, list int, number long")

    def _blocks(self, dealt: DataFrame) -> DataFrame:
        shared, dim = dealt.sparkSession.sparkContext.broadcast(self.centres), self.dim

        def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def block() -> pa.RecordBatch:
                ids, labels, m = (np.concatenate(x) for x in zip(*(h[1:] for h in held)))
                c = shared.value[held[0][0][0]]
                far = float(np.sqrt(((m - c) ** 2).sum(1)).max()) * (1 + 1e-9) + 1e-6
                return _batch(schema, [held[0][0][0]], [held[0][0][1]], [ids.astype(np.int64).tobytes()], [labels.astype(np.int64).tobytes()], *[[x] for x in _packed(m)], [far])

            for b in batches:
                where = np.stack([b["list"].to_numpy(), b["slot"].to_numpy()], 1)
                ids, labels, m = b["id"].to_numpy(), b["label"].to_numpy(), _matrix(b["vector"], dim)
                cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1).tolist(), len(b)]
                for i, j in zip(cuts[:-1], cuts[1:]):
                    key = tuple(where[i].tolist()) if j > i else None
                    while i < j:
                        have = sum(len(h[1]) for h in held)
                        if held and (held[0][0] != key or have == BLOCK_ROWS):
                            yield block()
                            held, have = [], 0
                        to = min(j, i + BLOCK_ROWS - have)
                        held.append((key, ids[i:to], labels[i:to], m[i:to]))
                        i = to
            if held:
                yield block()

        return _mapped(dealt.select("list", "slot", "id", "label", "vector"), run, "list int, slot int, ids binary, labels binary, kind string, vectors binary, radius double")

    def _packs(self, picked: DataFrame) -> DataFrame:
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            part, number = None, 0
            for b in batches:
                part = b["part"][0].as_py() if len(b) else part
                for at in range(0, len(b), PACK_ROWS):
                    s = b.slice(at, PACK_ROWS)
                    yield _batch(schema, [(part << 32) + number], [len(s)], [s["id"].to_numpy().tobytes()], [s["label"].to_numpy().tobytes()], *[[x] for x in _packed(_matrix(s["vector"], dim))])
                    number += 1

        return _mapped(picked.withColumn("part", F.spark_partition_id().cast("long")), run, "pack long, n int, a_ids binary, a_labels binary, a_kind string, a_vectors binary")

    def _pairs(self, packs: DataFrame, first: int, last: int) -> DataFrame:
        """A row for each slot of each list among the anchors' first-th to last-th whose bounds leave room in a window."""
        shared, dim = self.spark.sparkContext.broadcast((self.centres, self.radius, self.slots)), self.dim

        def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            centres, radius, slots = shared.value
            for b in batches:
                for r in b.to_pylist():
                    m = _unpacked(r["a_kind"], r["a_vectors"], dim)
                    ids, labels = np.frombuffer(r["a_ids"], np.int64), np.frombuffer(r["a_labels"], np.int64)
                    middle, reach = m.astype(float) @ centres.T, np.sqrt((m.astype(float) ** 2).sum(1))[:, None] * radius
                    slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
                    high, low = middle + reach + slack, middle - reach - slack
                    rank = np.argsort(np.argsort(-high, axis=1, kind="stable"), axis=1)
                    want = np.array([(w["member"], w["place"], max(w["lo"], LEAST if w["kth"] is None else w["kth"]), w["hi"]) for w in r["wants"]], np.int64)
                    near = (rank >= first) & (rank < last)
                    visit = near[want[:, 0]] & (high[want[:, 0]] >= want[:, 2, None]) & (low[want[:, 0]] <= want[:, 3, None])
                    for c in np.flatnonzero(visit.any(0) & (slots > 0)):
                        w = want[visit[:, c]]
                        members, w_at = np.unique(w[:, 0], return_inverse=True)
                        kind, data = _packed(m[members])
                        whole = np.column_stack([w, w_at]).astype(np.int64).tobytes()
                        for s in range(slots[c]):
                            yield _batch(schema, [c], [s], [r["pack"]], [ids[members].tobytes()], [labels[members].tobytes()], [kind], [data], [whole])

        return _mapped(packs, run, "list int, slot int, pack long, a_ids binary, a_labels binary, a_kind string, a_vectors binary, wanted binary")

    def _found(self, pairs: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best rows of each block for each want that visits it: pack, member, place, anchor_id, score, id."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                    a_ids, a_labels = np.frombuffer(r["a_ids"], np.int64), np.frombuffer(r["a_labels"], np.int64)
                    score = _products(_unpacked(r["a_kind"], r["a_vectors"], dim), _unpacked(r["kind"], r["vectors"], dim))
                    fit = ((a_labels[:, None] == labels) == same) & (a_ids[:, None] != ids)
                    want = np.frombuffer(r["wanted"], np.int64).reshape(-1, 5)
                    for at in range(0, len(want), TILE_ROWS):
                        w = want[at : at + TILE_ROWS]
                        s = score[w[:, 4]]
                        ok = fit[w[:, 4]] & (s >= w[:, 2, None]) & (s <= w[:, 3, None])
                        if s.shape[1] > k:
                            s = np.where(ok, s, LEAST)
                            ok &= s >= np.partition(s, -k, axis=1)[:, -k, None]
                        i, j = np.nonzero(ok)
                        v = s[i, j].astype(np.int64)
                        order = np.lexsort((ids[j], -v, i))
                        i, j, v = i[order], j[order], v[order]
                        top = np.arange(len(i)) - np.searchsorted(i, i) < k
                        i, j, v = i[top], j[top], v[top]
                        if len(i):
                            yield _batch(schema, np.full(len(i), r["pack"]), w[i, 0], w[i, 1], a_ids[w[i, 4]], v, ids[j])

        kind = "pack long, member int, place int, anchor_id long, score long, id long"
        return _mapped(pairs.join(self.blocks, ["list", "slot"]), run, kind)

    def search(self, wants: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best rows with the anchor's own (or another) label in each want's window: wants(pack, member, place, lo, hi).

        pack, member, place, anchor_id, score, id, rank; higher scores first, ties by smaller id. Rows with the anchor's id are left
        out. Each wave's best are written; the table goes when the driver ends.
        """
        wants, best = written(wants, "wants"), None
        order = Window.partitionBy("pack", "member", "place").orderBy(F.desc("score"), "id")
        lists, first = len(self.centres), 0
        for share in WAVES:
            last = max(first, int(np.ceil(lists * share)))
            kth = wants.withColumn("kth", F.lit(None).cast("long"))
            if best is not None:
                full = best.where(F.col("rank") == k).select("pack", "member", "place", F.col("score").alias("kth"))
                kth = wants.join(full, ["pack", "member", "place"], "left")
            asked = self.packs.join(kth.groupBy("pack").agg(F.collect_list(F.struct("member", "place", "lo", "hi", "kth")).alias("wants")), "pack")
            found = self._found(self._pairs(asked, first, last), k, same)
            before, first = best, last
            every = found if before is None else found.unionByName(before.drop("rank"))
            best = written(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
            if before is not None:
                dropped(before)
            if last == lists:
                break
        dropped(wants)
        return best

    def dropped(self) -> None:
        dropped(self.blocks)
        dropped(self.packs)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows(id long, label long, vector array<long>).

    Positives of an anchor are the best other rows of its label. For each, negatives are the best rows of other labels whose
    score s fulfils low * p <= 100 * s <= high * p, p being the positive's. Rows with a null id, label or vector, or a null
    component, take no part; shorter vectors count as ending in zeros. Repeated rows are rows of their own, but those with the
    anchor's id are neither its positives nor its negatives. Scores are sums of 64 bits. An empty table gives none.
    """
    whole = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor")).where(whole)
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not rows.where("anchor").limit(1).count():
        return rows.sparkSession.createDataFrame([], kind)
    index = Lists(rows)
    every = index.packs.select("pack", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("member"), F.lit(1).alias("place"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi"))
    near = index.search(every, positives, True)
    p = F.col("score").cast("decimal(20,0)")
    window = near.select("pack", "member", F.col("rank").alias("place"), F.ceil(F.lit(low) * p / F.lit(100)).cast("long").alias("lo"), F.floor(F.lit(high) * p / F.lit(100)).cast("long").alias("hi")).where("lo <= hi")
    far = index.search(window, negatives, False)
    index.dropped()
    told = near.select("pack", "member", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(told, ["pack", "member", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector is null or a component is null or not finite."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(v, lambda x: F.floor(x * scale)))


def op12(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 100; labels of ids divisible by 7 move on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").alias("id"), label.alias("label"), whole_numbers(F.col("embedding")).alias("vector"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


OP12_SQL = """
with e as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as a, e.id, e.label = a.label as same, list_dot_product(a.v, e.v)::bigint as s from e a join e on e.id <> a.id where a.id % 100 = 0),
p as (select a, id as p, s as ps from (select *, row_number() over (partition by a order by s desc, id) as k from s where same) where k <= 5)
select a as anchor_id, p as positive_id, k::int as rank, id as negative_id, ps as positive_score, s as negative_score from (
  select p.a, p, ps, id, s, row_number() over (partition by p.a, p order by s desc, id) as k from p join s on s.a = p.a and not same and 80 * ps <= 100 * s and 100 * s <= 100 * ps) where k <= 5"""
