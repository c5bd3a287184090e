"""Nearest vectors by cells against all pairs, and how many cells they read."""

import numpy as np
import pandas as pd
import pytest

from harborline.operators import vectors


def brute(queries, rows, k, weight=1.0):
    out = {}
    for qi, (q_id, q, q_kind) in enumerate(queries):
        scored = []
        for r_id, x, bonus, kind in rows:
            if r_id == q_id or q_kind is not None and q_kind != kind:
                continue
            cos = np.dot(q, x) / max(np.linalg.norm(q), 1e-12) / max(np.linalg.norm(x), 1e-12)
            scored.append((-round(weight * cos + bonus, 6) + 0.0, r_id))
        out[q_id] = sorted(scored)[:k]
    return out


@pytest.mark.parametrize("spread", [0.05, 2.0], ids=["clustered", "scattered"])
def test_same_as_all_pairs(spark, spread):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(12, 8))
    rows = [(i, (middle[i % 12] + spread * rng.normal(size=8)).round(3).tolist(), float(i % 5) / 10, str(i % 3)) for i in range(600)]
    rows += [(600 + i, rows[i % 3][1], 0.1, "0") for i in range(60)]  # copies
    rows.append((700, [0.0] * 8, 0.0, "1"))
    queries = [(i, rows[i][1], str(i % 3) if i % 2 else None) for i in range(0, 660, 7)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, bonus double, kind string").repartition(3)
    cells = vectors.Cells(df.union(spark.createDataFrame([(None, [1.0] * 8, 0.0, "0"), (999, None, 0.0, "0")], df.schema)))
    got = {}
    for r in cells.search(spark.createDataFrame(queries, "query_id long, vector array<double>, kind string").where("kind is null or true"), 5, 0.6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    want = brute(queries, rows, 5, 0.6)
    # a null kind asks for rows without one, as the table has the column
    for q_id, _, kind in queries:
        if kind is None:
            assert q_id not in got
        else:
            assert [(i, -s) for _, i, s in sorted(got[q_id])] == [(i, pytest.approx(s, abs=2e-6)) for s, i in want[q_id]]
    possible, seen = cells.visits[0]
    assert 0 < seen <= possible


def test_most_cells_are_left_alone_where_rows_cluster(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(40, 8))
    rows = [(i, (middle[i % 40] + 0.05 * rng.normal(size=8)).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    cells = vectors.Cells(df)
    found: dict[int, list] = {}
    for r in sorted(cells.search(df.selectExpr("id as query_id", "vector"), 3).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.id)
    want = brute([(i, v, None) for i, v in rows[::37]], [(i, v, 0.0, "") for i, v in rows], 3)
    for q, w in want.items():
        assert found[q] == [i for _, i in w]
    possible, seen = cells.visits[0]
    assert seen < 0.35 * possible


def test_queries_of_any_kind_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (3, [0.0, 1.0])], "id long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (9, [0.0, 2.0])], "query_id long, vector array<double>")
    got = sorted((r.query_id, r["rank"], r.id) for r in vectors.Cells(rows).search(q, 2).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (9, 1, 3), (9, 2, 3)]
    assert vectors.Cells(rows.limit(0)).search(q, 2).count() == 0
    assert vectors.Cells(rows).search(q.limit(0), 2).count() == 0


@pytest.mark.parametrize("weight", [0.6, -1.0])
def test_packs_in_tiles_by_several_tasks(spark, monkeypatch, weight):
    monkeypatch.setattr(vectors, "PACK_ROWS", 512)
    rng = np.random.default_rng(9)
    rows = [(2**60 + i, rng.normal(size=16).tolist(), float(i % 7) / 10) for i in range(1100)]
    rows += [(2**60 + 1100 + i, rows[3][1], 0.3) for i in range(90)]  # copies: ties by id
    df = spark.createDataFrame(rows, "id long, vector array<double>, bonus double").repartition(4)
    got: dict[int, list] = {}
    for r in sorted(vectors.Cells(df).search(df.selectExpr("id as query_id", "vector"), 5, weight).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert len(got) == len(rows)
    some = rows[::53] + rows[-2:]
    want = brute([(i, v, None) for i, v, _ in some], [(*r, "") for r in rows], 5, weight)
    for q, w in want.items():
        assert got[q] == [(i, pytest.approx(-s, abs=2e-6)) for s, i in w]


def test_a_pack_keeps_the_best_over_small_tiles_and_few_held_hits(monkeypatch):
    for name, value in (("TILE_ROWS", 7), ("HITS", 20), ("CHUNK", 16)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(3)
    x = vectors._unit(rng.normal(size=(200, 6)))
    x[150:] = x[0]
    x[9] = np.nan  # never among the best, and no bar to others
    bonus, kinds = rng.integers(0, 5, 200) / 10, np.array(["a", "b"], object)[np.arange(200) % 2]
    visit = np.packbits(np.ones((60, 4), bool), axis=1)
    asked = pd.DataFrame({"query": range(60), "query_id": range(60), "kind": [["a", "b", None][i % 3] for i in range(60)], "vector": list(np.where(np.isnan(x[:60]), 1.0, x[:60])), "kth": np.nan, "visit": [v.tobytes() for v in visit]})
    pack = vectors._Best(asked, 4, 0.5, True)
    for cell in range(4):
        j = np.arange(200)[np.arange(200) % 4 == cell]
        pack.take(cell, j, kinds[j], x[j], bonus[j])
    got = {i: list(zip(-g["score"], g["id"])) for i, g in pack.found().groupby("query")}
    for i, kind in enumerate(asked["kind"]):
        score = 0.5 * (x @ asked["vector"][i]) + bonus
        every = sorted((-round(float(s), 6) + 0.0, j) for j, s in enumerate(score) if j not in (i, 9) and kind in (None, kinds[j]))[:4]
        assert [j for _, j in got[i]] == [j for _, j in every] and [s for s, _ in got[i]] == pytest.approx([s for s, _ in every], abs=2e-6)


def test_embeddings_are_dealt_over_all_cores(spark):
    from harborline.operators import reports

    s = spark.createDataFrame([(i, 0.5) for i in range(40)], "supplier_id long, risk_score double").coalesce(1)
    rows = reports.embeddings(s, spark.createDataFrame([(1, "port-1")], "supplier_id long, neighbour string").coalesce(1))
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and rows.count() == 40
