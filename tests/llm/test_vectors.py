"""The embedding join against all pairs."""

import numpy as np

from neurofold.llm import vectors


def brute(rows, cosine):
    ok = {i: np.array(v, float) / max(map(abs, v)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _ in rows}
    for a in ok:
        for b in ok:
            if a != b and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= cosine:
                links[a].add(b)
    name = {i: i for i in links}
    moved = True
    while moved:
        moved = False
        for a in links:
            for b in links[a]:
                if name[b] < name[a]:
                    name[a], moved = name[b], True
    return sorted((i, len(links[i]), name[i]) for i in links)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    x = [b + rng.standard_normal(16) * s for b in base for s in (0, 0, 0.05, 0.15, 0.3)]
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [float("inf")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, rows[0][1]), (906, [2 * y for y in rows[7][1]])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id int, leaf int")
    got = vectors.near_duplicates(df).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows, 0.95)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = vectors.near_duplicates(df).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows, 0.95)


def test_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert vectors.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert vectors.near_duplicates(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 2


def test_extreme_magnitudes_link_like_any_others(spark):
    base = np.random.default_rng(3).standard_normal((3, 16))
    rows = [(10 * k + m, [float(y) for y in b * s]) for k, b in enumerate(base) for m, s in enumerate((1, 1e-200, 1e200, 5e-300))]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted((i, 3, i // 10 * 10) for i, _ in rows)


def test_clusters_over_many_cells_and_tiles(spark, monkeypatch):
    """A family of 500 near copies and scattered ones, with grids of many cells and tiles of few rows."""
    monkeypatch.setattr(vectors, "TILE", 64)
    monkeypatch.setattr(vectors, "PACK", 8)
    monkeypatch.setattr(vectors, "SEND", 1)
    rng = np.random.default_rng(6)
    hot = rng.standard_normal(16)
    x = [hot + rng.standard_normal(16) * 0.15 for _ in range(500)] + [b + rng.standard_normal(16) * s for b in rng.standard_normal((150, 16)) for s in (0.0, 0.2, 0.4)]
    rows = [(int(i) * 7 - 3000, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows, 0.95)


def test_null_ids(spark):
    v, w = [1.0, 0.0, 2.0, 3.0], [1.0, 0.01, 2.0, 3.0]
    rows = [(None, v), (None, v), (5, w), (None, [0.0, 1.0, 0.0, 0.0]), (None, None), (7, [3.0, -1.0, 0.0, 1.0])]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(None, 2, 5, False)] * 2 + [(5, 2, 5, True)] + [(None, 0, None, True)] * 2 + [(7, 0, 7, True)]))


def test_grid_probes_every_cell_in_reach():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 4))
    grid = vectors.Grid(x, vectors.bits(4, 0, 6))
    row, cell = grid.near(x, 0.3)
    probed, own = set(zip(row.tolist(), cell.tolist())), grid.own(x)
    near = np.argwhere(((x[:, None] - x[None]) ** 2).sum(2) <= 0.3)
    assert len(near) > 600 and all((int(i), int(own[j])) in probed for i, j in near)
    assert len(probed) < 400 * 64 / 2


def test_levels_add_up():
    for dims in (1, 3, 16):
        for a, b, c in ((0, 0, 5), (0, 7, 24), (4, 4, 4), (2, 5, 19)):
            assert [x + y for x, y in zip(vectors.bits(dims, a, b), vectors.bits(dims, b, c))] == vectors.bits(dims, a, c)
            assert sum(vectors.bits(dims, a, c)) == c - a


def test_meetings_are_all_pairs_in_reach_once(monkeypatch):
    monkeypatch.setattr(vectors, "VISITS", 1 << 9)
    monkeypatch.setattr(vectors, "TOGETHER", 16)
    rng = np.random.default_rng(9)
    own, probes = (np.concatenate([rng.standard_normal((n, 5)), np.ones((30, 5))]).astype(np.float32) for n in (300, 200))
    apart = lambda x, y: ((x[:, None] - y[None]) ** 2).sum(2)
    for leaf in (1, 8, 1000):
        got = [p for i, j in vectors.meetings(probes, own, 0.5, 3, leaf) for p in zip(i.tolist(), j.tolist())]
        assert sorted(got) == [tuple(p) for p in np.argwhere(apart(probes, own) <= 0.5).tolist()] and len(got) > 900
        got = [tuple(sorted(p)) for i, j in vectors.meetings(None, own, 0.5, 3, leaf) for p in zip(i.tolist(), j.tolist())]
        assert sorted(got) == [tuple(p) for p in np.argwhere(np.triu(apart(own, own) <= 0.5, 1)).tolist()]


def test_traffic_follows_coarse_cells():
    """Cells that vectors are sent to: one up to a tile, and far fewer than leaves beyond."""
    x = np.random.default_rng(10).standard_normal((4000, 64))
    x = vectors.unit(x)
    for count, most in ((10_000, 1), (60_000, 1), (1_000_000, 16), (30_000_000, 250)):
        blocks, budgets, coarse, leaf = vectors.plan(x, count, 0.1)
        assert count / 2**coarse <= vectors.tile_rows(64) and leaf <= count / 2**coarse
        grid = vectors.Grid(x[:, blocks[0]], vectors.bits(len(blocks[0]), 0, coarse))
        assert len(grid.near(x[:64, blocks[0]], budgets[0])[0]) <= 64 * most
