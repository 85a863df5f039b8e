"""Embedding near-duplicates by a subspace pigeonhole join, exact in double precision.

Unit vectors with cosine c differ by a squared distance of 2 - 2c.  After a fixed random
rotation the coordinates are split into blocks; if the squared distances of all blocks
were above their share of the total (in proportion to their size) the total would be
exceeded, so a pair must be within budget in at least one block.  Each block is joined
by range in two levels.  Coarse cells are cut so that one holds about ``TILE`` vectors:
a vector is sent to its own cell and, as a probe, to each later cell to which its squared
gaps, summed over the cut coordinates, stay within the block's budget, so that a pair
meets once.  Inside a cell a fine grid, cut at quantiles of the vectors that are there,
picks the leaves that a probe visits.  So traffic follows the number of coarse cells, not
of leaves, and one cell is all there is up to ``TILE`` vectors.  The number of blocks and
of leaves is the one that costs least by visits counted on a bounded sample.

A leaf's vectors and its visitors meet as matrices of block coordinates.  Only vectors
that have a partner within a block's budget go on; their whole vectors meet once more in
the same tile, where cosines are taken in double precision, every pair is counted in the
lowest block that holds it, and a spanning forest stands for the links.  So nothing that
leaves a task grows with the number of pairs, no link is missed and none is added.

Equal vectors are one class, joined once.  Cells beyond ``TILE`` vectors are cut into
tiles, so a cell in which a third of all vectors fall is many tasks; the links of such a
cluster are counted all the same (n_links is exact), which is work in proportion to the
links.

Defined results: vectors that are null, of another length than most, zero, or hold null
or non-finite components have no links and are kept; magnitudes from 1e-300 to 1e300 are
compared alike; repeated vec_ids are one vector if they are equal, and a null vec_id is
linked and counted like any other but never the least of its component unless it is alone;
a pair at exactly the cosine is linked; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components, forest

#: Numbers of blocks to choose from; vectors in the sample that the grids are cut by; sample rows that count visits.
BLOCKS, SAMPLE, TRIED = (4, 8, 16), 20_000, 256
#: Most levels of a grid (2**levels cells); most rows of a tile and most bytes of its whole vectors; rows that travel together.
LEVELS, TILE, TILE_BYTES, PACK = 24, 1 << 16, 32 << 20, 256
#: In comparisons: cost of sending a row to a coarse cell, of a visit to a leaf, of sending a whole vector.
SEND, VISIT, WHOLE = 500, 50, 5_000
#: Visits held at once inside a task, and visitors of a leaf that are compared together.
VISITS, TOGETHER = 1 << 20, 4096
#: Margins for rounding: of block distances in single precision, and in double.
LOOSE, TIGHT = 1e-5, 1e-9


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def scaled(values: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column in double precision, each divided by the power of two next to its largest magnitude (which is exact)."""
    x = np.array(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def bits(dims: int, first: int, last: int) -> list[int]:
    """How often each coordinate is cut in two at levels first to last - 1: coordinates take turns."""
    return [(last - k + dims - 1) // dims - (first - k + dims - 1) // dims for k in range(dims)]


class Grid:
    """Cells of one block: each coordinate is cut at quantiles of a sample into 2**times parts."""

    def __init__(self, x: np.ndarray, times: list[int]):
        self.cuts = [np.quantile(x[:, k], np.arange(1, 1 << b) / (1 << b)) if b and len(x) else np.zeros(0) for k, b in enumerate(times)]

    def own(self, x: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(x), np.int64)
        for k, cuts in enumerate(self.cuts):
            cell = cell * (len(cuts) + 1) + np.searchsorted(cuts, x[:, k], "right")
        return cell

    def near(self, x: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of each cell whose squared gaps to the row sum up to the budget at most."""
        row, cell, spent = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for k, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            v = x[:, k, None]
            gap = np.maximum(0, np.maximum(np.append(-np.inf, cuts) - v, v - np.append(cuts, np.inf))) ** 2
            total = spent[:, None] + gap[row]
            i, side = np.nonzero(total <= budget)
            row, cell, spent = row[i], cell[i] * (len(cuts) + 1) + side, total[i, side]
        return row, cell


def tile_rows(dims: int) -> int:
    return max(1, min(TILE, TILE_BYTES // (8 * dims)))


def plan(sample: np.ndarray, count: int, total: float) -> tuple[list[np.ndarray], np.ndarray, int, float]:
    """Blocks, budgets, levels of coarse cells and rows of a leaf that cost least for ``count`` vectors."""
    dims, best = sample.shape[1], None
    tried = sample[:: max(1, len(sample) // TRIED)]
    coarse = min(LEVELS, max(0, int(np.ceil(np.log2(max(1, count) / tile_rows(dims))))))
    for number in sorted({min(b, dims) for b in BLOCKS}):
        blocks = np.array_split(np.arange(dims), number)
        budgets = np.array([total * len(b) / dims for b in blocks])
        # Blocks are alike after the rotation: the first one stands for all.
        x, mine = sample[:, blocks[0]], tried[:, blocks[0]]
        partners = sum(int(close(augmented(mine[k : k + 64]), x, budgets[0]).sum()) for k in range(0, len(mine), 64)) - len(mine)
        partners *= count / max(1, len(mine) * len(x))
        sends = 0.0
        for levels in range(coarse, LEVELS + 1):
            if levels > coarse and count >> levels < 16:
                break
            grid = Grid(x, bits(x.shape[1], 0, levels))
            visits = sum(len(grid.near(mine[k : k + 64], budgets[0] + LOOSE)[0]) for k in range(0, len(mine), 64)) / max(1, len(mine))
            if levels == coarse:
                sends = SEND * visits + WHOLE * min(partners, visits)
            cost = number * (sends + visits * (VISIT + count / 2**levels))
            if best is None or cost < best[0]:
                best = cost, blocks, budgets, count / 2**levels
            elif cost > 4 * best[0]:
                break
    _, blocks, budgets, leaf = best
    return blocks, budgets, coarse, leaf


def augmented(probes: np.ndarray) -> np.ndarray:
    return np.concatenate([probes, (probes * probes).sum(1)[:, None], np.ones((len(probes), 1), probes.dtype)], 1)


def close(left: np.ndarray, own: np.ndarray, budget: float) -> np.ndarray:
    """Which (augmented) probes and vectors are within a squared distance, by one matrix product."""
    right = np.concatenate([-2 * own, np.ones((len(own), 1), own.dtype), (own * own).sum(1)[:, None]], 1)
    return left @ right.T <= budget


def meetings(probes: np.ndarray | None, own: np.ndarray, budget: float, first: int, leaf: float):
    """Places (i, j) of probes and own vectors within a squared distance, a bounded run of visits at a time, each pair once.

    Without probes the own vectors meet each other.  Cuts go on from level ``first``, down to leaves of about ``leaf`` rows.
    """
    if not len(own) or (probes is not None and not len(probes)):
        return
    levels = max(0, int(np.log2(max(1.0, len(own) / max(leaf, 1.0)))))
    grid = Grid(own, bits(own.shape[1], first, first + levels))
    at = grid.own(own)
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    ends = np.searchsorted(at, np.arange((1 << levels) + 1))
    alone = probes is None
    probes = own if alone else probes
    left = augmented(probes)
    step = max(1, VISITS >> levels)
    for k in range(0, len(probes), step):
        row, cell = grid.near(probes[k : k + step], budget)
        row += k
        if alone:
            row, cell = row[cell >= at[row]], cell[cell >= at[row]]
        if not len(cell):
            continue
        by = np.argsort(cell, kind="stable")
        row, cell = row[by], cell[by]
        cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        for a, b in zip(cuts, [*cuts[1:], len(cell)], strict=True):
            start, stop = ends[cell[a]], ends[cell[a] + 1]
            for m in range(start, stop, TOGETHER):
                n = min(stop, m + TOGETHER)
                for c in range(a, b, TOGETHER):
                    visitors = row[c : min(b, c + TOGETHER)]
                    i, j = np.nonzero(close(left[visitors], own[m:n], budget))
                    i, j = visitors[i], m + j
                    if alone:
                        i, j = i[i < j], j[i < j]
                    if len(i):
                        yield (order[i] if alone else i), order[j]


TILES = "block int, cell bigint, i int, j int"


def near_duplicates(embeddings: DataFrame, cosine: float = 0.95) -> DataFrame:
    """Links rows of embeddings (vec_id, embedding) with a cosine of at least ``cosine``.

    Returns vec_id, n_links (other vectors linked directly), component_id (least vec_id that links reach) and kept (vec_id is it).
    """
    sizes = embeddings.groupBy(F.size("embedding").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    dims = sizes["n"] if sizes else 0
    valid = F.col("embedding").isNotNull() & (F.size("embedding") == dims) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = embeddings.select("vec_id", F.when(valid, F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))).alias("v"))
    if not dims:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # A class of equal vectors goes by its least id, or by a hash where all its ids are null.
    least_id, copies = F.min("vec_id"), F.countDistinct("vec_id") + F.count_if(F.col("vec_id").isNull())
    classes = materialise(rows.where("v is not null").groupBy("v").agg(F.coalesce(least_id, F.xxhash64("v")).alias("id"), least_id.alias("named"), copies.alias("copies")), "vector-classes")
    turn = rotation(dims)
    count = classes.count()
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    sample = unit(scaled(sample, dims)) @ turn if len(sample) else np.zeros((0, dims))
    blocks, budgets, coarse, leaf = plan(sample, count, 2 - 2 * cosine)
    grids = [Grid(sample[:, b], bits(len(b), 0, coarse)) for b in blocks]

    def deal(batches):
        """Packs of ids and block coordinates by cell, of the vectors that lie there and of those that probe it."""
        for batch in batches:
            every = batch.column("id").to_numpy()
            turned = unit(scaled(batch.column("v"), dims)) @ turn
            for k, b in enumerate(blocks):
                for a in range(0, len(every), 1024):
                    ids, x = every[a : a + 1024], turned[a : a + 1024, b]
                    at = grids[k].own(x)
                    near, cells = grids[k].near(x, budgets[k] + LOOSE)
                    later = cells > at[near]
                    for probe, row, cell in ((False, np.arange(len(x)), at), (True, near[later], cells[later])):
                        if not len(cell):
                            continue
                        order = np.argsort(cell, kind="stable")
                        row, cell = row[order], cell[order]
                        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                        size = np.diff(np.append(first, len(cell)))
                        pieces = -(-size // PACK)
                        first = np.repeat(first, pieces) + PACK * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                        ends = np.append(first[1:], len(cell))
                        point = x[row].astype("<f4")
                        packs = [ids[row[i:j]].astype("<i8").tobytes() + point[i:j].tobytes() for i, j in zip(first, ends, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), k, np.int32)), pa.array(cell[first]), pa.array(np.full(len(first), probe)), pa.array((ends - first).astype(np.int32)), pa.array(ids[row[first]]), pa.array(packs, pa.binary())], ["block", "cell", "probe", "n", "head", "pack"])

    dealt = materialise(classes.select("id", "v").mapInArrow(deal, "block int, cell bigint, probe boolean, n int, head bigint, pack binary"), "vector-cells")
    # Tiles of bounded rows: each tile of a cell's vectors meets itself, the later ones (j below ``own``) and every tile of probes (j from there).
    in_tiles = lambda kind: F.ceil(F.coalesce(F.sum(F.when(kind, F.col("n"))), F.lit(0)) / tile_rows(dims)).cast("int")
    counts = dealt.groupBy("block", "cell").agg(in_tiles(~F.col("probe")).alias("own"), in_tiles(F.col("probe")).alias("probes")).where("own > 0")
    joined = dealt.join(materialise(counts, "cell-sizes"), ["block", "cell"])
    tile = F.pmod(F.xxhash64("head"), F.when(F.col("probe"), F.col("probes")).otherwise(F.col("own"))).cast("int")
    place = lambda i, j, probe: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(probe).alias("probe"))
    as_own = F.transform(F.sequence("mine", F.col("own") + F.col("probes") - 1), lambda j: place(F.col("mine"), j, False))
    to_earlier = F.when(F.col("mine") > 0, F.transform(F.sequence(F.lit(0), F.col("mine") - 1), lambda i: place(i, F.col("mine"), True))).otherwise(F.array().cast("array<struct<i:int,j:int,probe:boolean>>"))
    as_probe = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda i: place(i, F.col("own") + F.col("mine"), True))
    places = F.when(F.col("probe"), as_probe).otherwise(F.concat(as_own, to_earlier))
    tiled = joined.withColumn("mine", tile).select("block", "cell", F.explode(places).alias("at"), "n", "pack").select("block", "cell", "at.i", "at.j", "at.probe", "n", "pack")

    def partners(table: pa.Table) -> pa.Table:
        """The vectors and probes of a tile that have a partner within the block's budget."""
        block, alone = table.column("block")[0].as_py(), table.column("i")[0] == table.column("j")[0]
        probe, sizes = table.column("probe").to_numpy(), table.column("n").to_pylist()
        packs = table.column("pack").to_pylist()
        ids = [np.frombuffer(p, "<i8", n) for p, n in zip(packs, sizes, strict=True)]
        points = [np.frombuffer(p, "<f4", offset=8 * n).reshape(n, -1) for p, n in zip(packs, sizes, strict=True)]
        pick = lambda x, kind, empty: np.concatenate([v for v, p in zip(x, probe, strict=True) if p == kind] or [empty])
        none, flat = np.zeros(0, np.int64), np.zeros((0, len(blocks[block])), np.float32)
        own_ids, own, probe_ids, probes = pick(ids, False, none), pick(points, False, flat), pick(ids, True, none), pick(points, True, flat)
        met, meets = np.zeros(len(own_ids), bool), np.zeros(len(probe_ids), bool)
        for i, j in meetings(None if alone else probes, own, budgets[block] + LOOSE, coarse, leaf):
            (met if alone else meets)[i] = True
            met[j] = True
        found = np.concatenate([own_ids[met], probe_ids[meets]])
        same = lambda c, kind: pa.array([table.column(c)[0].as_py()] * len(found), kind)
        return pa.table({"block": same("block", pa.int32()), "cell": same("cell", pa.int64()), "i": same("i", pa.int32()), "j": same("j", pa.int32()), "probe": pa.array(np.arange(len(found)) >= met.sum()), "id": pa.array(found)})

    close_by = materialise(tiled.groupBy("block", "cell", "i", "j").applyInArrow(partners, f"{TILES}, probe boolean, id bigint"), "vector-partners")
    starts = np.array([b[0] for b in blocks])

    def verify(table: pa.Table) -> pa.Table:
        """For each vector of a tile that is linked: its links there, and the root of its tree in a spanning forest."""
        block, alone = table.column("block")[0].as_py(), table.column("i")[0] == table.column("j")[0]
        ids, copies, probe = table.column("id").to_numpy(), table.column("copies").to_numpy(), table.column("probe").to_numpy()
        x = scaled(table.column("v").combine_chunks(), dims)
        norm, turned = (x * x).sum(1), unit(x) @ turn
        mine, theirs = np.flatnonzero(probe), np.flatnonzero(~probe)
        points = turned[:, blocks[block]].astype(np.float32)
        n, a, b = np.zeros(len(ids), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def judge(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal n, a, b
            for m in range(0, len(i), 1 << 15):
                p, q = i[m : m + (1 << 15)], j[m : m + (1 << 15)]
                apart = np.add.reduceat((turned[p] - turned[q]) ** 2, starts, 1)
                # Every block decides alike wherever the pair meets: the lowest one that holds it counts it.
                within = apart <= budgets + TIGHT
                linked = (x[p] * x[q]).sum(1) / np.sqrt(norm[p] * norm[q]) >= cosine
                good = within[:, block] & ~within[:, :block].any(1) & linked
                p, q = p[good], q[good]
                n += (np.bincount(p, copies[q], len(ids)) + np.bincount(q, copies[p], len(ids))).astype(np.int64)
                a, b = forest(np.append(a, ids[p]), np.append(b, ids[q]))

        held, size = [], 0
        for i, j in meetings(None if alone else points[mine], points[theirs], budgets[block] + LOOSE, coarse, leaf):
            held.append((theirs[i] if alone else mine[i], theirs[j]))
            size += len(i)
            if size >= 1 << 17:
                judge(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if held:
            judge(*map(np.concatenate, zip(*held, strict=True)))
        degree = np.zeros(len(a), np.int64)
        np.add.at(degree, np.searchsorted(a, ids[n > 0]), n[n > 0])
        return pa.table({"id": pa.array(a), "root": pa.array(b), "n": pa.array(degree)})

    whole = close_by.join(classes, "id").select("block", "cell", "i", "j", "probe", "id", "copies", "v")
    links = materialise(whole.groupBy("block", "cell", "i", "j").applyInArrow(verify, "id bigint, root bigint, n bigint"), "vector-links")
    degree = links.groupBy("id").agg(F.sum("n").alias("linked"))
    joins = components(links.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = classes.join(degree, "id", "left").join(joins, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = materialise(named.groupBy("component").agg(F.min("named").alias("least")), "vector-least")
    named = named.join(least, "component", "left").select("v", F.xxhash64("v").alias("key"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("least").alias("component_id"))
    # Arrays are slow to sort by: a hash goes before them.
    out = rows.withColumn("key", F.xxhash64("v")).join(materialise(named, "vector-components"), ["key", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
