"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target amount of words; a document of the source is taken
``target / source size`` times on average, as a whole number of copies.  The
fractional copies are rounded dependently: two documents of a source exchange word
mass at random until one of them is a whole number, which keeps the source's total
exactly, and the one document left over meets the left-overs of other blocks in a
reduction tree.  A source's total is therefore off by less than one document.

Blocks hold bounded rows of one source, so a source with a third of all rows is
many blocks, and each round of the tree is one shuffle of the left-overs alone.
Randomness is drawn from a hash of the block's first document: reruns agree.

Defined results: null and empty texts have size 0 and are not taken; a null source
is a source of its own, sorted last; repeated rows, repeated ids and null ids are rows of
their own (rows repeated more often than a block holds are dealt to several blocks); an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Rows of a block, and left-overs that meet in one node of the tree.
BLOCK_ROWS = 4000
FAN_IN = 256


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """Targets of the sources in sizes (source, source_size, n), one row each: shares by weight of all words.

    A target stops at ``limit`` times the source's size and the excess goes to the others by weight, until none is above.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    kind = (F.row_number().over(order) - 1) % len(weights)
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), kind + 1).cast("double")).withColumn("cap", F.col("source_size") * limit)
    # Water-filling: in order of cap per weight, sources fill up one after another until the rest can share what is left.
    ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = ratio.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("left", F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("sharing", F.sum("weight").over(ratio.rowsBetween(0, W.unboundedFollowing))).withColumn("level", F.col("left") / F.col("sharing"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(ratio), "level"))
    s = s.withColumn("fits", fits).withColumn("final", F.min("fits").over(W.partitionBy())["level"])
    return s.select("source", "source_size", "n", F.least(F.col("cap"), F.coalesce("final", F.lit(0.0)) * F.col("weight")).alias("target"))


def _round_block(table: pa.Table) -> pa.Table:
    """Pairs the fractional documents of one block; at most one stays fractional."""
    table = table.sort_by([("doc_id", "ascending"), ("uid", "ascending")])
    size, part = table.column("size").to_numpy().astype(float), table.column("part").to_numpy().copy()
    uid = table.column("uid")[0].as_py()
    level = table.column("level")[0].as_py()
    rng = np.random.default_rng([uid % (1 << 63), level + 1])
    up = np.zeros(len(size), np.int64)
    loose = np.flatnonzero((part > 1e-12) & (part < 1 - 1e-12) & (size > 0))
    up[part >= 1 - 1e-12] = 1
    draws = rng.random(len(loose) + 1)
    hold = -1
    for k, j in enumerate(loose):
        if hold < 0:
            hold = j
            continue
        i = hold
        a, b, si, sj = part[i], part[j], size[i], size[j]
        rise = min(si * (1 - a), sj * b)
        fall = min(si * a, sj * (1 - b))
        if draws[k] * (rise + fall) < fall:
            part[i], part[j] = a + rise / si, b - rise / sj
        else:
            part[i], part[j] = a - fall / si, b + fall / sj
        hold = -1
        for x in (i, j):
            if part[x] <= 1e-9:
                part[x] = 0.0
            elif part[x] >= 1 - 1e-9:
                part[x], up[x] = 1.0, 1
            else:
                hold = x
    keep = table.drop_columns(["part", "up", "settled"])
    settled = np.ones(len(size), bool)
    if hold >= 0:
        settled[hold] = False
    return keep.append_column("part", pa.array(part)).append_column("up", pa.array(up)).append_column("settled", pa.array(settled))


STATE = "uid bigint, doc_id bigint, source string, size bigint, node bigint, level int, part double, up bigint, settled boolean"


def pivotal_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """Whole copies of each row of docs (doc_id, text, source) so that sources reach their target words.

    Returns doc_id, size, source_size, target, taken, copies and uid (a hash of the row, which tells repeated ids apart).
    """
    uid = F.xxhash64("doc_id", "source", "text")
    rows = docs.select("doc_id", "source", word_count().alias("size"), uid.alias("uid"), F.monotonically_increasing_id().alias("place"))
    rows = materialise(rows, "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = materialise(targets(sizes, weights, limit), "mix-targets")
    most = goal.agg(F.max("n")).first()[0] or 0
    wide = rows.join(goal, rows.source.eqNullSafe(goal.source)).select("doc_id", rows.source, "size", "uid", "place", "source_size", "target", "n")
    ratio = F.least(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)), F.lit(limit))
    wide = wide.withColumn("whole", F.floor(ratio + 1e-12)).withColumn("part", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    blocks = F.ceil(F.col("n") / BLOCK_ROWS)
    # Rows that repeat more often than a block holds are told apart by the table's order; which of them is which does not matter.
    repeated = rows.groupBy(F.col("uid").alias("twin")).agg(F.count("*").alias("times")).where(F.col("times") > BLOCK_ROWS)
    salt = F.lit(0).cast("long")
    if not repeated.isEmpty():
        wide = wide.join(repeated, F.col("uid") == F.col("twin"), "left")
        salt = F.when(F.col("times").isNotNull(), F.pmod("place", F.ceil(F.col("times") / BLOCK_ROWS))).otherwise(salt)
    state = wide.select("uid", "doc_id", "source", "size", F.pmod(F.xxhash64("uid", "doc_id", salt), blocks).alias("node"), F.lit(0).alias("level"), "part", F.lit(0).cast("long").alias("up"), F.lit(False).alias("settled"))
    done = []
    # One round rounds the blocks, each further one the left-overs of FAN_IN nodes.
    for level in range(1 + (math.ceil(math.log(max(1, math.ceil(most / BLOCK_ROWS)), FAN_IN)) if most else 0)):
        if level:
            state = state.withColumn("node", F.floor(F.col("node") / FAN_IN)).withColumn("level", F.lit(level))
        state = materialise(state.groupBy("source", "node").applyInArrow(_round_block, STATE), "mix-round")
        done.append(state.where("settled"))
        state = state.where("not settled")
    # The last document of each source that is still a fraction is taken or left at random.
    coin = F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(1 << 40)) / float(1 << 40)
    done.append(state.withColumn("up", (coin < F.col("part")).cast("long")))
    ups = done[0]
    for d in done[1:]:
        ups = ups.unionByName(d)
    out = ups.join(goal, ups.source.eqNullSafe(goal.source)).select("doc_id", ups.source, "size", "source_size", "target", "up", "uid")
    ratio = F.least(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)), F.lit(limit))
    copies = (F.floor(ratio + 1e-12) + F.col("up")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).alias("copies"), "uid")
