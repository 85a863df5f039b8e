"""Hilbert-curve sharding, in DataFrame functions only.

Documents are grouped by equal text, each group's metadata (source, language,
size) is quantised at corpus quantiles, groups are ordered by their Hilbert index
and the order is cut into runs of near-equal bytes, so that a shard covers a
compact box of the metadata and whole files can be pruned.  Groups of equal texts
are never split: a shard differs from the mean by less than its largest group.

Positions along the curve are running sums.  No task sorts the whole order: each
curve cell is cut into blocks of bounded row count, block sums are added up, and
rows are numbered inside their block; a group of copies is blocked the same way.

Defined results: a null text is empty (all null texts are one group), null metadata
count as empty strings, repeated rows, repeated ids and null ids are rows of their own,
ties along the curve go by a hash of the text, an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Rows that are numbered in one window frame.
BLOCK_ROWS = 5000


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Hilbert index of a point whose coordinates are integers of ``bits`` bits: first coordinate most significant."""
    n = len(dims)

    def step(x, k):
        # Undo one level of rotation for one axis.
        q, i = k["q"], k["i"]
        xi, x0 = F.element_at(x, i + 1), F.element_at(x, 1)
        swap = x0.bitwiseXOR(xi).bitwiseAND(q - 1)
        hit = xi.bitwiseAND(q) != 0
        return F.transform(
            x,
            lambda v, j: F.when(hit, F.when(j == 0, v.bitwiseXOR(q - 1)).otherwise(v)).otherwise(
                # For the first axis both exchanges cancel out.
                F.when((i != 0) & ((j == 0) | (j == i)), v.bitwiseXOR(swap)).otherwise(v)
            ),
        )

    start = F.array(*(d.cast("int") for d in dims))
    # All levels but the lowest; its masks are zero.
    levels = F.array(*(F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)))
    turned = F.aggregate(levels, start, step)
    # Gray-encode across the axes, then spread the last axis' parity.
    gray = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), turned, lambda x, i: F.transform(x, lambda v, j: F.when(j == i, v.bitwiseXOR(F.element_at(x, i.cast("int")))).otherwise(v)))
    level = lambda b: F.lit(1 << b)
    last = lambda x: F.element_at(x, n)
    spread = F.aggregate(
        F.array(*(level(b) for b in range(bits - 1, 0, -1))),
        F.named_struct(F.lit("x"), gray, F.lit("t"), F.lit(0)),
        lambda s, q: F.named_struct(F.lit("x"), s["x"], F.lit("t"), F.when(last(s["x"]).bitwiseAND(q) != 0, s["t"].bitwiseXOR(q - 1)).otherwise(s["t"])),
        lambda s: F.transform(s["x"], lambda v: v.bitwiseXOR(s["t"])),
    )
    # Interleave the bits, highest level first.
    places = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(i + 1).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)))
    return F.aggregate(
        places,
        F.named_struct(F.lit("x"), spread, F.lit("h"), F.lit(0).cast("long")),
        lambda s, p: F.named_struct(F.lit("x"), s["x"], F.lit("h"), s["h"] * 2 + F.call_function("shiftright", F.element_at(s["x"], p["i"]), p["b"]).bitwiseAND(F.lit(1))),
        lambda s: s["h"],
    )


def value_codes(groups: DataFrame, column: str, bits: int) -> DataFrame:
    """(column, column_code): each distinct string with the share of groups whose strings lie below it, as ``bits`` bits.

    Whole strings are ordered.  They are numbered in ranges, whose sums are added up.
    """
    values = groups.groupBy(column).agg(F.count("*").alias("n")).repartitionByRange(column).withColumn("range", F.spark_partition_id())
    values = materialise(values, f"{column}-values")
    sums = values.groupBy("range").agg(F.sum("n").alias("b"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("range", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.sum("b").over(W.partitionBy()).alias("total"))
    inside = W.partitionBy("range").orderBy(column).rowsBetween(W.unboundedPreceding, -1)
    below = F.col("b0") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return values.join(F.broadcast(starts), "range").select(column, F.floor(below * 2**bits / F.col("total")).cast("int").alias(f"{column}_code"))


def code_of(value: Column, cuts: Column) -> Column:
    """How many of the cuts lie below a value."""
    return F.size(F.filter(cuts, lambda c: c < value))


def hilbert_shards(docs: DataFrame, shards: int = 16, bits: int = 4) -> DataFrame:
    """Puts each row of docs (doc_id, text, lang, source) into one of ``shards`` runs of the curve with near-equal bytes.

    Returns doc_id, size (text bytes + 1), text_crc32, law ('bytes'), shard, slot (position in the shard), grown_shard (null)
    and curve (the Hilbert index that ordered it).
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id",
        (F.length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.monotonically_increasing_id().alias("place"),
    )
    # Texts are read once; from here on only their figures.
    rows = materialise(rows, "shard-rows")
    group = ["text_key", "text_crc32", "size"]
    groups = rows.groupBy(*group).agg(F.min("source").alias("source"), F.min("lang").alias("lang"), F.count("*").alias("rows"))
    # Quantile cuts of the size: a fixed number of values, whatever the input.  Strings are ranked themselves.
    cuts = [i / 2**bits for i in range(1, 2**bits)]
    found = groups.agg(F.percentile_approx("size", cuts, 10000).alias("size_cuts"))
    coded = groups.join(value_codes(groups, "source", bits), "source").join(value_codes(groups, "lang", bits), "lang")
    coded = coded.crossJoin(F.broadcast(found)).withColumn("size_code", F.greatest(code_of(F.col("size"), F.col("size_cuts")), F.lit(0)))
    codes = [F.col(f"{a}_code") for a in ("source", "lang", "size")]
    placed = materialise(coded.select(*group, "rows", hilbert_index(codes, bits).alias("curve")), "curve")
    # Blocks of bounded row count along the order (curve, text_key).
    cells = placed.groupBy("curve").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("pieces"))
    step = F.floor((F.col("text_key") / float(2**64) + 0.5) * F.col("pieces")).cast("long")  # not falling in text_key
    blocked = placed.join(F.broadcast(cells), "curve").withColumn("block", F.least(step, F.col("pieces") - 1))
    sums = blocked.groupBy("curve", "block").agg(F.sum(F.col("size") * F.col("rows")).alias("b"), F.sum("rows").alias("r"))
    # Running sums of the cells (a fixed number), and of the blocks inside each cell.
    cell_order, block_order = (w.rowsBetween(W.unboundedPreceding, -1) for w in (W.orderBy("curve"), W.partitionBy("curve").orderBy("block")))
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    cell_sums = sums.groupBy("curve").agg(F.sum("b").alias("cb"), F.sum("r").alias("cr"))
    cell_starts = cell_sums.select("curve", so_far("cb", cell_order).alias("cb0"), so_far("cr", cell_order).alias("cr0"), F.sum("cb").over(W.partitionBy()).alias("total"))
    starts = sums.select("curve", "block", so_far("b", block_order).alias("b0"), so_far("r", block_order).alias("r0")).join(F.broadcast(cell_starts), "curve")
    starts = starts.select("curve", "block", (F.col("cb0") + F.col("b0")).alias("b0"), (F.col("cr0") + F.col("r0")).alias("r0"), "total")
    inside = W.partitionBy("curve", "block").orderBy("text_key", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    grouped = blocked.join(starts, ["curve", "block"]).select(
        *group,
        "curve",
        "rows",
        (F.col("b0") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(inside), F.lit(0))).alias("bytes_before"),
        (F.col("r0") + F.coalesce(F.sum("rows").over(inside), F.lit(0))).alias("rows_before"),
        "total",
    )
    middle = F.col("bytes_before") + F.col("size") * F.col("rows") / 2
    cut = grouped.withColumn("shard", F.least(F.floor(middle * shards / F.col("total")), F.lit(shards - 1)).cast("int"))
    firsts = cut.groupBy("shard").agg(F.min("rows_before").alias("shard_start"))
    cut = cut.join(F.broadcast(firsts), "shard").select(*group, "curve", "shard", (F.col("rows_before") - F.col("shard_start")).alias("slot0"), F.ceil(F.col("rows") / BLOCK_ROWS).alias("copies"))
    # Rows of a group are numbered in blocks too: a group may hold a third of all rows, all of them with one id or none.
    joined = rows.select("doc_id", "place", *group).join(cut, group).withColumn("copy_block", F.pmod(F.xxhash64("doc_id", "place"), F.col("copies")))
    many = joined.where("copies > 1").groupBy(*group, "copy_block").agg(F.count("*").alias("n"))
    run = W.partitionBy(*group).orderBy("copy_block").rowsBetween(W.unboundedPreceding, -1)
    many = many.select(*group, "copy_block", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("block_start"))
    number = F.row_number().over(W.partitionBy(*group, "copy_block").orderBy("doc_id", "place")) - 1
    return joined.join(many, [*group, "copy_block"], "left").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("slot0") + F.coalesce("block_start", F.lit(0)) + number).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
