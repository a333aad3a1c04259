"""Shards of near equal size: a minimax contiguous partition, in DataFrame and SQL functions only.

Rows with equal texts form a group (by the 64-bit hash of the text; texts whose
hashes clash just stay together) and a group stays whole.  The atoms that are
dealt out, in order:

1. groups larger than a ``grain``-th of a mean shard, the largest first;
2. all other groups, put together by the leading bits of their hash.

Both are at most ``shards * grain`` many (the buckets up to the next power of
two), however large the table is.  The smallest feasible capacity of a shard is
found by binary search, each candidate checked greedily.  Cutting greedily there
would leave the last shards empty behind one huge atom, so each cut is the one
nearest above an equal share of the rest that the capacity allows, for this
shard and for those after it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.runtime import checkpointed, written_table

GRAIN = 1024
ROW_BYTES = 8
#: Rows that are numbered by one task.
SLICE_ROWS = 20_000


def sized_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32 and the group's hash; a null text has no bytes and is a group with the empty ones."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key), (F.octet_length(whole) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole).alias("__group"))


def atoms(rows: DataFrame, shards: int, grain: int) -> DataFrame:
    """(heavy, key, bytes) of every atom; key is a group's hash, or a bucket of hashes."""
    groups = checkpointed(rows.groupBy(F.col("__group").alias("key")).agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy = F.col("bytes") * (shards * grain) > total
    bucket = F.shiftright("key", 64 - _bucket_bits(shards, grain))
    return groups.select(heavy.alias("heavy"), F.when(heavy, F.col("key")).otherwise(bucket).alias("key"), "bytes") \
        .groupBy("heavy", "key").agg(F.sum("bytes").alias("bytes"))


def _bucket_bits(shards: int, grain: int) -> int:
    return math.ceil(math.log2(shards * grain))


#: The last prefix sum not above x, and the first not below x (places in the sorted array ``ends``), by bisection.
_AT_MOST = """aggregate(sequence(1, 40), named_struct('low', 1, 'high', size(ends)), (r, i) -> if(r.low >= r.high, r,
    if(element_at(ends, cast((r.low + r.high + 1) div 2 as int)) <= {x},
       named_struct('low', cast((r.low + r.high + 1) div 2 as int), 'high', r.high),
       named_struct('low', r.low, 'high', cast((r.low + r.high + 1) div 2 - 1 as int)))), r -> element_at(ends, r.low))"""
_AT_LEAST = """aggregate(sequence(1, 40), named_struct('low', 1, 'high', size(ends)), (r, i) -> if(r.low >= r.high, r,
    if(element_at(ends, cast((r.low + r.high) div 2 as int)) >= {x},
       named_struct('low', r.low, 'high', cast((r.low + r.high) div 2 as int)),
       named_struct('low', cast((r.low + r.high) div 2 + 1 as int), 'high', r.high))), r -> element_at(ends, r.low))"""


def shard_ends(ordered: DataFrame, shards: int) -> list[int]:
    """Prefix sums at which the shards end; ``ordered`` has (ends: sorted prefix sums from 0, widest: largest atom)."""
    total = "element_at(ends, -1)"
    reach = f"aggregate(sequence(1, {shards}), 0L, (a, k) -> {_AT_MOST.format(x='a + middle.c')})"
    # Feasible bounds: no shard can be below the mean or the largest atom, and the mean plus the largest atom always will do.
    smallest = f"""
        aggregate(sequence(1, 64),
            named_struct('low', greatest(({total} + {shards} - 1) div {shards}, widest), 'high', ({total} + {shards} - 1) div {shards} + widest),
            (s, i) -> if(s.low >= s.high, s,
                element_at(transform(array(named_struct('c', (s.low + s.high) div 2)), middle ->
                    if({reach} >= {total}, named_struct('low', s.low, 'high', middle.c), named_struct('low', middle.c + 1, 'high', s.high))), 1)),
            s -> s.low)"""
    with_capacity = ordered.selectExpr("ends", f"{smallest} AS capacity")
    # From the back: where each shard has to end at the least, so that those after it can hold the rest.
    least = f"""aggregate(sequence(1, {shards - 1}), array({total}), (a, k) ->
        concat(array({_AT_LEAST.format(x='element_at(a, 1) - capacity')}), a))""" if shards > 1 else f"array({total})"
    with_least = with_capacity.selectExpr("ends", "capacity", f"{least} AS least")
    equal = f"element_at(a, -1) + ({total} - element_at(a, -1) + {shards} - k) div ({shards} + 1 - k)"
    cuts = f"""slice(aggregate(sequence(1, {shards}), array(0L), (a, k) -> concat(a, array(greatest(element_at(least, k),
        least({_AT_MOST.format(x='element_at(a, -1) + capacity')}, {_AT_LEAST.format(x=equal)}))))), 2, {shards})"""
    row = with_least.selectExpr(f"{cuts} AS cuts").first()
    return list(row["cuts"]) if row else []


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", grain: int = GRAIN,
                  slice_rows: int = SLICE_ROWS) -> DataFrame:
    """key, size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0 in each shard) of every row.

    Rows are numbered by slices of a hash of their key; repeated rows get
    different slots.  A null key is a row like any other.  An empty table gives none.
    """
    rows = written_table(sized_rows(docs, key, text), "sized")
    dealt = checkpointed(atoms(rows, shards, grain))
    # At most 3 * shards * grain rows: two short columns on one task.
    line = Window.orderBy(F.desc("heavy"), F.when(F.col("heavy"), -F.col("bytes")), "key").rowsBetween(Window.unboundedPreceding, 0)
    ends = checkpointed(dealt.withColumn("end", F.sum("bytes").over(line)))
    cuts = shard_ends(
        ends.agg(F.max("bytes").alias("widest"), F.array_sort(F.concat(F.array(F.lit(0).cast("long")), F.collect_list("end"))).alias("ends"))
        .filter("widest IS NOT NULL"), shards)
    if not cuts:
        return rows.select(key, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    places = F.array(*[F.lit(c) for c in cuts])
    shard = F.size(F.filter(places, lambda c: c < F.col("end"))).cast("int")
    placed = checkpointed(ends.select("heavy", "key", shard.alias("shard")))
    heavy = placed.filter("heavy").select(F.col("key").alias("__group"), F.col("shard").alias("__heavy"))
    light = placed.filter("NOT heavy").select(F.col("key").alias("__bucket"), F.col("shard").alias("__light"))
    found = (rows.join(F.broadcast(heavy), "__group", "left")  # both have a bounded number of rows, see above
             .withColumn("__bucket", F.shiftright("__group", 64 - _bucket_bits(shards, grain)))
             .join(F.broadcast(light), "__bucket", "left")
             .select(key, "size", "text_crc32", "__group", F.coalesce("__heavy", "__light").alias("shard")))
    return _numbered(found, key, shards, slice_rows)


def _numbered(rows: DataFrame, key: str, shards: int, slice_rows: int) -> DataFrame:
    """Slots from two counts: rows of the slices before, and the place within the slice."""
    slices = max(1, -(-rows.count() // (shards * slice_rows)), 8)
    sliced = rows.withColumn("__slice", F.pmod(F.xxhash64(key, "__group", "size"), F.lit(slices)))
    before = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy("shard", "__slice").count()
    first = sizes.select("shard", "__slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy("shard", "__slice").orderBy(key, "__group")) - 1
    return (sliced.withColumn("__place", within).join(first, ["shard", "__slice"])
            .select(key, "size", "text_crc32", "shard", (F.col("__first") + F.col("__place")).cast("long").alias("slot")))
