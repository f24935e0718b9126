"""A reproducible shuffle of a table into shards: a Feistel permutation over global row numbers.

Rows are numbered in order of doc_id and text, whatever files or partitions
they lie in: one range shuffle of the columns asked for, then counts per range.
The permutation is a balanced Feistel network on the least square that holds
all numbers; a number that lands outside of the table walks on along its cycle.
Its round function is md5, so any engine can compute where a row lies
(``place``) and which row lies somewhere (``row_at``) from the number alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesmith.plans.storage import cut

ROUNDS = 4


def noise(seed: int, k: Column, half: Column) -> Column:
    """60 bits that depend on seed, round and half a number."""
    text = F.concat_ws(":", F.lit(str(seed)), k.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def once(x: Column, side: int, seed: int, back: bool = False) -> Column:
    """The network (or its inverse) on 0 .. side * side - 1."""
    pair = lambda a, b: F.struct(a.cast("long").alias("l"), b.cast("long").alias("r"))
    on = lambda s, k: pair(s["r"], F.pmod(s["l"] + F.pmod(noise(seed, k, s["r"]), F.lit(side)), F.lit(side)))
    off = lambda s, k: pair(F.pmod(s["r"] - F.pmod(noise(seed, k, s["l"]), F.lit(side)), F.lit(side)), s["l"])
    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    return F.aggregate(F.array(*map(F.lit, rounds)), pair(F.call_function("div", x, F.lit(side)), F.pmod(x, F.lit(side))), off if back else on, lambda s: s["l"] * F.lit(side) + s["r"])


def permuted(x: Column, rows: int, seed: int, back: bool = False) -> Column:
    """A permutation of 0 .. rows - 1.

    Fewer than 2 sqrt(rows) numbers of the square are outside of the table, so
    hardly any number walks, and none more steps than there are such numbers.
    """
    side = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    first = once(x.cast("long"), side, seed, back)
    loops = math.isqrt(side * side - rows) + 1
    step = lambda s, _: F.when(s < rows, s).otherwise(once(s, side, seed, back))
    turn = lambda s, _: F.when(s < rows, s).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(loops)), s, step))
    return F.aggregate(F.sequence(F.lit(1), F.lit(loops)), first, turn)


def place(row: Column, rows: int, shards: int, seed: int = 1) -> Column:
    """Struct (shard, slot) of a row number."""
    x = permuted(row, rows, seed)
    return F.transform(F.array(x), lambda y: F.struct(F.pmod(y, F.lit(shards)).cast("int").alias("shard"), F.call_function("div", y, F.lit(shards)).alias("slot")))[0]


def row_at(shard: Column, slot: Column, rows: int, shards: int, seed: int = 1) -> Column:
    """The number of the row that lies in a slot of a shard; null where the shard has no such slot."""
    x = slot.cast("long") * shards + shard
    return F.when((shard >= 0) & (shard < shards) & (slot >= 0) & (x < rows), permuted(x, rows, seed, back=True))


def numbered(docs: DataFrame, order: list[str]) -> DataFrame:
    """docs with ``row``, from 0, in the given order; rows that tie are numbered as they come.

    Ranges are even however many rows tie, since the place a row comes from is
    the last key of the order. What is broadcast has a row per range.
    """
    tied = docs.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*order, "_tie"]
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(tied.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(part.alias("_range")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return dealt.withColumn("_range", part).join(F.broadcast(bases), "_range").withColumn("row", F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_range", "_base", "_at")


def sharded(docs: DataFrame, shards: int = 16, seed: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row, and the columns of ``carry``.

    size is the text's UTF-8 bytes (null: none) plus 1, text_crc32 the unsigned
    checksum of these bytes. Law ``rows``: counts of shards differ by one at
    most, and slots run from 0; grown_shard is null, as with another count of
    shards most rows move. Rows without doc_id come first, texts of one doc_id
    in order of their hash; rows equal in both lie in neighbouring numbers, so
    which of them gets which is open. Columns of docs that aren't carried are
    ignored, whatever their names. An empty table gives no rows.
    """
    rest = F.struct(*(F.col(c) for c in carry)) if carry else F.lit(None).cast("string")
    own = docs.select(
        "doc_id", F.xxhash64("text").alias("mark"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), rest.alias("rest"),
    )
    rows = numbered(own, ["doc_id", "mark"])
    total = rows.count()
    put = rows.withColumn("at", place(F.col("row"), total, shards, seed))
    return put.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "at.shard", "at.slot", F.lit(None).cast("int").alias("grown_shard"), "row",
        *(F.col("rest").getField(c).alias(c) for c in carry),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 1) -> None:
    """Writes all columns of docs under path/shard=N, in order of ``slot``, which is a column too.

    Columns of docs named shard or slot are left out. A shard's rows are dealt to
    several tasks by ranges of slots, so no task needs to hold a shard.
    """
    kept = tuple(c for c in docs.columns if c not in ("shard", "slot", "doc_id"))
    found = sharded(docs.withColumnsRenamed({c: f"_{c}" for c in kept}).withColumn("text", F.col("_text")), shards, seed, tuple(f"_{c}" for c in kept))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = found.select("doc_id", *(F.col(f"_{c}").alias(c) for c in kept), "shard", "slot")
    out.repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
