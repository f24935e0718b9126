"""Names within an edit distance of each other, found without pairing a block.

Of two names at most d edits apart, the shorter one, cut into d + 1 segments, has
a segment that no edit touches: the longer one holds it, shifted by d at most. So
names meet on (block, length, segment number, segment). Names of d letters or
fewer have no d + 1 segments; they and names of up to 2 d letters meet on what is
left after at most d deletions. Distinct names meet, not mentions, and every
meeting is confirmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_at(length: Column, i: int, parts: int) -> Column:
    """Where segment i of ``parts`` begins in a name of a length, from 0."""
    return F.floor(length * i / parts).cast("int")


def segments(name: Column, d: int) -> Column:
    """Structs (length, i, piece) of a name of more than d letters."""
    size = F.char_length(name)
    return F.array(*(F.struct(size.alias("length"), F.lit(i).alias("i"), F.substring(name, cut_at(size, i, d + 1) + 1, cut_at(size, i + 1, d + 1) - cut_at(size, i, d + 1)).alias("piece")) for i in range(d + 1)))


def substrings(name: Column, d: int) -> Column:
    """The structs that a name not longer than this one, at most d letters shorter, may share with it."""
    size, out = F.char_length(name), []
    for less in range(d + 1):
        length = size - less
        for i in range(d + 1):
            start, end = cut_at(length, i, d + 1), cut_at(length, i + 1, d + 1)
            for shift in range(-d, d + 1):
                at = start + shift
                fits = (length > d) & (at >= 0) & (at + end - start <= size)
                out.append(F.when(fits, F.struct(length.alias("length"), F.lit(i).alias("i"), F.substring(name, at + 1, end - start).alias("piece"))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def shortened(name: Column, d: int) -> Column:
    """What is left of a name after at most d deletions."""
    every = F.array(name)
    for _ in range(d):
        one = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(x), F.lit(1))), lambda i: F.concat(F.substring(x, 1, i - 1), F.substring(x, i + 1, F.char_length(x))))
        every = F.array_distinct(F.concat(every, F.flatten(F.transform(every, one))))
    return every


def near_names(rows: DataFrame, block: str, name: str, d: int) -> DataFrame:
    """(block, a, b, distance): distinct names a < b of a block, at most d edits apart.

    Null names and blocks have no pairs. Names that repeat count once; what is
    counted are characters.
    """
    names = rows.select(F.col(block).alias("block"), F.col(name).alias("name")).where("block is not null and name is not null").distinct()
    size = F.char_length("name")
    shorter = names.where(size > d).select("block", F.col("name").alias("s"), F.explode(segments(F.col("name"), d)).alias("key"))
    longer = names.where(size > d).select("block", F.col("name").alias("t"), F.explode(substrings(F.col("name"), d)).alias("key"))
    # Sizes before keys are made mislead Spark into sending all keys of one side to every task through the driver.
    met = shorter.join(longer.hint("merge"), ["block", "key"]).select("block", "s", "t")
    if d:
        left = names.where(size <= 2 * d).select("block", F.col("name").alias("t"), F.explode(shortened(F.col("name"), d)).alias("key"))
        few = left.where(F.char_length("t") <= d).withColumnRenamed("t", "s")
        met = met.unionByName(few.join(left.hint("merge"), ["block", "key"]).select("block", "s", "t"))
    distance = F.levenshtein("a", "b", d)
    pairs = met.where("s <> t").select("block", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))
    return pairs.withColumn("distance", distance).where("distance >= 0").distinct()
