"""URL block lists as Bloom filter cascades, with allow and block rules.

Level 0 of a cascade encodes the listed keys. Level 1 encodes the keys of the
corpus that level 0 wrongly accepts, level 2 the listed keys that level 1
wrongly accepts, and so on until no key is wrong. A key of that corpus is
listed if and only if the number of levels that accept it in a row is odd, so
membership is exact and probing needs no join with the list.

A filter holds about ``SHARD`` keys; longer lists are split by a hash of the key
into shards, each with a cascade of its own. Filters of a measured size go to
all tasks, larger ones are dealt by shard and, as one key may have many pages,
by a salt.

A listed domain covers its subdomains: a host's keys are its last labels, as
many as any listed domain has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesmith.plans.storage import cut

#: Keys in one filter, bits for each, hash functions, bytes of all filters that may be broadcast, and copies of filters that are dealt.
SHARD, BITS, HASHES, BROADCAST, SALTS = 1 << 15, 10, 6, 64 << 20, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards))


def positions(key: Column, level: Column, size: Column) -> Column:
    """Bit positions of a key in a filter of ``size`` bits; double hashing."""
    one, two = F.xxhash64(key, level), F.xxhash64(level, key)
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: F.pmod(F.shiftright(one, 8) + i * F.shiftright(two, 8), size))


def bit_filter(keys: DataFrame, level: int) -> DataFrame:
    """One row per shard: bits as an array of longs."""
    sized = keys.groupBy("shard").agg(F.ceil(F.count("*") * BITS / 64).cast("long").alias("words"))
    bits = keys.join(sized, "shard").select("shard", "words", F.explode(positions(F.col("key"), F.lit(level), F.col("words") * 64)).alias("bit"))
    own = bits.select("shard", F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("bits"))
    blank = sized.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("words") - 1)).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = own.union(blank).groupBy("shard", "word").agg(F.expr("bit_or(bits)").alias("bits"))
    whole = words.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
    return whole.select("shard", F.lit(level).alias("level"), F.transform("w", lambda x: x["bits"]).alias("bits"))


def accepts(key: Column, level: Column, bits: Column) -> Column:
    size = F.size(bits).cast("long") * 64
    return F.forall(positions(key, level, size), lambda p: F.getbit(F.get(bits, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1)


def cascade(listed: DataFrame, universe: DataFrame) -> tuple[DataFrame, int]:
    """Filters (shard, levels) that tell listed keys from all other keys of the universe, and the shard count.

    Both have a column ``key``; nulls are left out, repeats don't matter. An
    empty list has no filters.
    """
    listed = cut(listed.select("key").where("key is not null").distinct(), "listed")
    shards = max(1, -(-listed.count() // SHARD))
    marked = listed.withColumn("shard", shard(F.col("key"), shards))
    others = cut(universe.select("key").where("key is not null").distinct().join(listed, "key", "left_anti").withColumn("shard", shard(F.col("key"), shards)), "others")
    levels: list[DataFrame] = []
    inside, outside = marked, others
    while not inside.isEmpty():
        made = cut(bit_filter(inside, len(levels)), "filter")
        levels.append(made)
        wrong = outside.join(made, "shard").where(accepts(F.col("key"), F.lit(len(levels) - 1), F.col("bits"))).select("key", "shard")
        inside, outside = cut(wrong, "wrong"), inside
    every = levels[0] if levels else listed.sparkSession.createDataFrame([], "shard long, level int, bits array<long>")
    for more in levels[1:]:
        every = every.union(more)
    return every.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("level", "bits"))).alias("levels")), shards


def member(key: Column, levels: Column) -> Column:
    """Whether a key of the universe is listed: an odd number of levels accept it in a row."""
    depth = F.aggregate(
        F.coalesce(levels, F.array().cast("array<struct<level:int,bits:array<bigint>>>")),
        F.struct(F.lit(True).alias("on"), F.lit(0).alias("depth")),
        lambda a, x: F.when(a["on"] & accepts(key, x["level"], x["bits"]), F.struct(F.lit(True).alias("on"), (a["depth"] + 1).alias("depth"))).otherwise(F.struct(F.lit(False).alias("on"), a["depth"].alias("depth"))),
        lambda a: a["depth"],
    )
    return depth % 2 == 1


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (host/path text) that fits, and its verdict; nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda x: len(x[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


def host_keys(host: Column, depths: list[int]) -> Column:
    """The host's last labels, for each of the depths that it reaches."""
    return F.array_compact(F.array(*(F.when(F.size(F.split(host, r"\.")) >= d, F.substring_index(host, ".", -d)) for d in depths)))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict: a fitting rule's, else block if a listed domain is the host or above it, else allow.

    Listed domains (column key) may have any number of labels. Null urls and
    urls without ``://`` have empty host and path, fit no rule, and are allowed.
    Every row of pages gives one row.
    """
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    # Labels in a domain: 127 at most.
    depths = sorted(r["d"] for r in listed.where("key is not null").select(F.size(F.split("key", r"\.")).alias("d")).distinct().collect())
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    blocked = F.lit(False)
    if depths:
        filters, shards = cascade(listed, seen.select("host").distinct().select(F.explode(host_keys(F.col("host"), depths)).alias("key")))
        filters = cut(filters, "cascade")
        room = filters.select(F.expr("coalesce(sum(aggregate(levels, 0L, (a, x) -> a + 8L * size(x.bits))), 0L)").alias("n")).first()["n"]
        for d in depths:
            key = F.when(F.size(F.split("host", r"\.")) >= d, F.substring_index("host", ".", -d))
            dealt = seen.withColumn("key", key).withColumn("shard", shard(F.col("key"), shards))
            if room <= BROADCAST:
                met = dealt.join(F.broadcast(filters), "shard", "left")
            else:
                copies = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
                met = dealt.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(copies, ["shard", "salt"], "left")
            listed_here = F.when(F.col("key").isNotNull(), member(F.col("key"), F.col("levels"))).otherwise(False)
            seen = met.withColumn(f"listed{d}", listed_here).drop("key", "shard", "salt", "levels")
            blocked = blocked | F.col(f"listed{d}")
    return seen.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(blocked, "block").otherwise("allow")).alias("verdict"))
