"""A store laid out by id."""

import time

import pytest
from pyspark.sql import functions as F

from namesmith.functions import canopies
from namesmith.operators import blocking
from namesmith.plans.storage import cut
from namesmith.schema import author, complete
from namesmith.sources import readers, writers


def some(spark, n=300):
    rows = spark.range(n).select(F.concat(F.lit("m"), "id").alias("mentionId"), author(F.lit("ann"), None, F.concat(F.lit("l"), (F.col("id") % 7).cast("string"))).alias("self"), F.col("id").cast("string").alias("title"))
    return complete(rows)


def test_fetch_does_not_shuffle_the_store(spark, tmp_path):
    m = some(spark)
    writers.bucketed_store(m, "store_of_test", f"file://{tmp_path}/store", 4)
    spark.catalog.dropTempView("store_of_test")
    spark.sql("DROP TABLE store_of_test")  # as in another session; the files stay
    store = readers.bucketed_store(spark, "store_of_test", f"file://{tmp_path}/store", 4)
    tasks = blocking.tasks(m, canopies.first_and_last)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = blocking.fetch(tasks, store)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        ready = found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.canopy, r.title) for r in found.collect()) == sorted((f"LAST_l{i % 7}_FIRST_ann", str(i)) for i in range(300))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SelectedBucketsCount: 4 out of 4" in ready, ready
    # Below the join, the store's side goes from the scan up without an exchange.
    side = ready[: ready.index("SelectedBucketsCount")].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :|+-"))
    scan, above = depth(side[-1]), []
    for line in reversed(side[:-1]):
        if depth(line) < scan:
            scan = depth(line)
            above.append(line)
            if "Join" in line:
                break
    assert above and "Join" in above[-1] and not any("Exchange" in line for line in above), ready
    assert plan


def test_repeated_ids_fail(spark, tmp_path):
    with pytest.raises(ValueError, match="repeated"):
        writers.bucketed_store(some(spark, 5).unionByName(some(spark, 5)), "store_of_copies", f"file://{tmp_path}/copies", 2)


def test_cut_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(key, "false"), shuffled()
    assert cut(spark.range(10_000).groupBy((F.col("id") % 99).alias("x")).count(), "counts").count() == 99
    end = time.time() + 20
    while (left := {x for x in shuffled() - before if x.endswith(".data")}) and time.time() < end:
        spark.range(1).collect()
        time.sleep(0.5)
    # What is left is of the count above, at most.
    assert len(left) <= 1 and spark.conf.get(key, "false") == was
