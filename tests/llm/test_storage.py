"""Scratch tables, and what they leave on the disks."""

import time

from pyspark.sql import functions as F

from pixelloom.llm import storage


def test_shuffle_files_of_a_written_table_are_removed_at_once(spark):
    context, tracker = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    low = context.newShuffleId()
    table = storage.stored(spark.range(1000).repartition(3, "id").groupBy(F.col("id") % 7).count(), "test-release")
    high = context.newShuffleId()
    assert high - low > 1  # there was a shuffle
    for _ in range(50):
        if not (left := [i for i in range(low + 1, high) if tracker.containsShuffle(i)]):
            break
        time.sleep(0.1)
    assert not left and table.count() == 7
