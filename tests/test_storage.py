import os

import pytest

from bitloom.plans import storage


def test_tables_live_in_the_folder_of_the_session(spark):
    table = storage.materialize(spark.range(10).toDF("x"), "some")
    root = spark.conf.get("spark.checkpoint.dir")
    assert sorted(r.x for r in table.collect()) == list(range(10))
    assert table.inputFiles() and all(root in f for f in table.inputFiles())
    assert storage.fits(table, 10) and not storage.fits(table, 9)


def test_without_a_folder_the_warehouse_is_used():
    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return {"spark.sql.warehouse.dir": "hdfs:///warehouse/"}.get(name, default)

    assert storage.shared_dir(Session()) == "hdfs:///warehouse/intermediate"


def test_a_folder_of_one_machine_is_no_shared_folder():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return {"spark.sql.warehouse.dir": "file:/home/me/spark-warehouse"}.get(name, default)

    with pytest.raises(ValueError, match="all executors share"):
        storage.shared_dir(Session())


def test_drop_intermediate(spark):
    path = storage.new_path(spark, "gone")
    storage.materialize(spark.range(3).toDF("x"), "gone")
    spark.range(3).write.option("path", storage.new_path(spark, "named")).saveAsTable("some_named_table")
    storage.remember_table(spark, "some_named_table")
    folder = os.path.dirname(path)
    assert os.path.isdir(folder)
    storage.drop_intermediate(spark)
    assert not os.path.exists(folder) and not spark.catalog.tableExists("some_named_table")


def test_a_table_that_one_task_reads_is_spread(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.range(6000, numPartitions=1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    dealt = storage.spread(one, "spread")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sorted(r.id for r in dealt.collect()) == [*range(6000)] and max(sizes) <= 3000
    few, even = spark.range(100, numPartitions=1), spark.range(6000, numPartitions=4)
    assert storage.spread(few, "spread") is few and storage.spread(even, "spread") is even
