import os

from pyspark.sql import functions as F

from storelens.plans.parallel import spread


def test_spread_only_for_few_files(spark, scratch):
    cores = spark.sparkContext.defaultParallelism
    few, many = os.path.join(scratch, "few"), os.path.join(scratch, "many")
    spark.range(100).coalesce(1).write.parquet(few)
    spark.range(100).repartition(cores + 1).write.parquet(many)
    one, lots = spark.read.parquet(few), spark.read.parquet(many)
    assert "RepartitionByExpression" in spread(one, "id")._jdf.queryExecution().analyzed().toString()
    assert spread(lots, "id") is lots
    assert spread(one, "id").agg(F.sum("id")).first()[0] == 4950
