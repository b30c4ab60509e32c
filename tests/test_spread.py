from seqjoin.operators.spread import spread


def test_only_few_splits_are_spread(spark):
    few, many = spark.range(1000).coalesce(1), spark.range(1000).repartition(9)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(r.id for r in spread(few).collect()) == list(range(1000))
    assert spread(many) is many
    grouped = spark.range(1000).groupBy("id").count()
    assert spread(grouped) is grouped
    assert spread(spark.range(0)).count() == 0
