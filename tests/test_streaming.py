from seqjoin.config import Config
from seqjoin.operators.targets import prepare_targets
from seqjoin.plans import synthetic
from seqjoin.plans.pipeline import match
from seqjoin.streaming.reads import match_stream


def test_batches_add_up_to_the_whole_run(spark, tmp_path):
    cfg = Config(Windows=(0, 20), WindowWidth=15, MaxReadLength=100)
    reads = synthetic.generate_reads(spark, 30)
    targets = prepare_targets(synthetic.generate_targets(spark, 40, 200))
    for i in range(3):
        reads.where(f"pmod(hash(name), 3) = {i}").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = match_stream(
        stream, targets, cfg, lambda found, n: found.results.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}")), str(tmp_path / "checkpoint")
    )
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = match(reads, targets, cfg).results
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count() == 3
