import random
import re

from pyspark.sql import functions as F

from seqjoin.llm.seen import SeenStore, answer_rates, seen_reads, sequence_key, unverified_rates

SCHEMA = "no long, seq string, key int, h int"


def key():
    return sequence_key(F.col("seq"))


def brute(history, reads):
    clean = lambda s: "".join(c if c in "ATGC" else "X" for c in s)[:100] if s else None
    seen, out = {clean(s) for s in history if s}, []
    for no, s in sorted(reads, key=lambda r: r[0]):
        if s:
            if clean(s) in seen:
                out.append(no)
            seen.add(clean(s))
    return sorted(out)


def keys_of(spark, run):
    return spark.createDataFrame([(s,) for s in run], "seq string").select(key())


def store_of(spark, *runs, **options):
    store = SeenStore(spark, **options)
    for run in runs:
        store.add(keys_of(spark, run))
    return store


def test_against_brute_force(spark):
    r = random.Random(2)
    pool = ["".join(r.choice("ATGCNé.") for _ in range(r.choice([0, 3, 99, 100, 101, 150]))) for _ in range(80)] + [None, "", "A" * 50_000]
    history = [r.choice(pool) for _ in range(60)]
    reads = [(i, r.choice(pool + ["HOT"] * 40), 1, 2) for i in r.sample(range(10_000), 600)]
    store = store_of(spark, history[::2], history[1::2], buckets=3, fanout=2)
    df = spark.createDataFrame(reads, SCHEMA).repartition(4)
    got = [x["no"] for x in seen_reads(df, "no", key(), store, batches=2).collect()]
    assert sorted(got) == brute(history, [(a, b) for a, b, *_ in reads])
    assert sorted(r.level for r in store.runs) == [2]
    rates = answer_rates(df, "no", key(), keys_of(spark, history), store).head()
    assert (rates.n_answers, rates.n_seen, rates.n_wrong) == (sum(bool(x[1]) for x in reads), len(got), 0)
    wrong = answer_rates(df, "no", key(), keys_of(spark, history[:-20]), store).head()
    assert wrong.n_wrong > 0 and wrong.wrong_rate == wrong.n_wrong / wrong.n_answers
    assert unverified_rates(df, key(), store, 64).head().n_wrong == 0
    assert 0 < unverified_rates(df, key(), store, 3).head().n_wrong <= rates.n_answers - rates.n_seen


def files(store):
    spark = store.spark
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store.path)
    return {re.sub("-.*", "", f.getPath().getName()) + ":" + f.getPath().getName() for f in store._fs.listStatus(path)}


def test_levels_manifest_and_deleted_runs(spark):
    store = store_of(spark, ["A"], ["T"], ["G", "T"], ["C"], ["AA"], buckets=4, fanout=2)
    assert [(r.level, r.rows) for r in store.runs] == [(2, 4), (0, 1)]
    assert sorted(r["key"] for r in store.keys().collect()) == ["A", "AA", "C", "G", "T"]
    assert sorted(f.split(":")[0] for f in files(store)) == ["manifest", "run", "run"]
    other = SeenStore(spark.newSession(), store.path, buckets=9, fanout=2)
    assert (other.runs, other.buckets) == (store.runs, 4)
    other.add(keys_of(other.spark, ["A", "GG"]))
    again = SeenStore(spark, store.path)
    assert sorted(r["key"] for r in again.keys().collect()) == ["A", "AA", "C", "G", "GG", "T"]
    again.drop()
    assert not again._fs.exists(again._path(again.path))


def scans(df):
    """(plan, rows each scan of a run gave) after the rows were made."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(node.plan())
        for i in range(node.children().length()):
            walk(node.children().apply(i))

    walk(plan)
    return plan.toString(), found


def test_runs_are_not_sorted_again_and_blocks_are_skipped(spark):
    from seqjoin.llm.seen import _bucketwise

    store = SeenStore(spark, buckets=2, block_rows=100)
    for k in range(2):
        store.add(spark.range(k * 5000, k * 5000 + 5000).select(F.col("id").cast("string")))
    few = spark.createDataFrame([("7",), ("x",)], "key string").select(F.xxhash64("key").alias("h"), "key").groupBy("h", "key").agg(F.lit(1).alias("no"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with _bucketwise(spark, 2):
            left = store.unseen(few)
            plan, rows = scans(left)
            assert [r["key"] for r in left.collect()] == ["x"]
            all_keys = spark.range(20_000).select(F.xxhash64(F.col("id").cast("string")).alias("h"), F.col("id").cast("string").alias("key"))
            many = store.unseen(all_keys.distinct())
            assert scans(many)[1] == [5000, 5000] and many.count() == 10_000
        assert all(0 < n <= 400 for n in rows) and len(rows) == 2
        joins = plan[plan.index("Final Plan") : plan.index("Initial Plan")] if "Initial Plan" in plan else plan
        assert joins.count("SortMergeJoin") == 2 and joins.count("Sort [") == 1 and "Bucketed: false" not in joins
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    store.drop()


def test_empty_store_and_table(spark):
    store = store_of(spark, [])
    df = spark.createDataFrame([(1, "A", 0, 0), (2, "A", 0, 0), (3, None, 0, 0)], SCHEMA)
    assert [x["no"] for x in seen_reads(df, "no", key(), store).collect()] == [2]
    none, empty = spark.createDataFrame([], SCHEMA), SeenStore(spark)
    assert seen_reads(none, "no", key(), empty).count() == 0
    assert answer_rates(none, "no", key(), none.select("seq"), empty).head().wrong_rate == unverified_rates(none, key(), empty).head().wrong_rate == 0.0
