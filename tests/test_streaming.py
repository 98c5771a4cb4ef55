import pytest
from lodestone.operators import operations
from lodestone.streaming import alarms
from pyspark.sql import functions as F

EVENTS = "/root/testdata/sf0.001/events.parquet"


def run(spark, made, name):
    query = made.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    """The events, and one of a later day that moves the watermark past all others."""
    d = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.limit(1).withColumns({"ts": F.expr("timestamp '2030-01-01'"), "event_type": F.lit("error"), "user_id": F.lit(-1).cast("long")})
    events.unionByName(last).coalesce(1).write.mode("overwrite").parquet(d)
    return lambda: spark.readStream.schema(events.schema).parquet(d)


def test_rates_equal_batch(spark, stream):
    failed = F.col("event_type") == "error"
    got = run(spark, alarms.rates(stream(), failed, "6 hours", least=2), "rates").collect()
    want = operations.rates(spark.read.parquet(EVENTS), failed, "6 hours", 2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_percentiles_equal_batch(spark, stream):
    got = run(spark, alarms.percentiles(stream(), "value", "6 hours", least=2), "p95").collect()
    values = {}
    for r in spark.read.parquet(EVENTS).select(F.window(F.col("ts").cast("timestamp"), "6 hours").start.alias("w"), "value").collect():
        values.setdefault(r.w, []).append(r.value)
    want = [(w, len(v), sorted(v)[-(-95 * len(v) // 100) - 1]) for w, v in values.items() if len(v) >= 2]
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_once(spark, stream):
    """Each key once, and a key seen a day before again only after that."""
    got = [r.user_id for r in run(spark, alarms.once(stream(), "user_id"), "once").collect()]
    want = {r.user_id for r in spark.read.parquet(EVENTS).select("user_id").distinct().collect()} | {-1}
    assert sorted(got) == sorted(want)


def test_cooldown_equals_batch(spark, stream):
    errors = stream().filter("event_type = 'error'")
    got = run(spark, alarms.cooled_down(errors, "user_id", 6 * 3600), "cooled").filter("user_id >= 0").collect()
    batch = spark.read.parquet(EVENTS).filter("event_type = 'error'").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    want = operations.cooled_down(batch, "user_id", "ts", 6 * 3600).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_edges_equal_batch(spark, stream):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        states = stream().select("event_type", "ts", (F.col("value") > 60).alias("active"))
        got = run(spark, alarms.edges(states, "event_type"), "edges").filter("ts < timestamp '2029-01-01'").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batch = spark.read.parquet(EVENTS).select("event_type", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 60).alias("active"))
    want = operations.edges(batch.dropDuplicates(["event_type", "ts"]), "event_type", "ts", "active").select("event_type", "ts", "change").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 50


def test_a_repeated_batch_adds_nothing(spark, stream, tmp_path):
    from lodestone.sources import tables

    path, events = str(tmp_path / "log"), spark.read.parquet(EVENTS)
    for n in (0, 1, 0, 1, 1):
        tables.add_batch(events.filter(F.col("event_id") % 2 == n), n, path)
    assert spark.read.text(path).count() == events.count()
    for _ in range(2):  # the second run goes on at the checkpoint
        query = tables.event_sink(stream(), str(tmp_path / "sink"), str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
    rows = tables.json_lines(spark, str(tmp_path / "sink"), stream().schema)
    assert rows.filter("problem is not null").count() == 0 and rows.select("event_id").distinct().count() == events.count()
    assert rows.count() == events.count() + 1


def test_line_numbers_of_a_split_file(spark, tmp_path):
    from lodestone.sources import tables

    lines = [f'{{"a": {i}}}' if i % 7 else ("" if i % 2 else "{no") for i in range(1, 3001)]
    (tmp_path / "one.jsonl").write_text("\r\n".join(lines))
    (tmp_path / "two.jsonl").write_text('\n{"a": 1}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        known = tables.numbered_lines(spark, str(tmp_path))
        assert known.rdd.getNumPartitions() > 1
        rows = tables.json_lines(spark, str(tmp_path), spark.createDataFrame([], "a int").schema).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {(r.file[-9:], r.line): (r.a, r.problem) for r in rows}
    want = {("one.jsonl", i): (i, None) if i % 7 else (None, "{no") for i in range(1, 3001) if i % 7 or i % 2 == 0}
    assert got == want | {("two.jsonl", 2): (1, None)}


def test_danish_lists(spark):
    from lodestone.operators.ordered import danish, sorted_list

    words = ["2", "10", "ab", "Abe", "abe", "zebra", "Æble", "æble", "øl", "Ørn", "ørn", "aa", "Ål", "ål", "Aarhus"]
    want = sorted(words, key=lambda x: ["10", "2", "ab", "Abe", "abe", "zebra", "Æble", "æble", "øl", "Ørn", "ørn", "aa", "Ål", "ål", "Aarhus"].index(x))
    df = spark.createDataFrame([(i, w, float(i % 3) if i % 5 else None) for i, w in enumerate([*words, None, None])], "id int, word string, n double").repartition(4)
    up = [r.word for r in sorted_list(df, [("word", False)], "id").orderBy("position").collect()]
    down = [r.word for r in sorted_list(df, [("word", True)], "id").orderBy("position").collect()]
    assert up == [*want, None, None] and down == [*want[::-1], None, None]
    both = [(r.n, r.word) for r in sorted_list(df, [("n", True), ("word", False)], "id").orderBy("position").collect()]
    assert both == sorted(both, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is None, want.index(x[1]) if x[1] else 0))
    pairs = df.alias("a").join(df.alias("b"), danish("a.word") == danish("b.word"))
    assert pairs.count() == len(words)
