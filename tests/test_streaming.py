"""The live curriculum against the replay."""

from pyspark.sql import functions as F

from maieutic.operators import curriculum
from maieutic.streaming import live_averages, scored_batches


def test_live_averages_equal_the_replay(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log = [(i, "aab"[i % 3] if i < 30 else "c", (i % 10) / 10) for i in range(1, 41)]
    df = spark.createDataFrame([("r", *x) for x in log], "run string, seq long, topic string, reward double")
    df.where("seq <= 20").coalesce(1).write.json(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
        q = live_averages(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        if _ == 0:
            df.where("seq > 20").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    want = curriculum.replay(df, "seq", "topic", "reward").orderBy("seq").collect()
    assert [r.seq for r in got] == [r.seq for r in want]
    assert all(abs(a.ema - b.ema) < 1e-12 and abs(a.weight - b.weight) < 1e-12 for a, b in zip(got, want))


def test_scored_batches(spark, tmp_path):
    df = spark.createDataFrame([(i, i // 4, [10.0, 10.0, 10.0, 9.65][i % 4]) for i in range(8)], "episode_id long, batch_id long, score double")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    out = []
    q = spark.readStream.schema(df.schema).json(str(tmp_path / "in")).writeStream.foreachBatch(scored_batches(lambda d, n: out.extend(d.where(F.col("mined")).collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.episode_id for r in out) == [3, 7]
    assert all(abs(r.reward - 0.9130384757729338) < 1e-12 for r in out)
