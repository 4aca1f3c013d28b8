from pyspark.sql import functions as F

from lexspark.operators import sequence
from lexspark.streaming import arrivals


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streams_agree_with_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i % 3}", i // 3, None if i < 3 else (i * 37 % 100) / 100) for i in range(60)], "participant_id string, pos int, sim double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run(arrivals.running_switches(stream, 0.5), "switches", "update")
    got = {r.participant_id: r.n_clusters for r in spark.table("switches").collect()}
    want = {r.participant_id: r.cluster_count for r in sequence.cluster_metrics(sequence.detect_clusters(rows, ["participant_id"], 0.5), ["participant_id"]).collect()}
    assert got == want


def test_windows_and_deliveries(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("rating_id"), F.lit("r").alias("rater_id"), (F.col("id") % 5).cast("int").alias("rating"), F.expr("timestamp'2024-01-01' + make_interval(0,0,0,cast(id as int))").alias("rated_at"))
    rows.union(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run(arrivals.first_deliveries(stream, "rating_id", "rated_at"), "firsts")
    assert spark.table("firsts").count() == 40
    run(arrivals.windowed_ratings(stream), "windows")
    assert spark.table("windows").agg(F.max("n")).first()[0] == 2
