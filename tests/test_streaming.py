import random

from millrace.operators import alarms
from millrace.streaming.alarms import live_alarms


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"run{i % 3}", i * 0.4, r.random()) for i in range(240)]
    schema = "run_name string, detection_time double, score double"
    for k in range(4):  # each file is a micro-batch, in the order of time
        spark.createDataFrame(rows[60 * k : 60 * (k + 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = live_alarms(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), 0.5, 2, 3, 1.5)
    query = stream.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = sorted((x["run_name"], x["detection_time"]) for x in spark.table("live").collect())
    batch = alarms.suppress(alarms.detections(spark.createDataFrame(rows, schema), (0.5,), 2, 3), 1.5)
    assert got == sorted((x["run_name"], x["detection_time"]) for x in batch.collect()) and got
