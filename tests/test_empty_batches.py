import glob
import os

from pyspark.sql import functions as F

from parapet.streaming.screen import StreamScreening, start_screening

SCHEMA = "message_id string, seq bigint, from_agent string, to_agent string, base_suspicion double"
ROWS = [[("1", 1, "a", "b", 0.2), ("2", 2, "b", "c", 0.4)], [], [("3", 3, "a", None, 0.8), ("4", 4, None, "d", 0.6)],
        [("5", 5, "a", "b", 0.4)]]  # the last one brings no agent, and no edge


def screened(spark, folder, batches):
    sink = StreamScreening(folder)
    for number, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, SCHEMA), number)
    columns = ["message_id", "suspicion_history", "cascade_potential", "cascade_risk", "high_risk"]
    return sorted(map(tuple, sink.detections(spark).select(*columns).collect()))


def test_a_batch_without_rows_is_not_screened(spark, tmp_path):
    """Such batches move the watermark on; what comes after goes on as if there had been none."""
    found = screened(spark, str(tmp_path / "some"), ROWS)
    assert found == screened(spark, str(tmp_path / "none"), [rows for rows in ROWS if rows])
    assert len(found) == 5
    assert not os.path.exists(tmp_path / "some/detections/batch=1")
    assert os.path.exists(tmp_path / "some/detections/batch=3")


def test_an_empty_first_batch_leaves_a_table(spark, tmp_path):
    assert screened(spark, str(tmp_path / "x"), [[], []]) == []


def test_seen_ids_are_kept_outside_the_heap(spark, tmp_path):
    spark.createDataFrame(ROWS[0], SCHEMA).write.parquet(str(tmp_path / "in"))
    sink = StreamScreening(str(tmp_path / "out"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    start_screening(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), sink, available_now=True).awaitTermination()
    assert sink.detections(spark).agg(F.count("*")).first()[0] == 2
    started = [open(f).read() for f in glob.glob(str(tmp_path / "out/progress/offsets/[0-9]*"))]
    assert started and all("RocksDB" in text for text in started)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
