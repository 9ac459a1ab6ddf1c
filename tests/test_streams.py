import datetime
import glob

from tidewatch.catalog import incremental as C
from tidewatch.streaming import incremental as I


def test_landed_files_and_batches_grow_in_number(spark, df, tmp_path, monkeypatch):
    """Forty events at five rows a file: a quarter is more than one file, and a stream takes a quarter's files at once."""
    monkeypatch.setattr(I, "ROWS_A_TASK", 5)
    at = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i / 2)
    events = df([(i, at(i), i, "view", 1.0, f'{{"k": {i}}}') for i in range(40)], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    path, schema, files = C._landed(spark, str(tmp_path))
    assert files == 3 and len(glob.glob(f"{path.removeprefix('file:')}/*.parquet")) > 4
    out, batches = f"{tmp_path}/out", []
    whole = lambda batch: batches.append(batch.count()) or batch.selectExpr("event_id", "to_date(start_time) as activity_date")
    I.stream_facts(spark, path, schema, whole, out, f"{tmp_path}/ckpt", files_per_trigger=files)
    assert sum(batches) == 40 and len(batches) > 1
    assert sorted(int(r.event_id) for r in spark.read.parquet(out).collect()) == list(range(40))
