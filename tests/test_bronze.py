"""Message parsing and the streaming raw zone."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from adkpi.operators.parse import parse_messages
from adkpi.paths import Layout
from adkpi.plans import silver
from adkpi.schemas import MESSAGE, event_schema, topic_for, zone_schema
from adkpi.sources.messages import file_stream
from adkpi.sources.tables import DayTable
from adkpi.sources.zones import read_zone
from adkpi.streaming import bronze

B = 1778803200


def parse(spark, values, kind="impression"):
    rows = [(0, i, dt.datetime(2026, 5, 15), v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "partition int, offset long, timestamp timestamp, value string")
    ingest = F.lit(dt.datetime(2026, 5, 16, 13, 5)).cast("timestamp")
    return parse_messages(frame, kind, ingest).orderBy("kafka_offset").collect()


def test_good_message(spark):
    text = (
        '{"event_id":"a","event_type":"impression","timestamp":1778803261,'
        '"event_time":"2026-05-15T00:01:01","uid":"u","campaign":3,"cost":0.5}'
    )
    [row] = parse(spark, [text])
    assert (row.event_id, row.uid, row.campaign, row.cost) == ("a", "u", 3, 0.5)
    assert row.event_timestamp == dt.datetime(2026, 5, 15, 0, 1, 1)
    assert (row.raw_date, row.raw_hour) == (dt.date(2026, 5, 16), 13)
    assert not row.is_malformed and row.raw_value is None


def test_bad_messages_keep_their_row(spark):
    texts = ["not json", '{"event_id":"b","timestamp":"x","campaign":1.5}', '{"event_id":"c","extra":1}', None]
    bad, typed, extra, nothing = parse(spark, texts)
    assert bad.is_malformed and bad.raw_value == "not json"
    assert bad.event_id is None and bad.timestamp is None and bad.cost is None
    assert (typed.event_id, typed.timestamp, typed.campaign) == ("b", None, None)
    assert typed.is_malformed and typed.event_timestamp is None
    assert (extra.event_id, extra.uid, extra.is_malformed) == ("c", None, False)
    assert nothing.is_malformed and nothing.event_id is None


def test_schemas_differ_per_event_type():
    names = {k: event_schema(k).fieldNames() for k in ("impression", "click", "conversion")}
    assert names["impression"][-1] == "cost"
    assert "impression_timestamp" in names["click"] and "cost" not in names["click"]
    assert names["conversion"][-1] == "conversion_delay_sec"
    with pytest.raises(ValueError):
        event_schema("view")
    assert topic_for("click") == "ad-clicks" and topic_for("click", "mine") == "mine"


def test_paths():
    local = Layout.resolve(None, "/w/", "p")
    assert local.zone("click") == "/w/bronze/clicks"
    assert local.zone_checkpoint("click") == "/w/checkpoints/bronze/clicks"
    bucket = Layout.resolve("b", None, "p")
    assert bucket.zone("impression") == "s3a://b/p/bronze/impressions"
    assert bucket.zone_checkpoint("impression") == "s3a://b/checkpoints/bronze/impressions"
    with pytest.raises(ValueError):
        Layout.resolve("b", "/w", "p")


def send(spark, folder, texts, topic="ad-impressions", start=0):
    rows = [("u", t, topic, 0, start + i, None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(folder)


def impression(event_id, cost):
    return f'{{"event_id":"{event_id}","timestamp":{B},"uid":"u","campaign":1,"cost":{cost}}}'


def run_stream(spark, folder, layout, fmt):
    stream = file_stream(spark, folder, "impression", max_files_per_batch=1)
    query = bronze.start(stream, "impression", layout, fmt, trigger="available")
    assert query.awaitTermination(120)
    return query


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_stream_appends_restarts_and_feeds_silver(spark, tmp_path, fmt):
    folder, layout = str(tmp_path / "messages"), Layout.for_warehouse(str(tmp_path / "lake"))
    send(spark, folder, [impression("a", 1.0), "broken", impression("b", 2.0)])
    send(spark, folder, ['{"event_id":"z"}'], topic="ad-clicks", start=10)
    run_stream(spark, folder, layout, fmt)
    zone = read_zone(spark, layout.zone("impression"), "impression", fmt)
    assert zone.count() == 3

    # After a restart only the new files are read; one of them repeats an event.
    send(spark, folder, [impression("b", 5.0), impression("c", 3.0)], start=20)
    run_stream(spark, folder, layout, fmt)
    zone = read_zone(spark, layout.zone("impression"), "impression", fmt)
    assert sorted(r.kafka_offset for r in zone.collect()) == [0, 1, 2, 20, 21]
    assert zone.filter("raw_date is null or raw_hour is null").count() == 0
    assert set(zone_schema("impression").fieldNames()) == set(zone.columns)

    silver.run(spark, layout, window_days=None, raw_format=fmt)
    rows = DayTable.silver(layout).read(spark).collect()
    assert sorted((r.event_id, r.cost) for r in rows) == [("a", 1.0), ("b", 5.0), ("c", 3.0)]
