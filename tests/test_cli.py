"""The five jobs in a row, as they are started from the command line."""

import datetime as dt
import json

import pytest

from adkpi import cli
from adkpi.paths import Layout
from adkpi.plans import explode, prepare, silver
from adkpi.sources.messages import file_stream
from adkpi.streaming import bronze

HEADER = "timestamp\tuid\tcampaign\tclick\tconversion\tconversion_timestamp\tcost\n"


def call(capsys, *argv):
    cli.main(list(map(str, argv)))
    return json.loads(capsys.readouterr().out.splitlines()[-1])


def test_jobs_in_a_row(spark, tmp_path, capsys):
    raw = tmp_path / "raw.tsv"
    rows = [
        f"{t}\tu{t % 7}\t{t % 2}\t{int(t % 2 == 0 or t % 3 == 0)}\t{int(t % 6 == 0)}\t"
        f"{t + 5000 if t % 6 == 0 else ''}\t0.5"
        for t in range(120)
    ]
    raw.write_text(HEADER + "\n".join(rows) + "\n")
    csv, events, lake = tmp_path / "csv", tmp_path / "events", tmp_path / "lake"

    report = call(capsys, "prepare", "--input", raw, "--output", csv)
    assert report["splits"]["initial"] == 120
    report = call(capsys, "explode", "--csv", csv / "prepared/split=initial", "--output", events)
    assert report["messages"] == {"ad-impressions": 120, "ad-clicks": 80, "ad-conversions": 20}
    for kind in ("impression", "click", "conversion"):
        call(
            capsys, "bronze", "--event-type", kind, "--messages", events / "messages",
            "--trigger", "available", "--warehouse", lake,
        )
    report = call(capsys, "silver", "--warehouse", lake, "--as-of", "2026-05-20")
    assert (report["rows"], report["clicks"], report["conversions"]) == (120, 80, 20)
    report = call(capsys, "gold", "--warehouse", lake, "--as-of", "2026-05-20")
    assert report["rows"] == 2 and report["touched_days"] == ["2026-05-15"]
    table = spark.read.parquet(f"{lake}/gold/campaign_daily_summary")
    [even] = table.filter("campaign = 0").collect()
    assert (even.impressions, even.clicks, even.conversions) == (60, 60, 20)
    assert (even.late_conversion_count, even.p95_conversion_delay_sec) == (20, 5000.0)


def test_days_do_not_depend_on_the_session(spark, tmp_path):
    raw = tmp_path / "raw.tsv"
    raw.write_text(HEADER + "\n".join(f"{t}\tu\t1\t0\t0\t\t0.5" for t in range(20)) + "\n")
    found, before = [], spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            name = zone.replace("/", "-")
            lake, events = Layout.for_warehouse(str(tmp_path / name)), str(tmp_path / f"{name}-e")
            csv = prepare.run(spark, str(raw), str(tmp_path / f"{name}-csv"))["output"]
            explode.run(spark, f"{csv}/split=initial", events, source_label="")
            stream = file_stream(spark, f"{events}/messages", "impression")
            bronze.start(stream, "impression", lake, trigger="available").awaitTermination()
            for kind in ("click", "conversion"):
                stream = file_stream(spark, f"{events}/messages", kind)
                bronze.start(stream, kind, lake, trigger="available").awaitTermination()
            report = silver.run(spark, lake, as_of=dt.date(2026, 5, 20))
            assert (report["rows"], report["outside_window"]) == (20, 0)
            assert report["rejected"] == {"impression": 0, "click": 0, "conversion": 0}
            early = silver.run(spark, lake, as_of=dt.date(2027, 5, 20))
            assert (early["rows"], early["outside_window"]) == (0, 20)
            assert spark.conf.get("spark.sql.session.timeZone") == zone
            found.append(report["touched_days"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found[0] == found[1] == [dt.date(2026, 5, 15)]


def test_bad_arguments():
    for argv in (
        ["silver", "--warehouse", "/w", "--bucket", "b"],
        ["silver"],
        ["bronze", "--event-type", "view", "--warehouse", "/w", "--messages", "/m"],
    ):
        with pytest.raises(SystemExit):
            cli.build_parser().parse_args(argv)
