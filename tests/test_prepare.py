"""Raw dump to CSV, and CSV to messages."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from adkpi.operators.explode import conversion_events, split_unusable
from adkpi.operators.normalise import normalise, rebase_offset, timestamp_range
from adkpi.operators.position import first_by_time, with_position, with_splits
from adkpi.operators.profile import dataset_profile
from adkpi.operators.sample import fixed_size_sample, with_row_key
from adkpi.plans import explode, prepare
from adkpi.sources.delimited import read_normalised_csv, read_raw_tsv

HEADER = "timestamp\tuid\tcampaign\tclick\tconversion\tconversion_timestamp\tcost\tcat1\tcat2"
LINES = [
    "10\tu1\t7\t1\t1\t50\t0.5\tc1\tc2",
    "20\tu2",
    "xx\tu3\t8\t1\t1\t-1\t\tc1\tc2\tsurplus",
    "",
    '30\t"u4\t9\tno\t0\t\t1.25\tc1\tc2',
]
BASE = 1778803200


def write_tsv(path, lines=LINES, header=HEADER):
    text = "\n".join([header, *lines]) + "\n"
    if path.suffix == ".gz":
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return str(path)


@pytest.mark.parametrize("name", ["raw.tsv", "raw.tsv.gz"])
def test_ragged_rows(spark, tmp_path, name):
    raw = read_raw_tsv(spark, write_tsv(tmp_path / name))
    assert raw.count() == 4
    assert timestamp_range(raw).first().asDict() == {"min_ts": 10, "max_ts": 30, "row_count": 4}
    rows = {r.uid: r for r in normalise(raw, rebase_offset(raw), keep_cats=True).collect()}
    assert rows["u1"].timestamp == BASE + 10 and rows["u1"].conversion_timestamp == BASE + 50
    assert (rows["u2"].campaign, rows["u2"].click, rows["u2"].cost) == ("", 0, "0.0")
    assert (rows["u2"].cat1, rows["u2"].cat9) == ("", "")
    assert (rows["u3"].timestamp, rows["u3"].conversion) == (BASE, 1)
    assert (rows["u3"].conversion_timestamp, rows["u3"].cost) == (None, "0.0")
    assert (rows['"u4'].click, rows['"u4'].cost, rows['"u4'].cat2) == (0, "1.25", "c2")


def test_columns_are_found_by_name_and_may_be_missing(spark, tmp_path):
    path = write_tsv(tmp_path / "raw.tsv", ["5\t0.25\tu"], "timestamp\tcost\tuid")
    [row] = normalise(read_raw_tsv(spark, path)).collect()
    assert (row.timestamp, row.uid, row.cost, row.campaign, row.click) == (5, "u", "0.25", "", 0)


def test_rebase_is_off_for_absolute_or_on_request(spark):
    frame = lambda *ts: spark.createDataFrame([(t,) for t in ts], "timestamp string")
    shift = lambda raw, **kw: raw.select(rebase_offset(raw, **kw).alias("s")).first().s
    assert shift(frame("5", "x")) == BASE
    assert shift(frame("5", "1000000000")) == 0
    assert shift(frame("x")) == 0
    assert shift(frame("5"), preserve_relative=True) == 0
    assert shift(frame("5"), base_datetime="1970-01-02T00:00:00") == 86400


@pytest.mark.parametrize("size", [0, 1, 17, 400, 999, 1000, 5000])
def test_sample_has_exact_size_and_ignores_partitioning(spark, size):
    rows = spark.range(1000)
    pick = lambda df, seed=42: sorted(r.id for r in fixed_size_sample(df, size, "id", seed).collect())
    chosen = pick(rows.repartition(7))
    assert len(chosen) == len(set(chosen)) == min(size, 1000)
    assert chosen == pick(rows.coalesce(1))
    if 0 < size < 1000:
        assert chosen != pick(rows, seed=1)


def test_sample_is_spread_evenly(spark):
    kept = [r.id for r in fixed_size_sample(spark.range(20_000), 4000, "id").collect()]
    per_tenth = [sum(1 for i in kept if i // 2000 == tenth) for tenth in range(10)]
    assert all(320 < n < 480 for n in per_tenth), per_tenth


def test_position_with_a_dominant_timestamp(spark):
    rng = random.Random(3)
    rows = [(5 if i % 3 else rng.randint(0, 9), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "timestamp long, key long").repartition(6)
    got = with_position(frame, ["timestamp", "key"]).orderBy("position").collect()
    assert [(r.timestamp, r.key) for r in got] == sorted(rows)
    assert [r.position for r in got] == list(range(3000))


def test_splits(spark):
    counts = lambda n: {
        r["split"]: r["count"]
        for r in with_splits(spark.range(n).withColumnRenamed("id", "position"), 80, (2, 3), 10)
        .groupBy("split")
        .count()
        .collect()
    }
    assert counts(100) == {"initial": 80, "batch_01": 2, "batch_02": 3, "rest": 15, "sample": 10}
    assert counts(82) == {"initial": 80, "batch_01": 2, "sample": 10}
    assert counts(10) == {"initial": 10, "sample": 10}


def test_first_rows(spark):
    rows = spark.createDataFrame([(3,), (1,), (2,)], "timestamp long")
    assert [r.timestamp for r in first_by_time(rows, 2).collect()] == [1, 2]
    assert first_by_time(rows, 0).count() == 0
    assert first_by_time(rows, None).count() == 3


def test_profile(spark, tmp_path):
    raw = read_raw_tsv(spark, write_tsv(tmp_path / "raw.tsv"))
    row = dataset_profile(normalise(raw, 0)).first()
    assert (row.total, row.clicks, row.conversions, row.campaigns) == (4, 2, 2, 4)
    assert (row.total_cost, row.ctr, row.cvr, row.cpa) == (1.75, 50.0, 100.0, 0.875)
    assert row.avg_delay_hours == pytest.approx(40 / 3600)
    assert row.period == "1970-01-01 00:00 ~ 1970-01-01 00:00"
    empty = dataset_profile(normalise(raw.limit(0), 0)).first()
    assert (empty.total, empty.clicks, empty.ctr, empty.cvr, empty.cpa) == (0, 0, None, None, None)
    assert (empty.avg_delay_hours, empty.period) == (0.0, "N/A")


def test_prepare_then_explode(spark, tmp_path):
    lines = [f"{t}\tu{t % 5}\t{t % 3}\t{t % 2}\t{int(t % 4 == 0)}\t{t + 30 if t % 4 == 0 else ''}\t0.5" for t in range(60)]
    lines += ["7\tcopy\t1\t0\t0\t\t0.5"] * 40
    source = write_tsv(tmp_path / "raw.tsv", lines)
    out = str(tmp_path / "csv")
    report = prepare.run(spark, source, out, sample=90, initial=60, batches=(10, 10), quick=5)
    assert report["source_rows"] == 100 and report["offset"] == BASE
    assert report["splits"] == {"initial": 60, "batch_01": 10, "batch_02": 10, "rest": 10, "sample": 5}
    assert report["profile"]["total"] == 90
    again = prepare.run(spark, source, str(tmp_path / "again"), sample=90, initial=60, batches=(10, 10), quick=5)
    assert again["profile"] == report["profile"]

    csv = report["output"]
    first = read_normalised_csv(spark, f"{csv}/split=initial")
    second = read_normalised_csv(spark, f"{csv}/split=batch_01")
    assert first.agg(F.max("timestamp")).first()[0] <= second.agg(F.min("timestamp")).first()[0]

    events = str(tmp_path / "events")
    report = explode.run(spark, f"{csv}/split=initial", events, source_label="")
    assert report["messages"]["ad-impressions"] == 60 and report["rejects"] == 0
    rows = spark.read.parquet(f"{events}/messages").collect()
    bodies = [json.loads(r.value) for r in rows]
    assert all(r.key == b["uid"] for r, b in zip(rows, bodies))
    by_type = {}
    for body in bodies:
        by_type.setdefault(body["event_type"], {})[body["event_id"]] = body
    assert sorted(by_type["impression"]) == [f"evt_{i:08d}" for i in range(60)]
    for event_id, click in by_type["click"].items():
        assert 1 <= click["timestamp"] - by_type["impression"][event_id]["timestamp"] <= 30
    assert all(c["conversion_delay_sec"] == 30 for c in by_type["conversion"].values())
    explode.run(spark, f"{csv}/split=batch_01", str(tmp_path / "b1"), limit=3, source_label="b1")
    ids = spark.read.parquet(str(tmp_path / "b1/messages")).select(F.get_json_object("value", "$.event_id")).distinct()
    assert sorted(r[0] for r in ids.collect()) == [f"evt_b1_{i:08d}" for i in range(3)]


def test_keep_cats_round_trip(spark, tmp_path):
    source, out = write_tsv(tmp_path / "raw.tsv"), str(tmp_path / "csv")
    prepare.run(spark, source, out, keep_cats=True, preserve_relative=True)
    rows = {r.uid: r for r in read_normalised_csv(spark, f"{out}/prepared/split=initial", keep_cats=True).collect()}
    assert rows["u1"].timestamp == 10 and rows["u1"].cat2 == "c2"
    assert rows['"u4'].cost == "1.25"


def test_unusable_records_and_conversion_rules(spark):
    rows = [
        (100, "u", "1", 1, 1, 40, "0.5"),
        (100, "u", "x", 1, 0, None, "0.5"),
        (100, "u", "", 1, 0, None, "0.5"),
        (100, "u", "2", 1, 0, None, "cheap"),
        (100, "u", "3", 0, 1, None, None),
    ]
    names = "timestamp long, uid string, campaign string, click long, conversion long, conversion_timestamp long, cost string"
    good, bad = split_unusable(spark.createDataFrame(rows, names))
    assert sorted((r.campaign, r.cost) for r in good.collect()) == [(1, 0.5), (3, 0.0)]
    assert bad.count() == 3
    [event] = conversion_events(good.withColumn("event_id", F.lit("e"))).collect()
    assert (event.timestamp, event.conversion_delay_sec) == (40, 0)


def test_prepare_leaves_other_files_and_all_rows(spark, tmp_path):
    lines = [f"{t}\tu\t1\t0\t0\t\t0.5" for t in range(50)]
    source, beside = write_tsv(tmp_path / "raw.tsv", lines), tmp_path / "events" / "x.txt"
    beside.parent.mkdir()
    beside.write_text("kept")
    for _ in range(2):
        report = prepare.run(
            spark, source, str(tmp_path), sample=None, initial=8, batches=(2, 2), quick=3
        )
        assert report["splits"] == {
            "initial": 8, "batch_01": 2, "batch_02": 2, "rest": 38, "sample": 3,
        }
    assert beside.read_text() == "kept" and read_raw_tsv(spark, source).count() == 50
    with pytest.raises(ValueError, match="would be replaced"):
        prepare.run(spark, f"{tmp_path}/prepared/split=rest", str(tmp_path))


def test_single_rows_get_their_keys_without_a_shuffle(spark):
    rows = [(f"a{k}", None if k % 7 == 0 else str(k)) for k in range(300)]
    plan = with_row_key(spark.createDataFrame(rows, "a string, b string"), "k")._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString()


def test_row_keys_are_the_same_on_either_way(spark):
    rows = [(f"a{k % 90}", None if k % 3 == 0 else str(k % 90)) for k in range(200)]
    rows += [("hot", "x")] * 25_000 + [(None, None)] * 3 + [("", None), (None, "")]
    df = spark.createDataFrame(rows, "a string, b string").repartition(5)
    narrow, wide = (
        sorted(with_row_key(df, "k", limit).collect(), key=lambda r: r["k"]) for limit in (1000, 0)
    )
    assert narrow == wide and len({r["k"] for r in narrow}) == len(rows)


def test_sample_is_the_same_for_every_split_size(spark, tmp_path):
    lines = [f"{t % 40}\tu{t % 7}\t1\t0\t0\t\t0.5" for t in range(300)]
    lines += ["5\tsame\t1\t0\t0\t\t0.5"] * 300
    source = write_tsv(tmp_path / "raw.tsv", lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    for size in ("1k", "5k", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        keyed = with_row_key(read_raw_tsv(spark, source), "k")
        assert keyed.select("k").distinct().count() == keyed.count() == 600
        found.append(sorted(r["k"] for r in fixed_size_sample(keyed, 90, "k").collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 90
    # A total that is told too high ends the search all the same.
    assert fixed_size_sample(keyed, 700, "k", total=5000).count() == 600


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "uid,cost,timestamp,campaign,click,conversion,conversion_timestamp\n,1.5,7,3,1,0,\n"
    )
    rows = read_normalised_csv(spark, str(tmp_path / "a.csv"))
    [row] = rows.collect()
    assert (row.timestamp, row.campaign, row.cost, row.click) == (7, "3", "1.5", 1)
    explode.run(spark, str(tmp_path / "a.csv"), str(tmp_path / "one"))
    explode.run(spark, str(tmp_path / "a.csv") + "/", str(tmp_path / "same"))
    bodies = [
        json.loads(r.value) for r in spark.read.parquet(str(tmp_path / "one/messages")).collect()
    ]
    assert all(b["uid"] == "" for b in bodies)
    (tmp_path / "b.csv").write_text("uid,timestamp\nu,1\n")
    with pytest.raises(ValueError, match="campaign"):
        read_normalised_csv(spark, str(tmp_path / "b.csv"))


def test_first_rows_are_cut_before_they_are_sorted(spark):
    """Ties at the cut, rows without a timestamp, and every size against a plain sort."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 5, 5, 5, *range(400)]), k) for k in range(900)]
    frame = spark.createDataFrame(rows, "timestamp long, k long").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for count in (1, 3, 60, 450, 899, 900, 2000):
        got = [tuple(r) for r in first_by_time(frame, count, "k").collect()]
        assert got == ordered[:count], count
    nothing = spark.createDataFrame([], "timestamp long, k long")
    assert first_by_time(nothing, 5, "k").count() == 0
    untimed = spark.createDataFrame([(None, 1), (None, 2)], "timestamp long, k long")
    assert [r.k for r in first_by_time(untimed, 1, "k").collect()] == [1]
