"""Command line: ``python -m adkpi <job> ...``."""

from __future__ import annotations

import argparse
import datetime as dt
import json

from adkpi.functions.scalars import DEFAULT_BASE_DATETIME
from adkpi.operators.kpis import LATE_THRESHOLD_SEC
from adkpi.operators.position import BATCH_ROWS, INITIAL_ROWS, SAMPLE_ROWS
from adkpi.paths import Layout
from adkpi.plans import explode, gold, prepare, silver
from adkpi.schemas import TOPICS
from adkpi.session import build_session
from adkpi.sources.messages import file_stream, topic_stream
from adkpi.sources.tables import CatalogTable, DayTable
from adkpi.sources.zones import FORMATS
from adkpi.streaming import bronze


def _add_layout(parser: argparse.ArgumentParser) -> None:
    place = parser.add_mutually_exclusive_group(required=True)
    place.add_argument("--bucket")
    place.add_argument("--warehouse")
    parser.add_argument("--prefix", default="adkpi")


def _or_all(text: str) -> int | None:
    return None if text == "all" else int(text)


def _window(text: str) -> int | None | str:
    return text if text == "default" else _or_all(text)


def _add_window(parser: argparse.ArgumentParser, days: int | str) -> None:
    parser.add_argument("--database", default=None, help="also name the table in the catalog")
    parser.add_argument("--merge-window-days", type=_window, default=days, help="or 'all'")
    parser.add_argument("--as-of", type=dt.date.fromisoformat, default=None)
    parser.add_argument("--only-changed", action="store_true")
    parser.add_argument("--merge-table", default=None, help="catalog table with row-level merge")
    parser.add_argument("--table-format", default=None, help="format to create that table with")


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="adkpi")
    parser.add_argument("--shuffle-partitions", type=int, default=None)
    jobs = parser.add_subparsers(dest="job", required=True)

    job = jobs.add_parser("prepare", help="raw dump to sampled, normalised, split CSV")
    job.add_argument("--input", required=True)
    job.add_argument("--output", default="./data")
    job.add_argument("--sample", type=_or_all, default=prepare.DEFAULT_SAMPLE, help="or 'all'")
    job.add_argument("--initial-rows", type=int, default=INITIAL_ROWS)
    job.add_argument("--batch-rows", type=int, nargs="*", default=list(BATCH_ROWS))
    job.add_argument("--quick-rows", type=int, default=SAMPLE_ROWS)
    job.add_argument("--keep-cats", action="store_true")
    job.add_argument("--seed", type=int, default=42)
    job.add_argument("--base-datetime", default=DEFAULT_BASE_DATETIME)
    job.add_argument("--preserve-relative-timestamps", action="store_true")

    job = jobs.add_parser("explode", help="normalised CSV to event messages")
    job.add_argument("--csv", required=True)
    job.add_argument("--output", default="./data/events")
    job.add_argument("--max-events", type=int, default=None)
    job.add_argument("--source-label", default=None, help="default: digest of the path")
    job.add_argument("--bootstrap-servers", default=None)

    job = jobs.add_parser("bronze", help="message stream to raw zone")
    job.add_argument("--event-type", choices=list(TOPICS), required=True)
    source = job.add_mutually_exclusive_group(required=True)
    source.add_argument("--bootstrap-servers")
    source.add_argument("--messages", help="folder of message files")
    job.add_argument("--topic", default=None)
    job.add_argument("--starting-offsets", default="earliest")
    job.add_argument("--output-format", choices=FORMATS, default="parquet")
    job.add_argument("--max-offsets", type=int, default=None, help="per batch, from a broker")
    job.add_argument("--max-files", type=int, default=None, help="per batch, from files")
    job.add_argument("--trigger", default=None, help="'available' or a time such as '1 minute'")
    _add_layout(job)

    job = jobs.add_parser("silver", help="raw zones to one row per impression")
    job.add_argument("--table", default="processed_events")
    job.add_argument("--raw-format", choices=FORMATS, default="parquet")
    job.add_argument("--mode", choices=silver.MODES, default="merge")
    job.add_argument("--since", type=dt.date.fromisoformat, default=None)
    job.add_argument("--trust-dates", action="store_true")
    _add_window(job, "default")
    _add_layout(job)

    job = jobs.add_parser("gold", help="silver to campaign x day KPIs")
    job.add_argument("--processed-table", default="processed_events")
    job.add_argument("--summary-table", default="campaign_daily_summary")
    job.add_argument("--silver-table", default=None, help="silver as a catalog table")
    job.add_argument("--late-threshold-sec", type=int, default=LATE_THRESHOLD_SEC)
    job.add_argument("--skip-quality-check", action="store_true")
    job.add_argument("--exact-percentiles", action="store_true")
    job.add_argument("--delete-missing", action="store_true")
    job.add_argument("--keep-state", action="store_true", help="mergeable state per day")
    job.add_argument("--days", type=dt.date.fromisoformat, nargs="+", default=None)
    job.add_argument("--check-stored", action="store_true")
    _add_window(job, gold.MERGE_WINDOW_DAYS)
    _add_layout(job)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = build_parser().parse_args(argv)
    spark = build_session(f"adkpi-{args.job}", shuffle_partitions=args.shuffle_partitions)
    report = _JOBS[args.job](spark, args)
    print(json.dumps(report, default=str))


def _layout(args: argparse.Namespace) -> Layout:
    return Layout.resolve(args.bucket, args.warehouse, args.prefix)


def _prepare(spark, args) -> dict:
    return prepare.run(
        spark,
        args.input,
        args.output,
        sample=args.sample,
        keep_cats=args.keep_cats,
        seed=args.seed,
        base_datetime=args.base_datetime,
        preserve_relative=args.preserve_relative_timestamps,
        initial=args.initial_rows,
        batches=args.batch_rows,
        quick=args.quick_rows,
    )


def _explode(spark, args) -> dict:
    return explode.run(
        spark, args.csv, args.output, args.max_events, args.source_label, args.bootstrap_servers
    )


def _bronze(spark, args) -> dict:
    if args.messages:
        stream = file_stream(
            spark, args.messages, args.event_type, args.topic, args.max_files
        )
    else:
        stream = topic_stream(
            spark,
            args.event_type,
            args.bootstrap_servers,
            args.topic,
            args.starting_offsets,
            args.max_offsets,
        )
    layout = _layout(args)
    query = bronze.start(stream, args.event_type, layout, args.output_format, args.trigger)
    query.awaitTermination()
    return {"zone": layout.zone(args.event_type), "last_batch": query.lastProgress}


def _silver(spark, args) -> dict:
    layout = _layout(args)
    return silver.run(
        spark,
        layout,
        mode=args.mode,
        window_days=args.merge_window_days,
        as_of=args.as_of,
        raw_format=args.raw_format,
        since=args.since,
        trust_dates=args.trust_dates,
        only_changed=args.only_changed,
        table=(
            CatalogTable.silver(args.merge_table, args.table_format)
            if args.merge_table
            else DayTable.silver(layout, args.table, args.database)
        ),
    )


def _gold(spark, args) -> dict:
    layout = _layout(args)
    return gold.run(
        spark,
        layout,
        window_days=args.merge_window_days,
        late_threshold_sec=args.late_threshold_sec,
        as_of=args.as_of,
        check=not args.skip_quality_check,
        exact_percentiles=args.exact_percentiles,
        only_changed=args.only_changed,
        delete_missing=args.delete_missing,
        keep_state=args.keep_state,
        days=args.days,
        check_stored=args.check_stored,
        silver=(
            CatalogTable.silver(args.silver_table)
            if args.silver_table
            else DayTable.silver(layout, args.processed_table)
        ),
        table=(
            CatalogTable.gold(args.merge_table, args.table_format)
            if args.merge_table
            else DayTable.gold(layout, args.summary_table, args.database)
        ),
    )


_JOBS = {
    "prepare": _prepare,
    "explode": _explode,
    "bronze": _bronze,
    "silver": _silver,
    "gold": _gold,
}
