"""Combined records to typed impression, click and conversion events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adkpi.functions.scalars import clamped_delay, iso_time, seeded_delay, text_or_blank
from adkpi.operators.position import with_position
from adkpi.schemas import TOPICS, event_schema

# Seed and longest made-up click delay in seconds.
CLICK_SEED = 42
LONGEST_CLICK_DELAY_SEC = 30


def with_event_ids(
    records: DataFrame, order: Sequence[str | Column], source_label: str | None = None
) -> DataFrame:
    """Number the records in ``order`` and derive ``event_id`` from the position.

    With a label, ids of different sources never meet. Without one every source starts
    at ``evt_00000000`` again, so a later source overwrites an earlier one downstream.
    """
    prefix = "evt_" if not source_label else f"evt_{source_label.replace('%', '%%')}_"
    return with_position(records, order).withColumn(
        "event_id", F.format_string(f"{prefix}%08d", F.col("position"))
    )


def split_unusable(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable records with typed campaign and cost, and those with a cell that is no number."""
    typed = records.withColumns(
        {
            "_campaign": F.col("campaign").try_cast("int"),
            "_cost": F.when(F.coalesce("cost", F.lit("")) == "", F.lit(0.0)).otherwise(
                F.col("cost").try_cast("double")
            ),
        }
    )
    needed = ("timestamp", "click", "conversion", "_campaign", "_cost")
    usable = reduce(Column.__and__, [F.col(name).isNotNull() for name in needed])
    good = typed.filter(usable).withColumns(
        {"campaign": F.col("_campaign"), "cost": F.col("_cost"), "uid": text_or_blank("uid")}
    )
    return good.drop("_campaign", "_cost"), typed.filter(~usable).drop("_campaign", "_cost")


def impression_events(records: DataFrame) -> DataFrame:
    return _events(records, "impression")


def click_events(records: DataFrame, seed: int = CLICK_SEED) -> DataFrame:
    """A click follows its impression by a repeatable 1 to 30 seconds."""
    return _events(records, "click", seed)


def conversion_events(records: DataFrame) -> DataFrame:
    """Needs the flag and a timestamp; the delay is never negative."""
    return _events(records, "conversion")


def event_payloads(records: DataFrame, seed: int = CLICK_SEED) -> DataFrame:
    """Message rows of all kinds: key is the user (none if blank), value the event as JSON text.

    Every record carries an array of its messages, which is unfolded once, so the records are
    read once for all topics.
    """
    made = []
    for event_type, topic in TOPICS.items():
        value = F.to_json(F.struct(*_columns(event_type, seed)))
        message = F.struct(value.alias("value"), F.lit(topic).alias("topic"))
        made.append(F.when(_happened(event_type), message))
    unfolded = records.select("uid", F.explode(F.array_compact(F.array(*made))).alias("message"))
    key = F.when(F.col("uid") != "", F.col("uid")).alias("key")
    return unfolded.select(key, "message.value", "message.topic")


def _happened(event_type: str) -> Column:
    return {
        "impression": F.lit(True),
        "click": F.col("click") != 0,
        "conversion": (F.col("conversion") != 0) & F.col("conversion_timestamp").isNotNull(),
    }[event_type]


def _columns(event_type: str, seed: int) -> list[Column]:
    """The fields of one event, from a record that carries its id and typed columns."""
    moment = {
        "impression": F.col("timestamp"),
        "click": F.col("timestamp")
        + seeded_delay(F.col("event_id"), seed, LONGEST_CLICK_DELAY_SEC),
        "conversion": F.col("conversion_timestamp"),
    }[event_type]
    values = {
        "event_type": F.lit(event_type),
        "timestamp": moment,
        "event_time": iso_time(moment),
        "impression_timestamp": F.col("timestamp"),
        "conversion_delay_sec": clamped_delay(F.col("conversion_timestamp"), F.col("timestamp")),
    }
    names = event_schema(event_type).fieldNames()
    return [values.get(name, F.col(name)).alias(name) for name in names]


def _events(records: DataFrame, event_type: str, seed: int = CLICK_SEED) -> DataFrame:
    return records.filter(_happened(event_type)).select(*_columns(event_type, seed))
