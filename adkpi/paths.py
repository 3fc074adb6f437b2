"""Folder layout below one base URI (any Hadoop file system)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    base: str
    checkpoints: str

    @classmethod
    def for_warehouse(cls, warehouse: str) -> Layout:
        root = warehouse.rstrip("/")
        return cls(base=root, checkpoints=f"{root}/checkpoints")

    @classmethod
    def for_bucket(cls, bucket: str, prefix: str = "adkpi") -> Layout:
        root = f"s3a://{bucket}"
        return cls(base=f"{root}/{prefix.strip('/')}", checkpoints=f"{root}/checkpoints")

    @classmethod
    def resolve(cls, bucket: str | None, warehouse: str | None, prefix: str) -> Layout:
        if bool(bucket) == bool(warehouse):
            raise ValueError("give either a bucket or a warehouse folder")
        return cls.for_bucket(bucket, prefix) if bucket else cls.for_warehouse(warehouse)

    def zone(self, event_type: str) -> str:
        return f"{self.base}/bronze/{event_type}s"

    def zone_map(self, event_type: str) -> str:
        return f"{self.base}/maps/{event_type}s"

    def zone_checkpoint(self, event_type: str) -> str:
        return f"{self.checkpoints}/bronze/{event_type}s"

    def silver(self, name: str = "processed_events") -> str:
        return f"{self.base}/silver/{name}"

    def gold(self, name: str = "campaign_daily_summary") -> str:
        return f"{self.base}/gold/{name}"
