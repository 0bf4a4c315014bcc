"""Stage manifest: what has been computed from which inputs, so that a run resumes."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import SparkSession

from weftlink.sources.files import Files
from weftlink.sources.readers import write_json


def signature(value: Any) -> str:
    """SHA-256 of a value's JSON, whatever the order of its keys; sets count sorted, other objects by their text."""
    text = json.dumps(value, sort_keys=True, default=lambda x: sorted(x) if isinstance(x, (set, frozenset)) else str(x))
    return hashlib.sha256(text.encode()).hexdigest()


class StageManifest:
    """Stages and their parts with signature, outputs and statistics, kept in a JSON file of any file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path, Files(spark)
        self.stages: dict[str, dict[str, Any]] = json.loads(self.files.read(path))["stages"] if self.files.exists(path) else {}

    def is_complete(self, stage: str, part: str, sign: str) -> bool:
        """Whether the part was finished under this signature and its outputs still exist."""
        entry = self.stages.get(stage, {}).get(part)
        return bool(entry) and entry["signature"] == sign and all(map(self.files.exists, entry["outputs"]))

    def complete(self, stage: str, part: str, sign: str, outputs: Iterable[str] = (), **statistics: Any) -> None:
        entry = {"signature": sign, "outputs": list(outputs), "statistics": statistics, "at": dt.datetime.now(dt.timezone.utc).isoformat()}
        self.stages.setdefault(stage, {})[part] = entry
        write_json(self.spark, {"stages": self.stages}, self.path)

    def chained(self, stage: str, value: Any, *upstream: str) -> str:
        """Signature of a stage that also changes with the stages it reads."""
        before = {u: sorted(e["signature"] for e in self.stages.get(u, {}).values()) for u in upstream}
        return signature({"stage": stage, "value": value, "upstream": before})
