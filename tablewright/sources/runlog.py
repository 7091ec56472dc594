"""The run log: what each run found and did, as an append-only table of committed runs.

A run's rows are written to a folder of their own (``rows/<run>/<attempt>``). One
empty file, ``commits/<run>@<attempt>``, then makes them part of the log. Its
creation is the only step that readers see, so a writer that dies before it leaves
nothing behind for them, and no store needs an atomic rename. Of several attempts
at the same run the first one by time of writing counts; attempts say the same, and
the others are never read. Readers list the commits and read these folders only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Iterator, Mapping
from dataclasses import asdict, is_dataclass
from datetime import datetime, timezone
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs

_COLUMNS = (
    "run_id string, run_name string, created_at timestamp, artifact string, "
    "path string, value double, text string"
)
_WHOLE = ""
_ROWS, _COMMITS, _MARK = "rows", "commits", "@"
_TIME = "%Y%m%dT%H%M%S%fZ"


def plain(value: Any) -> Any:
    """The value as JSON can hold it; schema objects become their type text."""
    if is_dataclass(value) and not isinstance(value, type):
        return plain(asdict(value))
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [plain(v) for v in value]
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    if callable(getattr(value, "simpleString", None)):
        return value.simpleString()
    return str(value)


def leaves(value: Any, path: str = "") -> Iterator[tuple[str, Any]]:
    """Every scalar of a nested value with its dotted path."""
    if isinstance(value, dict):
        items = value.items()
    elif isinstance(value, list):
        items = enumerate(value)
    else:
        yield path, value
        return
    for key, item in items:
        yield from leaves(item, f"{path}.{key}" if path else str(key))


class ExperimentLogger:
    """Appends one run's artifacts to a log that shows a run whole or not at all.

    Every scalar becomes a row that Spark can filter, join and pivot over many
    runs; each artifact is also kept whole as JSON in the row with an empty path.
    """

    def __init__(self, output_dir: str, spark: SparkSession | None = None):
        self.output_dir = str(output_dir)
        self.spark = spark

    def log_run(
        self,
        run_name: str,
        result: Any,
        policy: Any = None,
        metadata: Mapping | None = None,
        ml_metrics: Any = None,
        report: Any = None,
        run_id: str | None = None,
    ) -> str:
        """Write the artifacts and return the run id; see ``append``."""
        artifacts = {
            "metadata": metadata or {},
            "policy": policy,
            "raw_profile": result.raw_profile,
            "repair_actions": result.repair_actions,
            "cleaned_profile": result.cleaned_profile,
            "evaluation": result.evaluation,
            "opex_metrics": result.opex_metrics,
        }
        skews = result.evaluation.get("skew", {}).get("by_column", {}).values()
        artifacts["summary"] = {"skew_columns_reduced": sum((e["reduction"] or 0) > 0 for e in skews)}
        optional = {"ml_metrics": ml_metrics, "report": report}
        artifacts |= {name: a for name, a in optional.items() if a is not None}
        return self.append(run_name, artifacts, result.cleaned_df.sparkSession, run_id)

    def append(
        self,
        run_name: str,
        artifacts: Mapping[str, Any],
        spark: SparkSession | None = None,
        run_id: str | None = None,
    ) -> str:
        """Write and commit the artifacts, and return the run id.

        Without a given id the run gets one that sorts by time. A given id makes the
        call safe to repeat: if a run of that id is committed already, nothing is written.
        """
        spark = spark or self.spark
        now = datetime.now(timezone.utc)
        safe_name = re.sub(r"[^\w-]", "_", run_name.strip()).strip("_") or "run"
        run_id = f"{now:{_TIME}}_{safe_name}" if run_id is None else run_id
        if not re.fullmatch(r"\w[\w.-]*", run_id, re.ASCII):
            raise ValueError(f"A run id has letters, digits, '_', '.' and '-' only, not {run_id!r}.")
        if run_id in self._committed(spark):
            return run_id
        contents = {name: plain(a) for name, a in artifacts.items()}
        contents["manifest"] = {
            "run_name": run_name,
            "created_at_utc": now.isoformat(),
            "artifacts": sorted(contents),
        }
        rows = []
        for artifact, content in contents.items():
            rows.append((run_id, safe_name, now, artifact, _WHOLE, None, json.dumps(content, sort_keys=True)))
            for path, leaf in leaves(content):
                number = float(leaf) if isinstance(leaf, (int, float)) else None
                text = leaf if isinstance(leaf, str) else None
                rows.append((run_id, safe_name, now, artifact, path, number, text))
        table = spark.createDataFrame(rows, _COLUMNS).coalesce(1)
        attempt = f"{now:{_TIME}}-{uuid4().hex}"
        table.write.parquet(self._rows_of(run_id, attempt))
        self._commit(spark, run_id, attempt)
        return run_id

    def read(self, spark: SparkSession | None = None, only: Collection[str] | None = None) -> DataFrame:
        """The whole log, or that of some runs, one row per scalar."""
        return self._table(spark, only).filter(F.col("path") != _WHOLE)

    def run_ids(self, spark: SparkSession | None = None) -> list[str]:
        """Ids of the committed runs, in order."""
        return sorted(self._committed(spark or self.spark))

    def drop_uncommitted(self, before: datetime, spark: SparkSession | None = None) -> int:
        """Delete rows that are no part of the log and were begun before a time; how many attempts these were.

        Choose a time at which no writer of today had begun: an attempt under way has no commit yet either.
        """
        spark = spark or self.spark
        committed, dropped = self._committed(spark), 0
        for run in _names(spark, f"{self.output_dir}/{_ROWS}"):
            for attempt in _names(spark, f"{self.output_dir}/{_ROWS}/{run}"):
                if committed.get(run) != attempt and attempt < f"{before.astimezone(timezone.utc):{_TIME}}":
                    files, path = _files(spark, self._rows_of(run, attempt))
                    dropped += files.delete(path, True)
        return dropped

    def artifact(self, run_id: str, name: str, spark: SparkSession | None = None) -> Any:
        """One artifact of one run, as it was logged."""
        row = (
            self._table(spark, [run_id])
            .filter((F.col("run_id") == run_id) & (F.col("artifact") == name) & (F.col("path") == _WHOLE))
            .select("text")
            .first()
        )
        return None if row is None else json.loads(row["text"])

    def newest_run(self, suffix: str, spark: SparkSession | None = None) -> str:
        row = runs.latest_run_like(self._table(spark), suffix).first()
        if row is None:
            raise FileNotFoundError(f"No run ending with '{suffix}' found in {self.output_dir}.")
        return row["run_id"]

    def compare(self, first: str, second: str, spark: SparkSession | None = None) -> DataFrame:
        """Quality, model and effort metrics of two runs side by side."""
        wanted = runs.QUALITY_METRICS | runs.CLASSIFICATION_METRICS | runs.REGRESSION_METRICS | runs.EFFORT_METRICS
        log = self.read(spark, [first, second])
        return runs.compare_runs(runs.named_metrics(log, wanted), first, second)

    def verdicts(self, first: str, second: str, spark: SparkSession | None = None) -> DataFrame:
        """Whether two runs came to the same quality and the same models."""
        return runs.outcome_verdicts(self.compare(first, second, spark))

    def summary(self, table: str, spark: SparkSession | None = None) -> DataFrame:
        return runs.summary(self.read(spark), table)

    def _table(self, spark: SparkSession | None, only: Collection[str] | None = None) -> DataFrame:
        spark = spark or self.spark
        kept = {r: a for r, a in self._committed(spark).items() if only is None or r in only}
        if not kept:
            return spark.createDataFrame([], _COLUMNS)
        return spark.read.schema(_COLUMNS).parquet(*[self._rows_of(r, a) for r, a in sorted(kept.items())])

    def _rows_of(self, run_id: str, attempt: str) -> str:
        return f"{self.output_dir}/{_ROWS}/{run_id}/{attempt}"

    def _commit(self, spark: SparkSession, run_id: str, attempt: str) -> None:
        files, path = _files(spark, f"{self.output_dir}/{_COMMITS}/{run_id}{_MARK}{attempt}")
        files.create(path, False).close()

    def _committed(self, spark: SparkSession) -> dict[str, str]:
        """The attempt that counts of each committed run."""
        found: dict[str, str] = {}
        for name in sorted(_names(spark, f"{self.output_dir}/{_COMMITS}")):
            run_id, _, attempt = name.partition(_MARK)
            found.setdefault(run_id, attempt)
        return found


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The path's file system and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    files, path = _files(spark, folder)
    return [entry.getPath().getName() for entry in files.listStatus(path)] if files.exists(path) else []
