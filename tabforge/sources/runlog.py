"""Run log (A7).

Control-plane metadata only (one entry per operator call), kept on the
driver while a stage runs and persisted as append-only Parquet tables.
"""

from __future__ import annotations

import datetime as _dt
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tabforge.constants import MIN_RATIONALE_CHARS
from tabforge.errors import ParamError

STEP_DDL = ("stage string, seq int, tool string, params map<string,string>, rows_before bigint, "
            "rows_after bigint, summary string, ts timestamp")
DECISION_DDL = ("stage string, seq int, issue string, options array<string>, choice string, "
                "rationale string, ts timestamp")


def _now():
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


@dataclass
class RunLog:
    stage: str
    steps: list[tuple] = field(default_factory=list)
    decisions: list[tuple] = field(default_factory=list)

    def step(self, tool: str, params: dict, rows_before, rows_after, summary: str = "") -> None:
        p = {str(k): (v if isinstance(v, str) else json.dumps(v, default=str)) for k, v in params.items()}
        self.steps.append((self.stage, len(self.steps) + 1, tool, p,
                           rows_before, rows_after, summary, _now()))

    def decision(self, issue: str, options, choice: str, rationale: str) -> None:
        """A decision needs an issue, options, a choice and a rationale of >= 20 chars."""
        if isinstance(options, str):
            options = json.loads(options) if options.strip().startswith("[") else [options]
        if not issue or not str(issue).strip():
            raise ParamError("issue must be non-empty.")
        if not options:
            raise ParamError("options_considered must be a non-empty list.")
        if not choice or not str(choice).strip():
            raise ParamError("choice must be non-empty.")
        if not rationale or len(str(rationale).strip()) < MIN_RATIONALE_CHARS:
            raise ParamError(f"rationale must be at least {MIN_RATIONALE_CHARS} characters.")
        self.decisions.append((self.stage, len(self.decisions) + 1, issue.strip(),
                               [str(o) for o in options], choice.strip(), rationale.strip(), _now()))

    def steps_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.steps, STEP_DDL)

    def decisions_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.decisions, DECISION_DDL)

    def persist(self, spark: SparkSession, folder: str) -> None:
        """Append this stage's entries to ``folder``/steps and ``folder``/decisions."""
        if self.steps:
            self.steps_frame(spark).write.mode("append").parquet(f"{folder}/steps")
        if self.decisions:
            self.decisions_frame(spark).write.mode("append").parquet(f"{folder}/decisions")
