"""What each step of a job saw and how long it took, from the run itself: no pass is added."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siftmill.operators.columns import quoted


@dataclass
class Step:
    """label, milliseconds, and what was observed: (frame, column, rows, missing)."""

    label: str
    milliseconds: float = 0.0
    seen: list[tuple[str, str, int, int]] = field(default_factory=list)
    failed: bool = False


class Steps:
    """Collects steps. Inside `with steps.step(label) as watch`, watch(name, df) is df whose rows and nulls are
    counted while it is used; they are read when the step ends. A frame that was watched but never used
    has no counts. Where a frame is used several times, the first run counts."""

    def __init__(self) -> None:
        self.steps: list[Step] = []

    @contextmanager
    def step(self, label: str) -> Iterator:
        step, watched = Step(label), []
        self.steps.append(step)

        def watch(name: str, df: DataFrame) -> DataFrame:
            observation = Observation()
            watched.append((name, df.columns, observation))
            return df.observe(observation, F.count(F.lit(1)).alias("rows"), *(F.count_if(quoted(c).isNull()).alias(f"missing{i}") for i, c in enumerate(df.columns)))

        began = time.perf_counter()
        try:
            yield watch
        except BaseException:
            step.failed = True
            raise
        finally:
            step.milliseconds = (time.perf_counter() - began) * 1000
            for name, columns, observation in watched if not step.failed else []:
                found = self._counts(observation)
                if found:
                    step.seen += [(name, c, found["rows"], found[f"missing{i}"]) for i, c in enumerate(columns)]

    @staticmethod
    def _counts(observation: Observation) -> dict | None:
        """What was observed, without waiting for a run that never came. Where the optimizer finds that a frame
        is empty, nothing is observed either."""
        java = observation._jo
        if java is None or not java.future().isCompleted():
            return None
        row = java.future().value().get()
        return observation.get if row.isSuccess() and row.get().length() else None

    def table(self, spark: SparkSession) -> DataFrame:
        """(place, label, milliseconds, failed, frame, column, rows, missing): a row for each column watched in a step,
        and one, without them, for a step that watched none."""
        rows = [(i, s.label, s.milliseconds, s.failed, *(x or (None, None, None, None))) for i, s in enumerate(self.steps) for x in (s.seen or [None])]
        return spark.createDataFrame(rows, "place int, label string, milliseconds double, failed boolean, frame string, column string, rows long, missing long")
