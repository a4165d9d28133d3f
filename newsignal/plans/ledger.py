"""A ledger of job runs, so that a run that ended early goes on at its first unfinished step.

One row per finished step: run, step, version of the input, note and time. A step writes its tables first and its row
afterwards; steps are keyed writes, so one that ended in between is repeated without harm. Another input under
the same name of a run is another version and starts anew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal.sources import sinks

SCHEMA = "run string, step string, version string, note string, finished_at timestamp"


def input_version(*inputs: DataFrame, parameters: Sequence = ()) -> str:
    """Digest of the rows of the inputs in any order, repeats counted, and of the parameters of the run.

    Columns must have a hash, as all but maps have.
    """
    parts = []
    for df in inputs:
        row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        sums = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(20,0)")).alias("s"), F.bit_xor(row).alias("x")).first()
        parts.append(f"{sums['n']}:{sums['s']}:{sums['x']}")
    return "|".join([*parts, *map(str, parameters)])


@dataclass
class Ledger:
    """The ledger at ``path`` for one run over one version of its input."""

    spark: SparkSession
    path: str
    run: str
    version: str

    def finished(self) -> dict[str, str | None]:
        """Steps of this run that have finished, with their notes."""
        if not sinks.exists(self.spark, self.path):
            return {}
        rows = self.spark.read.schema(SCHEMA).parquet(self.path).filter(
            (F.col("run") == self.run) & (F.col("version") == self.version)).select("step", "note").distinct()
        return {row["step"]: row["note"] for row in rows.collect()}  # a handful of steps

    def _record(self, step: str, note: str | None) -> None:
        row = self.spark.range(1).select(
            F.lit(self.run).alias("run"), F.lit(step).alias("step"), F.lit(self.version).alias("version"),
            F.lit(note).cast("string").alias("note"), F.current_timestamp().alias("finished_at"))
        row.coalesce(1).write.mode("append").parquet(self.path)

    def steps(self, steps: Sequence[tuple[str, Callable[[], object]]], stop: Callable[[str, str | None], bool] = lambda *_: False) -> str | None:
        """Run the steps that have not finished, in order. A step may return a text, which is its note.

        The run ends after a step for which ``stop`` holds, also when that step had finished before; returns the last note.
        """
        done, note = self.finished(), None
        for name, work in steps:
            if name in done:
                note = done[name] or note
            else:
                result = work()
                said = result if isinstance(result, str) else None
                self._record(name, said)
                note = said or note
            if stop(name, note):
                break
        return note
