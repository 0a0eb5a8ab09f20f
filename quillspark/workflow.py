"""Stages with required inputs and outputs, run in order; settings; and checks of frames."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.files import files


@dataclass(frozen=True)
class Settings:
    """Thresholds, weights and sizes; the values are those of the reference (fixed values)."""

    relevance: dict[str, float] = field(default_factory=lambda: {"loose": 0.5, "medium": 0.6, "strict": 0.8})
    presence: dict[str, float] = field(default_factory=lambda: {"loose": 0.5, "medium": 0.6, "strict": 0.8, "super_strict": 0.9})
    svm_weight_presence: float = 0.6
    glm_weight_absence: float = 0.8
    optimal_threshold: float = 0.55
    sample_size: int = 200
    per_confidence: dict[str, int] = field(default_factory=lambda: {"high": 25, "medium": 15, "low": 8})
    least_per_stratum: int = 1


@dataclass
class Stage:
    """``run`` makes the outputs (paths) from the required ones."""

    name: str
    run: Callable[[SparkSession], None]
    required: Sequence[str] = ()
    outputs: Sequence[str] = ()


def present(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, or a folder whose writing was finished."""
    return bool(files(spark, f"{path}/_SUCCESS")) or bool(files(spark, path)) and not files(spark, f"{path}/_temporary")


def run_stages(spark: SparkSession, stages: Iterable[Stage], only: Sequence[str] = (), again: bool = False, stop_on_error: bool = True) -> DataFrame:
    """Run the stages (or those named in ``only``) in order and report position, stage, status,
    message and seconds of each.

    A stage whose outputs are all there is skipped unless ``again``; one whose inputs are missing, or
    that raises, has failed, and then the later ones are not run unless ``stop_on_error`` is off. A
    stage that leaves an output unwritten is done, with the outputs in the message.
    """
    rows, stopped = [], False
    for stage in stages:
        if only and stage.name not in only:
            continue
        began = time.time()
        missing = [p for p in stage.required if not present(spark, p)]
        if stopped:
            status, message = "not run", "an earlier stage failed"
        elif not again and stage.outputs and all(present(spark, p) for p in stage.outputs):
            status, message = "skipped", "outputs exist"
        elif missing:
            status, message = "failed", f"missing: {', '.join(missing)}"
        else:
            try:
                stage.run(spark)
                unwritten = [p for p in stage.outputs if not present(spark, p)]
                status, message = "done", f"not created: {', '.join(unwritten)}" if unwritten else "completed"
            except Exception as e:  # noqa: BLE001  (a stage may fail in any way; the report says how)
                status, message = "failed", f"{type(e).__name__}: {str(e)[:500]}"
        stopped = stopped or (status == "failed" and stop_on_error)
        rows.append((len(rows), stage.name, status, message, round(time.time() - began, 3)))
    return spark.createDataFrame(rows, "position int, stage string, status string, message string, seconds double")


def subset(stages: Iterable[Stage], sets: dict[str, Sequence[str]], name: str) -> list[Stage]:
    """The stages of a named set, in their own order."""
    if name not in sets:
        raise ValueError(f"no such set: {name}; there are {', '.join(sorted(sets))}")
    return [s for s in stages if s.name in sets[name]]


def problems(df: DataFrame, required: Sequence[str] = (), least: int = 1) -> list[str]:
    """What is wrong with a frame: missing columns, too few rows. Reads no more than ``least`` rows."""
    out = [f"missing column: {c}" for c in required if c not in df.columns]
    n = df.limit(least).count() if df.columns else 0
    return out + ([f"{n} rows, at least {least} needed"] if n < least else [])


def validated(df: DataFrame, required: Sequence[str] = (), least: int = 1, what: str = "data") -> DataFrame:
    """The frame itself, or a ValueError that names all problems."""
    found = problems(df, required, least)
    if found:
        raise ValueError(f"{what}: {'; '.join(found)}")
    return df


def attempted(run: Callable[[], DataFrame], otherwise: DataFrame, log: list[str] | None = None) -> DataFrame:
    """The result of ``run``, or ``otherwise`` if making it raises; the error goes to the log."""
    try:
        return run()
    except Exception as e:  # noqa: BLE001  (that is its purpose)
        if log is not None:
            log.append(f"{type(e).__name__}: {e}")
        return otherwise


def recovered(df: DataFrame, key: str, numbers: Sequence[str] = ()) -> DataFrame:
    """Without rows that are all null, with one row a key (the least) and numbers cast; text that is
    no number becomes null."""
    some = df.where(" or ".join(f"`{c}` is not null" for c in df.columns))
    rest = [c for c in df.columns if c != key]
    one = some.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_x")).select(key, *[f"_x.{c}" for c in rest])
    out = one.unionByName(some.where(F.col(key).isNull()))
    return out.select(*[F.col(c).try_cast("double").alias(c) if c in numbers else F.col(c) for c in df.columns])


def in_chunks(df: DataFrame, process: Callable, schema: str) -> DataFrame:
    """A function of a chunk of rows (a pandas frame) applied to all chunks; chunks are batches of the
    partitions, so nothing is collected."""
    return df.mapInPandas(lambda chunks: (process(c) for c in chunks), schema)


def row_by_row(df: DataFrame, key: str, process: Callable[[dict], dict], schema: str) -> DataFrame:
    """The key and what ``process`` makes of each row (a dict of its columns; ``schema`` names the new
    ones), with status and message.

    A row that raises has the status "error", the error as message and null in the new columns, and
    doesn't stop the others. Rows go to Python in Arrow batches; for work that column expressions
    can't express."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType([df.schema[key], *T.StructType.fromDDL(schema).fields, T.StructField("status", T.StringType()), T.StructField("message", T.StringType())])
    arrow = to_arrow_schema(kind)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for row in b.to_pylist():
                try:
                    one = {key: row[key], **process(row), "status": "ok"}
                    pa.RecordBatch.from_pylist([one], schema=arrow)  # a value of another type is this row's error too
                except Exception as e:  # noqa: BLE001  (a row may fail in any way; its message says how)
                    one = {key: row[key], "status": "error", "message": f"{type(e).__name__}: {e}"[:500]}
                rows.append(one)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, kind)
