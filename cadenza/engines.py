"""Engines: named jobs with the tables they need, those they can do without, and a check of whether they can run."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Called with a stage's name and the share of the job that is done.
Progress = Callable[[str, float], None]
Runner = Callable[[SparkSession, Mapping[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Engine:
    """inputs: table to the columns it must have; optional likewise. run gets the tables that are there, by name."""

    name: str
    inputs: Mapping[str, tuple[str, ...]]
    run: Runner
    optional: Mapping[str, tuple[str, ...]] = ()


@dataclass(frozen=True)
class Status:
    available: bool
    detail: str


class MissingInputs(ValueError):
    """An engine was started without inputs that it needs; names has them."""

    def __init__(self, engine: str, names: list[str]):
        super().__init__(f"{engine} needs {', '.join(names)}")
        self.names = names


def tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    """Those of the tables that the folder has."""
    found = {}
    for name in names:
        try:
            found[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return found


def lacking(engine: Engine, given: Mapping[str, DataFrame]) -> list[str]:
    """What an engine needs and is not given: tables, and columns as table.column. An optional table must be whole too."""
    out = [name for name in engine.inputs if name not in given]
    for name, columns in {**engine.inputs, **dict(engine.optional)}.items():
        out += [f"{name}.{c}" for c in columns if name in given and c not in given[name].columns]
    return out


def status(engine: Engine, given: Mapping[str, DataFrame]) -> Status:
    """Whether an engine could run on these tables, from their schemas alone; a broken one is unavailable, not an error."""
    try:
        missing = lacking(engine, given)
    except Exception as e:
        return Status(False, f"error: {e}")
    extra = [name for name in dict(engine.optional) if name in given]
    return Status(not missing, "lacks " + ", ".join(missing) if missing else ("with " + ", ".join(extra) if extra else "ready"))


def start(engine: Engine, spark: SparkSession, given: Mapping[str, DataFrame], progress: Progress | None = None) -> DataFrame:
    """The engine's result. Tables that it does not name are not handed on; what it needs and lacks raises MissingInputs."""
    missing = lacking(engine, given)
    if missing:
        raise MissingInputs(engine.name, missing)
    told = progress or (lambda stage, share: None)
    told("inputs", 0.0)
    out = engine.run(spark, {k: v for k, v in given.items() if k in engine.inputs or k in dict(engine.optional)})
    told("planned", 1.0)
    return out
