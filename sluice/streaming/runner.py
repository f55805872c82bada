"""Pipelines on streaming DataFrames.

Stages that look at one row at a time run unchanged. `summarize` and `distinct` by keys keep state: with a watermark they
are handed to Spark's stateful aggregation (a time window as key lets them close), without one only complete or update
output can run them. Stages that need all rows or their order can't run on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..engine import Engine
from ..operators.stages import needs_rows
from ..plans import syntax as S
from ..plans.syntax import PipelineError

STATELESS = (S.Where, S.Project, S.ProjectRename, S.ProjectRemove, S.ProjectKeep, S.Explode, S.Lookup, S.IgnoreError)


def is_stateless(pipeline: S.Pipeline) -> bool:
    return all(isinstance(s, STATELESS) for s in pipeline.stages)


def run_stream(engine: Engine, name: str, stream: DataFrame, watermark: tuple[str, str] | None = None, validation: str = "lenient") -> DataFrame:
    """The pipeline over a stream; watermark: (time column, delay)."""
    p = engine.pipeline(name)
    bad = [type(s).__name__ for s in p.stages if isinstance(s, (S.Take, S.Top))]
    if bad or needs_rows(p.stages):
        raise PipelineError(f"{name} needs the order of all rows ({', '.join(bad) or 'an ordered aggregate'}); a stream has none")
    return engine.run(name, stream.withWatermark(*watermark) if watermark else stream, validation)
