"""What a run is told: dataset, shape, syntax, folds and limits; from keywords, JSON or the session's settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import SparkSession

from weft.functions.codecs import syntax_of


@dataclass(frozen=True)
class Run:
    dataset: str = ""
    shape: str = ""
    folds: int = 10
    limit: int | None = None
    test_share: int = 6
    seed: int = 42

    @property
    def syntax(self) -> dict[str, str | bool]:
        return syntax_of(self.dataset)

    @staticmethod
    def of(settings: dict[str, str | int | None]) -> Run:
        """Unknown names are an error; numbers may be text."""
        known = {f.name for f in fields(Run)}
        if unknown := set(settings) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        number = {"folds", "limit", "test_share", "seed"}
        return Run(**{k: int(v) if k in number and v is not None else v for k, v in settings.items()})

    @staticmethod
    def from_json(text: str) -> Run:
        return Run.of(json.loads(text))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    def told_by(self, spark: SparkSession) -> Run:
        """This run, with what the session's settings weft.<name> say instead."""
        told = {f.name: v for f in fields(Run) if (v := spark.conf.get(f"weft.{f.name}", None)) is not None}
        return replace(self, **{k: getattr(Run.of({k: v}), k) for k, v in told.items()})
