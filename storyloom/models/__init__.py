"""The surface to models: callables by name, run in Arrow batches, with retries; no model is part of the package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

#: Roles that stages ask for; a registry maps each to a factory of a callable.
ROLES = (
    "scene_segmenter", "alias_resolver", "alias_retry", "character_extractor", "synthesizer", "shot_grouper", "scene_analyst", "voice_activity", "recognizer", "aligner",
    "speaker_embedder", "diarizer", "clusterer", "frame_embedder", "sound_classifier", "source_separator", "emotion", "prosody", "shot_detector", "music_analyst",
)


class InvalidOutput(ValueError):
    """A model's output that does not have the form asked for."""


def with_retries(call: Callable[[Any], Any], check: Callable[[Any], Any] | None = None, most: int = 3) -> Callable[[Any], Any]:
    """``call`` whose output ``check`` turns into its final form; InvalidOutput is tried again, ``most`` times in all."""

    def run(x: Any) -> Any:
        for k in range(most):
            try:
                out = call(x)
                return check(out) if check else out
            except InvalidOutput:
                if k == most - 1:
                    raise

    return run


def fields(**kinds: type) -> Callable[[Any], dict]:
    """A check that an output is a mapping with these keys and types; others are an InvalidOutput."""

    def check(out: Any) -> dict:
        if not isinstance(out, dict) or any(not isinstance(out.get(k), t) for k, t in kinds.items()):
            raise InvalidOutput(f"wanted {', '.join(kinds)}")
        return out

    return check


def one_of(names: list[str]) -> Callable[[Any], str]:
    """A check for one of the names of a run."""
    allowed = frozenset(names)

    def check(out: Any) -> str:
        if out not in allowed:
            raise InvalidOutput(f"not one of {len(allowed)} names")
        return out

    return check


@dataclass
class Registry:
    """Factories by role, and their settings: given ones before a project's, and these before the defaults of a role."""

    factories: dict[str, Callable[..., Callable]] = field(default_factory=dict)
    defaults: dict[str, dict] = field(default_factory=dict)
    project: dict[str, dict] = field(default_factory=dict)
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def key(self, role: str, given: dict | None = None) -> tuple[str, str, str]:
        """What a worker holds a model by: this registry, the role and its settings, so that no other one is taken for it."""
        return self.token, role, repr(sorted(self.settings(role, given).items(), key=lambda kv: kv[0]))

    def register(self, role: str, factory: Callable[..., Callable], **defaults: Any) -> None:
        if role not in ROLES:
            raise ValueError(f"unknown role: {role}")
        self.factories[role], self.defaults[role] = factory, defaults
        self.token = uuid.uuid4().hex  # what workers hold is of the factory before

    def settings(self, role: str, given: dict | None = None) -> dict:
        merged = dict(self.defaults.get(role, {}))
        for layer in (self.project.get(role), given):
            merged |= {k: v for k, v in (layer or {}).items() if v is not None}
        return merged

    def factory(self, role: str, given: dict | None = None) -> Callable[[], Callable]:
        """A factory without arguments, to be sent to tasks."""
        if role not in self.factories:
            raise ValueError(f"no model for {role}")
        make, settings = self.factories[role], self.settings(role, given)
        return lambda: make(**settings)


POINTS = 50_000  #: vectors that a clusterer of one recording may get
_HELD: dict[Any, Callable] = {}


def held(key: Any, make: Callable[[], Callable]) -> Callable:
    """One model for each Python worker and key; a worker makes it at its first batch."""
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def apply_model(rows: DataFrame, make: Callable[[], Callable[[dict], list[dict]]], schema: str, key: Any = None, batch: int = 64) -> DataFrame:
    """The rows that the model gives for each row: a callable from a row (a dict) to rows of the schema.

    It is made once for each task (with a key: for each worker); errors of the model fail the task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = None
        for whole in batches:
            for low in range(0, whole.num_rows, batch):
                call = call or (make() if key is None else held(key, make))
                out = [y for x in whole.slice(low, batch).to_pylist() for y in call(x)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return rows.mapInArrow(run, schema)


def sweep(rows: DataFrame, make: Callable[..., Callable[[list[list[float]]], tuple[list[int], float]]], grid: list[dict]) -> DataFrame:
    """(candidate, id, label, persistence): clusterings of rows(id, v) under every setting of the grid, a task for each.

    A clusterer is a callable that takes all vectors of one recording, so that they go to each task as they are: POINTS at
    most, beyond which this is an error and ``operators.density.sweep``, which clusters on the cluster itself, is the way.
    With three vectors or fewer all have label 0. Null vectors take no part.
    """
    spark = rows.sparkSession
    held = rows.where("v IS NOT NULL").select("id", "v").limit(POINTS + 1).collect()
    if len(held) > POINTS:
        raise ValueError(f"over {POINTS} vectors: use operators.density.sweep")
    points = sorted((r["id"], list(r["v"])) for r in held)
    data = spark.sparkContext.broadcast(points)
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                ids, vectors = [i for i, _ in data.value], [v for _, v in data.value]
                labels, persistence = ([0] * len(ids), 1.0) if len(ids) <= 3 else make(**grid[k])(vectors)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(ids), pa.int32()), pa.array(ids), pa.array([int(x) for x in labels], pa.int32()), pa.array([float(persistence)] * len(ids))], ["candidate", "id", "label", "persistence"])

    n = len(grid) if len(points) > 3 else 1
    return spark.range(n).selectExpr("CAST(id AS INT) AS candidate").repartition(n).mapInArrow(run, f"candidate int, id {kind}, label int, persistence double")
