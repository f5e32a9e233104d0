"""Tasks and steps over tables in folders: what is stale runs, in a fixed order, for each source.

A task reads and writes folders or files of any file system that Spark knows. It is stale if its marker is missing or
older than any of its inputs; inputs that are missing don't count. A task's settings are part of what makes it stale.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession



# The steps in the order in which they run.
NOVEL = ("novel.chapters", "novel.scenes", "novel.aliases", "novel.characters")
FILM = ("film.shots", "film.frames", "film.audio.separate", "film.audio.vad", "film.audio.stt", "film.audio.speakers", "film.audio.emotion", "film.audio.sound_events", "film.audio.music", "film.shot_groups", "film.scenes")
CROSS = ("cross.synthesize",)
STEPS = NOVEL + FILM + CROSS
ALL_SOURCES = "__cross__"


def expand(prefix: str) -> list[str]:
    """The steps that a name or a prefix of whole parts stands for, in order."""
    found = [s for s in STEPS if s == prefix or s.startswith(prefix.rstrip(".") + ".")]
    if not found:
        raise ValueError(f"no step: {prefix}")
    return found


class Store:
    """Times of files, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _open(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def changed(self, path: str) -> int | None:
        """The last change of a file, or of the newest file below a folder, in milliseconds; null if there is none."""
        p, fs = self._open(path)
        if not fs.exists(p):
            return None
        if fs.getFileStatus(p).isFile():
            return fs.getFileStatus(p).getModificationTime()
        times, files = [], fs.listFiles(p, True)
        while files.hasNext():
            times.append(files.next().getModificationTime())
        return max(times, default=None)

    def read(self, path: str) -> str | None:
        p, fs = self._open(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Under another name first, then moved."""
        p, fs = self._open(path)
        part = self.spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
        stream = fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs.delete(p, False)
        fs.rename(part, p)


@dataclass
class Task:
    """``run`` makes the outputs from the inputs; the marker tells when it last did, and with which settings."""

    key: str | None
    inputs: list[str]
    marker: str
    run: Callable[[], object]
    settings: dict = field(default_factory=dict)

    def _signature(self) -> str:
        return json.dumps(self.settings, sort_keys=True, default=str)

    def stale(self, store: Store) -> bool:
        done = store.changed(self.marker)
        if done is None or (self.settings and store.read(self.marker) != self._signature()):
            return True
        return any((t := store.changed(x)) is not None and t > done for x in self.inputs)

    def execute(self, store: Store, force: bool = False) -> bool:
        if not force and not self.stale(store):
            return False
        self.run()
        store.write(self.marker, self._signature())
        return True


@dataclass
class Step:
    name: str
    tasks: list[Task]

    def execute(self, store: Store, force: bool = False, key: str | None = None) -> bool:
        """Runs the stale tasks, or the one of that key; whether any ran."""
        chosen = self.tasks if key is None else [t for t in self.tasks if t.key == key]
        if not chosen:
            raise ValueError(f"no task {key} in {self.name}")
        return any([t.execute(store, force) for t in chosen])

    def complete(self, store: Store) -> bool:
        return not any(t.stale(store) for t in self.tasks)


@dataclass(frozen=True)
class Source:
    """A novel or a film, and how far it is to be trusted."""

    id: str
    type: str
    path: str
    authority: str = "PRIMARY"
    config: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.type not in ("novel", "film", "subtitles") or self.authority not in ("PRIMARY", "SECONDARY", "RUMOR"):
            raise ValueError(f"{self.id}: type {self.type}, authority {self.authority}")


@dataclass
class Project:
    """Sources, groups of steps and settings of models, below one folder."""

    root: str
    sources: list[Source]
    groups: dict[str, list[str]] = field(default_factory=dict)
    models: dict[str, dict] = field(default_factory=dict)

    @staticmethod
    def load(root: str, text: str) -> Project:
        """From JSON, or YAML where its reader is installed."""
        try:
            data = json.loads(text)
        except ValueError:
            import yaml

            data = yaml.safe_load(text)
        known = {"id", "type", "path", "authority", "config"}
        sources = [Source(**{k: v for k, v in x.items() if k in known}) for x in data.get("sources", [])]
        if len({s.id for s in sources}) < len(sources):
            raise ValueError("source ids repeat")
        return Project(root.rstrip("/"), sources, data.get("step_groups", {}), data.get("models", {}))

    def source(self, id: str) -> Source:
        for s in self.sources:
            if s.id == id:
                return s
        raise ValueError(f"no source: {id}")

    def subtitles(self, id: str) -> Source:
        s = self.source(id)
        if s.type != "subtitles":
            raise ValueError(f"{id} holds no subtitles")
        return s

    def source_path(self, s: Source) -> str:
        return s.path if s.path.startswith("/") or "://" in s.path else f"{self.root}/{s.path}"

    def step_folder(self, source: str, step: str) -> str:
        """Where a step of a source leaves its results."""
        return f"{self.root}/processed/{source}/steps/{step.split('.', 1)[1]}"

    def cross_folder(self, name: str) -> str:
        return f"{self.root}/cross/{name}"

    def souls_folder(self) -> str:
        return f"{self.root}/souls"


class Orchestrator:
    """Runs steps of a project. ``build(step, source, project)`` gives the Step; ``after(label)`` is called once if anything ran."""

    def __init__(self, spark: SparkSession, project: Project, build: Callable[[str, str, Project], Step], after: Callable[[str], object] = lambda label: None):
        self.spark, self.project, self.build, self.after, self.store = spark, project, build, after, Store(spark)

    def run(self, steps: Iterable[str], source: str, force: bool = False, key: str | None = None, tell: bool = True) -> bool:
        steps = list(steps)
        names = [s for prefix in steps for s in expand(prefix)]
        ran = any([self.build(s, source, self.project).execute(self.store, force, key) for s in names])
        if ran and tell:
            self.after("+".join(steps) + f"-{source}")
        return ran

    def run_group(self, name: str, source: str, force: bool = False) -> bool:
        if name not in self.project.groups:
            raise ValueError(f"no group: {name}")
        return self.run(self.project.groups[name], source, force)

    def _all(self) -> list[tuple[str, str]]:
        each = {"novel": NOVEL, "film": FILM}
        return [(step, s.id) for s in self.project.sources for step in each.get(s.type, ())] + [(step, ALL_SOURCES) for step in CROSS]

    def run_all(self, force: bool = False) -> bool:
        ran = any([self.run([step], source, force, tell=False) for step, source in self._all()])
        if ran:
            self.after("all")
        return ran

    def status(self) -> DataFrame:
        """(step, source, complete) in order."""
        rows = [(step, source, self.build(step, source, self.project).complete(self.store)) for step, source in self._all()]
        return self.spark.createDataFrame(rows, "step string, source string, complete boolean")


def roll_up(tasks: DataFrame) -> DataFrame:
    """(step, source, complete, any_ran): tasks(step, source, fresh, ran)."""
    from pyspark.sql import functions as F

    return tasks.groupBy("step", "source").agg(F.bool_and("fresh").alias("complete"), F.bool_or("ran").alias("any_ran"))


def pending(groups: DataFrame, done: DataFrame) -> DataFrame:
    """groups(group_id, source_time, ...) not among done(group_id, source_time): results of another time of the source don't count."""
    return groups.join(done.select("group_id", "source_time"), ["group_id", "source_time"], "left_anti")


def newest_results(done: DataFrame) -> DataFrame:
    """done(group_id, source_time, shard, ...) with one row for each group and time: that of the last shard."""
    from ..operators.entities import last_of

    return last_of(done, ["group_id", "source_time"], "shard")


def save_results(results: DataFrame, folder: str, size: int = 500) -> None:
    """Writes results(group_id, span_start, ...) by shards of ``size`` spans; a shard's old rows are kept unless their group is new."""
    from pyspark.sql import functions as F

    spark = results.sparkSession
    new = results.withColumn("shard", F.floor(F.col("span_start") / size).cast("long"))
    store = Store(spark)
    if store.changed(folder) is not None:
        old = spark.read.parquet(folder).join(F.broadcast(new.select("shard").distinct()), "shard", "left_semi").join(new.select("group_id"), "group_id", "left_anti")
        new = new.unionByName(old.select(*new.columns)).checkpoint() if spark.sparkContext.getCheckpointDir() else new.unionByName(old.select(*new.columns))
    # Only the partitions that have rows are replaced, each as a whole.
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)
