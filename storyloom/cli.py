"""python -m storyloom run|list|status|backup --project FOLDER ..."""

from __future__ import annotations

import argparse
import importlib
import sys
from pathlib import Path

from .plans.snapshots import Snapshots
from .plans.tasks import ALL_SOURCES, CROSS, STEPS, Orchestrator, Project, expand


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="storyloom")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("run", "list", "status", "backup"):
        p = sub.add_parser(name)
        p.add_argument("--project", required=True)
        p.add_argument("--build", default="storyloom.plans.stages:build", help="module:function that builds steps")
        if name == "run":
            p.add_argument("--source")
            p.add_argument("--task")
            p.add_argument("--force", action="store_true")
            what = p.add_mutually_exclusive_group(required=True)
            what.add_argument("--step")
            what.add_argument("--group")
            what.add_argument("--all", action="store_true")
        if name == "backup":
            p.add_argument("--label", default="manual")
            p.add_argument("--prune", action="store_true")
    return top


def load(root: str) -> Project:
    for name in ("project.json", "project.yaml"):
        if (Path(root) / name).exists():
            return Project.load(root, (Path(root) / name).read_text(encoding="utf-8"))
    raise FileNotFoundError(f"no project in {root}")


def source_of(project: Project, steps: list[str], given: str | None) -> str:
    """The given source; steps over all sources need none."""
    names = [s for prefix in steps for s in expand(prefix)]
    if all(s in CROSS for s in names):
        return ALL_SOURCES
    if not given:
        raise ValueError("--source is needed")
    return project.source(given).id


def main(args: list[str] | None = None, spark=None) -> int:
    given = parser().parse_args(args)
    try:
        project = load(given.project)
        if given.command == "list":
            print("Sources:", *[f"  {s.id} ({s.type}, {s.authority})" for s in project.sources], "Steps:", *[f"  {s}" for s in STEPS], "Groups:", *[f"  {k}: {', '.join(v)}" for k, v in project.groups.items()], sep="\n")
            return 0
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("storyloom").getOrCreate()
        snapshots = Snapshots(given.project)
        if given.command == "backup":
            print(snapshots.take(given.label))
            if given.prune:
                print(*snapshots.prune(spark), sep="\n")
            return 0
        module, _, name = given.build.partition(":")
        runner = Orchestrator(spark, project, getattr(importlib.import_module(module), name)(spark), lambda label: (snapshots.take(label), snapshots.prune(spark)))
        if given.command == "status":
            for r in runner.status().collect():
                print(f"  [{'x' if r.complete else ' '}] {r.step:<24} {r.source}")
        elif given.all:
            runner.run_all(given.force)
        else:
            steps = [given.step] if given.step else project.groups.get(given.group)
            if steps is None:
                raise ValueError(f"no group: {given.group}")
            runner.run(steps, source_of(project, steps, given.source), given.force, given.task)
        return 0
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
