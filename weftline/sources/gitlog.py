"""Spark data sources over git histories: commits with their changed files and diffs, and file contents.

Repositories are folders that all executors can read, named in the option paths (comma separated).
A repository's log is dealt into runs of commits (option commits, 500 each), one task a run and one
git log a task: it prints ids, changed blobs and diffs of the run, which are read as a stream.
since, until and newest narrow the log, file restricts it to a path, as git itself does. A merge is
compared with its first parent, a root commit with nothing. Failed git calls are tried again.
"""

from __future__ import annotations

import subprocess
import time
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NONE = "0" * 40  # fixed value: the id git prints for no blob


def git(path: str, *args: str, tries: int = 3) -> bytes:
    for attempt in range(tries):
        try:
            return subprocess.run(["git", "-C", path, *args], capture_output=True, check=True, timeout=600).stdout
        except (subprocess.CalledProcessError, subprocess.TimeoutExpired):
            if attempt == tries - 1:
                raise
            time.sleep(0.2 * 2**attempt)
    raise AssertionError


class Commits(InputPartition):
    def __init__(self, path: str, skip: int, count: int):
        self.path, self.skip, self.count = path, skip, count


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.limits = [f"--{k}={options[k]}" for k in ("since", "until") if k in options]
        self.newest = int(options["newest"]) if "newest" in options else None
        self.run = int(options.get("commits", 500))
        self.only = ["--", options["file"]] if options.get("file") else []

    def partitions(self) -> list[Commits]:
        plan = []
        for path in self.paths:
            n = int(git(path, "rev-list", "--count", *self.limits, "HEAD", *self.only))
            n = min(n, self.newest) if self.newest is not None else n
            plan += [Commits(path, a, min(self.run, n - a)) for a in range(0, n, self.run)]
        return plan or [Commits("", 0, 0)]

    def read(self, partition: Commits) -> Iterator[tuple]:
        if not partition.count:
            return
        ids = git(partition.path, "rev-list", *self.limits, f"--skip={partition.skip}", f"--max-count={partition.count}", "HEAD", *self.only).decode().split()
        if not ids:
            return
        form = ["--no-walk=unsorted", "--format=%x01%H %ct %P", "--raw", "--no-abbrev", "--no-renames", "-p", "-U0", "--histogram", "--diff-merges=first-parent", "--no-color", "--no-ext-diff"]
        args = ["git", "-C", partition.path, "-c", "core.quotePath=false", "-c", "log.showRoot=true", "log", *form, *ids, *self.only]
        with subprocess.Popen(args, stdout=subprocess.PIPE) as log:
            for head, files, diffs in commits_of(log.stdout):
                sha, seconds, *parents = head.split()
                ts = datetime.fromtimestamp(int(seconds), UTC)
                for (old, new, name), diff in zip(files, diffs, strict=True):
                    yield partition.path, sha, ts, not parents, name, diff, None if new == NONE else new, None if old == NONE else old
        if log.returncode:
            raise OSError(f"git log of {partition.path} ended with {log.returncode}")


def commits_of(stream) -> Iterator[tuple[str, list[tuple[str, str, str]], list[str]]]:
    """Header, changed files (old blob, new blob, name) and their diffs of each commit of a log."""
    head, files, parts = None, [], []

    def done():
        diffs, at = [], 0
        for _, _, _, kind in files:
            n = 2 if kind == "T" else 1  # a change of type is printed as a removal and an addition
            diffs.append("".join("".join(p) for p in parts[at : at + n]))
            at += n
        return head, [f[:3] for f in files], diffs

    for raw in stream:
        line = raw.decode("utf-8", "replace")
        if line.startswith("\x01"):
            if head is not None:
                yield done()
            head, files, parts = line[1:].rstrip("\n"), [], []
        elif line.startswith("diff --git "):
            parts.append([line])
        elif parts:
            parts[-1].append(line)
        elif line.startswith(":"):
            fields, name = line.rstrip("\n").split("\t", 1)
            _, _, old, new, kind = fields.split(" ")
            files.append((old, new, name, kind[0]))
    if head is not None:
        yield done()


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "repository string, commit_id string, ts timestamp, root boolean, file string, diff string, blob string, old_blob string"

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)


def read_git(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    spark.dataSource.register(GitSource)
    return spark.read.format("gitlog").options(paths=",".join(paths), **options).load()


def read_blobs(wanted: DataFrame, tasks: int = 64) -> DataFrame:
    """repository, blob, source of the distinct blobs wanted (repository, blob): each is read once, by one
    process a task and repository. What is missing or not UTF-8 has a null source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, subprocess.Popen] = {}
        try:
            for batch in batches:
                sources = []
                for path, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if path not in open_:
                        open_[path] = subprocess.Popen(["git", "-C", path, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
                    p = open_[path]
                    p.stdin.write(blob.encode() + b"\n")
                    p.stdin.flush()
                    head = p.stdout.readline().split()
                    data = None
                    if len(head) == 3 and head[1] == b"blob":
                        data = p.stdout.read(int(head[2]))
                        p.stdout.read(1)
                    elif len(head) == 3:
                        p.stdout.read(int(head[2]) + 1)
                    try:
                        sources.append(None if data is None else data.decode())
                    except UnicodeDecodeError:
                        sources.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sources, pa.string())], ["repository", "blob", "source"])
        finally:
            for p in open_.values():
                p.stdin.close()
                p.wait()

    distinct = wanted.select("repository", "blob").filter("blob is not null").distinct()
    return distinct.repartition(tasks, F.col("repository"), F.xxhash64("blob") % 8).mapInArrow(run, "repository string, blob string, source string")
