"""A Python data source that reads a folder of a git repository at a ref: ``spark.read.format("gitref")``."""

from __future__ import annotations

import subprocess
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringEndsWith, StringStartsWith

from ..session import ship

#: Bytes of files that a task reads, unless the option ``partitionBytes`` names a number, and the most files.
PARTITION_BYTES, PARTITION_FILES = 32 << 20, 10_000
#: What a file costs beside its bytes: many small files are several tasks too.
FILE_BYTES = 4096


class GitRefError(ValueError):
    """The repository or the ref doesn't exist."""


def _git(repo: str, *args: str) -> subprocess.CompletedProcess:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True)


class GitRefSource(DataSource):
    """Options: ``repo`` (a folder inside the repository), ``ref``, ``path`` (a folder in it, default all), ``partitionBytes``. An absent path has no rows.

    The driver lists names, sizes and object ids of the ref's files; tasks read the contents, each its share of the bytes. Filters on ``rel`` (equal to, starts
    with, ends with) choose from that list, so contents that no row needs are never read; they count while ``spark.sql.python.filterPushdown.enabled`` is on
    (:func:`register` turns it on). Links and submodules are no files.
    """

    @classmethod
    def name(cls) -> str:
        return "gitref"

    def schema(self) -> str:
        return "repo string, rel string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["repo"], self.options.get("ref", "HEAD"), self.options.get("path", "").strip("/"), int(self.options.get("partitionBytes", PARTITION_BYTES)))


@dataclass
class _Files(InputPartition):
    """Files of one task as (object id, path below the asked folder)."""

    files: list[tuple[str, str]]


_TESTS = {EqualTo: str.__eq__, StringEndsWith: str.endswith, StringStartsWith: str.startswith}


class _Reader(DataSourceReader):
    def __init__(self, repo: str, ref: str, path: str, partition_bytes: int = PARTITION_BYTES):
        self.path, self.partition_bytes, self.tests = path, partition_bytes, []
        if ref.startswith("-"):
            raise GitRefError(f"bad ref {ref!r}")
        if partition_bytes < 1:
            raise GitRefError("partitionBytes must be 1 or more")
        top = _git(repo, "rev-parse", "--show-toplevel")
        if top.returncode:
            raise GitRefError(f"{repo} is in no git repository")
        self.top = top.stdout.decode().strip()
        commit = _git(self.top, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}")
        if commit.returncode:
            raise GitRefError(f"unknown ref {ref!r}")
        self.commit = commit.stdout.decode().strip()  # a branch that moves meanwhile changes nothing

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("rel",) and isinstance(f.value, str):
                self.tests.append((_TESTS[type(f)], f.value))
            else:
                yield f

    def _listed(self) -> Iterator[tuple[str, int, str]]:
        """(object id, bytes, path below the asked folder) of the files that pass the filters."""
        at = ["--", f"{self.path}/"] if self.path else []
        listing = _git(self.top, "ls-tree", "-r", "-l", "-z", "--full-tree", self.commit, *at)
        if listing.returncode:
            raise GitRefError(listing.stderr.decode(errors="replace").strip())
        for entry in listing.stdout.decode(errors="surrogateescape").split("\0"):
            head, _, name = entry.partition("\t")
            if not name or not head.startswith("100"):  # a plain file's mode
                continue
            _, _, oid, size = head.split()
            rel = name.removeprefix(f"{self.path}/") if self.path else name
            if all(test(rel, value) for test, value in self.tests):
                yield oid, int(size), rel

    def partitions(self) -> list[InputPartition]:
        out, held, total = [], [], 0
        for oid, size, rel in self._listed():
            if held and (total + size + FILE_BYTES > self.partition_bytes or len(held) >= PARTITION_FILES):
                out.append(_Files(held))
                held, total = [], 0
            held.append((oid, rel))
            total += size + FILE_BYTES
        return [*out, _Files(held)] if held or not out else out

    def read(self, partition: _Files) -> Iterator[tuple]:
        """The contents from one ``git cat-file --batch``, asked for and read one file at a time."""
        if not partition.files:
            return
        with subprocess.Popen(["git", "-C", self.top, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for oid, rel in partition.files:
                git.stdin.write(f"{oid}\n".encode())
                git.stdin.flush()
                head = git.stdout.readline().decode().split()
                if len(head) != 3:
                    raise GitRefError(f"{rel}: object {oid} can't be read")
                content = git.stdout.read(int(head[2]))
                git.stdout.read(1)  # the line end behind it
                yield (self.top, rel.encode(errors="surrogateescape").decode(errors="replace"), content)
            git.stdin.close()


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitRefSource)
