"""The git source: contents, tasks by bytes, filters that choose before anything is read."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from costlens.operators import scan as S
from costlens.sources import gitref


@pytest.fixture
def repo(tmp_path):
    """One folder of many Python files beside a large binary, an empty file, a link and odd names."""
    run = lambda *a: subprocess.run(["git", "-C", tmp_path, "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    run("init", "-q")
    at = tmp_path / "src"
    at.mkdir()
    for n in range(40):
        (at / f"m{n:02d}.py").write_text(f"N = {n}\n" + "# filler\n" * 400)
    (at / "data.bin").write_bytes(bytes(range(256)) * 4000)
    (at / "empty.py").write_text("")
    (at / "no end.py").write_bytes(b"x = '\x00\n\n'")
    os.symlink("m00.py", at / "link.py")
    (tmp_path / "top.py").write_text("T = 1\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    return tmp_path


@pytest.fixture
def read(spark, repo):
    gitref.register(spark)
    return lambda **o: spark.read.format("gitref").options(repo=str(repo), **o).load()


def test_contents_are_those_of_the_files(read, repo):
    got = {r["rel"]: bytes(r["content"]) for r in read(path="src", partitionBytes=9000).collect()}
    want = {p.name: p.read_bytes() for p in (repo / "src").iterdir() if not p.is_symlink()}
    assert got == want
    assert {r["rel"] for r in read().select("rel").collect()} == {f"src/{n}" for n in want} | {"top.py"}


def test_one_folder_is_read_by_several_tasks(read):
    rows = read(path="src", partitionBytes=32_000).filter(F.endswith("rel", F.lit(".py")))
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.length("content")).alias("n")).collect()]
    assert len(sizes) >= 5 and max(sizes) <= 32_000
    assert read(path="src").rdd.getNumPartitions() == 1


def test_filters_reach_the_listing(read, spark, capsys):
    scanned = S.python_files(read(path="src").withColumn("repo", F.lit("r")))
    scanned.explain()
    plan = capsys.readouterr().out
    assert "BatchScan gitref" in plan and "EndsWith" not in plan  # the source has taken it over, other filters stay
    assert scanned.count() == 42
    assert [r["rel"] for r in read(path="src").filter("rel = 'm07.py'").collect()] == ["m07.py"]
    assert read(path="src").filter("rel like 'm0%' and length(content) > 3").count() == 10


def test_the_reader_lists_only_what_passes(repo):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringEndsWith

    reader = gitref._Reader(str(repo), "HEAD", "src")
    other = GreaterThan(("rel",), "a")
    assert list(reader.pushFilters([StringEndsWith(("rel",), ".bin"), other])) == [other]
    assert [[f[1] for f in p.files] for p in reader.partitions()] == [["data.bin"]]
    reader = gitref._Reader(str(repo), "HEAD", "src")
    assert list(reader.pushFilters([EqualTo(("rel",), "absent")])) == [] and [p.files for p in reader.partitions()] == [[]]


def test_bad_options(repo):
    for ref, path, size, message in (("nope", "", 1, "unknown ref"), ("--all", "", 1, "bad ref"), ("HEAD", "", 0, "partitionBytes")):
        with pytest.raises(gitref.GitRefError, match=message):
            gitref._Reader(str(repo), ref, path, size)
    with pytest.raises(gitref.GitRefError, match="no git repository"):
        gitref._Reader("/", "HEAD", "")
    assert [p.files for p in gitref._Reader(str(repo), "HEAD", "absent").partitions()] == [[]]
