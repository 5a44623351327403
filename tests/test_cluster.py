"""Queries on executors that are processes of their own."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
RUN = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__

name, folder, out = sys.argv[1:]
settings = {"spark.executor.memory": "1g", "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{out}/shared", "spark.sql.warehouse.dir": f"{out}/warehouse"}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=settings).getOrCreate()
__spark_entry__.queries()[name](spark, folder).write.parquet(f"{out}/rows")
spark.stop()
"""


def on_a_cluster(tmp_path, name: str, folder: str) -> str:
    """Runs a query with two executors; gives the folder of its rows."""
    import pyspark

    home = tmp_path / "home"  # executors log to a folder in it
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": str(REPO), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", RUN, name, folder, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    return f"{tmp_path}/rows"


@pytest.mark.parametrize("name", ["s9_postgres", "s10_mysql"])
def test_a_database_is_read_by_executors(spark, tmp_path, name):
    tables = tmp_path / "tables"
    contents = ["plain", None, "", ' "a", b ', "two\r\nlines\nand\rmore\n", "Ωμέγα \U0001f600 \\", "x" * 40_000]
    spark.createDataFrame([*enumerate(contents, 1)], "id bigint, content string").repartition(3).write.parquet(f"{tables}/articles.parquet")
    rows = spark.read.parquet(on_a_cluster(tmp_path, name, str(tables))).orderBy("seq")
    assert [tuple(r) for r in rows.collect()] == [(i, i, c or "", f"{i}.00") for i, c in enumerate(contents, 1)]


@pytest.mark.parametrize("name", ["s9_postgres", "s10_mysql"])
def test_a_database_takes_any_ids(spark, tmp_path, name):
    from __spark_entry__ import queries

    ids = [-(2**63), -7, 0, 7, 7, 10**18, 2**63 - 1, None]
    rows = [(i, f"of {i}") for i in ids]
    spark.createDataFrame(rows, "id bigint, content string").repartition(3).write.parquet(f"{tmp_path}/articles.parquet")
    found = queries()[name](spark, str(tmp_path)).orderBy("seq").collect()
    assert [tuple(r) for r in found] == [(n, i, text, None if i is None else f"{i}.00") for n, (i, text) in enumerate(rows, 1)]


def test_a_database_lies_in_the_shared_folder(spark):
    from loomline.plans.lineage import shared_dir
    from loomline.plans.queries import database

    url = database(spark, spark.createDataFrame([(1, "a")], "id bigint, content string"))
    path = url.removeprefix("jdbc:derby:jar:(").removesuffix(")made")
    assert Path(path).is_file() and path.startswith(shared_dir(spark).removeprefix("file://"))
