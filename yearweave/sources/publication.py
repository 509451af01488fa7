"""Tables that appear together: a folder per version, and a manifest that is written last.

    <path>/versions/<number>-<id>/<table>
    <path>/manifest

A version's tables are written one after the other into a folder that nobody reads yet. The manifest's line
for it, one small file in one commit, makes all of them visible at once. A run that stops earlier
leaves the version before as it was, and files that no manifest names.
"""

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

MANIFEST = "number bigint, folder string, tables array<string>"


def latest(spark: SparkSession, path: str) -> tuple[int, str, list[str]] | None:
    """(number, folder, tables) of the version that counts, if there is one.

    Of two versions with one number, written at the same time, the one with the larger folder name counts.
    """
    try:
        lines = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    row = lines.where("folder is not null").agg(F.max(F.struct("number", "folder", "tables")).alias("v")).first()["v"]
    return row and (row["number"], row["folder"], row["tables"])


def published(spark: SparkSession, path: str) -> dict[str, str]:
    """Table name -> its folder, in the version that counts; empty if nothing was published."""
    found = latest(spark, path)
    if found is None:
        return {}
    _, folder, tables = found
    return {name: f"{path}/{folder}/{name}" for name in tables}


def publish(spark: SparkSession, path: str, tables: dict[str, Callable[[str], None]]) -> dict[str, str]:
    """Write a version, each table by its function of a folder, and return what `published` will."""
    before = latest(spark, path)
    number = before[0] + 1 if before else 1
    folder = f"versions/{number:08d}-{uuid.uuid4().hex}"
    for name, write in tables.items():
        write(f"{path}/{folder}/{name}")
    line = spark.createDataFrame([(number, folder, list(tables))], MANIFEST)
    line.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return {name: f"{path}/{folder}/{name}" for name in tables}
