"""What a command shows: rows as a text table or as indented JSON, and tables written with one writer at a time."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.functions.text import truncate_cell

FORMATS = ("table", "json")


def table_lines(df: DataFrame, width: int = 60) -> DataFrame:
    """place, line: a heading and a line a row, columns apart by tabs, cells cut to width, null as `-`. df has a total
    order in its first column place."""
    names = [c for c in df.columns if c != "place"]
    cells = [F.coalesce(truncate_cell(F.regexp_replace(F.col(f"`{c}`").cast("string"), "[\\t\\n\\r]+", " "), width), F.lit("-")) for c in names]
    head = df.sparkSession.createDataFrame([(0, "\t".join(n.upper() for n in names))], "place long, line string")
    return head.unionByName(df.select(F.col("place").cast("long").alias("place"), F.concat_ws("\t", *cells).alias("line")))


def shown(df: DataFrame, kind: str = "table", limit: int = 1000, width: int = 60) -> str:
    """At most limit rows (a report's length) as text."""
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    rows = df.limit(limit)
    if kind == "json":
        return json.dumps([json.loads(r.j) for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()], ensure_ascii=False, indent=2)
    body = [[("-" if v is None else " ".join(str(v).split())) for v in r] for r in rows.collect()]
    body = [[c if len(c) <= width else c[: width - 3] + "..." for c in r] for r in [[c.upper() for c in df.columns], *body]]
    wide = [max(len(r[i]) for r in body) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in body)


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    df.write.format(kind).mode(mode).save(path)


def create_new(spark: SparkSession, path: str, content: bytes = b"") -> bool:
    """Make a file in one step of the file system; False if there is one. Hadoop's client looks first and makes then on a mounted
    folder, where the system's own exclusive creation is used."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":
        local = fs.makeQualified(at).toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "xb") as f:
                f.write(content)
            return True
        except FileExistsError:
            return False
    try:
        out = fs.create(at, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(content))
    out.close()
    return True


@contextmanager
def one_writer(spark: SparkSession, path: str) -> Iterator[None]:
    """Hold a table for writing: a lock file beside it is made where there is none, in one step of the file system. A
    second writer fails at once; a lock that a lost driver left is removed by hand. Versioned tables need no lock, and
    claims give a lost worker's part to another."""
    lock = f"{path.rstrip('/')}.lock"
    if not create_new(spark, lock):
        raise RuntimeError(f"{path} is being written")
    try:
        yield
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(lock)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False)
