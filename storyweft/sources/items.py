"""JSON item files, canonical JSON, and the append-only ledger."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyweft.operators.mutations import append_new, latest
from storyweft.operators.validate import payload_errors


class _Number(str):
    """A number as it was written."""


def _scalar(x) -> str:
    if isinstance(x, _Number):
        return str(x)
    out = json.dumps(x, ensure_ascii=False)
    if isinstance(x, str):
        for c, e in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
            out = out.replace(c, e)
    return out


class _Text(str):
    """Already encoded."""


def _encode(value) -> str:
    """With a stack of what is still to come, so that no depth is too great."""
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo.append(_Text("}"))
            for i, k in enumerate(sorted(x, reverse=True), 1):
                todo += [x[k], _Text(f"{'' if i == len(x) else ','}{_scalar(k)}:")]
            todo.append(_Text("{"))
        elif isinstance(x, list):
            todo.append(_Text("]"))
            for i in range(len(x) - 1, -1, -1):
                todo += [x[i], _Text("," if i else "")]
            todo.append(_Text("["))
        else:
            out.append(x if isinstance(x, _Text) else _scalar(x))
    return "".join(out)


def canonical_json(text: str) -> str | None:
    """Keys in order, no blanks, numbers as written; null unless the text is exactly one JSON value, or if it is nested
    deeper than Python's parser goes (some thousand levels)."""
    try:
        value = json.loads(text, parse_float=_Number, parse_int=_Number, parse_constant=_refuse)
    except (TypeError, ValueError, RecursionError):
        return None
    return _encode(value)


def _refuse(constant: str):
    raise ValueError(f"{constant} is no JSON")


@F.pandas_udf(T.StringType())
def canonical(texts: pd.Series) -> pd.Series:
    return pd.Series([canonical_json(t) for t in texts], dtype="object")


@F.pandas_udf(T.StringType())
def payload_hash(texts: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form, of the raw text if it has none."""
    return pd.Series([None if t is None else hashlib.sha256((canonical_json(t) or t).encode()).hexdigest() for t in texts], dtype="object")


def read_items(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, payload of every .json file (any case of the ending); Spark hides names that start with a dot."""
    files = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.[jJ][sS][oO][nN]").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def inline_item(spark: SparkSession, text: str) -> DataFrame:
    if not text.strip():
        raise ValueError("the item is empty")
    return spark.createDataFrame([("inline", text.strip())], "path string, payload string")


def ledger_rows(items: DataFrame, fetched_at: str) -> DataFrame:
    """Valid items as ledger rows, in order of their path."""
    ok = items.filter(F.size(payload_errors(F.col("payload"))) == 0)
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    return ok.select(
        "path", F.trim(get("source")).alias("source"), F.trim(get("source_item_id")).alias("source_item_id"), F.lower(F.trim(get("source_metadata.collection"))).alias("collection"), get("canonical_url").alias("url"),
        F.try_to_timestamp(F.upper(get("published_at"))).alias("source_published_at"), F.lit(fetched_at).cast("timestamp").alias("fetched_at"), F.col("payload").alias("raw_payload"), payload_hash("payload").alias("payload_hash"), F.lit(None).cast("timestamp").alias("deleted_at"),
    )


def ingest(ledger: DataFrame, items: DataFrame, fetched_at: str) -> DataFrame:
    """Rows to append; replays and repeats within the batch add none."""
    return append_new(ledger, ledger_rows(items, fetched_at), ["source", "source_item_id", "payload_hash"], "path")


RUNS = "run_id long, source string, status string, started_at timestamp, finished_at timestamp, items_fetched long, items_inserted long, error_message string"


def started(spark: SparkSession, run_id: int, source: str, at: str) -> DataFrame:
    """A run's row while it goes on."""
    return spark.createDataFrame([(run_id, source, at)], "run_id long, source string, at string").select(
        "run_id", "source", F.lit("running").alias("status"), F.col("at").cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(0).cast("long").alias("items_fetched"),
        F.lit(0).cast("long").alias("items_inserted"), F.lit(None).cast("string").alias("error_message"),
    )


def finished(run: DataFrame, items: DataFrame, fresh: DataFrame, at: str, error: str | None = None) -> DataFrame:
    """The run's row at its end: completed, or failed with the error cut at 4000 bytes and nothing inserted."""
    cut = None if error is None else error.encode()[:4000].decode("utf-8", "ignore")
    n = items.agg(F.count("*").alias("n")).join(fresh.agg(F.count("*").alias("k")))  # single rows
    return run.drop("items_fetched", "items_inserted").join(n).select(
        "run_id", "source", F.lit("failed" if error is not None else "completed").alias("status"), "started_at", F.lit(at).cast("timestamp").alias("finished_at"), F.col("n").alias("items_fetched"),
        (F.col("k") * (0 if error is not None else 1)).alias("items_inserted"), F.lit(cut).cast("string").alias("error_message"),
    )


def run_states(log: DataFrame) -> DataFrame:
    """Each run's last state. log: rows of started() and finished() in any order, appended as they come."""
    return latest(log, ["run_id"], [F.desc_nulls_last("finished_at")])


def checkpoints(log: DataFrame) -> DataFrame:
    """Each source's cursor after its last run. log: source, run_id, cursor_checkpoint."""
    return latest(log, ["source"], [F.desc("run_id")])
