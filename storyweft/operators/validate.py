"""Item validation as column expressions: each failed rule adds its field's name to an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweft.functions.text import let

#: Fixed values of the item contract: version, and the least and most code points of each text field.
VERSION = "v1"
LIMITS = {
    "source": (1, 128), "source_item_id": (1, 512), "title": (1, 2048), "canonical_url": (0, 4096), "body_text": (0, 500_000), "language": (2, 35), "source_domain": (1, 255), "image_url": (0, 4096),
}
REQUIRED = ["payload_version", "source", "source_item_id", "title", "source_metadata"]
OPTIONAL = ["canonical_url", "published_at", "body_text", "language", "source_domain", "authors", "tags", "image_url"]
#: Most elements of each list, and most code points of an element.
LISTS = {"authors": (64, 256), "tags": (128, 128)}
METADATA = {"collection": 128, "job_name": 256, "job_run_id": 256, "scraped_at": None}
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
BLANK = r"^[\t-\r \x{85}\p{Z}]*$"


def _blank(x: str) -> Column:
    return F.col(x).isNull() | F.col(x).rlike(BLANK)


def bad_time(x: Column) -> Column:
    shaped = x.rlike(RFC3339)
    return x.isNotNull() & (~shaped | F.try_to_timestamp(F.upper(x)).isNull())


def bad_uri(x: Column) -> Column:
    return x.isNotNull() & ~x.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\s]+$")


def item_errors() -> Column:
    """Names of the fields that break a rule, for rows with the item's text columns."""
    rules = [
        ("payload_version", F.coalesce(F.col("payload_version") != VERSION, F.lit(True))),
        *((c, _blank(c) | (F.char_length(F.col(c)) > LIMITS[c][1])) for c in ("source", "source_item_id", "title")),
        ("published_at", bad_time(F.col("published_at"))),
        ("canonical_url", bad_uri(F.col("canonical_url")) | F.coalesce(F.char_length("canonical_url") > LIMITS["canonical_url"][1], F.lit(False))),
    ]
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]), lambda e: e.isNotNull())


def payload_errors(payload: Column) -> Column:
    """Errors of a JSON text: `not an object` alone, else `missing KEY`, `unknown key`, and the name of each field that
    has another type or breaks a rule of its own (`metadata KEY` for those of source_metadata).

    Types are those of the JSON values: null, a number or a list is no text. An object that repeats a key, a number that
    JSON has not (NaN), or anything after the value makes the text none. Null gives `not an object`.
    """
    # The parser stops after a value; within brackets of two kinds nothing but one value can stand.
    alone = F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), payload, F.lit("}")))
    value = F.try_variant_get(F.when(alone.isNotNull(), named), "$.v", "variant")
    return let(value, lambda v: let(F.json_object_keys(payload), lambda keys: _value_errors(v, keys)))


def _value_errors(value: Column, keys: Column) -> Column:
    """payload_errors of a parsed value and its keys, each parsed once."""
    part = lambda path: F.try_variant_get(value, path, "variant")
    kind = lambda x: F.schema_of_variant(x)
    text = lambda path: F.try_variant_get(value, path, "string")
    is_text = lambda path: F.coalesce(kind(part(path)) == "STRING", F.lit(False))
    there = lambda path: kind(part(path)).isNotNull()

    def bad_text(path: str, least: int = 0, most: int | None = None, *more: Column) -> Column:
        n = F.char_length(text(path))
        bad = (n < least) | (n > most if most is not None else F.lit(False))
        for m in more:
            bad = bad | m
        return there(path) & (~is_text(path) | F.coalesce(bad, F.lit(False)))

    def bad_list(path: str, most: int, longest: int) -> Column:
        own = F.try_variant_get(value, path, "array<variant>")
        word = lambda x: F.try_variant_get(x, "$", "string")
        bad = lambda x: F.coalesce(kind(x) != "STRING", F.lit(True)) | F.coalesce(word(x).rlike(BLANK) | (F.char_length(word(x)) > longest), F.lit(True))
        return there(path) & (own.isNull() | F.coalesce((F.size(own) > most) | F.exists(own, bad), F.lit(True)))

    blank = lambda path: text(path).rlike(BLANK)
    link = lambda path: bad_uri(text(path)) | blank(path)
    more = {
        "source": lambda p: [blank(p)], "source_item_id": lambda p: [blank(p)], "title": lambda p: [blank(p)], "canonical_url": lambda p: [link(p)], "image_url": lambda p: [link(p)],
    }
    meta = "$.source_metadata"
    is_object = F.coalesce(kind(part(meta)).startswith("OBJECT"), F.lit(False))
    rules = [
        *((f"missing {k}", ~there(f"$.{k}")) for k in REQUIRED),
        ("unknown key", F.size(F.array_except(keys, F.array(*[F.lit(k) for k in REQUIRED + OPTIONAL]))) > 0),
        ("payload_version", bad_text("$.payload_version", 0, None, text("$.payload_version") != VERSION)),
        *((k, bad_text(f"$.{k}", *LIMITS[k], *more.get(k, lambda p: [])(f"$.{k}"))) for k in LIMITS),
        ("published_at", bad_text("$.published_at", 0, None, bad_time(text("$.published_at")))),
        *((k, bad_list(f"$.{k}", *LISTS[k])) for k in LISTS),
        ("source_metadata", there(meta) & ~is_object),
        *((f"metadata {k}", is_object & (~there(f"{meta}.{k}") | bad_text(f"{meta}.{k}", 0 if k == "scraped_at" else 1, most, *([bad_time(text(f"{meta}.{k}"))] if k == "scraped_at" else [])))) for k, most in METADATA.items()),
    ]
    found = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]), lambda e: e.isNotNull())
    return F.when(F.coalesce(kind(value).startswith("OBJECT"), F.lit(False)), found).otherwise(F.array(F.lit("not an object")))


def report(rows: DataFrame) -> DataFrame:
    """scanned, valid, invalid of rows with a column valid."""
    return rows.agg(F.count("*").alias("scanned"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))
