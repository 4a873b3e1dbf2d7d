"""The function library for SQL users: temporary SQL functions, inlined by the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

from storyweft.functions.scoring import AUTO_COSINE, AUTO_COSINE_WITH_TITLE, AUTO_TITLE, GRAY_COSINE, WEIGHTS
from storyweft.functions.text import BLANKS, CONTROL, TOKEN

FUNCTIONS = {
    "sw_normalize(x STRING) RETURNS STRING": f"trim(regexp_replace(regexp_replace(lower(x), r'{CONTROL}', ''), r'{BLANKS}', ' '))",
    "sw_tokens(x STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(trim(regexp_replace(regexp_replace(lower(x), r'{CONTROL}', ''), r'{BLANKS}', ' ')), r'{TOKEN}', 0)",
    "sw_hamming(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
    "sw_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "IF(size(a) = 0 OR size(b) = 0, 0D, size(array_intersect(a, b)) / size(array_union(a, b)))",
    "sw_composite(cosine DOUBLE, title DOUBLE, day DOUBLE) RETURNS DOUBLE": f"greatest(0D, least(1D, {WEIGHTS[0]}D * cosine + {WEIGHTS[1]}D * title + {WEIGHTS[2]}D * day))",
    "sw_auto_merge(cosine DOUBLE, title DOUBLE) RETURNS BOOLEAN": f"cosine >= {AUTO_COSINE}D OR (cosine >= {AUTO_COSINE_WITH_TITLE}D AND title >= {AUTO_TITLE}D)",
    "sw_gray_zone(cosine DOUBLE) RETURNS BOOLEAN": f"cosine >= {GRAY_COSINE}D AND cosine < {AUTO_COSINE_WITH_TITLE}D",
}


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
