"""Small functions under SQL names, as temporary SQL functions of a session: no Python in the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "step_weights": ("n INT, m INT, g DOUBLE", "ARRAY<DOUBLE>", "CASE WHEN n <= 0 THEN CAST(array() AS ARRAY<DOUBLE>) ELSE transform(sequence(0, n - 1), k -> CASE WHEN k < greatest(0, least(m, n - 1)) THEN 0.0D ELSE power(g, k - greatest(0, least(m, n - 1))) END) END"),
    "shift_step": ("m INT, n INT, d INT", "INT", "greatest(0, least(m + d, n - 1))"),
    "clean_text": ("t STRING", "STRING", r"trim(regexp_replace(t, '(?U)[\\s\\x1c-\\x1f]+', ' '))"),
    "log_sigmoid": ("x DOUBLE", "DOUBLE", "-(log1p(exp(-abs(x))) + greatest(-x, 0.0D))"),
    "looks_truncated": ("t STRING", "BOOLEAN", r"length(regexp_replace(t, '(?U)[\\s\\x1c-\\x1f]+$', '')) < 80 OR regexp_replace(t, '(?U)[\\s\\x1c-\\x1f]+$', '') RLIKE '[=+*/:,-]\\z'"),
    "split_hash": ("seed INT, id STRING", "STRING", "md5(concat(seed, ':', id))"),
}


def register(spark: SparkSession) -> list[str]:
    """Create all functions in the session, replacing older ones; their names are returned."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
