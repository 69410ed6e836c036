"""The main text functions for use inside SQL, as temporary SQL functions.

Each is an expression the optimizer inlines, the same one the Column functions
build; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from logquarry import fixed_values as V
from logquarry.functions.patterns import java_regex, whole_line
from logquarry.functions.text import TEMPLATE_PATTERN
from logquarry.functions.times import ISO, LAST_SECOND


def _text(value: str) -> str:
    """A SQL string literal."""
    special = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return "'" + "".join(special.get(ch, ch) for ch in value) + "'"


def _map(pairs: dict) -> str:
    return "map(" + ", ".join(f"{_text(str(k))}, {_text(str(v))}" for k, v in pairs.items()) + ")"


def definitions() -> dict[str, tuple[str, str]]:
    """name -> (parameters, expression)."""
    months = _map({m: f"{i + 1:02d}" for i, m in enumerate(V.MONTHS)})
    plain = (f"regexp_replace(regexp_replace(translate(trim(coalesce(x, '')), '=@,', 'xx.'), {_text(ISO)}, '=$1T$2$3$4'),"
             f" {_text(whole_line(V.CLF_TIME))}, '@$3-$2-$1 $4:$5:$6$7:$8')")
    return {
        "lq_norm_level": ("x STRING", f"coalesce(try_element_at({_map(V.LEVEL_NAMES)}, upper(x)), x)"),
        "lq_first_ipv4": ("x STRING", f"regexp_extract(x, {_text(java_regex(V.IPV4))}, 1)"),
        "lq_make_template": ("x STRING", f"regexp_replace(coalesce(x, ''), {_text(TEMPLATE_PATTERN)}, '*')"),
        "lq_truncate": ("x STRING", f"CASE WHEN char_length(x) > {V.TRUNCATE_AT} THEN left(x, {V.TRUNCATE_AT})"
                                    f" || {_text(V.TRUNCATE_MARK)} ELSE coalesce(x, '') END"),
        "lq_csv_cell": ("x STRING", f"CASE WHEN left(x, 1) IN ({', '.join(map(_text, V.CSV_RISKY_STARTS))})"
                                    " THEN '\\'' || x ELSE coalesce(x, '') END"),
        "lq_plain_time": ("x STRING", plain),
        "lq_read_time": ("p STRING", f"""CASE
            WHEN startswith(p, '=') THEN try_cast(trim(TRAILING 'T' FROM substring(p, 2, 64)) AS TIMESTAMP)
            WHEN startswith(p, '@') THEN try_cast(substring(p, 2, 5) || try_element_at({months},
              lower(substring(p, 7, 3))) || trim(TRAILING ':' FROM substring(p, 10, 64)) AS TIMESTAMP)
            WHEN p RLIKE '^[0-9]+$' AND try_cast(p AS BIGINT) <= if(char_length(p) >= 13,
              {LAST_SECOND * 1000 + 999}, {LAST_SECOND}) THEN timestamp_micros(try_cast(p AS BIGINT) *
              if(char_length(p) >= 13, 1000, 1000000)) END"""),
        "lq_event_time": ("x STRING", "lq_read_time(lq_plain_time(x))"),
        "lq_norm_ts": ("x STRING", "coalesce(replace(date_format(lq_event_time(x),"
                                   " 'yyyy-MM-dd\\'T\\'HH:mm:ss.SSSSSS'), '.000000', ''), '')"),
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Make the functions visible to `spark.sql`; gives their names."""
    made = definitions()
    for name, (parameters, expression) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {expression}")
    return list(made)
