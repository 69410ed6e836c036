"""Column functions (Column -> Column), all JVM-side expressions."""

from logquarry.functions.markup import highlight
from logquarry.functions.patterns import capture, captured, glob_to_regex, java_regex
from logquarry.functions.sql import register_sql_functions
from logquarry.functions.text import (answer_key, csv_cell, first_ipv4, level_rank,
                                      make_search, make_template, norm_lang, norm_level,
                                      number_or_null, safe_base_name, status_class,
                                      system_prompt, template_item, truncate)
from logquarry.functions.times import (bucket_label, bucket_range, dt_bound, event_time,
                                       iso_text, norm_ts)

__all__ = [
    "answer_key", "bucket_label", "bucket_range", "capture", "captured", "csv_cell",
    "dt_bound", "event_time", "first_ipv4", "glob_to_regex", "highlight", "iso_text",
    "java_regex", "level_rank", "make_search", "make_template", "norm_lang",
    "norm_level", "norm_ts", "number_or_null", "register_sql_functions", "safe_base_name", "status_class",
    "system_prompt", "template_item", "truncate",
]
