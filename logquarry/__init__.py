"""Log analytics on Spark DataFrames: ingest, parse, filter, cluster, follow."""

from logquarry.functions import (answer_key, csv_cell, first_ipv4, make_search,
                                 make_template, norm_level, norm_ts, truncate)
from logquarry.operators.filters import FilterSpec, apply_filter
from logquarry.operators.parsers import (parse_auto, parse_clf, parse_generic,
                                         parse_jsonl, parse_raw, parse_syslog,
                                         parse_w3c, register_parser)
from logquarry.plans.load import load_files
from logquarry.session import configure, scratch_folder

__all__ = [
    "FilterSpec", "answer_key", "apply_filter", "configure", "csv_cell",
    "first_ipv4", "load_files", "make_search", "make_template", "norm_level",
    "norm_ts", "parse_auto", "parse_clf", "parse_generic", "parse_jsonl",
    "parse_raw", "parse_syslog", "parse_w3c", "register_parser",
    "scratch_folder", "truncate",
]
