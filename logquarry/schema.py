"""Table shapes. Text columns hold '' when absent; typed twins hold NULL."""

from pyspark.sql import types as T

KEYS = ("owner", "dataset", "file", "line_no")
FIELDS = ("ts", "level", "ip", "host", "app", "pid", "method", "path", "code", "bytes", "msg")

LINE_SCHEMA = T.StructType([
    T.StructField("owner", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("value", T.StringType()),
])

ROW_COLUMNS = (*KEYS, "format", *FIELDS, "raw", "template", "search",
               "ts_norm", "event_time", "code_int", "bytes_num")

RUNBOOK_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("explicacion", T.StringType()),
    T.StructField("causa", T.StringType()),
    T.StructField("solucion", T.StringType()),
    T.StructField("ref", T.StringType()),
    T.StructField("created_at", T.StringType()),
])

ANSWER_SCHEMA = T.StructType([
    T.StructField("hash", T.StringType()),
    T.StructField("line", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("created_at", T.StringType()),
])

MANIFEST_COLUMNS = ("owner", "dataset", "file", "size", "format", "encoding", "compressed",
                    "inner", "total", "parsed", "rejected", "meta", "w3c_fields", "loaded_at")

MANIFEST_SCHEMA = ("owner string, dataset string, file string, size long, format string, encoding string, compressed string,"
                   " inner string, total long, parsed long, rejected long, meta array<string>, w3c_fields array<string>,"
                   " loaded_at timestamp")
