"""Lines to rows. A parser is two expressions: what it captures, what it makes of it.

All formats run in one projection over the line table, so a mixed table is read
and matched once; there is no branch per format and no union.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry import fixed_values as V
from logquarry import schema
from logquarry.functions.patterns import capture, captured, whole_line
from logquarry.functions.text import (blank, first_ipv4, make_search, make_template,
                                      norm_level, number_or_null)
from logquarry.functions.times import iso_text, plain_time, read_time
from logquarry.session import lookup_join, settle

CLF_GROUPS = 6
CLF_PATTERN = whole_line(
    "(?:" + "|".join((V.CLF_STRICT, V.CLF_LOOSE, V.CLF_OPEN_QUOTE)) + ")")
LEVELLED_PATTERN = whole_line(V.LEVELLED, "i")
SYSLOG_PATTERN = whole_line(V.SYSLOG)

SPACES = r"(?U)\s+"
SPACE_CHARACTERS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(c, F.lit(SPACE_CHARACTERS))


@dataclass(frozen=True)
class LineParser:
    """`capture(value)` -> any Column; `accepts(captured, value)` -> boolean;
    `fields(captured, value)` -> the row fields it sets (others are '')."""

    name: str
    capture: Callable[[Column], Column]
    accepts: Callable[[Column, Column], Column]
    fields: Callable[[Column, Column], dict[str, Column]]


# --- access logs -----------------------------------------------------------

def _clf_part(g: Column, i: int) -> Column:
    """Field i of the form that matched: the strict one, else loose, else open quote."""
    return (F.when(F.get(g, 3) != "", F.get(g, i))
            .when(F.get(g, CLF_GROUPS + 3) != "", F.get(g, CLF_GROUPS + i))
            .otherwise(F.get(g, 2 * CLF_GROUPS + i)))


def clf_variant(g: Column) -> Column:
    return (F.when(F.get(g, 3) != "", "strict").when(F.get(g, CLF_GROUPS + 3) != "", "loose")
            .otherwise("open_quote"))


def _clf_fields(g: Column, value: Column) -> dict[str, Column]:
    ip, date, method, path, code, size = (_clf_part(g, i) for i in range(1, 7))
    return {"ts": date, "ip": ip, "method": method, "path": path, "code": code, "bytes": size,
            "msg": F.concat_ws(" ", method, path)}


CLF = LineParser("apache",
                 lambda v: capture(v, CLF_PATTERN, 3 * CLF_GROUPS),
                 lambda g, v: captured(g, 3 * CLF_GROUPS), _clf_fields)


# --- W3C extended: needs the file's column list in `w3c_fields` ------------

def _w3c_column(names: tuple[str, ...]) -> Column:
    columns = F.col("w3c_fields")
    at = [F.nullif(F.array_position(columns, n).cast("int"), F.lit(0)) for n in names]
    return F.coalesce(*at)


def _w3c_fields(tokens: Column, value: Column) -> dict[str, Column]:
    def get(*names: str) -> Column:
        return blank(F.try_element_at(tokens, _w3c_column(names)))
    method, path = get("cs-method"), get("cs-uri-stem", "cs-uri", "cs-uri-query")
    return {"ts": F.trim(F.concat_ws(" ", get("date"), get("time"))), "ip": get("c-ip"),
            "method": method, "path": path, "code": get("sc-status"), "bytes": get("sc-bytes"),
            "msg": F.concat_ws(" ", method, path)}


def _w3c_accepts(tokens: Column, value: Column) -> Column:
    width = F.size("w3c_fields")
    return F.coalesce((width > 0) & ~value.startswith("#") & value.rlike(r"(?U)\S")
                      & (F.size(tokens) >= width), F.lit(False))


W3C = LineParser("w3c", lambda v: F.split(strip(v), SPACES), _w3c_accepts, _w3c_fields)


def header_columns(line: Column) -> Column:
    """Column list of a `#Fields` line."""
    rest = F.regexp_replace(strip(F.substring(line, 8, 1 << 30)), "^:", "")
    return F.filter(F.split(strip(rest), SPACES), lambda x: x != "")


# --- JSON lines ------------------------------------------------------------

# The object is read as the first of two array elements, the second being this
# end mark. Text after the object would shift or hide the mark, so a line with
# anything behind its object is refused, as a strict JSON reader does.
JSON_END = "_line_end"
JSON_KEYS = tuple(dict.fromkeys(V.JSON_TIME_KEYS + V.JSON_LEVEL_KEYS
                                + V.JSON_MESSAGE_KEYS + V.JSON_IP_KEYS))
JSON_TYPE = T.ArrayType(T.StructType(
    [T.StructField(k, T.StringType()) for k in (*JSON_KEYS, JSON_END)]))


def _json_capture(value: Column) -> Column:
    text = strip(value)
    framed = F.concat(F.lit("["), text, F.lit(',{"' + JSON_END + '":"1"}]'))
    return F.when(text.startswith("{"),
                  F.from_json(framed, JSON_TYPE, {"allowSingleQuotes": "false"}))


def _json_accepts(parsed: Column, value: Column) -> Column:
    return F.coalesce((F.size(parsed) == 2) & F.get(parsed, 0).isNotNull()
                      & (F.get(parsed, 1)[JSON_END] == "1"), F.lit(False))


def _json_fields(parsed: Column, value: Column) -> dict[str, Column]:
    record = F.get(parsed, 0)

    def first(keys: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.when(~record[k].isin("", "0", "0.0", "false", "[]", "{}"), record[k])
                            for k in keys], F.lit(""))
    message = first(V.JSON_MESSAGE_KEYS)
    return {"ts": first(V.JSON_TIME_KEYS), "level": norm_level(F.upper(first(V.JSON_LEVEL_KEYS))),
            "ip": first(V.JSON_IP_KEYS),
            "msg": F.when(message == "", strip(value)).otherwise(message)}


JSONL = LineParser("json", _json_capture, _json_accepts, _json_fields)


# --- syslog, levelled text, raw --------------------------------------------

SYSLOG = LineParser(
    "syslog", lambda v: capture(v, SYSLOG_PATTERN, 5), lambda g, v: captured(g, 5),
    lambda g, v: {"ts": F.get(g, 1), "host": F.get(g, 2), "app": F.get(g, 3),
                  "pid": F.get(g, 4), "ip": first_ipv4(v), "msg": F.get(g, 5)})


def _generic_fields(g: Column, value: Column) -> dict[str, Column]:
    hit = captured(g, 4)
    return {"ts": F.when(hit, F.concat_ws(" ", F.get(g, 1), F.get(g, 2))).otherwise(""),
            "level": F.when(hit, norm_level(F.get(g, 3))).otherwise("RAW"),
            "ip": first_ipv4(value),
            "msg": F.when(hit, F.get(g, 4)).otherwise(value)}


GENERIC = LineParser("generic", lambda v: capture(v, LEVELLED_PATTERN, 4),
                     lambda g, v: F.lit(True), _generic_fields)
RAW = LineParser("raw", lambda v: F.lit(True), lambda g, v: F.lit(True),
                 lambda g, v: {"level": F.lit("RAW"), "msg": v})

PARSERS: dict[str, LineParser] = {
    p.name: p for p in (CLF, W3C, JSONL, SYSLOG, GENERIC, RAW)}


def register_parser(parser: LineParser) -> None:
    """Add or replace a format for `parse_auto` and `parse_as`."""
    PARSERS[parser.name] = parser


# --- running them ----------------------------------------------------------

def tag_lines(lines: DataFrame, formats: list[str]) -> DataFrame:
    """Every line with `accepted` and its row fields, from one pass.

    `lines` carries `format` (one of `formats`) and, for W3C, `w3c_fields`.
    The fields of a line that is not accepted mean nothing.
    """
    value, fmt = F.col("value"), F.col("format")
    parsers = [PARSERS[f] for f in formats]
    one = len(parsers) == 1

    def only(p: LineParser, c: Column) -> Column:
        return c if one else F.when(fmt == p.name, c)
    held = lines.select("*", *[only(p, p.capture(value)).alias(f"_{p.name}") for p in parsers])

    def row(p: LineParser) -> Column:
        got = F.col(f"_{p.name}")
        made = p.fields(got, value)
        return F.struct(p.accepts(got, value).alias("accepted"), *[
            blank(made[f]).alias(f) if f in made else F.lit("").alias(f) for f in schema.FIELDS])
    keep = [c for c in lines.columns if c != "w3c_fields"]
    packed = held.select(*keep, F.coalesce(*[only(p, row(p)) for p in parsers]).alias("_row"))
    # A one-element inline, not a projected struct: the optimizer cannot push a
    # filter on `accepted` below it, which would run every match a second time.
    flat = packed.select(*keep, F.inline(F.array("_row")))
    return flat


def enrich(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Load-time columns: raw, template, search text, canonical and typed time."""
    # Step by step: each step's expressions read plain columns, so none is repeated
    # inside another and the generated methods stay small enough to be compiled.
    keep = [*schema.KEYS, "format", *schema.FIELDS, *extra]
    cut = rows.select(*keep, blank(F.col("value")).alias("raw"), plain_time(F.col("ts")).alias("_ts"))
    timed = cut.select(*keep, "raw", read_time(F.col("_ts")).alias("event_time"))
    return timed.select(
        *keep, "raw", make_template(F.col("raw")).alias("template"),
        make_search({f: F.col(f) for f in V.SEARCH_FIELDS}).alias("search"),
        iso_text(F.col("event_time")).alias("ts_norm"), "event_time",
        number_or_null(F.col("code"), "int").alias("code_int"),
        number_or_null(F.col("bytes"), "bigint").alias("bytes_num"))


def _parse_as(lines: DataFrame, name: str) -> DataFrame:
    tagged = tag_lines(lines.withColumn("format", F.lit(name)), [name])
    return enrich(tagged.filter("accepted"))


def parse_clf(lines: DataFrame) -> DataFrame:
    return _parse_as(lines, "apache")


def parse_jsonl(lines: DataFrame) -> DataFrame:
    return _parse_as(lines, "json")


def parse_syslog(lines: DataFrame) -> DataFrame:
    return _parse_as(lines, "syslog")


def parse_generic(lines: DataFrame) -> DataFrame:
    return _parse_as(lines, "generic")


def parse_raw(lines: DataFrame) -> DataFrame:
    return _parse_as(lines, "raw")


def w3c_header(lines: DataFrame) -> DataFrame:
    """First `#Fields` per file -> (file, w3c_fields). Fixed-width buckets first."""
    marks = lines.filter(F.col("value").startswith("#Fields"))
    first = marks.groupBy("file").agg(F.min_by("value", "line_no").alias("_header"))
    return first.select("file", header_columns(F.col("_header")).alias("w3c_fields"))


def with_latest_header(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Each line with the column list of the last `#Fields` at or before it.

    Headers become half-open line ranges, cut at `STEP` lines, and join on
    (file, step): no window ever orders the lines of a whole file.
    """
    from pyspark.sql import Window
    step = 1 << 16
    marks = headers.select("file", "line_no", header_columns(F.col("value")).alias("w3c_fields"))
    until = F.lead("line_no").over(Window.partitionBy("file").orderBy("line_no"))
    spans = marks.select("file", "w3c_fields", F.col("line_no").alias("_from"), until.alias("_to"))
    last = lines.groupBy("file").agg(F.max("line_no").alias("_last"))
    spans = (spans.join(last, "file")
             .withColumn("_to", F.coalesce("_to", F.col("_last") + 1))
             .withColumn("_step", F.explode(F.sequence(
                 F.floor(F.col("_from") / step), F.floor((F.col("_to") - 1) / step))))
             .drop("_last"))
    cut = lines.withColumn("_step", F.floor(F.col("line_no") / step))
    return (lookup_join(cut, settle(spans), ["file", "_step"])
            .filter((F.col("line_no") >= F.col("_from")) & (F.col("line_no") < F.col("_to")))
            .drop("_from", "_to", "_step"))


def parse_w3c(lines: DataFrame, fields: DataFrame | list[str] | None = None,
              repeated_headers: bool = False) -> DataFrame:
    """`fields`: a known column list, or a (file, w3c_fields) table; default: the header."""
    if isinstance(fields, list):
        ready = lines.withColumn("w3c_fields", F.array(*[F.lit(f) for f in fields]))
    elif repeated_headers:
        ready = with_latest_header(lines, lines.filter(F.col("value").startswith("#Fields")))
    else:
        table = fields if fields is not None else settle(w3c_header(lines))
        ready = lookup_join(lines, table, ["file"])
    return _parse_as(ready, "w3c")


def tag_auto(lines: DataFrame, detected: DataFrame) -> DataFrame:
    """Lines tagged by the format of their file; `detected`: (file, format, w3c_fields)."""
    ready = lookup_join(lines, detected.select("file", "format", "w3c_fields"), ["file"])
    return tag_lines(ready, present_formats(detected))


def present_formats(detected: DataFrame) -> list[str]:
    """The known formats that occur: a handful of names, read on the driver."""
    found = {r["format"] for r in detected.select("format").distinct().toLocalIterator()}
    return [f for f in PARSERS if f in found] or ["raw"]


def parse_auto(lines: DataFrame, detected: DataFrame) -> DataFrame:
    return enrich(tag_auto(lines, detected).filter("accepted"))


def reject_rows(tagged: DataFrame) -> DataFrame:
    return tagged.filter("NOT accepted").select(
        *schema.KEYS, "format", "value", F.lit("no_match").alias("reason"))


def parse_quality(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("owner", "dataset", "file", "format").agg(
        F.count("*").alias("total"), F.count_if("accepted").alias("parsed"),
        F.count_if(~F.col("accepted")).alias("rejected"))
