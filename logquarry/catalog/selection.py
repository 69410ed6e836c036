"""Filters, presets and pages."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.catalog.base import ORACLES, event_rows, lines_cte, query, rows_cte, text_lines
from logquarry.operators import filters, paging
from logquarry.operators.filters import FilterSpec, Presets
from logquarry.operators.parsers import parse_raw
from logquarry.operators.postings import PostingTable
from logquarry.session import scratch_folder
from logquarry.sinks import ordinals, tables

G, A = f"WITH {rows_cte('generic')}", f"WITH {rows_cte('apache')}"


def _rows(name: str, form: str, where: str, spec: FilterSpec) -> None:
    @query(name, f"WITH {rows_cte(form)} SELECT line_no, level, code, ip, ts_norm FROM r WHERE {where}")
    def run(spark, sf):
        rows = event_rows(spark, sf, form)
        return filters.apply_filter(rows, spec).select("line_no", "level", "code", "ip", "ts_norm")


_rows("filter_exact_terms", "apache", "code IN ('200', '500') AND level <> 'ERR'",
      FilterSpec(code="200, 500,", level="!ERR"))
_rows("filter_level_terms", "generic", "level IN ('ERR', 'WRN')", FilterSpec(level="ERR,WRN"))
_rows("filter_substring_terms", "apache",
      "(contains(ip, '.1.') OR contains(ip, '.249')) AND NOT contains(lower(path), 'click')",
      FilterSpec(ip=".1.,.249", path="!CLICK"))
_rows("filter_free_text", "generic", "contains(search, 'signup from') AND NOT contains(search, '.3.')",
      FilterSpec(q="SignUp from,! .3."))
_rows("filter_template", "generic", "template = '*-*-* *:*:*.* ERROR user * error from * took *'",
      FilterSpec(tpl="*-*-* *:*:*.* ERROR user * error from * took *"))
_rows("filter_date_text", "generic", "contains(ts, '01-2')", FilterSpec(dt=" 01-2 "))
_rows("filter_time_range", "generic", "ts_norm >= '2024-01-05T00:00:00' AND ts_norm <= '2024-01-06T12:30:00'",
      FilterSpec(dt_from="2024-01-05", dt_to="06/Jan/2024:14:30:00 +0200"))
_rows("filter_combined", "apache",
      "code IN ('500', '404') AND contains(ip, '10.2') AND contains(path, '/api/') AND ts_norm >= '2024-01-10T00:00:00'"
      " AND NOT contains(search, 'view/1')",
      FilterSpec(code="500,404", ip="10.2", path="/API/", q="!view/1", dt_from="2024-01-10 00:00:00"))
_rows("drilldown_bucket", "generic", "substr(ts_norm, 1, 13) = '2024-01-07T13' AND level = 'DBG'",
      FilterSpec().with_("level", "DBG").with_bucket("2024-01-07T13"))
_rows("drilldown_value", "syslog", "contains(search, 'host3')", FilterSpec().with_("host", "host3"))


@query("filter_phrase", f"""WITH {lines_cte()}, t AS (SELECT file, line_no, ' ' || trim(regexp_replace(
    strip_accents(lower(value)), '[^\\pL\\pN]+', ' ', 'g')) || ' ' AS tok FROM ln)
  SELECT file, line_no FROM t WHERE (contains(tok, ' of the ') OR contains(tok, ' de la ')) AND NOT contains(tok, ' and ')""")
def filter_phrase(spark, sf):
    return text_lines(spark, sf).filter(filters.phrase_terms(
        F.col("value"), filters.parse_terms("of the,de la,!and"))).select("file", "line_no")


def _indexed(spark, lines):
    """A posting table of the lines, added in two parts that share blocks."""
    index = PostingTable(spark, scratch_folder(spark, "postings"))
    for part in (0, 1):
        index.append(lines.filter(F.col("line_no") % 2 == part), "value")
    return index


@query("posting_phrase", ORACLES["filter_phrase"])
def posting_phrase(spark, sf):
    """The phrases of filter_phrase, answered from the posting table."""
    lines = text_lines(spark, sf)
    return _indexed(spark, lines).search(lines, "of the,de la,!and", "value").select("file", "line_no")


@query("posting_phrase_conversations", f"""WITH {lines_cte('conversations')}, t AS (SELECT file, line_no, ' ' || trim(regexp_replace(
    strip_accents(lower(value)), '[^\\pL\\pN]+', ' ', 'g')) || ' ' AS tok FROM ln)
  SELECT file, line_no FROM t WHERE contains(tok, ' the ') OR contains(tok, ' can you ') OR contains(tok, ' how do i ')""")
def posting_phrase_conversations(spark, sf):
    lines = text_lines(spark, sf, "conversations")
    return _indexed(spark, lines).search(lines, "The, can you ,how do I", "value").select("file", "line_no")


PHRASES = ("of the", "de la", "and of the", "for the first time")


def _looked_at_sql(phrase: str) -> str:
    words = sorted(set(phrase.split()))
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""SELECT '{phrase}' AS phrase,
  (SELECT token FROM (VALUES {", ".join(f"('{w}')" for w in words)}) w(token) LEFT JOIN d USING (token)
   ORDER BY coalesce(blocks, 0), token LIMIT 1) AS rarest,
  (SELECT min(coalesce(blocks, 0)) FROM (VALUES {", ".join(f"('{w}')" for w in words)}) w(token) LEFT JOIN d USING (token)) AS rarest_blocks,
  CAST((SELECT coalesce(sum(blocks), 0) FROM d WHERE token IN ({listed})) AS BIGINT) AS all_blocks,
  CAST({len(words)} * (SELECT count(*) FROM (SELECT file, block FROM p WHERE token IN ({listed}) GROUP BY file, block
    HAVING count(DISTINCT token) = {len(words)})) AS BIGINT) AS read_blocks"""


@query("posting_blocks", f"""WITH {lines_cte()}, p AS (SELECT DISTINCT file, line_no // 1024 AS block, unnest(string_split(trim(regexp_replace(
    strip_accents(lower(value)), '[^\\pL\\pN]+', ' ', 'g')), ' ')) AS token FROM ln),
  d AS (SELECT token, count(*) AS blocks FROM p WHERE token <> '' GROUP BY token)
  """ + " UNION ALL ".join(f"({_looked_at_sql(p)})" for p in PHRASES))
def posting_blocks(spark, sf):
    """What phrases look at: postings of the blocks of their rarest token, of all there are."""
    index = PostingTable(spark, scratch_folder(spark, "postings"))
    index.append(text_lines(spark, sf), "value")
    return reduce(DataFrame.unionByName, [index.looked_at(p) for p in PHRASES])


@query("count_filtered", f"{A} SELECT count(*) AS n FROM r WHERE code = '500'")
def count_filtered(spark, sf):
    return filters.count_filtered(event_rows(spark, sf, "apache"), FilterSpec(code="500"))


PRESETS = (Presets().add("errors", FilterSpec(level="ERR")).add("old", FilterSpec(q="x"))
           .add("quiet", FilterSpec(level="!ERR,!WRN")).add("late", FilterSpec(dt_from="2024-01-20"))
           .add("old", FilterSpec(q="purchase")).remove("late"))


@query("presets_count", f"""{G} SELECT 'errors' AS preset, count(*) FILTER (WHERE level = 'ERR') AS n FROM r UNION ALL
  SELECT 'quiet', count(*) FILTER (WHERE level NOT IN ('ERR', 'WRN')) FROM r UNION ALL
  SELECT 'old', count(*) FILTER (WHERE contains(search, 'purchase')) FROM r""")
def presets_count(spark, sf):
    saved = Presets.from_table(PRESETS.to_table(spark))
    return filters.count_by_preset(event_rows(spark, sf), saved)


@query("owner_isolation", f"{G} SELECT line_no, owner FROM r WHERE owner = 'u1'")
def owner_isolation(spark, sf):
    return filters.for_owner(event_rows(spark, sf), "u1").select("line_no", "owner")


@query("page_rows", f"""{G} SELECT line_no, raw FROM r WHERE level = 'ERR' ORDER BY line_no LIMIT 100 OFFSET 200""")
def page_rows(spark, sf):
    return paging.page(event_rows(spark, sf), FilterSpec(level="ERR"), page=3, size=100).select("line_no", "raw")


@query("deep_page", f"""WITH {lines_cte()} SELECT file, line_no FROM ln ORDER BY file, line_no LIMIT 700 OFFSET 6300""")
def deep_page(spark, sf):
    rows = parse_raw(text_lines(spark, sf))
    return paging._deep_page(rows, 6300, 700).select("file", "line_no")


@query("indexed_page", f"""WITH {rows_cte('generic')} SELECT line_no, raw, level FROM r WHERE owner = 'u1'
  ORDER BY line_no LIMIT 200 OFFSET 200 * (SELECT count(*) // 300 FROM r WHERE owner = 'u1')""")
def indexed_page(spark, sf):
    """A page two thirds into a stored dataset, through the ordinal index."""
    path = scratch_folder(spark, "rows")
    tables.append_rows(event_rows(spark, sf), path)
    rows = tables.read_rows(spark, path)
    ordinals.write_ordinals(rows, path + "-ordinals")
    number = rows.filter("owner = 'u1'").count() // 300 + 1
    index = ordinals.read_ordinals(spark, path + "-ordinals")
    return ordinals.indexed_page(rows, index, "u1", "generic", number, 200).select("line_no", "raw", "level")


@query("keyset_page", f"""{A} SELECT line_no, ip, code FROM r WHERE code = '404' AND line_no > 4000
  ORDER BY line_no LIMIT 250""")
def keyset_page(spark, sf):
    return paging.keyset_page(event_rows(spark, sf, "apache"), FilterSpec(code="404"),
                              ("apache.log", 4000), 250).select("line_no", "ip", "code")


@query("display_columns", f"WITH {rows_cte('syslog')} SELECT ts, host, app, pid, msg FROM r")
def display_columns(spark, sf):
    return paging.display(event_rows(spark, sf, "syslog"), "syslog")


@query("filter_text_beyond_cut", f"""WITH {lines_cte()}, w AS (SELECT file, line_no, value FROM ln WHERE length(value) > 620)
  SELECT file, line_no, CAST(length(value) AS BIGINT) AS n_chars FROM w WHERE contains(lower(substr(value, 601)), 'tion')""")
def filter_text_beyond_cut(spark, sf):
    """Free text is found wherever it stands in a line, and the row holds the whole line."""
    rows = parse_raw(text_lines(spark, sf))
    found = filters.apply_filter(rows, FilterSpec(q="tion")).filter("char_length(msg) > 620")
    tail = F.lower(F.substring("raw", 601, 1 << 30))
    return found.filter(tail.contains("tion")).select("file", "line_no", F.char_length("raw").cast("long").alias("n_chars"))
