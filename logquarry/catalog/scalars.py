"""Column functions over whole tables."""

from pyspark.sql import functions as F

from logquarry import functions as C
from logquarry.catalog.base import (EV, event_lines, event_rows, events, lines_cte, query, rows_cte, table,
                                    text_lines)
from logquarry.functions.text import PROMPT, PROMPT_LANGUAGE


@query("norm_ts_forms", f"""WITH {EV} SELECT event_id, form,
  CASE form WHEN 'iso' THEN exact WHEN 'zone' THEN exact WHEN 'clf' THEN whole WHEN 'epoch' THEN whole
    WHEN 'millis' THEN CASE WHEN substr(fine, 10, 3) = '000' THEN whole ELSE whole || '.' || substr(fine, 10, 3) || '000' END
    WHEN 'day' THEN day || 'T00:00:00' ELSE '' END AS ts_norm
  FROM ev, (VALUES ('iso'), ('zone'), ('clf'), ('epoch'), ('millis'), ('day'), ('word')) f(form)""")
def norm_ts_forms(spark, sf):
    t = F.col("ts").cast("timestamp")
    shifted = t + F.expr("INTERVAL 2 HOURS")
    forms = {
        "iso": F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "zone": F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00")),
        "clf": F.concat(F.date_format(shifted, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0200")),
        "epoch": F.unix_seconds(t).cast("string"),
        "millis": F.unix_millis(t).cast("string"),
        "day": F.date_format(t, "yyyy-MM-dd"),
        "word": F.col("event_type"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("form"), v.alias("text")) for k, v in forms.items()])
    return (events(spark, sf).select("event_id", F.inline(pairs))
            .select("event_id", "form", C.norm_ts(F.col("text")).alias("ts_norm")))


@query("norm_level", f"WITH {EV} SELECT event_id, level, 'x-' || lvl AS unknown FROM ev")
def norm_level(spark, sf):
    return events(spark, sf).select("event_id", C.norm_level(F.col("lvl")).alias("level"),
                                    C.norm_level(F.concat(F.lit("x-"), "lvl")).alias("unknown"))


@query("truncate_msg", "SELECT doc_id, CASE WHEN length(text) > 600 THEN left(text, 600) || ' ...' ELSE text END AS msg"
       " FROM documents")
def truncate_msg(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.truncate(F.col("text")).alias("msg"))


@query("first_ipv4", f"WITH {rows_cte('generic')} SELECT line_no, ip FROM r")
def first_ipv4(spark, sf):
    return event_rows(spark, sf).select("line_no", C.first_ipv4(F.col("raw")).alias("ip"))


@query("status_class", f"""WITH {EV} SELECT event_id, substr(code, 1, 1) || 'xx' AS class, '' AS none FROM ev""")
def status_class(spark, sf):
    return events(spark, sf).select("event_id", C.status_class(F.col("code")).alias("class"),
                                    C.status_class(F.col("event_type")).alias("none"))


@query("csv_guard", f"""WITH {lines_cte()} SELECT file, line_no, CASE WHEN left(cell, 1) IN
  ('=', '+', '-', '@', chr(9), chr(13), chr(10)) THEN '''' || cell ELSE cell END AS cell FROM (
  SELECT file, line_no, CASE line_no % 4 WHEN 0 THEN '=' || value WHEN 1 THEN '@' || value ELSE value END AS cell
  FROM ln)""")
def csv_guard(spark, sf):
    n = F.col("line_no") % 4
    lead = F.when(n == 0, "=").when(n == 1, "@").otherwise("")
    return text_lines(spark, sf).select(
        "file", "line_no", C.csv_cell(F.concat(lead, "value")).alias("cell"))


@query("safe_names", """SELECT page_id, CASE WHEN n = '' THEN 'subido' ELSE n END AS name FROM (
  SELECT page_id, replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^A-Za-z0-9.\\-_]', '_', 'g'), '..', '')
  AS n FROM pages)""")
def safe_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.safe_base_name(F.col("url")).alias("name"))


@query("answer_key", "SELECT doc_id, sha256('local' || chr(0) || 'es' || chr(0) || text) AS hash FROM documents")
def answer_key(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", C.answer_key(F.col("text"), F.lit("local"), F.lit(" ES ")).alias("hash"))


@query("prompt_by_lang", f"""SELECT doc_id, '{PROMPT}' || CASE lang WHEN 'es' THEN '{PROMPT_LANGUAGE['es']}'
  WHEN 'en' THEN '{PROMPT_LANGUAGE['en']}' ELSE '{PROMPT_LANGUAGE['auto']}' END AS prompt FROM documents""")
def prompt_by_lang(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.system_prompt(F.col("lang")).alias("prompt"))


def _escape_sql(x: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        x = f"replace({x}, '{raw}', '{safe}')"
    return x


@query("highlight_terms", f"""SELECT page_id, replace(replace({_escape_sql(
    "regexp_replace(html, '(amp|div|class=)', chr(1) || '\\1' || chr(2), 'gi')")},
    chr(1), '<mark>'), chr(2), '</mark>') AS shown FROM pages""")
def highlight_terms(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", C.highlight(F.col("html"), ["amp", "div", "class="]).alias("shown"))


@query("search_text", f"WITH {rows_cte('syslog')} SELECT line_no, search FROM r")
def search_text(spark, sf):
    return event_rows(spark, sf, "syslog").select("line_no", "search")


@query("sql_functions", f"""WITH {rows_cte('generic')} SELECT level, template, count(*) AS n, min(ts_norm) AS first
  FROM r GROUP BY level, template""")
def sql_functions(spark, sf):
    """Clusters written in SQL with the registered functions."""
    C.register_sql_functions(spark)
    event_lines(spark, sf, "generic").createOrReplaceTempView("lq_lines")
    return spark.sql("""
        SELECT lq_norm_level(split(value, ' ')[2]) AS level, lq_make_template(lq_truncate(value)) AS template,
               count(*) AS n, min(lq_norm_ts(left(value, 26))) AS first
        FROM lq_lines GROUP BY 1, 2""")
