"""Runbooks, line context, answers and diagnosis."""

from pyspark.sql import functions as F

from logquarry import schema
from logquarry.catalog.base import (EV, event_rows, lines_cte, query, rows_cte, table,
                                    template_sql, text_lines)
from logquarry.operators import answers, context, runbooks
from logquarry.operators.parsers import parse_raw
from logquarry.session import settle

# id, pattern, kind
PATTERNS = (
    (1, r"error from 10\.[0-2]", "regex"), (2, "*purchase*took ??", "glob"), (3, r"user \d5 ", "regex"),
    (4, "([", "regex"), (5, "signup", "regex"), (6, "user [!1-8]* view *", "glob"), (7, "", "regex"),
    (8, "no such text", "regex"))
HITS = {1: r"error from 10\.[0-2]", 2: r"^.*purchase.*took ..$", 3: r"user \d5 ", 5: "signup",
        6: r"^user [^1-8].* view .*$", 8: "no such text"}


def books(spark):
    return spark.createDataFrame(
        [(i, p, k, f"why {i}", "", "", "", "2024-01-01 00:00:00") for i, p, k in PATTERNS],
        schema.RUNBOOK_SCHEMA)


G = f"WITH {rows_cte('generic')}"
MATCH = " UNION ALL ".join(
    f"SELECT line_no, CAST({i} AS BIGINT) AS id FROM r WHERE regexp_matches(msg, '{p}')" for i, p in HITS.items())


@query("runbook_match", f"{G} {MATCH}")
def runbook_match(spark, sf):
    return runbooks.match_runbooks(event_rows(spark, sf), books(spark), keep=("line_no",))


@query("runbook_match_conversations", """SELECT c.conv_id, c.turn, CAST(p.id AS BIGINT) AS id FROM conversations c,
  (VALUES (1, '\\d{3,}'), (2, '[Tt]he '), (3, '^.*\\?.*$')) p(id, pattern) WHERE regexp_matches(c.text, p.pattern, 's')""")
def runbook_match_conversations(spark, sf):
    small = spark.createDataFrame(
        [(1, r"\d{3,}", "regex", "", "", "", "", ""), (2, "[Tt]he ", "regex", "", "", "", "", ""),
         (3, "*[?]*", "glob", "", "", "", "", "")], schema.RUNBOOK_SCHEMA)
    return runbooks.match_runbooks(table(spark, sf, "conversations"), small, message="text",
                                   keep=("conv_id", "turn"))


@query("runbook_many", f"""{G} SELECT line_no, CAST(user_id AS BIGINT) AS id FROM r
    WHERE user_id < 2000 AND right(raw, 1) = right(CAST(user_id AS VARCHAR), 1)
  UNION ALL SELECT line_no, 5000 FROM r WHERE regexp_matches(msg, '[0-9]{{5}}$')
  UNION ALL SELECT line_no, 5001 FROM r WHERE regexp_matches(msg, '^.*purchase.*took ..$')
  UNION ALL SELECT line_no, 5002 FROM r WHERE regexp_matches(msg, 'error from 10.1|signup from 10.2')""")
def runbook_many(spark, sf):
    """Two thousand patterns with one automaton before them, some without a text to look for."""
    many = [(i, rf"user {i} .* took \d*{i % 10}$", "regex") for i in range(2000)]
    many += [(5000, r"\d{5}$", "regex"), (5001, "*purchase*took ??", "glob"),
             (5002, r"(?i)(ERROR|signup (?=from 10\.2))( FROM 10\.1|from 10)", "regex"), (5003, "(never|seen) this", "regex")]
    table = spark.createDataFrame([(*m, "", "", "", "", "") for m in many], schema.RUNBOOK_SCHEMA)
    return runbooks.match_runbooks(event_rows(spark, sf), table, keep=("line_no",))


@query("runbook_coverage", f"{G}, m AS ({MATCH}) SELECT CAST(p.id AS BIGINT) AS id, p.pattern, count(m.id) AS n FROM (VALUES "
       + ", ".join(f"({i}, '{p}')" for i, p, _ in PATTERNS)
       + ") p(id, pattern) LEFT JOIN m ON m.id = p.id GROUP BY p.id, p.pattern")
def runbook_coverage(spark, sf):
    return runbooks.coverage(event_rows(spark, sf), books(spark))


@query("runbook_unmatched", f"{G} SELECT line_no, msg FROM r WHERE line_no NOT IN (SELECT line_no FROM ({MATCH}))")
def runbook_unmatched(spark, sf):
    return runbooks.unmatched(event_rows(spark, sf), books(spark)).select("line_no", "msg")


def _suggested(spark, sf):
    """A runbook per event type, with its template's text as a glob."""
    return (event_rows(spark, sf, "syslog").select(F.concat(F.lit("*"), "app", F.lit("*")).alias("pattern"))
            .distinct().withColumn("kind", F.lit("glob")))


@query("runbook_add", """SELECT id, pattern, kind FROM (SELECT 5 + row_number() OVER (ORDER BY pattern) AS id, pattern,
    'glob' AS kind FROM (SELECT DISTINCT '*' || event_type || '*' AS pattern FROM events) WHERE pattern <> '*click*')
  UNION ALL SELECT 5, '*click*', 'glob'""")
def runbook_add(spark, sf):
    base = spark.createDataFrame([(5, "*click*", "glob", "", "", "", "", "")], schema.RUNBOOK_SCHEMA)
    return runbooks.add_runbooks(base, _suggested(spark, sf), on_conflict="ignore").select("id", "pattern", "kind")


@query("runbook_edit_delete", """SELECT id, pattern, CASE WHEN pattern = '*error*' THEN 'seen ' || n ELSE '' END AS causa
  FROM (SELECT row_number() OVER (ORDER BY event_type) AS id, '*' || event_type || '*' AS pattern, count(*) AS n
  FROM events GROUP BY event_type) WHERE id <> 1""")
def runbook_edit_delete(spark, sf):
    empty = spark.createDataFrame([], schema.RUNBOOK_SCHEMA)
    base = runbooks.add_runbooks(empty, _suggested(spark, sf))
    seen = event_rows(spark, sf, "syslog").filter("app = 'error'").agg(F.count("*").alias("n"))
    edit = (base.filter("pattern = '*error*'").drop("causa").withColumn("_k", F.lit(1))
            .join(F.broadcast(seen.withColumn("_k", F.lit(1))), "_k")
            .withColumn("causa", F.concat(F.lit("seen "), "n")).drop("_k", "n"))
    return runbooks.delete_runbook(runbooks.update_runbooks(base, edit), 1).select("id", "pattern", "causa")


@query("context_lines", f"""WITH {lines_cte()} SELECT t.file, t.line_no AS target, l.line_no, l.line_no + 1 AS shown_line,
  CASE WHEN l.line_no < t.line_no THEN 'before' WHEN l.line_no > t.line_no THEN 'after' ELSE 'current' END AS position,
  l.value FROM ln t JOIN ln l ON l.file = t.file AND l.line_no BETWEEN t.line_no - 2 AND t.line_no + 2
  WHERE contains(lower(t.value), 'license')""")
def context_lines(spark, sf):
    lines = text_lines(spark, sf)
    return context.context(lines, lines.filter(F.lower("value").contains("license")), 2)


@query("context_frame", f"""WITH {lines_cte()} SELECT file, line_no,
  coalesce(string_agg(value, chr(10)) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(value, chr(10)) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after
  FROM ln""")
def context_frame(spark, sf):
    return context.context_frame(text_lines(spark, sf), 2)


# --- answers ---------------------------------------------------------------

def stub(prompt: str) -> tuple[bool, str]:
    """Stands for a model: refuses texts with an even number of characters."""
    return (len(prompt) % 2 == 1, f"{len(prompt)} chars: {prompt[:20]}")


KEY = "sha256('local' || chr(0) || 'auto' || chr(0) || {0})"


def _requests(spark, sf):
    from logquarry.functions import answer_key
    lines = text_lines(spark, sf).filter("value != ''").select(F.col("value").alias("line"))
    return lines.withColumn("hash", answer_key(F.col("line"), F.lit("local"), F.lit("auto")))


def _cache(spark, sf):
    """Answers already known: lines that start with a letter up to m."""
    known = _requests(spark, sf).filter(F.lower(F.left("line", F.lit(1))).between("a", "m"))
    return known.groupBy("hash").agg(F.min("line").alias("line")).select(
        "hash", "line", F.concat(F.lit("known "), F.left("line", F.lit(5))).alias("answer"),
        F.lit("2024-01-01 00:00:00").alias("created_at"))


Q = f"""WITH {lines_cte()}, q AS (SELECT value AS line, {KEY.format('value')} AS hash,
  lower(left(value, 1)) BETWEEN 'a' AND 'm' AS hit FROM ln WHERE value <> '')"""


@query("cache_split", f"""{Q} SELECT CASE WHEN hit THEN 'hit' ELSE 'miss' END AS kind, hash,
  CASE WHEN hit THEN 'known ' || left(line, 5) ELSE '' END AS answer, CASE WHEN hit THEN count(*) ELSE 1 END AS n
  FROM q GROUP BY hash, hit, line""")
def cache_split(spark, sf):
    hits, misses = answers.cache_split(_requests(spark, sf), _cache(spark, sf))
    hits = hits.groupBy("hash", "answer").agg(F.count("*").alias("n"))
    return hits.select(F.lit("hit").alias("kind"), "hash", "answer", "n").unionByName(
        misses.select(F.lit("miss").alias("kind"), "hash", F.lit("").alias("answer"), F.lit(1).cast("bigint").alias("n")))


@query("cache_insert_ignore", f"""{Q} SELECT DISTINCT hash, line,
  CASE WHEN hit THEN 'known ' || left(line, 5) ELSE 'new' END AS answer FROM q""")
def cache_insert_ignore(spark, sf):
    new = _requests(spark, sf).select("hash", "line", F.lit("new").alias("answer"),
                                      F.lit("2024-02-01 00:00:00").alias("created_at"))
    return answers.insert_or_ignore(_cache(spark, sf), new).select("hash", "line", "answer")


@query("enrich_answers_stub", f"""{Q} SELECT DISTINCT hash, hit AS cached, hit OR length(line) % 2 = 1 AS ok,
  CASE WHEN hit THEN 'known ' || left(line, 5) ELSE length(line) || ' chars: ' || left(line, 20) END AS answer FROM q""")
def enrich_answers_stub(spark, sf):
    got, _ = answers.enrich_answers(_requests(spark, sf).select("line"), _cache(spark, sf), stub)
    return got.select("hash", "cached", "ok", "answer")


# One dataset per source; document lines stand for imported rows without a level.
DIAG = f"""WITH {lines_cte()}, d AS (SELECT d.source AS dataset, ln.file, ln.line_no,
    ln.value AS raw
    FROM ln JOIN documents d ON CAST(d.doc_id AS VARCHAR) = ln.file),
  g AS (SELECT dataset, template, count(*) AS n,
    arg_min(raw, file || chr(1) || lpad(CAST(line_no AS VARCHAR), 12, '0')) AS example
    FROM (SELECT *, {template_sql('raw')} AS template FROM d) WHERE template <> '' GROUP BY dataset, template),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, template) AS rank FROM g)
    WHERE rank <= 200),
  i AS (SELECT *, 'PLANTILLA (' || n || ' ocurrencias):' || chr(10) || template || chr(10) || 'Ejemplo: ' || example AS item,
    CAST(floor((rank - 1) / 50) AS INTEGER) AS batch FROM k)"""


def _chosen(spark, sf):
    names = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), "source")
    rows = parse_raw(text_lines(spark, sf)).join(names, "file").withColumns(
        {"dataset": F.col("source"), "format": F.lit("results"), "level": F.lit("")})
    return answers.select_templates(rows, "ERR")


@query("diagnose_templates", f"{DIAG} SELECT dataset, CAST(rank AS INTEGER) AS rank, template, n, example FROM k")
def diagnose_templates(spark, sf):
    return _chosen(spark, sf)


@query("diagnose_level", f"""WITH {EV}, {rows_cte('generic').split('FROM events),', 1)[1]} SELECT owner AS dataset, CAST(1 AS INTEGER) AS rank,
  template, count(*) AS n, arg_min(raw, line_no) AS example FROM r WHERE level = 'ERR' GROUP BY owner, template""")
def diagnose_level(spark, sf):
    """Datasets with rows of the level are described by those only."""
    return answers.select_templates(event_rows(spark, sf).withColumn("dataset", F.col("owner")), "ERR")


@query("diagnose_batches", f"""{DIAG}, b AS (SELECT dataset, batch, CAST(count(*) AS INTEGER) AS size,
    string_agg(item, chr(10) || chr(10) ORDER BY rank) AS items FROM i GROUP BY dataset, batch)
  SELECT dataset, batch, size, CAST(sum(size) OVER (PARTITION BY dataset) AS BIGINT) AS total,
  batch = max(batch) OVER (PARTITION BY dataset) AS is_last, items FROM b""")
def diagnose_batches(spark, sf):
    return answers.diagnose_batches(_chosen(spark, sf))


@query("diagnose_key", f"""{DIAG} SELECT dataset, count(*) AS analyzed, sha256('m' || chr(0) || 'en' || chr(0) || dataset || chr(1)
  || 'ERR' || chr(1) || string_agg(item, chr(1) ORDER BY rank)) AS hash FROM i GROUP BY dataset""")
def diagnose_key(spark, sf):
    return answers.diagnose_keys(_chosen(spark, sf), "ERR", "m", "en")


def count_items(prompt: str) -> tuple[bool, str]:
    """Stub for the fold: adds the batch's items to the count carried along."""
    before = 0
    if prompt.startswith("Summary of the batches so far:\n"):
        before = int(prompt.split("\n")[1])
    return True, str(before + prompt.count("PLANTILLA ("))


@query("diagnose_report", f"""{DIAG} SELECT dataset, CAST(count(*) AS VARCHAR) AS conclusion, count(*) AS analyzed,
  string_agg(n || ' ' || template, chr(10) ORDER BY rank) FILTER (WHERE rank <= 10) AS top FROM i GROUP BY dataset""")
def diagnose_report(spark, sf):
    chosen = settle(_chosen(spark, sf))
    folded = answers.diagnose(answers.diagnose_batches(chosen), count_items)
    report = answers.diagnose_report(chosen, folded)
    line = F.transform("top", lambda t: F.concat_ws(" ", t["n"], t["template"]))
    return report.select("dataset", "conclusion", "analyzed", F.array_join(line, "\n").alias("top"))
