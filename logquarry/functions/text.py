"""Text functions of a log row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry import fixed_values as V
from logquarry.functions.patterns import java_regex

# One alternation does the work of the three successive replacements: each part
# is bounded by \b on both sides, so what one part takes never changes where
# another may start. The look-ahead only skips positions cheaply.
TEMPLATE_PATTERN = java_regex(
    rf"(?=[\da-fA-F])\b(?:{V.TEMPLATE_IP}|{V.TEMPLATE_HEX}|{V.TEMPLATE_NUMBER})\b")


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def norm_level(c: Column) -> Column:
    """Known spellings to INF WRN ERR CRIT DBG; anything else as given."""
    names = F.create_map(*[F.lit(x) for pair in V.LEVEL_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.upper(c)), c)


def first_ipv4(c: Column) -> Column:
    return F.regexp_extract(c, java_regex(V.IPV4), 1)


def make_search(row: dict[str, Column]) -> Column:
    return F.lower(F.concat_ws(" ", *[blank(row[f]) for f in V.SEARCH_FIELDS]))


def make_template(c: Column) -> Column:
    return F.regexp_replace(blank(c), TEMPLATE_PATTERN, "*")


def truncate(c: Column, at: int = V.TRUNCATE_AT) -> Column:
    c = blank(c)
    return F.when(F.char_length(c) > at,
                  F.concat(F.left(c, F.lit(at)), F.lit(V.TRUNCATE_MARK))).otherwise(c)


def csv_cell(c: Column) -> Column:
    """Guard against spreadsheet formulas."""
    c = blank(c)
    return F.when(F.left(c, F.lit(1)).isin(*V.CSV_RISKY_STARTS),
                  F.concat(F.lit("'"), c)).otherwise(c)


def number_or_null(c: Column, kind: str) -> Column:
    return F.when(c.rlike(r"^[0-9]+$"), c.try_cast(kind))


def status_class(code: Column) -> Column:
    """2xx 3xx 4xx 5xx by upper bound; '' when there is no leading number."""
    n = F.regexp_extract(code, r"^\s*([+-]?[0-9]+)", 1).try_cast("long")
    return (F.when(n.isNull(), "").when(n < 300, "2xx").when(n < 400, "3xx")
            .when(n < 500, "4xx").otherwise("5xx"))


def safe_base_name(name: Column) -> Column:
    base = F.element_at(F.split(name, "/"), -1)
    safe = F.replace(F.regexp_replace(base, r"[^A-Za-z0-9.\-_]", "_"), F.lit(".."), F.lit(""))
    return F.when(safe == "", "subido").otherwise(safe)


def level_rank(level: Column) -> Column:
    order = F.array(*[F.lit(x) for x in V.LEVEL_ORDER])
    at = F.array_position(order, level)
    return F.when(at > 0, at).otherwise(F.lit(len(V.LEVEL_ORDER) + 1)).cast("int")


def norm_lang(c: Column) -> Column:
    lang = F.lower(F.trim(blank(c)))
    return F.when(lang.isin(*V.ANSWER_LANGUAGES), lang).otherwise("auto")


def answer_key(line: Column, model: Column, lang: Column) -> Column:
    """SHA-256 of model, language and text, NUL-separated."""
    nul = F.lit(b"\x00")
    model = F.when(blank(model) == "", "local").otherwise(model)
    return F.sha2(F.concat(F.encode(model, "UTF-8"), nul, F.encode(norm_lang(lang), "UTF-8"),
                           nul, F.encode(blank(line), "UTF-8")), 256)


PROMPT = ("You are a log analyst. Given one log line, say what is going on, name the likely"
          " cause and list concrete next steps. Keep it short.")
PROMPT_LANGUAGE = {
    "auto": " Answer in the language of the line.",
    "es": " Answer in Spanish, whatever the language of the line.",
    "en": " Answer in English, whatever the language of the line.",
}


def system_prompt(lang: Column) -> Column:
    tails = F.create_map(*[F.lit(x) for pair in PROMPT_LANGUAGE.items() for x in pair])
    return F.concat(F.lit(PROMPT), F.element_at(tails, norm_lang(lang)))


def template_item(count: Column, template: Column, example: Column) -> Column:
    return F.format_string(V.TEMPLATE_ITEM, count, template, blank(example))
