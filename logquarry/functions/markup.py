"""HTML-safe highlighting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "\u0001", "\u0002"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def escape_html(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def quote_term(term: str) -> str:
    return "".join("\\" + ch if ch in r".*+?^${}()|[]\-&#~" else ch for ch in term)


def highlight(c: Column, terms: list[str]) -> Column:
    """Wrap every hit of the terms in <mark>, everything escaped.

    Hits are marked on the plain text with two control characters, which turn
    into tags only after escaping, so a term never matches inside an entity.
    Such characters in the text itself are dropped first (they do not render).
    """
    terms = [t for t in terms if t and t.strip()]
    c = F.translate(F.coalesce(c, F.lit("")), OPEN + CLOSE, "")
    if not terms:
        return escape_html(c)
    pattern = "(?iU)(" + "|".join(quote_term(t) for t in terms) + ")"
    marked = escape_html(F.regexp_replace(c, pattern, f"{OPEN}$1{CLOSE}"))
    return F.replace(F.replace(marked, F.lit(OPEN), F.lit("<mark>")),
                     F.lit(CLOSE), F.lit("</mark>"))
