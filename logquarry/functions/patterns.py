"""Regular expressions: dialect flags and one-match group capture."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"


def java_regex(pattern: str, flags: str = "") -> str:
    """Unix line ends and Unicode classes, so \\d \\s \\w \\b mean any script."""
    return f"(?dU{flags}){pattern}"


def whole_line(pattern: str, flags: str = "") -> str:
    """Anchor at the line start and swallow the rest, as a prefix match does."""
    return f"(?dUs{flags})^{pattern}.*$"


def capture(value: Column, pattern: str, groups: int) -> Column:
    """All groups of a `whole_line` pattern from a single match.

    Gives an array whose element i is group i, or an array of another size when
    the line does not match. Extracting each group on its own would repeat the
    match per group. The groups are joined by a control character; a line that
    holds it gets a separator built from the line's own digest instead.
    """
    joined = F.lit(MARK + MARK.join(f"${i}" for i in range(1, groups + 1)))
    held = value.contains(MARK)
    own = F.concat(F.lit(MARK), F.sha2(value, 256), F.lit(MARK))
    marked = F.regexp_replace(
        value, F.lit(pattern), F.when(held, F.replace(joined, F.lit(MARK), own)).otherwise(joined))
    return F.split(marked, F.when(held, own).otherwise(F.lit(MARK)))


def captured(groups: Column, n: int) -> Column:
    return F.coalesce(F.size(groups) == n + 1, F.lit(False))


def glob_to_regex(glob: str) -> str:
    """Shell wildcard to a whole-string regex: * ? [set] [!set], all else literal."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            end = glob.find("]", i + 1 if glob[i:i + 1] != "!" else i + 2)
            if end < 0:
                out.append("\\[")
                continue
            body = glob[i:end]
            i = end + 1
            negate = body.startswith("!")
            body = body[1:] if negate else body
            body = "".join("\\" + c if c in "\\[]^&" else c for c in body)
            out.append(f"[{'^' if negate else ''}{body}]")
        elif ch.isalnum() or ch in " _":
            out.append(ch)
        else:
            out.append("\\" + ch if ch.isascii() else ch)
    return "(?s)^(?:" + "".join(out) + ")\\z"
