"""Text helpers: LIKE patterns, counts formatted for reports, size text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LIKE_SPECIAL = ("%", "_", "\\")


def contains_pattern(needle: str, upper: bool = True) -> str:
    """``%needle%`` with the source system's escaping rules.

    User text is not escaped, so ``%`` and ``_`` stay wildcards.  A backslash
    escapes the next character; PostgreSQL then matches any escaped
    character literally, while Spark only accepts ``\\%``, ``\\_`` and
    ``\\\\``.  Reading left to right, a backslash that is not followed by one
    of those three is dropped, which gives the same matches.  A trailing user
    backslash escapes the appended ``%`` in both systems.
    """
    text = needle.upper() if upper else needle
    raw = "%" + text + "%"
    out: list[str] = []
    i = 0
    while i < len(raw):
        ch = raw[i]
        if ch == "\\":
            nxt = raw[i + 1] if i + 1 < len(raw) else ""
            if nxt in _LIKE_SPECIAL and nxt != "":
                out.append(ch + nxt)
                i += 2
                continue
            i += 1          # escape of an ordinary character: keep only the character
            continue
        out.append(ch)
        i += 1
    return "".join(out)


def count_text(n: Column | str) -> Column:
    """Integer as ``to_char(n, '999,999,999')`` prints it (width 12)."""
    n = F.col(n) if isinstance(n, str) else n
    return (F.when(n.isNull(), F.lit(None).cast("string"))
            .when(F.abs(n) > 999999999, F.lit("#" * 12))
            .otherwise(F.lpad(F.format_number(n, 0), 12, " ")))


def _half_rounded(c: Column) -> Column:
    # halve, rounding half up (sizes are never negative)
    return F.shiftright(c + 1, 1)


def size_text(nbytes: Column | str) -> Column:
    """Byte count in PostgreSQL's ``pg_size_pretty`` style (non-negative sizes).

    Fixed values: below 10 * 1024 bytes print as bytes; each larger unit
    (kB, MB, GB, TB, PB) is used while the size in half-units of it is below
    20 * 1024 - 1, then rounded half up; the last unit takes all remaining
    sizes.  Integer shifts keep it exact.
    """
    b = (F.col(nbytes) if isinstance(nbytes, str) else nbytes).cast("long")
    units = ["kB", "MB", "GB", "TB", "PB"]
    limit = 20 * 1024 - 1
    expr = F.when(b < 10 * 1024, F.concat(b.cast("string"), F.lit(" bytes")))
    half = F.shiftright(b, 9)            # half-units of kB
    for i, unit in enumerate(units):
        cond = (half < limit) if i < len(units) - 1 else F.lit(True)
        expr = expr.when(cond, F.concat(_half_rounded(half).cast("string"), F.lit(" " + unit)))
        half = F.shiftright(half, 10)
    return expr
