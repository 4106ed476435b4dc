"""LIKE: byte-wise and case-sensitive; only an unescaped % is a wildcard, a backslash takes the next character literally."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(pattern: str) -> list[str]:
    """The literal texts around the wildcards; runs of wildcards are one.  A trailing backslash is itself."""
    out, now, i = [], [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            now.append(pattern[i + 1])
            i += 2
            continue
        if c == "%":
            if not (out and not now and pattern[i - 1] == "%" and i):
                out.append("".join(now))
                now = []
        else:
            now.append(c)
        i += 1
    out.append("".join(now))
    return _merged(out)


def _merged(texts: list[str]) -> list[str]:
    """Drops empty texts between wildcards."""
    return [t for i, t in enumerate(texts) if t or i in (0, len(texts) - 1)] if len(texts) > 1 else texts


def like(column: Column, pattern: str) -> Column:
    """Null for a null column; the simple shapes compile to predicates that Parquet scans can use."""
    p = parts(pattern)
    if len(p) == 1:
        return column == F.lit(p[0])
    if len(p) == 2:
        head, tail = p
        if not head and not tail:
            return column.isNotNull()
        if not tail:
            return F.startswith(column, F.lit(head))
        if not head:
            return F.endswith(column, F.lit(tail))
        both = F.startswith(column, F.lit(head)) & F.endswith(column, F.lit(tail))
        return both & (F.char_length(column) >= len(head) + len(tail))
    if len(p) == 3 and not p[0] and not p[2]:
        return F.contains(column, F.lit(p[1]))
    return column.rlike(regex(p))


def regex(p: list[str]) -> str:
    """Atomic groups fix the leftmost match of each inner text, so matching is linear in the text."""

    def quoted(t: str) -> str:
        return "".join(f"\\x{{{ord(c):x}}}" for c in t)

    inner = "".join(f"(?>.*?{quoted(t)})" for t in p[1:-1])
    return rf"(?s)\A{quoted(p[0])}{inner}.*{quoted(p[-1])}\z"
