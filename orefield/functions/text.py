"""Text functions as column expressions: hashing, COBOL areas, replacing, redaction, estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a line, besides the line feed itself.
LINE_ENDS = "\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
#: Characters that are blank at the end of a line: the white space of Unicode.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: Kinds and patterns of sensitive text, in the order in which they are replaced.
REDACTIONS = (
    ("SSN", r"\b\d{3}[- ]?\d{2}[- ]?\d{4}\b"),
    ("CARD", r"\b(?:\d[ -]?){13,19}\b"),
    ("IBAN", r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{1,30})\b"),
    ("ROUTING", r"\b\d{9}\b"),
    ("CRED", r"(?i)\b(PASS|PASSWORD|PWD|USERID|USER)\s*=\s*\S+"),
    ("FTP_CRED", r"(?i)^\s*USER\s+\S+|^\s*PASS\s+\S+"),
    ("TOKEN", r"\b[0-9a-fA-F]{32,}\b"),
)
LABEL = "[REDACTED]"


def with_line_feeds(text: Column) -> Column:
    """Text in which every line end is a line feed."""
    return F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), LINE_ENDS, "\n" * len(LINE_ENDS))


def lines(text: Column) -> Column:
    """Lines of a text; a line end at the very end begins no further line, an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(with_line_feeds(text), r"\n\z", ""), "\n", -1))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text without blanks at line ends and with plain line feeds."""
    return F.sha2(F.array_join(F.transform(lines(text), lambda x: F.rtrim(x, F.lit(BLANKS))), "\n"), 256)


def content_area(line: Column) -> Column:
    """Columns 8 to 72 of a COBOL line; nothing of a comment line."""
    mark = F.substring(line, 7, 1)
    area = (
        F.when((F.length(line) >= 7) & mark.isin("*", "/"), "")
        .when((F.length(line) >= 7) & ~mark.isin(" ", "-"), F.substring(line, 1, 72))
        .when(F.length(line) > 7, F.substring(line, 8, 65))
        .otherwise(line)
    )
    return F.rtrim(area, F.lit(" \t\n\x0b\f\r"))


def without_literals(text: Column) -> Column:
    return F.regexp_replace(text, r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"", "")


def replace_pairs(text: Column, pairs: Column) -> Column:
    """Replace every ==from== by its partner, pair after pair; ``pairs`` is an array of structs (from, to)."""
    return F.aggregate(pairs, text, lambda s, p: F.replace(s, F.concat(F.lit("=="), p["from"], F.lit("==")), p["to"]))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(name: Column) -> Column:
    return F.lower(F.translate(name, " _", "--"))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def redact(text: Column, patterns: Sequence[tuple[str, str]] = REDACTIONS, label: str = LABEL, overrides: dict[str, str] | None = None) -> Column:
    """Text with every match replaced by ``label:KIND``, kind after kind, and the literals of ``overrides`` by their names."""
    for kind, pattern in patterns:
        text = F.regexp_replace(text, pattern, f"{label}:{kind}".replace("$", "\\$"))
    for name, value in (overrides or {}).items():
        if value:
            text = F.replace(text, F.lit(value), F.lit(f"{label}:{name}"))
    return text


def redaction_counts(text: Column, patterns: Sequence[tuple[str, str]] = REDACTIONS, label: str = LABEL) -> Column:
    """Array of (kind, n): matches of each kind, counted on the text as the kinds before left it."""
    out = []
    for kind, pattern in patterns:
        out.append(F.struct(F.lit(kind).alias("kind"), F.regexp_count(text, F.lit(pattern)).cast("bigint").alias("n")))
        text = F.regexp_replace(text, pattern, f"{label}:{kind}")
    return F.filter(F.array(*out), lambda c: c["n"] > 0)
