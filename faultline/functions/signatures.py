"""The catalogue of error signatures and the Columns that apply it to a text.

The catalogue lives on the driver and is compiled into literal Columns: one scan of the text column, no join, no
shuffle, and each pattern is compiled once per task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.functions.text import split_lines, strip
from faultline.schemas import CATEGORIES, SEVERITIES


@dataclass(frozen=True)
class Signature:
    name: str
    category: str
    severity: str
    regexes: tuple[str, ...]
    description: str
    recommendation: str


# Family, category, severity, regexes, description, recommendation.  Order matters.
CATALOGUE = [
    Signature("java_oom", "resource_exhaustion", "high",
              (r"java\.lang\.OutOfMemoryError", r"Java heap space", r"GC overhead limit exceeded", r"Metaspace"),
              "Java process ran out of memory", "Increase executor memory or optimize data partitioning"),
    Signature("python_oom", "resource_exhaustion", "high",
              (r"MemoryError", r"Cannot allocate memory", r"killed.*OOM", r"OOMKilled"),
              "Python process ran out of memory", "Reduce batch size or increase container memory limits"),
    Signature("disk_full", "resource_exhaustion", "critical",
              (r"No space left on device", r"Disk quota exceeded", r"ENOSPC"),
              "Disk space exhausted", "Clean up temporary files or increase disk allocation"),
    Signature("timeout", "resource_exhaustion", "medium",
              (r"TimeoutError", r"timed out", r"deadline exceeded", r"execution timeout"),
              "Operation timed out", "Increase timeout or optimize the operation"),
    Signature("column_not_found", "schema_mismatch", "high",
              (r"column.*not found", r"KeyError.*column", r"no such column", r"Unknown column",
               r"AnalysisException.*cannot resolve"),
              "Expected column not found in data", "Verify source schema and update transformation"),
    Signature("type_mismatch", "schema_mismatch", "medium",
              (r"cannot cast", r"type mismatch", r"invalid type", r"TypeError.*expected", r"cannot be converted to"),
              "Data type mismatch", "Add type casting or fix source data types"),
    Signature("parse_error", "schema_mismatch", "medium",
              (r"parse error", r"JSON.*invalid", r"malformed", r"unexpected token", r"XMLSyntaxError"),
              "Failed to parse input data", "Check source data format and parser configuration"),
    Signature("connection_refused", "source_unavailable", "high",
              (r"Connection refused", r"ECONNREFUSED", r"Could not connect", r"Connection reset"),
              "Cannot connect to external service", "Check if the source service is running and accessible"),
    Signature("http_5xx", "source_unavailable", "high",
              (r"HTTP 5\d{2}", r"500 Internal Server Error", r"502 Bad Gateway", r"503 Service Unavailable",
               r"504 Gateway Timeout"),
              "External API returned server error", "Check external service status and retry"),
    Signature("dns_failure", "source_unavailable", "high",
              (r"Name or service not known", r"getaddrinfo failed", r"DNS resolution failed", r"NXDOMAIN"),
              "DNS resolution failed", "Check network configuration and DNS settings"),
    Signature("null_constraint", "data_quality", "medium",
              (r"NOT NULL constraint", r"null value in column.*violates", r"Cannot insert NULL"),
              "NULL value violates constraint", "Add NULL handling or fix source data"),
    Signature("unique_violation", "data_quality", "medium",
              (r"unique constraint", r"duplicate key", r"IntegrityError.*UNIQUE"),
              "Duplicate key violation", "Add deduplication logic or use UPSERT"),
    Signature("assertion_failed", "data_quality", "medium",
              (r"AssertionError", r"data quality check failed", r"expectation.*failed",
               r"Great Expectations.*failed"),
              "Data quality assertion failed", "Investigate data quality issue in source"),
    Signature("auth_failure", "permission_error", "high",
              (r"401 Unauthorized", r"403 Forbidden", r"Access Denied", r"PermissionDenied",
               r"authentication failed"),
              "Authentication or authorization failed", "Check credentials and permissions"),
    Signature("token_expired", "permission_error", "medium",
              (r"token.*expired", r"JWT.*expired", r"session.*expired", r"credential.*expired"),
              "Authentication token expired", "Refresh authentication tokens"),
    Signature("ssl_error", "network_error", "high",
              (r"SSL.*error", r"certificate verify failed", r"SSLError", r"CERTIFICATE_VERIFY_FAILED"),
              "SSL/TLS connection error", "Check SSL certificates and configuration"),
]

# Case-insensitive, only "\n" ends a line, Unicode classes and case folding.
DIALECT = "(?idU)"

MATCH_TYPE = (
    "array<struct<sig_idx:int,name:string,category:string,severity:string,description:string,"
    "recommendation:string,matches:array<string>>>"
)


def catalogue(custom: list[Signature] | None = None) -> list[Signature]:
    """The default families, or ``custom`` in their place (an empty list does not replace them)."""
    chosen = list(custom) if custom else CATALOGUE
    for signature in chosen:
        if signature.category not in CATEGORIES or signature.severity not in SEVERITIES:
            raise ValueError(f"unknown category or severity in signature {signature.name!r}")
        for regex in signature.regexes:
            if re.compile(regex).groups > 1:
                raise ValueError(f"at most one group allowed in {regex!r}")
    return chosen


def signature_catalog(spark: SparkSession, custom: list[Signature] | None = None) -> DataFrame:
    """The catalogue as a small table, one row per regex."""
    rows = [
        (sig_idx, rx_idx, s.name, s.category, s.severity, regex, s.description, s.recommendation)
        for sig_idx, s in enumerate(catalogue(custom))
        for rx_idx, regex in enumerate(s.regexes)
    ]
    return spark.createDataFrame(
        rows,
        "sig_idx int, rx_idx int, name string, category string, severity string, regex string, "
        "description string, recommendation string",
    )


def ranked(signatures: list[Signature]) -> list[tuple[int, Signature]]:
    """(catalogue index, signature), most severe first, ties in catalogue order."""
    return sorted(enumerate(signatures), key=lambda pair: SEVERITIES.index(pair[1].severity))


def is_plain(regex: str) -> bool:
    """Only literals, ``.*`` and digit classes: such a regex never crosses lines and has no anchors."""
    return re.fullmatch(r"(?:[A-Za-z0-9_ /'\-]|\\\.|\.\*|\\d(?:\{\d+\})?)+", regex) is not None


def required_literal(regex: str) -> str | None:
    """The longest plain ASCII piece that any match must contain, lower-cased; None if the regex is not that simple."""
    if not is_plain(regex):
        return None
    pieces = [p.replace(r"\.", ".") for p in re.split(r"\.\*|\\d(?:\{\d+\})?", regex)]
    longest = max(pieces, key=len).lower()
    return longest if len(longest) >= 3 else None


def any_word(words: list[str], folds: dict[str, str]) -> str:
    """A regex that finds any of the lower-case words in either case, without flags.

    Words that share their first letters share that part of the regex, so a position of the text costs one test per
    first letter and not one per word.  ``folds`` adds letters that count as a given one.
    """
    kept = [w for w in set(words) if not any(o != w and w.startswith(o) for o in words)]

    def branch(rest: list[str]) -> str:
        if "" in rest:
            return ""
        heads = sorted({w[0] for w in rest})
        parts = [letter(h) + branch([w[1:] for w in rest if w[0] == h]) for h in heads]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    def letter(char: str) -> str:
        if char.isalpha():
            return f"[{char}{char.upper()}{folds.get(char, '')}]"
        return re.escape(char)

    return branch(kept)


# Letters that case folding takes for an ASCII one.
FOLDS = {"i": "\u0131\u0130", "s": "\u017f", "k": "\u212a"}


def screen(text: Column, signatures: list[Signature]) -> Column:
    """A cheap necessary condition for ``any_signature``: true if the text holds some regex's literal."""
    words = [required_literal(regex) for s in signatures for regex in s.regexes]
    return F.lit(True) if None in words else text.rlike(any_word(words, FOLDS))


def is_linewise(signatures: list[Signature]) -> bool:
    """True if no match can cross lines and no anchor sees where a line is cut."""
    return all(is_plain(regex) for s in signatures for regex in s.regexes)


def folded(text: Column) -> Column:
    """Lower case, with the four letters that fold to ASCII only under Unicode case folding."""
    return F.lower(F.translate(text, "\u0131\u0130\u017f\u212a", "iisk"))


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _find_all(text: str, folded_text: str, regex: str) -> str:
    group = 1 if re.compile(regex).groups else 0
    found = f"regexp_extract_all({text}, {sql_text(DIALECT + regex)}, {group})"
    literal = required_literal(regex)
    # Plain byte search first: a regex runs only over a text that can match it.
    return found if literal is None else f"if(contains({folded_text}, {sql_text(literal)}), {found}, null)"


def family_matches(text: str, folded_text: str, signatures: list[Signature]) -> Column:
    """Families that occur in the text column, with their matches in (regex, position) order.

    The array is laid out in severity order on the driver, so the first element is the primary error.  It is written as
    one SQL expression: hundreds of literal Columns would cost a call to the JVM each.
    """
    families = []
    for index, s in ranked(signatures):
        found = ", ".join(_find_all(text, folded_text, regex) for regex in s.regexes)
        fields = {
            "sig_idx": str(index), "name": sql_text(s.name), "category": sql_text(s.category),
            "severity": sql_text(s.severity), "description": sql_text(s.description),
            "recommendation": sql_text(s.recommendation),
            "matches": f"flatten(array_compact(array({found}, cast(null as array<string>))))",
        }
        families.append("named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")")
    return F.expr(f"filter(array({', '.join(families)}), family -> size(family.matches) > 0)")


def any_signature(line: Column, signatures: list[Signature]) -> Column:
    """True where a line matches any regex of any family."""
    joined = "|".join(f"(?:{regex})" for s in signatures for regex in s.regexes)
    return screen(line, signatures) & line.rlike(f"{DIALECT}(?:{joined})")


def candidate_lines(text: Column, signatures: list[Signature]) -> Column:
    """The lines that may match, as an array: all that later steps need to read where matching is line-wise."""
    return F.filter(split_lines(text), lambda line: screen(line, signatures))


def key_lines(lines: Column, signatures: list[Signature], limit: int = 10) -> Column:
    """The first ``limit`` lines in log order that match anything, stripped."""
    hits = F.filter(lines, lambda line: any_signature(line, signatures))
    return F.transform(F.slice(hits, 1, limit), strip)
