"""How metrics are written in training logs and in iteration reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What a log line must look like to count.
EPOCH = r"[Ee]poch\s*[:\[]?\s*(\d+)"
LOSS = r"[Ll]oss[:\s]+([\d.]+)"
ACCURACY = r"[Aa]cc(?:uracy)?[:\s]+([\d.]+)%?"
CONFUSION = r"TP[=:\s]+(\d+).*?FP[=:\s]+(\d+).*?FN[=:\s]+(\d+).*?TN[=:\s]+(\d+)"
PRECISION = r"[Pp]recision[=:\s]+([\d.]+)%?"
RECALL = r"[Rr]ecall[=:\s]+([\d.]+)%?"
F1 = r"[Ff]1[=:\s]+([\d.]+)%?"
FEATURES = r"[Ff]eatures?[=:\s]+(\d+)"
PARAMS = r"[Pp]arams?[=:\s]+([\d,]+)"

# The lines of an iteration report.
REPORT_ACCURACY = r"Accuracy:\s*([\d.]+)%"
REPORT_ACTIONS = r"Actions:\s*(.+)"
REPORT_JOB = r"Job ID:\s*(\S+)"
REPORT_FEATURES = r"Features:\s*(\d+)"
REPORT_STOP = r"(?i)Should Stop:\s*(true|false)"
REPORT_REASON = r"Reason:\s*(.+)"


def captured(text: str | Column, pattern: str, group: int = 1) -> Column:
    """The captured text of the first match, NULL without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def stripped(text: str | Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def metric(line: Column, hint: str, pattern: str, kind: str, group: int = 1) -> Column:
    """A number from a log line; NULL if absent or malformed.

    ``hint`` is literal text every match contains. Most lines lack it, and
    looking for it costs far less than running the pattern. No match gives an
    empty text, which is no number either.
    """
    text = F.replace(F.regexp_extract(line, pattern, group), F.lit(","), F.lit(""))
    return F.when(line.contains(hint), text.try_cast(kind))
