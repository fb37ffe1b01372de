"""Level vocabulary of entry headers."""

from __future__ import annotations

LEVEL_OF = {
    "TRACE": "TRACE", "TRC": "TRACE",
    "DEBUG": "DEBUG", "DBG": "DEBUG",
    "INFO": "INFO", "INF": "INFO",
    "WARN": "WARN", "WARNING": "WARN", "WRN": "WARN",
    "ERROR": "ERROR", "ERR": "ERROR",
    "CRITICAL": "CRITICAL", "CRIT": "CRITICAL", "CRT": "CRITICAL",
    "FATAL": "FATAL", "FTL": "FATAL",
}
LETTER_LEVEL = {"D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL"}
LEVEL_ALT = "(?:" + "|".join(sorted(LEVEL_OF, key=len, reverse=True)) + ")"
