"""Words of a text: runs of three or more letters, case ignored; placeholders, ids, digests and stamps are no words."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_HOLE = re.compile(r"\{[^{}\n]*\}")
#: The full patterns run only where a cheap sign of them is in the text.
_UUID_SIGN = re.compile(r"-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-")
_UUID = re.compile(r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b")
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_MONTH_SIGN = re.compile(_MONTH + r"[ /]{1,2}\d")
_STAMP = re.compile(rf"\b(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? +)?(?:\d{{1,2}}[ /])?{_MONTH}[ /]{{1,2}}(?:\d{{1,2}} \d\d:|\d{{4}}[ :])")
_RUN = re.compile(r"[^\W_]+")


def word_list(text: str) -> list[str]:
    """In order, repeats kept. A run of letters and digits together is an id and no word."""
    if "{" in text:
        text = _HOLE.sub(" ", text)
    if _UUID_SIGN.search(text):
        text = _UUID.sub(" ", text)
    if _MONTH_SIGN.search(text):
        text = _STAMP.sub(" ", text)
    return [w for w in _RUN.findall(text.lower()) if len(w) > 2 and w.isalpha()]


def hash32(words: set[str] | list[str]) -> np.ndarray:
    """Sorted distinct 32-bit hashes."""
    h = xxhash.xxh32_intdigest
    return np.unique(np.fromiter((h(w) for w in words), np.uint32, len(words)))
