"""Plain word splitting for comparisons."""

import re


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")
