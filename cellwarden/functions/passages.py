"""The passage of a text that holds most of the asked terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cellwarden.functions.text import TOKEN

_TOKEN = re.compile(TOKEN)
_FOUND = "start long, stop long, first_token int, last_token int, distinct_terms int"


def best_window(places: list[int], terms: list[str], width: int) -> tuple[int, int, int]:
    """First and last token and distinct terms of the window with most distinct terms in ``width`` tokens; then the shortest, then the first.

    ``places`` are the rising token numbers of hits, ``terms`` the term of each. Both ends move only forwards.
    """
    best, low, inside = (0, 0, -1), 0, {}
    for high, term in enumerate(terms):
        inside[term] = inside.get(term, 0) + 1
        while places[high] - places[low] >= width or inside[terms[low]] > 1:
            inside[terms[low]] -= 1
            if not inside[terms[low]]:
                del inside[terms[low]]
            low += 1
        found = (len(inside), places[low] - places[high], -places[low])
        if best[2] < 0 or found > (best[0], best[1] - best[2], -best[1]):
            best = (len(inside), places[low], places[high])
    return best[1], best[2], best[0]


def _locate(lowered: pd.Series, terms: pd.Series, width: int) -> pd.DataFrame:
    rows = []
    for text, asked in zip(lowered, terms):
        spans = [m.span() for m in _TOKEN.finditer(text or "")]
        wanted = set(asked if asked is not None else ())
        hits = [(i, text[a:b]) for i, (a, b) in enumerate(spans) if text[a:b] in wanted]
        if not hits:
            rows.append((None, None, None, None, 0))
            continue
        first, last, distinct = best_window([i for i, _ in hits], [t for _, t in hits], width)
        begin = max(0, first - (width - (last - first + 1)) // 2)
        end = min(len(spans), begin + width) - 1
        rows.append((spans[begin][0], spans[end][1], first, last, distinct))
    frame = pd.DataFrame(rows, columns=["start", "stop", "first_token", "last_token", "distinct_terms"])
    return frame.astype({c: "Int64" for c in frame.columns})


def passage(text: Column, terms: Column, width: int) -> Column:
    """Struct of the passage, the window of the terms in it (tokens from 0) and how many distinct ones it holds.

    The passage is the window, widened to ``width`` tokens of the text, as it is written there; null without a hit.
    """
    lowered = F.lower(text)
    found = F.pandas_udf(lambda t, asked: _locate(t, asked, width), _FOUND)(lowered, terms)
    # Lower-casing keeps the number of characters but for a few letters; then the lower-cased text is shown.
    shown = F.when(F.length(text) == F.length(lowered), text).otherwise(lowered)
    return F.struct(
        F.substr(shown, (found["start"] + 1).cast("int"), (found["stop"] - found["start"]).cast("int")).alias("passage"),
        found["first_token"].alias("first_token"), found["last_token"].alias("last_token"), found["distinct_terms"].alias("distinct_terms"),
    )
