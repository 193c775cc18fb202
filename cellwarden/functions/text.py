"""Text columns: tokens, HTML to text, snippets, parts of terms."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters a-z and digits, in order, for the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(TOKEN))


def html_to_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags out, blanks collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def first_hit(text: Column, terms: Column) -> Column:
    """Position (from 1) of the first whole token that is one of ``terms``; 0 if none, or without terms."""
    whole = F.concat(F.lit("(?<![a-z0-9])(?:"), F.array_join(terms, "|"), F.lit(")(?![a-z0-9])"))
    return F.when(F.size(terms) > 0, F.regexp_instr(F.lower(text), whole)).otherwise(0)


def snippet(text: Column, place: Column, width: int) -> Column:
    """``width`` characters of ``text`` around the position ``place``."""
    start = F.greatest(F.lit(1), place - F.lit(width // 2))
    return F.when(place > 0, F.substr(text, start, F.lit(width)))


def _part(length: Column, number: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of one of ``parts`` even parts of a term; the last ones take what is over."""
    even, plain = F.floor(length / parts), parts - length % parts
    return even * number + F.greatest(F.lit(number) - plain, F.lit(0)), even + (F.lit(number) >= plain).cast("int")


def segments(term: Column, max_dist: int) -> Column:
    """The ``max_dist + 1`` parts of a term, each with the term's length and its number."""
    parts = [_part(F.length(term), i, max_dist + 1) for i in range(max_dist + 1)]
    return F.array(*[
        F.struct(
            F.length(term).alias("length"), F.lit(i).alias("number"),
            F.substr(term, (start + 1).cast("int"), size.cast("int")).alias("letters"),
        )
        for i, (start, size) in enumerate(parts)
    ])


def segment_probes(term: Column, max_dist: int) -> Column:
    """The parts that terms within ``max_dist`` edits may have, wherever they may stand in this term."""
    probes = []
    for more in range(-max_dist, max_dist + 1):
        length = F.length(term) + more
        for i in range(max_dist + 1):
            start, size = _part(length, i, max_dist + 1)
            for move in range(-max_dist, max_dist + 1):
                inside = (length >= 0) & (start + move >= 0) & (start + move + size <= F.length(term))
                letters = F.substr(term, (start + move + 1).cast("int"), size.cast("int"))
                probes.append(F.when(inside, F.struct(length.alias("length"), F.lit(i).alias("number"), letters.alias("letters"))))
    return F.array_distinct(F.array_compact(F.array(*probes)))


def bounded_distance(a: str, b: str, most: int) -> int | None:
    """Edit distance of two texts if it is at most ``most``, in time of their length times ``most``."""
    start = len(os.path.commonprefix([a, b]))
    a, b = a[start:], b[start:]
    stop = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - stop], b[: len(b) - stop]
    if abs(len(a) - len(b)) > most:
        return None
    row = {j: j for j in range(min(most, len(b)) + 1)}  # only places beside the diagonal can stay within the bound
    for i, x in enumerate(a, start=1):
        above, row = row, {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            options = [above[j] + 1] if j in above else []
            if j:
                options += [row[j - 1] + 1] if j - 1 in row else []
                options += [above[j - 1] + (x != b[j - 1])] if j - 1 in above else []
            row[j] = min(options)
        if min(row.values()) > most:
            return None
    return row[len(b)] if row.get(len(b), most + 1) <= most else None


def long_distance(a: Column, b: Column, most: int) -> Column:
    """``levenshtein`` with a bound, for long texts: the built-in function takes the product of their lengths. Beyond the bound: -1."""

    def distances(left: pd.Series, right: pd.Series) -> pd.Series:
        found = [bounded_distance(x, y, most) for x, y in zip(left, right)]
        return pd.Series([-1 if d is None else d for d in found], dtype="int32")

    return F.pandas_udf(distances, "int")(a, b)
