"""Conversion between scripts by a dictionary of phrases: the longest phrase that starts at a place is replaced, from left to right."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The most phrases of a dictionary: it goes to every task.
MOST_PHRASES = 1 << 20


def dictionary(phrases: DataFrame, source: str = "source", target: str = "target") -> dict[str, str]:
    """A table of phrases as a dictionary; ValueError if it has more than ``MOST_PHRASES``, an empty source, or two targets for one."""
    rows = phrases.select(source, target).distinct().limit(MOST_PHRASES + 1).collect()
    found = {r[0]: r[1] for r in rows}
    if len(rows) > MOST_PHRASES or len(found) < len(rows) or "" in found or None in found or None in found.values():
        raise ValueError("a dictionary has at most one target for each phrase, none of them empty")
    return found


def converted(text: Column, phrases: dict[str, str]) -> Column:
    """STR-23: a text with its phrases replaced, whole phrases before the characters in them; null stays null."""
    if not phrases:
        return text

    # where a phrase may begin, and how long those are that begin so, longest first
    lengths: dict[str, list[int]] = {}
    for source in phrases:
        held = lengths.setdefault(source[0], [])
        if len(source) not in held:
            held.append(len(source))
    lengths = {first: sorted(held, reverse=True) for first, held in lengths.items()}
    begins = re.compile("[" + "".join(map(re.escape, lengths)) + "]")

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        parts, at, seek = [], 0, 0
        while m := begins.search(t, seek):
            p = seek = m.start()
            for n in lengths[m[0]]:
                if (target := phrases.get(t[p : p + n])) is not None:
                    parts += (t[at:p], target)
                    at = seek = p + n
                    break
            else:
                seek = p + 1
        return "".join(parts) + t[at:]

    # rows go to Python a hundred at a time; Arrow's batches would be of ten thousand whole texts, several times over in each process
    return F.udf(one, StringType(), useArrow=False)(text)


def normalized(text: Column, language: Column, phrases: dict[str, str]) -> Column:
    """Chinese texts converted, others as they are; a language is its code up to a dash or underscore."""
    return F.when(F.lower(F.regexp_extract(language, r"^[A-Za-z]+", 0)).isin("zh", "yue", "cmn"), converted(text, phrases)).otherwise(text)
