"""Ranked search as Column expressions: subsequence scores, parsed queries, filters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the score: a run's n-th neighbour, a skipped character, a word start,
# a place, an exact match, and letters and digits swapped.
RUN, GAP, START, PLACE, EXACT, SWAPPED = 5.0, 2.0, 10.0, 0.1, 100.0, 5.0
BEFORE_WORD = r"[\s\-_./:]"


def _subsequence(query: str, text: Column) -> Column:
    """Score of a lower-case literal as a subsequence of lower-case text; null if it is none."""
    start = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("run"), F.lit(0.0).alias("score"), F.lit(True).alias("ok"))

    def step(s: Column, c: Column) -> Column:
        i = F.position(c, text, s["at"] + 2) - 1
        near = i == s["at"] + 1
        run = F.when(near, s["run"] + 1).otherwise(0)
        moved = F.when(near, -RUN * (s["run"] + 1)).when(s["at"] >= 0, GAP * (i - s["at"] - 1)).otherwise(0.0)
        word = F.when((i == 0) | F.rlike(F.substr(text, i, F.lit(1)), F.lit(BEFORE_WORD)), -START).otherwise(0.0)
        found = s["ok"] & (i >= 0)
        return F.struct(F.when(found, i).otherwise(s["at"]).alias("at"), run.alias("run"), F.when(found, s["score"] + moved + word + PLACE * i).otherwise(s["score"]).alias("score"), found.alias("ok"))

    end = F.aggregate(F.array(*[F.lit(c) for c in query]), start, step)
    return F.when(end["ok"], end["score"] - F.when(text == query, EXACT).otherwise(0.0))


def fuzzy_score(query: str, text: Column) -> Column:
    """Score of query in text, smaller is better; null where it does not match."""
    query, low = query.lower(), F.lower(text)
    if not query:
        return F.lit(0.0)
    own = _subsequence(query, low)
    parts = re.fullmatch(r"([a-z]+)([0-9]+)|([0-9]+)([a-z]+)", query)
    if not parts:
        return own
    a, b = [p for p in parts.groups() if p]
    return F.coalesce(own, _subsequence(b + a, low) + SWAPPED)


def query_score(query: str, text: Column) -> Column:
    """Summed score of a query's tokens: `re:` takes the rest as a regular expression,
    quoted phrases must occur, other tokens match fuzzily. Null where one fails."""
    query = query.strip()
    if query.startswith("re:"):
        return F.when(F.rlike(text, F.lit("(?i)" + query[3:].strip())), 0.0)
    scores = []
    for phrase, token in re.findall(r'"([^"]*)"|([^\s/"]+)', query):
        if token:
            scores.append(fuzzy_score(token, text))
        elif phrase.strip():
            at = F.instr(F.lower(text), " ".join(phrase.lower().split()))
            scores.append(F.when(at > 0, (at - 1) * PLACE))
    return reduce(lambda a, b: a + b, scores, F.lit(0.0))


def ranked(df: DataFrame, query: str, text: str, newest: str | None = None) -> DataFrame:
    """Rows that match, best first, then newest first."""
    out = df.withColumn("score", query_score(query, F.col(text))).where("score is not null")
    return out.orderBy("score", *([F.desc(newest)] if newest else []))
