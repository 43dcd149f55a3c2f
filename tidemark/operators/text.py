"""Text scalars of headlines and posts as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BULLISH, BEARISH, NEGATIONS = ("the", "with", "pour"), ("and", "that", "les"), ("not", "no", "is")


def normalise(text) -> Column:
    """Lower case without links, addresses and punctuation, blanks collapsed."""
    x = F.regexp_replace(F.lower(text), "https?://[^ \n]+|[^ \n]+@[^ \n]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9 ]", " "), " +", " "))


def tickers(text) -> Column:
    """Distinct runs of two to five capitals, sorted, without common ones."""
    runs = F.filter(F.regexp_extract_all(text, F.lit("[A-Z]+"), F.lit(0)), lambda x: F.length(x).between(2, 5))
    return F.array_sort(F.array_except(F.array_distinct(runs), F.array(*map(F.lit, ("THE", "AND", "FOR")))))


def lexicon_score(text) -> Column:
    """(bullish - bearish) / (1 + both) over words; a negation flips the next three words. A fold over the words."""
    state = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(0).alias("flip"))

    def step(s, w):
        sign = F.when(w.isin(*BULLISH), 1).when(w.isin(*BEARISH), -1).otherwise(0) * F.when(s["flip"] > 0, -1).otherwise(1)
        flip = F.when(w.isin(*NEGATIONS), 3).otherwise(F.greatest(s["flip"] - 1, F.lit(0)))
        return F.struct((s["up"] + F.when(sign > 0, 1.0).otherwise(0.0)).alias("up"), (s["down"] + F.when(sign < 0, 1.0).otherwise(0.0)).alias("down"), flip.alias("flip"))

    return F.aggregate(F.split(normalise(text), " "), state, step, lambda s: (s["up"] - s["down"]) / (1 + s["up"] + s["down"]))
