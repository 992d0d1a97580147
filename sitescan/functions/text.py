"""Text checks of detected plates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyword_check(texts: Column, keywords: Column, conf: Column, short_side: Column, least_conf: float = 0.25, least_side: float = 60.0, least_text: float = 0.3) -> Column:
    """Keywords that the read words contain: words (array<struct<text, conf>>) of enough confidence, in capitals, joined by spaces.
    Null (not checked) for a weak or small detection or a product without keywords."""
    words = F.array_join(F.transform(F.filter(texts, lambda t: t.conf >= least_text), lambda t: F.upper(t.text)), " ")
    found = F.filter(keywords, lambda k: F.contains(words, F.upper(k)))
    return F.when((conf >= least_conf) & (short_side >= least_side) & (F.size(keywords) > 0), found)
