"""The target mix that op4 and the pipeline's last stage share, over the columns of `documents`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Target mix of op4 and of the pipeline's last stage.
WEIGHTS = {
    "domain": {"hub": 2, "even": 5, "odd": 3},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    "source": {"src1": 3, "src2": 2},
}
SEED, EPOCHS = 7, 3
WORDS = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS))


def domain(source: Column) -> Column:
    """The test tables name no domain: the hot source is one, the others split by the parity of their number."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d+)$", 1)
    odd = F.substring(number, -1, 1).isin("1", "3", "5", "7", "9")
    return F.when(source == "src0", "hub").when(odd, "odd").otherwise("even")


def total_tokens() -> Column:
    """Half of what the leaves hold in one epoch."""
    return F.expr("sum(tokens) div 2")
