"""An index of spans of minutes: every span lies in one bin of a size like its own, so that a window finds what overlaps it by bins alone.

A span of n minutes goes to level k, the least with n <= 2**k, and there to the bin of 2**k minutes that it begins in; it
reaches the next bin at most. What overlaps [low, high] is then, on each level, in the bins from one before low's to
high's: both ends prune, and long spans don't widen the search for short ones. Bins of a level are stored by slots of about a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer spans than 2**TOP minutes (two years) aren't expected; they go to the top level, which is searched whole.
TOP = 20
#: Levels below this one are stored in slots of 2**SLOT minutes, the others in one slot a bin.
SLOT = 11


def binned(spans: DataFrame, low: str = "run_start", high: str = "run_end") -> DataFrame:
    """The spans [low, high], both included, with ``level``, ``slot`` and ``bin``."""
    length = F.greatest(F.col(high) - F.col(low) + 1, F.lit(1))
    level = F.least(F.ceil(F.log2(length.cast("double"))), F.lit(TOP)).cast("int")
    bin_ = F.floor(F.col(low) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    slot = F.floor(F.col(low) / F.pow(F.lit(2.0), F.greatest(F.col("level"), F.lit(SLOT)))).cast("long")
    return spans.withColumn("level", level).withColumn("bin", bin_).withColumn("slot", slot)


def overlapping(low: int, high: int, start: str = "run_start", end: str = "run_end") -> Column:
    """Whether a binned span overlaps [low, high], both included: by slots and bins, and then by its ends."""
    inside = F.col("level") == TOP
    for k in range(TOP):
        size, wide = 1 << k, 1 << max(k, SLOT)
        # A span reaches into the bin after its own, never further.
        first = low - size + 1
        inside = inside | ((F.col("level") == k) & F.col("slot").between(first // wide, high // wide) & F.col("bin").between(low // size - 1, high // size))
    return inside & (F.col(start) <= high) & (F.col(end) >= low)
