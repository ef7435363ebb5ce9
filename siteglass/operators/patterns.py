"""Page types by a table of URL patterns, however many: an index of the texts that a pattern can't do without.

A pattern that matches a URL has its literal parts in it. Of each pattern's literal parts the three-letter piece that the fewest patterns have is indexed;
the pieces of a URL find its candidates by a join on the piece, and only those are matched. Patterns without such a part are candidates everywhere.
"""

from __future__ import annotations

import re
import re._constants as K
import re._parser as parser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

GRAM = 3
#: Different patterns that are broadcast at most (counted first); more are joined by a shuffle. Results are equal.
BROADCAST_PATTERNS = 20_000


def literal_parts(pattern: str) -> list[str]:
    """Texts that every match of a regular expression contains, in lower case; none where the expression can't be read."""
    runs: list[str] = [""]

    def walk(sequence) -> None:
        for kind, value in sequence:
            if kind is K.LITERAL:
                runs[-1] += chr(value)
            elif kind is K.SUBPATTERN:
                walk(value[3])
            elif kind in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] >= 1:
                runs.append("")
                walk(value[2])
                runs.append("")
            elif kind is not K.AT:  # a place has no width; all else ends a literal part
                runs.append("")

    try:
        walk(parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return []
    # A letter whose lower-case form is longer or depends on its neighbours isn't relied on.
    return [r.lower() for r in runs if r and r.isascii()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parts(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: [] if p is None else literal_parts(p))


def _grams(text: Column) -> Column:
    last = F.length(text) - (GRAM - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, GRAM)))).otherwise(F.array().cast("array<string>"))


def index(patterns: DataFrame, how: str = "merge") -> DataFrame:
    """``patterns`` (pattern_id, pattern, page_type, priority) with ``gram``, the indexed piece; empty where there is none.

    The joins have a hint, ``how``: Spark takes the size of a computed table for that of the few columns it is made from, and would broadcast
    one of any size. Only for a counted, bounded table is "broadcast" in place; it spares the tasks of frequent pieces.
    """
    each = patterns.withColumn("_grams", F.flatten(F.transform(_parts("pattern"), _grams)))
    counts = each.select(F.explode(F.array_distinct("_grams")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    rarest = each.select("pattern_id", F.explode(F.array_distinct("_grams")).alias("gram")).join(counts.hint(how), "gram").groupBy("pattern_id").agg(F.min(F.struct("n", "gram")).alias("best"))
    return patterns.join(rarest.select("pattern_id", F.col("best.gram").alias("gram")).hint(how), "pattern_id", "left").withColumn("gram", F.coalesce("gram", F.lit("")))


def least_of_equals(patterns: DataFrame) -> DataFrame:
    """One row per different pattern: of equal ones only that of the least priority, then id, can be a first match. Null patterns are left out."""
    row = F.struct("pattern_id", "page_type", "priority")
    least = patterns.where(F.col("pattern").isNotNull()).groupBy("pattern").agg(F.min_by(row, F.struct("priority", "pattern_id")).alias("_least"))
    return least.select("pattern", "_least.*")


def first_matches(urls: DataFrame, patterns: DataFrame, url: str = "url", default: str = "unknown") -> DataFrame:
    """(url, page_type, pattern_id) per distinct url: of the patterns found in it that of the least priority, then id; ``default`` and null if none.

    ``patterns``: pattern_id (unique), pattern, page_type, priority. A null url or pattern matches nothing. Patterns with case folded by a flag
    are found as well, as pieces are compared in lower case.
    """
    different = least_of_equals(patterns)
    how = "broadcast" if different.count() <= BROADCAST_PATTERNS else "merge"
    table = index(different, how).hint(how)
    distinct = urls.select(F.col(url).alias("url")).distinct()
    pieces = distinct.select("url", F.explode(F.concat(F.array(F.lit("")), _grams(F.lower("url")))).alias("gram"))
    best = (
        pieces.join(table, "gram").where(F.rlike("url", F.col("pattern")))
        .groupBy("url").agg(F.min_by(F.struct("page_type", "pattern_id"), F.struct("priority", "pattern_id")).alias("best"))
    )
    joined = distinct.join(best.hint("merge"), "url", "left")
    return joined.select("url", F.coalesce("best.page_type", F.lit(default)).alias("page_type"), F.col("best.pattern_id").alias("pattern_id"))
