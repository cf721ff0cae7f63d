"""Spans of regex matches with SQL functions alone, and their textual digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

#: start, order of the kind, end, kind: sorts as the contract says.
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def running_sums(values: Column) -> Column:
    """The sums of an array's heads, by doubling: n elements take log2(n) passes, and no array grows element by element."""

    def double(sums: Column, k: Column) -> Column:
        return let(F.power(F.lit(2), k).cast("int"), lambda d: F.transform(sums, lambda x, i: F.when(i >= d, x + F.get(sums, i - d)).otherwise(x)))

    passes = F.ceil(F.log2(F.size(values).cast("double"))).cast("int")
    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(F.sequence(F.lit(0), passes - 1), values, double))


def find_spans(text: Column, pattern: str, kind: str, rank: int, keep=None) -> Column:
    """All leftmost non-overlapping matches as SPAN; ``keep`` tells from the matched string which ones stay.

    The pieces between matches and the matches themselves alternate, so running sums of their lengths give the
    positions in code points; n matches take n log n steps. Matches must not be empty.
    """

    def place(matches: Column) -> Column:
        def walk(pieces: Column) -> Column:
            lengths = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))

            def spans(ends: Column) -> Column:
                def span(m: Column, i: Column) -> Column:
                    made = F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.lit(rank).alias("rank"), F.get(ends, i).alias("end"), F.lit(kind).alias("kind"))
                    return made if keep is None else F.when(keep(m), made)

                return F.array_compact(F.transform(matches, span)).cast(SPAN)

            return let(let(lengths, running_sums), spans)

        return let(F.split(text, pattern, -1), walk)

    # One pass decides for the many texts without a match.
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(F.array().cast(SPAN))


def join_spans(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    said = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(said, ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
