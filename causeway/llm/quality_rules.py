"""Quality rules as a short-circuit cascade.

Word and line statistics of the whole text decide the base rule. The other rules form a cascade: each rule's cost
and share of rejections are estimated on a sample, and a document meets the rules in order of rejections per cost
until one rejects it. The order changes only how much is computed; the verdict is the same in any order.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, persist_shared, text_of

#: Fixed value: the characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
SAMPLE_ROWS = 1000
#: How often a rule is tried on each row of the sample, until its own time stands out.
REPEATS = (4, 32, 256)


def _repeat_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the text."""
    starts = F.sequence(F.lit(0), F.size(words) - 3)

    def covered(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)

        def at(i: Column) -> Column:
            return F.get(sorted_windows, i)["g"]

        twice = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: ((i > 0) & (at(i) == at(i - 1))) | ((i < n - 1) & (at(i) == at(i + 1))),
        )
        spots = F.transform(twice, lambda i: let(F.get(sorted_windows, i)["p"], lambda p: F.array(p, p + 1, p + 2)))
        return F.size(F.array_distinct(F.flatten(spots)))

    def window(i: Column) -> Column:
        # Words hold no spaces, so joined windows are equal only if their words are.
        return F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("p"))

    exact = let(F.sort_array(F.transform(starts, window)), covered)
    # Equal windows have equal fingerprints: texts whose fingerprints all differ need no sort.
    prints = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(starts, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))),
    )
    some = let(prints, lambda p: F.size(F.array_distinct(p)) < F.size(p))
    return F.when(F.size(words) < 4, 0).when(some, exact).otherwise(0).cast("long")


def _word_stats(text: Column) -> Column:
    def stats(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), stats)


def _line_stats(text: Column) -> Column:
    def stats(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    return let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), stats)


def text_stats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, _text and n_words, word_chars, n_repeat_words, n_symbols, n_lines, n_dup_lines."""
    text = text_of(docs, text_col)
    symbols = F.length(F.regexp_replace(text, SYMBOLS.replace("[", "[^") + "+", "")).cast("long")
    out = docs.select(*[docs[c] for c in keep], text.alias("_text"), _word_stats(text).alias("w"), _line_stats(text).alias("l"), symbols.alias("n_symbols"))
    return out.select(*keep, "_text", "w.*", "l.*", "n_symbols")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a boolean over the columns of ``text_stats``."""

    name: str
    rejects: Column


def default_rules(duplicate_share: float = 0.3, fewest_duplicates: int = 4) -> tuple[Rule, ...]:
    """Thresholds of common web-text heuristics.

    Lines that repeat earlier ones reject a text if they are more than ``duplicate_share`` of its lines and at least
    ``fewest_duplicates``: in a short text one repeated header or footer is a large share. 0 turns that exemption off.
    """
    text = F.col("_text")
    letters, upper = F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    return (
        Rule("symbols", F.col("n_symbols") > 0.1 * F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 2.5 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("duplicate_lines", (F.col("n_dup_lines") > duplicate_share * F.col("n_lines")) & (F.col("n_dup_lines") >= fewest_duplicates)),
        Rule("shouting", upper > 0.4 * letters),
        Rule("exclamations", F.regexp_count(text, F.lit("!")) > 0.2 * F.col("n_words")),
        Rule("letterless_words", F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")) > 0.3 * F.col("n_words")),
        Rule("ellipsis_lines", F.regexp_count(text, F.lit(r"(?m)(\.\.\.|…)[ \t]*$")) > 0.3 * F.col("n_lines")),
        Rule("bullet_lines", F.regexp_count(text, F.lit(r"(?m)^[ \t]*[•‣*-][ \t]")) > 0.9 * F.col("n_lines")),
    )


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """name, cost (seconds for one row), rejected (share of the sample), in the order in which to apply the rules.

    The sample holds about ``sample_rows`` rows, each drawn on its own. A rule is tried on the sample repeated in one
    job, more often until it takes as long as the same job without it: a job's own time then hides no rule's cost.
    """
    total = docs.count()
    if not total:
        return [{"name": r.name, "cost": 0.0, "rejected": 0.0} for r in rules]
    some = docs if total <= sample_rows else docs.sample(sample_rows / total, seed=3)
    sample = persist_shared(text_stats(some, text_col, ()), "quality-sample")
    n = sample.count()
    if not n:
        return [{"name": r.name, "cost": 0.0, "rejected": 0.0} for r in rules]
    idle: dict[int, float] = {}

    def timed(what: Column, times: int) -> tuple[float, float]:
        began = time.perf_counter()
        repeated = sample.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.lit(times))))
        share = float(repeated.agg(F.avg(F.coalesce(what, F.lit(False)).cast("double"))).first()[0])
        return time.perf_counter() - began, share

    def tried(rule: Rule) -> dict:
        for times in REPEATS:
            if times not in idle:
                idle[times] = min(timed(F.col("_nth") < 0, times)[0] for _ in range(2))
            took, share = timed(rule.rejects, times)
            if took > 2 * idle[times]:
                break
        return {"name": rule.name, "cost": max(took - idle[times], idle[times] / 100) / (times * n), "rejected": share}

    return sorted(map(tried, rules), key=lambda x: (-x["rejected"] / x["cost"], x["cost"], x["name"]))


def quality_filter(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: tuple[Rule, ...] | None = None, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the statistics, base_failed, kept.

    Null and empty texts have no words and fail the base rule; very long texts are counted whole; repeated rows, and rows
    with a null id, are judged one by one; rules that tie in rejections per cost are met by cost, then name, which changes
    no verdict; an empty table gives an empty result; other columns are ignored, so clashing names cannot arise.
    """
    rules = default_rules() if rules is None else rules
    by_name = {r.name: r for r in rules}
    cascade = F.when(base_failed(), False)
    for x in order_rules(docs, rules, text_col, sample_rows):
        cascade = cascade.when(F.coalesce(by_name[x["name"]].rejects, F.lit(False)), False)
    stats = text_stats(docs, text_col, (id_col,)).withColumnRenamed(id_col, "doc_id")
    return stats.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), cascade.otherwise(True).alias("kept"),
    )
