"""URL filter: allow and block rules, then a character language-model ratio for the URLs that no rule fits.

Two smoothed variable-order Markov models, of URLs that rules accept and of URLs that rules reject, are counted as
tables of character n-grams. Orders are interpolated (Witten-Bell), so a context that was never seen hands over to
the next shorter one. A URL's score is the difference of its two log-likelihoods over its length; the threshold is
calibrated on rule-judged URLs that the models haven't counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, persist_shared

#: Fixed values: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
ORDER = 4
FOLDS = 5
#: Characters that URLs are taken to be drawn from when nothing is known of them.
ALPHABET = 128
#: At most so many of the most frequent n-grams are broadcast (some megabytes).
HOT_GRAMS = 50_000
#: The unit in which log-likelihood differences are summed.
UNIT = 1e-9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """host, lower-cased where ASCII, and path; both empty without ``://``."""
    tail = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(tail, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)


def apply_rules(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """rule and its verdict, of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def grams_of(told: Column, order: int) -> Column:
    """Each character of ``told``, and its end, behind its context of ``order`` characters; linear in the length.

    The text is split into characters once: reading substrings by position would walk it from its start each time.
    """

    def all_grams(chars: Column) -> Column:
        pads = order + F.size(chars) + 1  # with the starts and the end
        at = lambda i: F.when(i < order, "\x02").when(i < pads - 1, F.get(chars, i - order)).otherwise("\x03")
        return F.transform(F.sequence(F.lit(0), F.size(chars)), lambda i: F.concat(*[at(i + k) for k in range(order + 1)]))

    return let(F.regexp_extract_all(told, F.lit("(?s)."), F.lit(0)), all_grams)


def fit_models(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, allow, block: counts of the n-grams of the highest order in the URLs with each ``verdict``."""
    grams = urls.select("verdict", F.explode(grams_of(F.col("told"), order)).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block"))
    return persist_shared(counts, "url-models")


def gram_ratios(models: DataFrame, grams: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n_seen, ratio: occurrences of each distinct n-gram and its log-likelihood difference under both models, in UNIT.

    Whole units, so that sums of ratios don't depend on the order in which they are added.
    """
    out = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n_seen")).withColumn("p_allow", F.lit(1.0 / ALPHABET)).withColumn("p_block", F.lit(1.0 / ALPHABET))
    for k in range(order + 1):
        seen = models.groupBy(F.substring("gram", order - k + 1, k + 1).alias("sub")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        context = seen.groupBy(F.substring("sub", 1, k).alias("context")).agg(
            *[f(v).alias(n + v) for v in ("allow", "block") for n, f in (("n_", F.sum), ("t_", lambda v: F.count_if(F.col(v) > 0)))]
        )
        out = out.withColumn("sub", F.substring("gram", order - k + 1, k + 1)).withColumn("context", F.substring("gram", order - k + 1, k))
        out = out.join(seen, "sub", "left").join(context, "context", "left")
        for v in ("allow", "block"):
            n, t, c = (F.coalesce(F.col(x), F.lit(0)) for x in (f"n_{v}", f"t_{v}", v))
            out = out.withColumn(f"q_{v}", F.when(n > 0, (c + t * F.col(f"p_{v}")) / (n + t)).otherwise(F.col(f"p_{v}")))
        out = out.select("gram", "n_seen", F.col("q_allow").alias("p_allow"), F.col("q_block").alias("p_block"))
    return persist_shared(out.select("gram", "n_seen", F.round((F.ln("p_allow") - F.ln("p_block")) / UNIT).cast("long").alias("ratio")), "url-ratios")


def calibrate(scored: DataFrame) -> float:
    """The threshold with the best mean of both classes' hit rates, of 400 steps; 0 if a class has no URL."""
    step = F.least(F.greatest(F.round(F.col("score") * 50), F.lit(-200)), F.lit(200)).cast("int").alias("step")
    bins = sorted(scored.groupBy(step).agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b")).collect())
    allow, block = sum(r["a"] for r in bins), sum(r["b"] for r in bins)
    if not allow or not block:
        return 0.0
    best, found, above, below = 0.0, [], allow, 0
    for r in bins:  # at this step: URLs below it are blocked
        hit = above / allow + below / block
        if hit > best + 1e-12:
            best, found = hit, [r["step"]]
        elif abs(hit - best) <= 1e-12:
            found.append(r["step"])
        above, below = above - r["a"], below + r["b"]
    return (found[len(found) // 2] - 0.5) / 50


def filter_urls(pages: DataFrame, url_col: str = "url", id_col: str = "page_id", rules: tuple[tuple[str, str, str], ...] = RULES, order: int = ORDER) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score.

    Null and empty URLs count as empty: no rule fits them, and they are scored by their end alone. URLs of any length
    are read whole, in linear time; repeated rows are judged one by one; of rules of equal length that fit, the last in
    the order of the alphabet wins; an empty table gives an empty result; other columns are ignored, so clashing names
    cannot arise. Where the rules judge no URL of a class, both models know nothing of it and the threshold is 0.
    """
    host, path = split_url(F.coalesce(pages[url_col].cast("string"), F.lit("")))
    rows = pages.select(pages[id_col].alias("page_id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("_url"), host.alias("host"), path.alias("path"))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    # What the models are told is the URL in lower case without its scheme. Rules heed the case of paths, so URLs that
    # are told alike can be judged apart; each judgement is then a URL of its own.
    told = F.translate(F.when(F.contains("_url", F.lit("://")), F.substring("_url", F.instr("_url", "://") + 3, F.length("_url"))).otherwise(F.col("_url")), _UPPER, _LOWER)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), told.alias("told"))

    urls = rows.groupBy("told", F.coalesce("by_rule", F.lit("")).alias("judged")).agg(F.count(F.lit(1)).alias("n_rows"))
    urls = persist_shared(urls.withColumn("url_id", F.monotonically_increasing_id()), "url-distinct")
    held = F.pmod(F.xxhash64("told"), F.lit(FOLDS)) == 0
    models = fit_models(urls.where((F.col("judged") != "") & ~held).select("told", F.col("judged").alias("verdict")), order)
    # A URL travels as a number. The most frequent n-grams are looked up where they are read, and a URL's sum over them
    # is one row; only the others meet their ratios in a shuffle.
    grams = urls.select("url_id", F.explode(grams_of(F.col("told"), order)).alias("gram"))
    ratios = gram_ratios(models, grams, order)
    hot = ratios.orderBy(F.col("n_seen").desc(), "gram").limit(HOT_GRAMS).select("gram", F.col("ratio").alias("known"))
    rest = F.when(F.col("known").isNull(), F.col("gram")).alias("rest")
    marked = grams.join(F.broadcast(hot), "gram", "left").groupBy("url_id", rest).agg(F.sum("known").alias("known"), F.count(F.lit(1)).alias("times"))  # HOT_GRAMS rows at most
    marked = persist_shared(marked, "url-grams")
    others = marked.where("rest is not null").join(ratios.select(F.col("gram").alias("rest"), "ratio"), "rest")
    parts = marked.where("rest is null").select("url_id", "known", "times").union(others.select("url_id", F.col("ratio") * F.col("times"), "times"))
    sums = parts.groupBy("url_id").agg((F.sum("known") / F.sum("times") * UNIT).alias("score"))
    scored = persist_shared(urls.join(sums, "url_id").select("told", "judged", held.alias("held"), "score"), "url-scores")
    threshold = calibrate(scored.where((F.col("judged") != "") & F.col("held")).select("score", F.col("judged").alias("verdict")))
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    rows = rows.withColumn("judged", F.coalesce("by_rule", F.lit("")))
    return rows.join(scored.select("told", "judged", "score"), ["told", "judged"]).select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score")
