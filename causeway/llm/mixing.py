"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be copied ``f = target / source size`` times. The whole part is certain; the
fraction is decided by pivotal rounding: two documents meet, mass moves between them at random until one of the
two probabilities becomes 0 or 1, and the other document goes on to meet the next. Mass is counted in words, so
each meeting keeps the expected words of the pair exactly, and only the last document of a source is rounded
freely. Documents meet in groups of bounded size; what is left of each group goes up a reduction tree.
All randomness is a hash of the document, and all sums that decide anything are sums of whole numbers, so reruns agree
whatever the order of the shuffles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_words, let, persist_shared, text_of

#: Weights in the order of the sources, the share of all words to take, the most copies of a document.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
FAN_IN = 64
#: What tells documents apart, besides ``k``, which numbers repeated ones.
IDENTITY = ("doc_id", "source", "size", "print")
#: Repeated documents are numbered in runs of so many, which are dealt over the tasks.
RUN = 65_536


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, n_docs, source_size, target: shares by weight, none above ``most`` times the source's size.

    ``sizes`` has source and size. Sources are ranked by code point, null last. The rank is a range sort with one
    offset for each partition, so no task holds all sources.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    # monotonically_increasing_id has the sorted partition above bit 33 and the row within it below.
    ranked = per.sort(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    ranked = persist_shared(ranked, "mix-sources").withColumn("part", F.shiftright("at", 33))
    counts = sorted((r["part"], r["n"]) for r in ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for part, n in counts:
        offsets += [F.lit(part), F.lit(before % len(weights))]
        before += n
    if not offsets:
        return ranked.select("source", "n_docs", "source_size", F.lit(0.0).alias("target"))
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    rank = F.element_at(F.create_map(*offsets), F.col("part")) + within
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int") + 1)
    ranked = ranked.select("source", "n_docs", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap"))
    wanted = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)

    # Water filling: at a level, the sources with weight * level above their cap stand at the cap. Capped sources
    # stay capped as the level rises, so the loop ends; each round is one aggregation to three numbers.
    level, capped_n = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        # Few distinct weights: the sources left are counted for each, so nothing depends on the order of a sum.
        sums = ranked.groupBy(over.alias("over"), "weight").agg(F.sum("source_size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
        cap_sum = most * sum(r["words"] for r in sums if r["over"])
        weight_sum = math.fsum(r["weight"] * r["n"] for r in sums if not r["over"])
        n = sum(r["n"] for r in sums if r["over"])
        if n == capped_n or not weight_sum:
            break
        capped_n, level = n, (wanted - cap_sum) / weight_sum
    target = F.least(F.col("weight") * F.lit(level), F.col("cap"))
    return ranked.select("source", "n_docs", "source_size", target.alias("target"))


_FIELDS = ("doc_id", "k", "size", "source", "print", "bucket", "p", "u")
_ITEM = "struct<doc_id:bigint,k:bigint,size:bigint,source:string,print:bigint,bucket:bigint,p:double,u:double>"


def _meet(left: Column, item: Column) -> Column:
    """One pivotal meeting: struct(done: array of decided items, left: the undecided item or null)."""
    si, sj = left["size"].cast("double"), item["size"].cast("double")

    def moved(who: Column, p: Column) -> Column:
        return who.withField("p", p)

    def outcome(up: Column) -> Column:
        # up: mass that the left item can take from the new one, in words; down: what it can give.
        def with_down(down: Column) -> Column:
            rises = item["u"] * (up + down) < down
            gain = F.when(rises, up).otherwise(-down)
            full_i = F.when(rises, (1 - left["p"]) * si <= item["p"] * sj).otherwise(left["p"] * si <= (1 - item["p"]) * sj)
            full_j = F.when(rises, (1 - left["p"]) * si >= item["p"] * sj).otherwise(left["p"] * si >= (1 - item["p"]) * sj)
            i = moved(left, F.when(full_i, F.when(rises, 1.0).otherwise(0.0)).otherwise(left["p"] + gain / si))
            j = moved(item, F.when(full_j, F.when(rises, 0.0).otherwise(1.0)).otherwise(item["p"] - gain / sj))
            none = F.lit(None).cast(_ITEM)
            return (
                F.when(full_i & full_j, F.struct(F.array(i, j).alias("done"), none.alias("left")))
                .when(full_i, F.struct(F.array(i).alias("done"), j.alias("left")))
                .otherwise(F.struct(F.array(j).alias("done"), i.alias("left")))
            )

        return let(F.least(left["p"] * si, (1 - item["p"]) * sj), with_down)

    return let(F.least((1 - left["p"]) * si, item["p"] * sj), outcome)


def _round_groups(items: DataFrame) -> DataFrame:
    """Let the items of each (source, bucket) meet, largest first: done and at most one left for each group."""
    key = F.struct((-F.col("size")).alias("order"), *_FIELDS)
    grouped = items.groupBy("source", "bucket").agg(F.sort_array(F.collect_list(key)).alias("all"))
    plain = F.transform("all", lambda x: F.struct(*[x[c].alias(c) for c in _FIELDS]).cast(_ITEM))
    start = F.struct(F.lit(None).cast(f"array<{_ITEM}>").alias("done"), F.lit(None).cast(_ITEM).alias("left"))
    start = F.struct(F.array().cast(f"array<{_ITEM}>").alias("done"), start["left"].alias("left"))

    def step(acc: Column, item: Column) -> Column:
        met = let(
            _meet(acc["left"], item), lambda m: F.struct(F.concat(acc["done"], m["done"]).alias("done"), m["left"].alias("left"))
        )
        return F.when(acc["left"].isNull(), F.struct(acc["done"].alias("done"), item.alias("left"))).otherwise(met)

    return grouped.select(F.aggregate(plain, start, step).alias("met"))


def _draw(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *IDENTITY, "k"), F.lit(1 << 53)) / float(1 << 53)


def _settle(items: DataFrame, most_docs: int, seed: int) -> DataFrame:
    """doc_id, k, size, source, print, p with p rounded to 0 or 1; n is the number of items of a source."""
    sure = items.where("p = 0 or p = 1").select("doc_id", "k", "size", "source", "print", "p")
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / FAN_IN))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *IDENTITY, "k"), n_buckets)
    level = items.where("p > 0 and p < 1").select("doc_id", "k", "size", "source", "print", bucket.alias("bucket"), "p")
    width, depth, done = -(-most_docs // FAN_IN), 0, sure
    while True:
        met = persist_shared(_round_groups(level.withColumn("u", _draw(seed + 1 + depth))), f"mix-level{depth}")
        done = done.union(met.select(F.explode("met.done").alias("x")).select(*[f"x.{c}" for c in sure.columns]))
        left = met.where("met.left is not null").select("met.left.*")
        if width <= 1:
            break
        level, width, depth = left.withColumn("bucket", F.expr(f"bucket div {FAN_IN}")), -(-width // FAN_IN), depth + 1
    last = left.withColumn("p", F.when(_draw(seed - 1) < F.col("p"), 1.0).otherwise(0.0))
    return done.union(last.select(*sure.columns))


def _numbered(docs: DataFrame, text_col: str, id_col: str, source_col: str) -> DataFrame:
    """IDENTITY and k for each row: documents alike in id, source and text are counted first and numbered from the
    count, in runs, so that no task gathers the rows of one document however often it is repeated."""
    text = text_of(docs, text_col)
    thin = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), count_words(text).alias("size"), F.xxhash64(text).alias("print"))
    counted = persist_shared(thin.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("m")), "mix-counted")  # texts are read once
    once = counted.where("m = 1").select(*IDENTITY, F.lit(1).cast("long").alias("k"))
    runs = counted.where("m > 1").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {RUN}"))))
    last = F.least(F.col("m"), (F.col("run") + 1) * RUN)
    return once.union(runs.repartition(*IDENTITY, "run").select(*IDENTITY, F.explode(F.sequence(F.col("run") * RUN + 1, last)).alias("k")))


def mix(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 20,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, k, source, size, print, source_size, target, copies, taken.

    k numbers rows alike in id, source and text (print is the text's hash), which are interchangeable. Null and empty
    texts have size 0 and are never taken; null sources are one source, null ids are ids like others; very long texts
    are counted whole; of items of equal size the lesser id, then k, meets first; an empty table gives an empty result;
    other columns are ignored, so clashing names cannot arise.
    """
    rows = persist_shared(_numbered(docs, text_col, id_col, source_col), "mix-rows")
    targets = persist_shared(source_targets(rows, weights, share, most), "mix-targets")
    t = targets.withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate).cast("int")
    all_rows = rows.join(t, rows["source"].eqNullSafe(t["_source"])).drop("_source")
    all_rows = all_rows.withColumn("whole", whole).withColumn("p", rate - whole)

    # Large documents are settled first. What a class of sizes misses of its words is carried to the next smaller
    # class, whose probabilities shift alike; the last rounding of a source is then one of a small document.
    mean = F.col("source_size") / F.col("n_docs")
    fractional = all_rows.where("size > 0 and p > 0").withColumn("class", F.when(F.col("size") > mean, 0).when(F.col("size") > mean / 4, 1).otherwise(2))
    fractional = persist_shared(fractional.select(*IDENTITY, "k", "p", "class"), "mix-items")
    # p is the same for all items of a source, so what is due is one product of a sum of whole numbers.
    classes = fractional.groupBy("source", "class").agg(F.sum("size").alias("words"), F.max("p").alias("p"), F.count(F.lit(1)).alias("n"))
    classes = persist_shared(classes, "mix-classes")
    chosen = None
    for nth in range(3):
        owed = classes.where(F.col("class") <= nth).groupBy("source").agg(
            (F.sum("words") * F.max("p")).alias("due"), F.max(F.when(F.col("class") == nth, F.col("words"))).alias("words"), F.max(F.when(F.col("class") == nth, F.col("n"))).alias("n")
        )
        if chosen is not None:
            given = chosen.groupBy("source").agg(F.sum(F.when(F.col("p") == 1, F.col("size")).otherwise(0)).alias("given")).withColumnRenamed("source", "_given")
            owed = owed.join(given, owed["source"].eqNullSafe(given["_given"]), "left")
        else:
            owed = owed.withColumn("given", F.lit(0))
        owed = owed.where("words is not null").select(F.col("source").alias("_source"), "n", ((F.col("due") - F.coalesce("given", F.lit(0))) / F.col("words")).alias("_p"))
        owed = persist_shared(owed, "mix-owed")
        now = fractional.where(F.col("class") == nth)
        now = now.join(owed, now["source"].eqNullSafe(owed["_source"])).withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_p"))))
        settled = _settle(now, owed.agg(F.max("n")).first()[0] or 0, seed + 100 * nth)
        chosen = settled if chosen is None else chosen.union(settled)
    chosen = chosen.where("p = 1").select(*[F.col(c).alias(f"_{c}") for c in (*IDENTITY, "k")], F.lit(1).alias("extra"))
    same = all_rows["k"] == chosen["_k"]
    for c in IDENTITY:
        same &= all_rows[c].eqNullSafe(chosen[f"_{c}"])
    out = all_rows.join(chosen, same, "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
    return out.select("doc_id", "k", "source", "size", "print", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix with their columns, each as often as it is taken.

    Rows alike in id, source and text are one document, taken as often as all of them are; of rows that differ in other
    columns only, the one whose columns hash lowest stands for it. Null and empty texts are never taken; null ids and
    sources count as values; an empty table gives an empty result; columns that clash with the operator's keep their names.
    """
    key = F.struct("doc_id", "source", "print").alias("_key")  # structs are equal where their nulls are
    plan = mix(docs, text_col, id_col, source_col, **options).groupBy(key).agg(F.sum("copies").cast("int").alias("_copies")).where("_copies > 0")
    names = [f"_d{i}" for i in range(len(docs.columns))]
    own = F.struct(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), F.xxhash64(text_of(docs, text_col)).alias("print"))
    keyed = docs.select(own.alias("_key"), *[docs[c].alias(n) for c, n in zip(docs.columns, names)])
    # Repeated rows become one in the tasks that read them: they meet in no task. Texts are shuffled once, for the join too.
    single = keyed.groupBy("_key").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("d"))
    times = single.join(persist_shared(plan, "mix-plan"), "_key").withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return times.select(*[F.col(f"d.{n}").alias(c) for c, n in zip(docs.columns, names)])
