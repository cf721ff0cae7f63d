"""Exact deduplication by deterministic block naming.

Each text is cut into fixed-size blocks of UTF-8 bytes. Every distinct block gets an integer name by sorting;
then adjacent names are paired and each distinct pair gets an integer name, until every document is left with
one name. Two texts of as many blocks have the same name exactly when they are the same text, so the identity
is free of collisions. Block contents are shuffled once; a pair of 64-bit fingerprints routes their occurrences,
and the names table proves on the data at hand that no two distinct blocks share a fingerprint pair (otherwise
the pass is repeated with another seed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, persist_shared, text_of

BLOCK_BYTES = 8192


def _blocks(text: Column, size: int) -> Column:
    """The text's UTF-8 bytes in blocks of ``size``; an empty text has one empty block."""
    return let(
        text.cast("binary"),
        lambda b: F.transform(
            F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.octet_length(b) / size)).cast("int") - 1),
            lambda i: F.substring(b, i * size + 1, F.lit(size)),
        ),
    )


def _fingerprint(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), block).alias("a"), F.xxhash64(F.lit(~seed), block).alias("b"))


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names for distinct rows: partition number and rank within the sorted partition."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def name_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, text_sha256, n_blocks, name; (n_blocks, name) is the identity.

    Null texts count as empty; empty texts share one identity; very long texts are cut into as many blocks as they need;
    repeated rows keep one row_id each; null ids are kept; other columns are ignored, so clashing names cannot arise; an
    empty table gives an empty result.
    """
    text = text_of(docs, text_col)
    seed = 0
    while True:
        base = persist_shared(
            docs.select(
                F.monotonically_increasing_id().alias("row_id"),
                docs[id_col].cast("long").alias("doc_id"),
                F.sha2(text, 256).alias("text_sha256"),
                F.transform(_blocks(text, block_bytes), lambda b: _fingerprint(b, seed)).alias("prints"),
            ).withColumn("n_blocks", F.size("prints")),
            "naming-base",
        )
        contents = docs.select(F.explode(_blocks(text, block_bytes)).alias("block")).select(_fingerprint(F.col("block"), seed).alias("p"), "block")
        distinct = contents.select("p.a", "p.b", "block").distinct()
        names = persist_shared(_named(distinct, ["a", "b", "block"]).select("a", "b", "name"), "naming-blocks")
        if names.groupBy("a", "b").count().where("count > 1").isEmpty():
            break
        seed += 1

    level = base.select("row_id", "n_blocks", F.posexplode("prints").alias("pos", "p")).select("row_id", "n_blocks", "pos", "p.a", "p.b")
    level = persist_shared(level.join(names, ["a", "b"]).select("row_id", "pos", "name", F.col("n_blocks").alias("n")), "naming-level")
    done = [level.where("n = 1").select("row_id", "name")]
    longest = base.agg(F.max("n_blocks")).first()[0] or 1
    level = level.where("n > 1")
    while longest > 1:
        pairs = level.groupBy("row_id", F.expr("pos div 2").alias("pos"), F.ceil(F.col("n") / 2).cast("int").alias("n")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"),
        )
        pairs = persist_shared(pairs, "naming-pairs")
        names = persist_shared(_named(pairs.select("l", "r").distinct(), ["l", "r"]), "naming-names")
        level = persist_shared(pairs.join(names, ["l", "r"]).select("row_id", F.col("pos").cast("int").alias("pos"), "name", "n"), "naming-level")
        done.append(level.where("n = 1").select("row_id", "name"))
        level = level.where("n > 1")
        longest = -(-longest // 2)
    named = done[0]
    for more in done[1:]:
        named = named.union(more)
    return base.drop("prints").join(named, "row_id")


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays (null ids last); of rows that repeat id and text one stays. Nulls,
    empty and very long texts, empty tables and other columns as in ``name_texts``.
    """
    named = persist_shared(name_texts(docs, text_col, id_col, block_bytes), "naming-done")
    groups = named.groupBy("n_blocks", "name").agg(
        F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    # Written first: both sides of the join are then plain shuffles, which Spark can split where a group is large.
    return named.join(persist_shared(groups, "naming-groups"), ["n_blocks", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("keep.row_id") == F.col("row_id")).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    Of rows that repeat id and text, however many, the one whose columns hash lowest stays. Very long texts are compared
    whole. Null and empty texts are one group; null ids stay only where no other row of the text has one; an empty table gives an empty result; columns that clash with the
    operator's keep their names.
    """
    key = lambda i, sha: F.struct(i.alias("doc_id"), sha.alias("sha")).alias("_key")  # noqa: E731  structs are equal where their nulls are
    stay = persist_shared(exact_groups(docs, text_col, id_col, block_bytes).where("kept").select(key(F.col("doc_id"), F.col("text_sha256"))), "dedup-stay")
    names = [f"_d{i}" for i in range(len(docs.columns))]
    keyed = docs.select(key(docs[id_col].cast("long"), F.sha2(text_of(docs, text_col), 256)), *[docs[c].alias(n) for c, n in zip(docs.columns, names)])
    # Repeated rows become one in the tasks that read them, and texts are shuffled once, for the join too.
    single = keyed.groupBy("_key").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("d"))
    return single.join(stay, "_key", "left_semi").select(*[F.col(f"d.{n}").alias(c) for c, n in zip(docs.columns, names)])
