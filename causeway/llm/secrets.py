"""Secret scanning with a trigram inverted index.

For each rule a Boolean trigram query is derived from its regex. The index maps each trigram that some query
names to the texts that have it; intersecting its postings gives the candidates of a rule, and only those are
verified with the regex. Rules whose regex demands no trigram scan all texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persist_shared, text_of
from .spans import SPAN, count_kind, find_spans, join_spans
from .trigram_query import trigram_query


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: Callable[[Column], Column] | None = None


_ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"

#: The base kinds in their order.
BASE_RULES = (
    Rule("assign", _ASSIGN, lambda m: F.length(F.regexp_extract(m, _ASSIGN, 2)) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: F.length(m) >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)

#: Public formats of further credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]{20,}"),
    Rule("url_password", r"[a-z][a-z0-9+]{0,20}://[A-Za-z0-9._%-]+:[^\x20\x09-\x0D/@:]{6,}@[A-Za-z0-9.-]+"),
)


def postings(docs: DataFrame, trigrams: list[str], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The inverted index: trigram, doc_id, print; print is a fingerprint of the text.

    Only the given trigrams are indexed: postings that no query asks for would never be read.
    """
    text = text_of(docs, text_col)
    low = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), F.lower(text).alias("_low"))
    there = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in trigrams]))
    return low.select("doc_id", "print", F.explode(there).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, print, kinds: the rules whose trigram query a text satisfies, by intersection of postings."""
    spark = index.sparkSession
    wanted = [(r.kind, n, g, len(alt)) for r in rules for n, alt in enumerate(trigram_query(r.pattern) or []) for g in sorted(alt)]
    query = spark.createDataFrame(wanted, "kind string, alternative int, trigram string, n_trigrams int")
    hits = index.distinct().join(F.broadcast(query), "trigram")  # one row for each trigram of the rules' queries
    both = hits.groupBy("doc_id", "print", "kind", "alternative", "n_trigrams").count().where("count = n_trigrams")
    return both.groupBy("doc_id", "print").agg(F.collect_set("kind").alias("kinds"))


def scan_secrets(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", base: tuple[Rule, ...] = BASE_RULES, more: tuple[Rule, ...] = MORE_RULES
) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, sorted by start, then by the order of the rules.

    Null and empty texts have no spans; very long texts are scanned whole, in n log n steps for n matches; repeated rows
    are answered one by one; rows with a null id are kept; spans that start together stand in the order of the rules;
    an empty table gives an empty result; other columns are ignored, so clashing names cannot arise.
    """
    rules = base + more
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = tuple(r for r in rules if queries[r.kind])
    trigrams = sorted({g for r in indexed for alt in queries[r.kind] for g in alt})
    text = text_of(docs, text_col)
    rank = {r.kind: n for n, r in enumerate(rules)}

    found = persist_shared(candidates(postings(docs, trigrams, text_col, id_col), indexed), "secret-candidates")
    found = found.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), "kinds")
    keyed = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("_text"), F.xxhash64(text).alias("print"))

    # Equal texts verify equally, so a row of each (doc_id, print) that the index names is read.
    to_verify = keyed.join(found, (keyed["print"] == found["_print"]) & keyed["doc_id"].eqNullSafe(found["_id"]))
    verified = F.flatten(
        F.array(*[F.when(F.array_contains("kinds", r.kind), find_spans(F.col("_text"), r.pattern, r.kind, rank[r.kind], r.keep)).otherwise(F.array().cast(SPAN)) for r in indexed])
    )
    verified = to_verify.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), verified.alias("_verified")).where(F.size("_verified") > 0)
    verified = persist_shared(verified, "secret-verified").dropDuplicates(["_id", "_print"])

    scanned = F.flatten(F.array(*[find_spans(F.col("_text"), r.pattern, r.kind, rank[r.kind], r.keep) for r in rules if r not in indexed], F.array().cast(SPAN)))
    whole = keyed.select("doc_id", "print", scanned.alias("_scanned"))
    out = whole.join(verified, (whole["print"] == verified["_print"]) & whole["doc_id"].eqNullSafe(verified["_id"]), "left")
    return out.select("doc_id", F.sort_array(F.concat("_scanned", F.coalesce("_verified", F.array().cast(SPAN)))).alias("spans"))


def secret_digest(scanned: DataFrame, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256, spans as text."""
    kinds = [r.kind for r in base]
    counts = [count_kind(F.col("spans"), k).alias(f"n_{k}") for k in kinds]
    first = F.filter("spans", lambda s: s["rank"] < len(kinds))
    return scanned.select("doc_id", *counts, F.sha2(join_spans(first), 256).alias("base_sha256"), join_spans(F.col("spans")).alias("spans"))
