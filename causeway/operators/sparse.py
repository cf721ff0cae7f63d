"""Sparse text vectors in long form (id, term, weight) and searches over them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import STOP_WORDS, once, tokens
from ..sources.shared import persist_shared
from .apply import sorted_groups
from .ranking import with_row_number


#: Bits of a term's number within its block; a part of a table has 2^14 blocks at most.
SLOT_BITS = 28
#: Words that a task counts at once, unless a single text has more.
BLOCK_WORDS = 3_000_000


def _spread(df: DataFrame, key: str, text: Column, carry: Sequence[str], stop: Sequence[str]) -> DataFrame:
    """key, carry, words. Only a table of fewer parts than there are cores is spread first."""
    if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism:
        df, text = df.select(key, *carry, text.alias("_text")).repartition(key), F.col("_text")
    return df.select(key, *carry, tokens(text, stop).alias("words"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of at most BLOCK_WORDS words, or of one row."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.list_value_length(b.column("words")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_WORDS, side="right"))
            end = min(max(end, at + 1), b.num_rows)
            yield b.slice(at, end - at)
            at = end


def _word_slots(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words of each text, the places of all words, distinct words)."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    named = words.flatten().dictionary_encode()
    return sizes, named.indices.to_numpy(zero_copy_only=False).astype(np.int64), named.dictionary


def _distinct_terms(code: np.ndarray, sizes: np.ndarray, n: int, pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct, ends, slots, tf): terms are the places of ``n`` words or, from ``n`` on, of pairs of them; text i has those at slots[ends[i]:ends[i + 1]]."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    if pairs and len(code) > 1:
        near = np.flatnonzero(text[1:] == text[:-1])
        code, text = np.r_[code, n + code[near] * n + code[near + 1]], np.r_[text, text[near]]
    distinct, slot = np.unique(code, return_inverse=True)
    met, tf = np.unique(text * len(distinct) + slot, return_counts=True)
    text, slot = np.divmod(met, max(len(distinct), 1))
    return distinct, np.r_[0, np.cumsum(np.bincount(text, minlength=len(sizes)))], slot, tf


def _term_strings(names: pa.Array, distinct: np.ndarray) -> pa.Array:
    """Sorted places of words or, behind those, of pairs of them as strings."""
    n = len(names)
    cut = int(np.searchsorted(distinct, n))
    second = distinct[cut:] - n
    terms = names.take(pa.array(distinct[:cut]))
    if len(second):
        terms = pa.concat_arrays([terms, pc.binary_join_element_wise(names.take(pa.array(second // n)), names.take(pa.array(second % n)), " ")])
    return terms


def _count(words: pa.Array, pairs: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, ends, slots, tf) of a block: its distinct terms; text i has those at slots[ends[i]:ends[i + 1]], ``tf`` times each.

    Words are numbered within the block, and pairs of neighbours are pairs of numbers, so strings are made once for each term.
    """
    sizes, slots, names = _word_slots(words)
    n = len(names)
    distinct, ends, slot, tf = _distinct_terms(slots, sizes, n, pairs)
    return _term_strings(names, distinct), ends, slot, tf


def term_lists(df: DataFrame, key: str, text: Column, pairs: bool = True, carry: Sequence[str] = (), stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """key, carry, terms: each row's distinct terms with their counts.

    Counted within the row, so neither texts nor terms are shuffled, and written once for all that reads them. ``key`` must tell rows apart.
    """
    rows = _spread(df, key, text, carry, stop)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            terms, ends, slot, tf = _count(b.column("words"), pairs)
            told = pa.StructArray.from_arrays([terms.take(pa.array(slot)), pa.array(tf, pa.int64())], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (key, *carry)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), told)], [key, *carry, "terms"])

    schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in (key, *carry)], T.StructField("terms", T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])))])
    return persist_shared(rows.mapInArrow(work, schema), "term-lists")


def _term_blocks(df: DataFrame, key: str, text: Column, stop: Sequence[str]) -> DataFrame:
    """Written rows of two kinds: (b, key, slots, tf) of each text, and (b, terms, n, total) of each block b of texts.

    A block's terms lie in the order of their slots, ``n`` is how many of its texts have them. Slots rise within a text and are
    written as steps. A term's place is its slot in the lower SLOT_BITS and its block above.
    """
    rows = _spread(df, key, text, (), stop)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = TaskContext.get().partitionId() << 14
        for part in _blocks(batches):
            terms, ends, slot, tf = _count(part.column("words"), True)
            b, many = b + 1, part.num_rows
            if len(terms) >> SLOT_BITS or not b & 0x3FFF:
                raise ValueError("a text or a part of the table has too many terms to be numbered")
            steps = np.diff(slot, prepend=0)
            starts = ends[:-1][np.diff(ends) > 0]
            steps[starts] = slot[starts]
            lists = lambda ends, x, kind=pa.int32(): pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind))
            texts = [pa.array(np.full(many, b)), part.column(key), lists(ends, steps), lists(ends, tf), *[pa.nulls(many, k) for k in (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()))]]
            yield pa.RecordBatch.from_arrays(texts, names)
            if len(terms):
                one, total = [0, len(terms)], np.bincount(slot, weights=tf, minlength=len(terms)).astype(np.int64)
                held = [pa.array([b]), pa.nulls(1, part.column(key).type), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32()))]
                held += [pa.ListArray.from_arrays(pa.array(one, pa.int32()), terms), lists(one, np.bincount(slot, minlength=len(terms))), lists(one, total, pa.int64())]
                yield pa.RecordBatch.from_arrays(held, names)

    names = ["b", "key", "slots", "tf", "terms", "n", "total"]
    kind = rows.schema[key].dataType.simpleString()
    return persist_shared(rows.mapInArrow(work, f"b long, key {kind}, slots array<int>, tf array<int>, terms array<string>, n array<int>, total array<long>"), "term-blocks")


def in_rows(lists: DataFrame, key: str, *carry: str) -> DataFrame:
    """key, carry, term, tf: a row for each term."""
    return lists.select(key, *carry, F.explode("terms").alias("t")).select(key, *carry, "t.*")


def normalized(weights: DataFrame, key: str) -> DataFrame:
    """Weights over the length of each key's vector: gathered by key once, a vector in a row."""
    rows = weights.groupBy(key).agg(F.collect_list(F.struct("term", "weight")).alias("v"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    return rows.select(key, "length", F.explode("v").alias("t")).select(key, "t.term", (F.col("t.weight") / F.when(F.col("length") == 0, 1.0).otherwise(F.col("length"))).alias("weight"))


def _weighted(key: str):
    """Weights of a block's texts over the length of each; only terms that are named are answered."""

    def work(texts: pa.Table, known: pa.Table) -> pa.Table:
        out = {c: pa.array([], k) for c, k in ((key, texts.schema.field("key").type), ("term", pa.string()), ("weight", pa.float64()))}
        if not (texts.num_rows and known.num_rows):
            return pa.table(out)
        flat = lambda c: pc.list_flatten(texts.column(c)).to_numpy()
        slots, tf, sizes = np.cumsum(flat("slots"), dtype=np.int64), flat("tf"), pc.list_value_length(texts.column("slots")).to_numpy()
        before = np.r_[0, slots][np.cumsum(sizes) - sizes]  # steps begin anew in each text
        slots, text = slots - np.repeat(before, sizes), np.repeat(np.arange(texts.num_rows), sizes)
        at = known.column("slot").to_numpy()
        row = np.full(max(int(at.max()), int(slots.max(initial=0))) + 1, -1)
        row[at] = np.arange(len(at))
        there = row[slots] >= 0
        row, tf, text = row[slots[there]], tf[there], text[there]
        idf = np.log((1 + known.column("texts").to_numpy()) / (1 + known.column("df").to_numpy())) + 1
        w = (1 + np.log(tf)) * idf[row]
        w /= np.sqrt(np.bincount(text, weights=w * w, minlength=texts.num_rows))[text]
        term = known.column("term").combine_chunks()
        named = term.is_valid().to_numpy(zero_copy_only=False)[row]
        return pa.table({key: texts.column("key").combine_chunks().take(pa.array(text[named])), "term": term.take(pa.array(row[named])), "weight": w[named]})

    return work


def tfidf(df: DataFrame, key: str, text: Column, min_df: int = 2, max_df: float = 0.5, most_terms: int | None = None, stop: Sequence[str] = STOP_WORDS, asked: DataFrame | None = None) -> DataFrame:
    """key, term, weight: (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), L2-normalised.

    Terms of fewer than ``min_df`` texts or more than the share ``max_df`` are left out, then the most frequent
    ``most_terms`` stay (ties by term). With a table of ``asked`` terms (term, distinct) only rows of those are answered, of
    the same weights.

    No term leaves its block of texts as a string: each is sent once, as 72 bits of hashes (two of 300 million terms would agree with
    a chance of about 1e-5), to be counted, and its count comes back; texts travel as numbers. Only where the most frequent terms are
    to be found are terms sent as they are. ``key`` must tell rows apart.
    """
    if most_terms:
        return _tfidf_of_most(df, key, text, min_df, max_df, most_terms, stop, asked)
    blocks, parts, texts = _numbered_words(df, key, text, stop)
    sent = _sent_terms(blocks, parts, "term_part")
    if asked is not None:
        sent = sent.unionByName(asked.select("term").mapInArrow(_send_asked(parts), "b long, term_part int, n long, number binary, mark binary, many binary"))
    told = sent.groupBy("term_part").applyInArrow(_count_terms(min_df, max_df * texts, asked is not None), "b long, term_part int, n long, df binary, asked binary")
    kind = dict(blocks.dtypes)["keys"][6:-1]
    return blocks.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(_text_weights(key, parts, texts), f"{key} {kind}, term string, weight double")


def _tfidf_of_most(df: DataFrame, key: str, text: Column, min_df: int, max_df: float, most_terms: int, stop: Sequence[str], asked: DataFrame | None) -> DataFrame:
    """``tfidf`` over the ``most_terms`` most frequent terms; a block of texts sends each of its terms once and gets those of the vocabulary back."""
    blocks = _term_blocks(df, key, text, stop)
    sums = [F.sum(c).over(Window.partitionBy("term")).alias(name) for c, name in (("n", "df"), ("total", "total"))]
    told = blocks.where("terms is not null").select("b", F.posexplode(F.arrays_zip("terms", "n", "total")).alias("slot", "t"))
    place = F.shiftleft("b", SLOT_BITS).bitwiseOR(F.col("slot").cast("long")).alias("place")
    told = told.select(place, F.col("t.terms").alias("term"), F.col("t.n").alias("n"), F.col("t.total").alias("total")).select("place", "term", *sums)
    n = df.agg(F.count(F.lit(1)).alias("texts"))
    known = told.where(F.col("df") >= min_df).crossJoin(F.broadcast(n)).where(F.col("df") <= max_df * F.col("texts"))  # one row
    known = known.join(known.select("term", "total").distinct().orderBy(F.col("total").desc(), "term").limit(most_terms).select("term"), "term", "left_semi")
    name = F.col("term")
    if asked is not None:
        known, name = known.join(asked.select("term", F.lit(True).alias("_asked")), "term", "left"), F.when(F.col("_asked"), F.col("term"))
    known = known.select(F.shiftright("place", SLOT_BITS).alias("_b"), F.col("place").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int").alias("slot"), name.alias("term"), F.col("df").cast("int").alias("df"), F.col("texts"))
    texts = blocks.where("slots is not null").select("b", "key", "slots", "tf")
    kind = dict(texts.dtypes)["key"]
    return texts.groupBy("b").cogroup(known.groupBy("_b")).applyInArrow(_weighted(key), f"{key} {kind}, term string, weight double")


def bm25_rows(df: DataFrame, key: str, text: Column, k1: float = 1.2, b: float = 0.75, carry: Sequence[str] = (), stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """key, carry, v: (term, weight) of each text, tf / (tf + k1 (1 - b + b length / mean length)), L2-normalised.

    Only the mean length comes from other rows: all else is worked out within the row. Texts without terms have none.
    """
    total = F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + t["tf"])
    lists = term_lists(df, key, text, False, carry, stop).where(F.size("terms") > 0).withColumn("length", total)
    mean = lists.agg(F.avg("length").alias("mean"))
    sized = lists.crossJoin(F.broadcast(mean)).withColumn("_k", k1 * (1 - b + b * F.col("length") / F.col("mean")))  # one row
    raw = once(F.col("_k"), lambda k: F.transform("terms", lambda t: F.struct(t["term"].alias("term"), (t["tf"] / (t["tf"] + k)).alias("weight"))))
    # The length is taken within the row too: behind the explode it would be worked out anew for each term.
    size = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, t: s + t["weight"] * t["weight"]))
    unit = once(raw, lambda r: once(size(r), lambda n: F.transform(r, lambda t: F.struct(t["term"].alias("term"), (t["weight"] / n).alias("weight")))))
    return sized.select(key, *carry, unit.alias("v"))


def bm25(df: DataFrame, key: str, text: Column, k1: float = 1.2, b: float = 0.75, carry: Sequence[str] = (), stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """key, carry, term, weight: a row for each term of ``bm25_rows``."""
    return bm25_rows(df, key, text, k1, b, carry, stop).select(key, *carry, F.explode("v").alias("t")).select(key, *carry, "t.*")


def bm25_for(df: DataFrame, key: str, text: Column, queries: DataFrame, query_key: str, query_text: Column, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(queries: key, term, weight; written rows of ``bm25``) with only the terms that queries have.

    A query's weights are the inverse document frequencies of its known terms, summing to 1. Terms of no query are dropped where texts are unfolded, before anything is written or shuffled.
    """
    rows = bm25_rows(df, key, text, carry=carry)
    terms = persist_shared(queries.select(query_key, F.explode(F.array_distinct(tokens(query_text))).alias("term")), "query-terms")
    asked = persist_shared(terms.select("term").distinct(), "asked-terms")
    corpus = persist_shared(rows.select(key, *carry, F.explode("v").alias("t")).select(key, *carry, "t.*").join(asked, "term", "left_semi"), "asked-corpus")
    return _query_weights(terms, query_key, corpus, rows.agg(F.count(F.lit(1)).alias("n"))), corpus


def _query_weights(terms: DataFrame, key: str, corpus: DataFrame, n: DataFrame) -> DataFrame:
    df = corpus.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = terms.join(df, "term").crossJoin(F.broadcast(n)).withColumn("weight", F.ln((F.col("n") + 1) / (F.col("df") + 0.5)))  # one row
    return idf.select(key, "term", (F.col("weight") / F.sum("weight").over(Window.partitionBy(key))).alias("weight"))


def tf_query(queries: DataFrame, key: str, text: Column, vocabulary: DataFrame) -> DataFrame:
    """key, term, weight: 1 + ln tf of the vocabulary's terms, L2-normalised, without corpus idf."""
    return _tf_weights(in_rows(term_lists(queries, key, text), key), key, vocabulary)


def _tf_weights(tf: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    known = vocabulary.join(tf.select("term").distinct(), "term", "left_semi").select("term").distinct()
    return normalized(tf.join(known, "term", "left_semi").select(key, "term", (1 + F.ln("tf")).alias("weight")), key)


def tfidf_for(df: DataFrame, key: str, text: Column, queries: DataFrame, query_key: str, query_text: Column, min_df: int = 2, max_df: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(``tf_query`` over the vocabulary, written rows of ``tfidf``) with only the terms that queries have; all terms count in the lengths."""
    tf = persist_shared(in_rows(term_lists(queries, query_key, query_text), query_key), "query-terms")
    corpus = persist_shared(tfidf(df, key, text, min_df, max_df, asked=tf.select("term").distinct()), "asked-tfidf")
    return _tf_weights(tf, query_key, corpus), corpus


#: Rows of one block of documents and queries of one block of queries in a search.
SEARCH_ROWS, SEARCH_QUERIES = 400_000, 256


def _best_of_block(k: int, least: float):
    """Of block pairs (x, y): for each query (side 1) its k best documents (side 0) in the block, ties by key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["x", "y"]):
            side = t.column("side").to_numpy()
            ask, docs = t.filter(pa.array(side == 1)).combine_chunks(), t.filter(pa.array(side == 0)).combine_chunks()
            if not (ask.num_rows and docs.num_rows):
                continue
            asks, terms = pc.dictionary_encode(ask.column("query").combine_chunks()), pc.unique(ask.column("term").combine_chunks())
            q, at = asks.indices.to_numpy(), pc.index_in(ask.column("term"), terms).to_numpy()
            order = np.argsort(at, kind="stable")
            q, weight, ends = q[order].astype(np.int64), ask.column("weight").to_numpy()[order], np.r_[0, np.cumsum(np.bincount(at, minlength=len(terms)))]
            named = pc.dictionary_encode(docs.column("key").combine_chunks())
            place = pc.sort_indices(named.dictionary).to_numpy()
            keys, rank = named.dictionary.take(pa.array(place)), np.empty(len(place), np.int64)
            rank[place] = np.arange(len(place))
            doc, term, w = rank[named.indices.to_numpy()], pc.index_in(docs.column("term"), terms), docs.column("weight").to_numpy()
            known = term.is_valid().to_numpy()
            doc, term, w = doc[known], term.drop_null().to_numpy(), w[known]
            by = np.argsort(doc, kind="stable")
            doc, term, w = doc[by], term[by], w[by]
            some = max(1, SEARCH_ROWS // SEARCH_QUERIES)  # documents at once
            for low in range(0, len(keys), some):
                part = slice(*np.searchsorted(doc, [low, low + some]))
                many = ends[term[part] + 1] - ends[term[part]]
                row = np.repeat(np.arange(len(many)), many)
                post = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + ends[term[part]][row]
                cell, n = q[post] * some + doc[part][row] - low, len(asks.dictionary) * some
                sums = np.round(np.bincount(cell, weights=w[part][row] * weight[post], minlength=n), 9).reshape(-1, some)
                met = (np.bincount(cell, minlength=n) > 0).reshape(-1, some) & (sums >= least)
                i, j = [], []
                for x in np.flatnonzero(met.any(axis=1)):
                    hit = np.flatnonzero(met[x])
                    hit = hit[np.argsort(-sums[x, hit], kind="stable")[:k]]
                    i.append(np.full(len(hit), x))
                    j.append(hit)
                if i:
                    i, j = np.concatenate(i), np.concatenate(j)
                    yield pa.RecordBatch.from_arrays([asks.dictionary.take(pa.array(i)), keys.take(pa.array(j + low)), pa.array(sums[i, j])], ["query", "key", "similarity"])

    return work


def sparse_top_k(queries: DataFrame, query_key: str, docs: DataFrame, key: str, k: int, least: float) -> DataFrame:
    """query_key, key, similarity, place of the k best documents of each query; ties by id.

    Similarities count to nine decimals, so that equal texts tie whatever the order of their sums.
    Blocks of documents meet blocks of queries: a task multiplies the postings of a pair of blocks and answers only each query's k
    best there, so hits are never shuffled. Only rows of the queries' terms should come; filter the documents before for a date range.
    """
    n_x = max(1, -(-docs.count() // SEARCH_ROWS))
    n_y = max(1, -(-queries.select(query_key).distinct().count() // SEARCH_QUERIES))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kinds = {"query": dict(queries.dtypes)[query_key], "key": dict(docs.dtypes)[key]}
    row = lambda side, **c: [F.lit(side).alias("side"), *[c.get(x, F.lit(None).cast(kinds[x])).alias(x) for x in kinds], "term", F.col("weight").cast("double").alias("weight")]
    told = docs.select(block(key, n_x).alias("x"), every(n_y).alias("y"), *row(0, key=F.col(key)))
    asked = queries.select(block(query_key, n_y).alias("y"), every(n_x).alias("x"), *row(1, query=F.col(query_key)))
    dealt = told.unionByName(asked).repartition("x", "y").sortWithinPartitions("x", "y")
    hits = dealt.mapInArrow(_best_of_block(k, least), f"query {kinds['query']}, key {kinds['key']}, similarity double")
    hits = hits.select(F.col("query").alias(query_key), F.col("key").alias(key), "similarity")
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.col("similarity").desc(), key))
    return hits.withColumn("place", place).where(F.col("place") <= k)


#: Words of texts for each part of a vocabulary that is numbered in one task.
PART_WORDS = 4_000_000
#: Leading weights of one block of vectors, as long as there are at most MOST_BLOCKS; those that a task indexes at once; products that it adds up at once.
BLOCK, MOST_BLOCKS, INDEXED, PRODUCTS = 1 << 20, 6, 1 << 23, 1_500_000
#: Share of the threshold that shared leading terms must reach.
SLACK = 0.1
#: Places of the filter that tells which vectors have candidates.
NEEDED = 1 << 20
#: Steps of the length of what is left of a vector from a term on.
STEPS = 65_535


def _packed(x: np.ndarray) -> bytes:
    """Numbers of one kind with equal bytes side by side, compressed."""
    return pa.compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes(), "zstd", asbytes=True) if len(x) else b""


def _unpacked(b: bytes, kind: type, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(b, n * width, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _prints(words: list[str], distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """72 bits that stand for each term: a number and a mark. Texts of other blocks find the same ones."""
    n = len(words)
    both = np.frombuffer(b"".join(blake2b(w.encode(), digest_size=16).digest() for w in words), "<u8").reshape(-1, 2)
    cut = int(np.searchsorted(distinct, n))
    single, (first, second) = distinct[:cut], np.divmod(distinct[cut:] - n, max(n, 1))
    number, mark = (np.r_[both[single, k], _mixed(both[first, k] * np.uint64(0x9E3779B97F4A7C15) + _mixed(both[second, k] + np.uint64(k + 1)))] for k in (0, 1))
    return number, mark.astype(np.uint8)


def _part_of(number: np.ndarray, parts: int) -> np.ndarray:
    """Equal ranges of numbers."""
    return (((number >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _word_blocks(df: DataFrame, key: str, text: Column, stop: Sequence[str]) -> DataFrame:
    """A written row for each block of texts: b, keys, sizes (words of each text), words (distinct ones), slots (the texts' words as places among those)."""
    rows = _spread(df, key, text, (), stop)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = TaskContext.get().partitionId() << 14
        for part in _blocks(batches):
            b += 1
            sizes, slots, words = _word_slots(part.column("words"))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            told = [pa.array([b]), one(part.column(key)), one(pa.array(sizes, pa.int32())), one(words), pa.array([_packed(slots.astype(np.int32))], pa.binary())]
            yield pa.RecordBatch.from_arrays([*told, pa.array([len(slots)])], ["b", "keys", "sizes", "words", "slots", "n"])

    return persist_shared(rows.mapInArrow(work, f"b long, keys array<{rows.schema[key].dataType.simpleString()}>, sizes array<int>, words array<string>, slots binary, n long"), "word-blocks")


def _numbered_words(df: DataFrame, key: str, text: Column, stop: Sequence[str], part_words: int | None = None) -> tuple[DataFrame, int, int]:
    """(``_word_blocks``, parts of the vocabulary, number of texts)."""
    blocks = _word_blocks(df, key, text, stop)
    words, texts = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    return blocks, int(max(1, -(-words // (part_words or PART_WORDS)))), texts


def _block_terms(row: dict, parts: int) -> tuple[np.ndarray, ...]:
    """A block's (distinct, ends, slots, tf), and of its terms, as they are sent: order, part, number, mark."""
    sizes, words = np.asarray(row["sizes"], np.int64), row["words"]
    distinct, ends, slot, tf = _distinct_terms(_unpacked(row["slots"], np.int32, row["n"]).astype(np.int64), sizes, len(words), True)
    number, mark = _prints(words, distinct)
    order = np.argsort(number)
    number = number[order]
    return distinct, ends, slot, tf, order, _part_of(number, parts), number, mark[order]


def _send_terms(parts: int):
    """Of each block its terms' numbers, marks and how many texts have them, part by part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                _, _, slot, _, order, part, number, mark = _block_terms(row, parts)
                many = np.bincount(slot, minlength=len(order))[order].astype(np.int32)
                cuts = np.searchsorted(part, np.arange(parts + 1))
                told = [_sorted_terms(number[x:y], mark[x:y], many[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([row["b"]]), pa.array([told], pa.list_(_SENT))], ["b", "sent"])

    return work


_SENT = pa.struct([("n", pa.int64()), ("number", pa.binary()), ("mark", pa.binary()), ("many", pa.binary())])


def _sorted_terms(number: np.ndarray, mark: np.ndarray, many: np.ndarray) -> dict:
    return {"n": len(number), "number": _packed(np.diff(number, prepend=np.uint64(0))), "mark": _packed(mark), "many": _packed(many)}


def _sent_terms(blocks: DataFrame, parts: int, name: str) -> DataFrame:
    """A row for each block of texts and part (``name``) of its terms."""
    sent = blocks.mapInArrow(_send_terms(parts), "b long, sent array<struct<n: long, number: binary, mark: binary, many: binary>>")
    return sent.select("b", F.posexplode("sent").alias(name, "t")).select("b", name, "t.*").where("n > 0")


def _send_asked(parts: int):
    """Terms as if a block -1 had sent them, with no texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [x for t in b.column("term").to_pylist() if t is not None and len(x := t.split(" ")) < 3]
            words = sorted({w for t in terms for w in t})
            at, n = {w: i for i, w in enumerate(words)}, len(words)
            codes = [[at[w] for w in t] for t in terms]
            number, mark = _prints(words, np.array(sorted({c[0] if len(c) == 1 else n + c[0] * n + c[1] for c in codes}), np.int64))
            order = np.lexsort((mark, number))
            number, mark = number[order], mark[order]
            part = _part_of(number, parts)
            for p in np.unique(part):
                told = _sorted_terms(number[part == p], mark[part == p], np.zeros((part == p).sum(), np.int32))
                yield pa.RecordBatch.from_pylist([{"b": -1, "term_part": p} | told], pa.schema([("b", pa.int64()), ("term_part", pa.int32()), *_SENT]))

    return work


def _same_terms(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the group of each term that was sent, how many texts have each group, where rows end)."""
    number = np.concatenate([np.cumsum(_unpacked(x["number"], np.uint64, x["n"]), dtype=np.uint64) for x in rows])
    mark, many = (np.concatenate([_unpacked(x[c], kind, x["n"]) for x in rows]) for c, kind in (("mark", np.uint8), ("many", np.int32)))
    order = np.lexsort((mark, number))
    new = np.r_[True, (np.diff(number[order]) != 0) | (np.diff(mark[order]) != 0)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, np.bincount(group, weights=many).astype(np.int64), np.cumsum([x["n"] for x in rows])


def _count_terms(least: int, most: float, some: bool):
    """Of a part: how many texts have each block's terms, 0 for those not in the vocabulary; and with ``some``, which are asked for (by block -1)."""

    def work(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        group, df, ends = _same_terms(rows)
        known = np.where((df >= least) & (df <= most), df, 0)[group].astype(np.int32)
        wanted = np.zeros(len(df), np.uint8)
        wanted[np.concatenate([np.zeros(0, np.int64), *[group[e - r["n"] : e] for r, e in zip(rows, ends) if r["b"] < 0]])] = 1
        told = [(r, slice(e - r["n"], e)) for r, e in zip(rows, ends) if r["b"] >= 0]
        asked = [_packed(wanted[group[at]]) if some else None for _, at in told]
        columns = {"b": pa.int64(), "term_part": pa.int32(), "n": pa.int64()}
        return pa.table({c: pa.array([r[c] for r, _ in told], kind) for c, kind in columns.items()} | {"df": pa.array([_packed(known[at]) for _, at in told], pa.binary()), "asked": pa.array(asked, pa.binary())})

    return work


def _text_weights(key: str, parts: int, texts: int):
    """key, term, weight of a block's texts, over the length of each; only terms that are asked for are answered."""

    def work(block: pa.Table, told: pa.Table) -> pa.Table:
        keys = block.column("keys").combine_chunks().flatten()
        if not (block.num_rows and told.num_rows):
            return pa.table({key: keys.slice(0, 0), "term": pa.array([], pa.string()), "weight": pa.array([], pa.float64())})
        row = block.to_pylist()[0]
        distinct, ends, slot, tf, order = _block_terms(row, parts)[:5]
        slot, tf = slot.astype(np.int32), tf.astype(np.int32)
        rows = sorted(told.to_pylist(), key=lambda x: x["term_part"])
        df, asked = np.empty(len(order), np.int32), np.ones(len(order), np.uint8)
        df[order] = np.concatenate([_unpacked(r["df"], np.int32, r["n"]) for r in rows])
        if rows[0]["asked"] is not None:
            asked[order] = np.concatenate([_unpacked(r["asked"], np.uint8, r["n"]) for r in rows])
        del order, rows
        there = (df > 0)[slot]
        text, slot, tf = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))[there], slot[there], tf[there]
        w = np.log(tf)
        w += 1
        w *= (np.log((1 + texts) / (1 + df)) + 1)[slot]
        del there, tf
        w /= np.sqrt(np.bincount(text, weights=w * w, minlength=len(keys)))[text]
        told_of = np.flatnonzero(asked & (df > 0))
        at = np.full(len(df), -1, np.int32)
        at[told_of] = np.arange(len(told_of))
        terms = _term_strings(pa.array(row["words"], pa.string()), distinct[told_of])
        del row, distinct, df, asked, told_of
        slot = at[slot]
        if (named := slot >= 0).sum() < len(slot):
            text, slot, w = text[named], slot[named], w[named]
        return pa.table({key: keys.take(pa.array(text)), "term": terms.take(pa.array(slot)), "weight": w})

    return work


def _number_terms(parts: int, least: int, most: float):
    """Of a part: each block's terms as numbers, from rare to frequent, and how many texts have them; 0 for those not in the vocabulary."""

    def work(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        group, df, ends = _same_terms(rows)
        known = np.flatnonzero((df >= least) & (df <= most))
        known = known[np.argsort(df[known], kind="stable")]
        if (len(known) + 1) * parts + parts >> 31:
            raise ValueError("the vocabulary has too many terms to be numbered")
        named = np.zeros(len(df), np.int64)
        named[known] = np.arange(1, len(known) + 1) * parts + rows[0]["p"]
        told = [[_packed(np.where(v > 0, x, 0)[e - r["n"] : e].astype(np.int32)) for r, e in zip(rows, ends)] for v, x in ((named[group], named[group]), (named[group], df[group]))]
        return pa.table({"b": [x["b"] for x in rows], "p": pa.array([x["p"] for x in rows], pa.int32()), "n": [x["n"] for x in rows], "named": pa.array(told[0], pa.binary()), "df": pa.array(told[1], pa.binary())})

    return work


def _text_vectors(parts: int, texts: int):
    """k, steps, raw, size of a block's texts that have terms of the vocabulary."""

    def work(block: pa.Table, told: pa.Table) -> pa.Table:
        keys = block.column("keys").combine_chunks().flatten()
        if not (block.num_rows and told.num_rows):
            return _vectors(keys.slice(0, 0), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        _, ends, slot, tf, order, *_ = _block_terms(block.to_pylist()[0], parts)
        rows = sorted(told.to_pylist(), key=lambda x: x["p"])
        named, df = (np.empty(len(order), np.int64) for _ in range(2))
        for x, c in ((named, "named"), (df, "df")):
            x[order] = np.concatenate([_unpacked(r[c], np.int32, r["n"]) for r in rows])
        text, number = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), named[slot]
        there = np.flatnonzero(number > 0)
        there = there[np.lexsort((number[there], text[there]))]
        raw = (1 + np.log(tf[there])) * (np.log((1 + texts) / (1 + df[slot[there]])) + 1)
        sizes = np.bincount(text[there], minlength=len(keys))
        some = np.flatnonzero(sizes)
        length = np.sqrt(np.bincount(text[there], weights=raw * raw, minlength=len(keys)))
        return _vectors(keys.take(pa.array(some)), np.r_[0, np.cumsum(sizes[some])], number[there], raw, length[some])

    return work


def _vectors(keys: pa.Array, ends: np.ndarray, number: np.ndarray, raw: np.ndarray, length: np.ndarray) -> pa.Table:
    steps = np.diff(number, prepend=0)
    starts = ends[:-1][np.diff(ends) > 0]
    steps[starts] = number[starts]
    lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind))
    return pa.table({"k": keys, "steps": lists(steps, pa.int32()), "raw": lists(raw, pa.float64()), "length": pa.array(length, pa.float64())})


def tfidf_vectors(df: DataFrame, key: str, text: Column, min_df: int = 2, max_df: float = 0.5, stop: Sequence[str] = STOP_WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """k, steps, raw, length, written: ``tfidf`` with a vector in a row. Terms are numbers, from rare to frequent but for chance, written as steps
    from one to the next; a weight is ``raw`` over ``length``.

    No term leaves its block as a string: each is sent once as 72 bits of hashes to be counted, and comes back as a number.
    """
    blocks, parts, texts = _numbered_words(df, key, text, stop, part_words)
    sent = _sent_terms(blocks, parts, "p")
    told = sent.groupBy("p").applyInArrow(_number_terms(parts, min_df, max_df * texts), "b long, p int, n long, named binary, df binary")
    kind = dict(blocks.dtypes)["keys"][6:-1]
    vectors = blocks.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(_text_vectors(parts, texts), f"k {kind}, steps array<int>, raw array<double>, length double")
    return persist_shared(vectors, "pair-vectors")


def _read(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, numbers, weights) of vectors."""
    flat = lambda c: pc.list_flatten(b.column(c)).to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(b.column("steps")).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, upto = np.r_[0, np.cumsum(sizes)], np.r_[0, np.cumsum(flat("steps"), dtype=np.int64)]
    return ends, upto[1:] - np.repeat(upto[ends[:-1]], sizes), flat("raw") / np.repeat(b.column("length").to_numpy(zero_copy_only=False), sizes)


def _heads(ends: np.ndarray, weights: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which weights are in their vector's head: those from which on the rest can reach ``least``. And the length of what lies behind each head."""
    upto = np.r_[0, np.cumsum(weights * weights)]
    sizes = np.diff(ends)
    rest = np.repeat(upto[ends[1:]], sizes) - upto[:-1]
    head = rest + 1e-9 >= least * least
    behind = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~head], weights=(weights * weights)[~head], minlength=len(sizes))
    return head, np.sqrt(behind)


def _names(least: float):
    """k, name (equal for vectors that are equal to nine decimals), heads: how many weights lead."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ends, number, w = _read(b)
                head, _ = _heads(ends, w, least)
                many = np.diff(np.r_[0, np.cumsum(head)][ends])
                w = np.round(w, 9)
                names = [blake2b(number[i:j].tobytes() + w[i:j].tobytes(), digest_size=16).digest() for i, j in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(names, pa.binary()), pa.array(many, pa.int64())], ["k", "name", "heads"])

    return work


def _rounded_up(x: np.ndarray) -> np.ndarray:
    """The upper half of single-precision numbers that are no smaller."""
    return ((np.nextafter(x.astype(np.float32), np.float32(np.inf)).view(np.uint32) + np.uint32(0xFFFF)) >> np.uint32(16)).astype(np.uint16)


def _pack_heads(least: float):
    """Of vectors (k, x) a row for each block x and batch: the heads, weights rounded up."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ends, number, w = _read(b)
            head, behind = _heads(ends, w, least)
            raw, length = _rounded_up(pc.list_flatten(b.column("raw")).to_numpy(zero_copy_only=False)), b.column("length").to_numpy(zero_copy_only=False)
            sizes, block = np.diff(np.r_[0, np.cumsum(head)][ends]), b.column("x").to_numpy()
            of = np.repeat(block, np.diff(ends))
            for x in np.unique(block):
                rows, at = np.flatnonzero(block == x), np.flatnonzero((of == x) & head)
                told = [_packed(sizes[rows].astype(np.int32)), _packed(np.diff(number[at], prepend=0).astype(np.int32)), _packed(raw[at]), _packed(length[rows].astype(np.float32)), _packed((behind[rows] * (1 + 1e-6)).astype(np.float32))]
                yield pa.RecordBatch.from_arrays([pa.array([x]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), b.column("k").take(pa.array(rows))), *[pa.array([v], pa.binary()) for v in told], pa.array([len(at)])], ["x", "keys", "sizes", "steps", "w", "lengths", "behind", "n"])

    return work


def _pack_whole(n: int):
    """Of vectors (k, x, mask) a row for each batch and each block that ``mask`` names: all weights, as places among the distinct ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ends, number, w = _read(b)
            raw, block, mask = pc.list_flatten(b.column("raw")).to_numpy(zero_copy_only=False), b.column("x").to_numpy(), b.column("mask").to_numpy()
            sizes = np.diff(ends)
            for x in np.unique(block):
                for o in range(n):
                    there = (block == x) & ((mask >> o) & 1 > 0)
                    rows, at = np.flatnonzero(there), np.flatnonzero(np.repeat(there, sizes))
                    if not len(rows):
                        continue
                    levels, level = np.unique(raw[at], return_inverse=True)
                    one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                    told = [_packed(sizes[rows].astype(np.int32)), _packed(np.diff(number[at], prepend=0).astype(np.int32)), _packed(level.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([pa.array([min(x, o)]), pa.array([max(x, o)]), pa.array([x]), one(b.column("k").take(pa.array(rows))), one(b.column("length").take(pa.array(rows))), one(pa.array(levels, pa.float64())), *[pa.array([v], pa.binary()) for v in told], pa.array([len(at)])], ["px", "py", "x", "keys", "lengths", "levels", "sizes", "steps", "w", "n"])

    return work


def _portions(sizes: Sequence[int], most: int) -> list[list[int]]:
    """Places in turn, a portion of at most ``most`` in all, or of one place."""
    out, held = [], 0
    for i, n in enumerate(sizes):
        if not out or held + n > most:
            out.append([])
            held = 0
        out[-1].append(i)
        held += n
    return out


class _Leading:
    """The heads of some packed rows without the copies: of each weight its term, text, and place by what is left from it on; the more, the sooner."""

    def __init__(self, rows: list[dict], keys: list[pa.Array], copies: pa.Array | None):
        held = [self._of(r, k, copies) for r, k in zip(rows, keys)]
        at = np.cumsum([0, *[len(h[0]) for h in held]])
        self.keys = pa.concat_arrays([h[0] for h in held])
        self.doc = np.concatenate([h[1] + np.int32(a) for h, a in zip(held, at)])
        self.w, self.left, self.number = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))

    @staticmethod
    def _of(r: dict, keys: pa.Array, copies: pa.Array | None) -> tuple:
        sizes = _unpacked(r["sizes"], np.int32, len(keys)).astype(np.int64)
        ends = np.r_[0, np.cumsum(sizes)]
        doc = np.repeat(np.arange(len(keys), dtype=np.int32), sizes)
        raw = (_unpacked(r["w"], np.uint16, r["n"]).astype(np.uint32) << np.uint32(16)).view(np.float32)
        w = raw / (_unpacked(r["lengths"], np.float32, len(keys)) * np.float32(1 - 1e-6))[doc]
        upto = np.r_[0, np.cumsum(w.astype(np.float64) ** 2)]
        left = np.sqrt(np.maximum((upto[ends[1:]] + _unpacked(r["behind"], np.float32, len(keys)).astype(np.float64) ** 2)[doc] - upto[:-1], 0)).astype(np.float32)
        number = np.cumsum(_unpacked(r["steps"], np.int32, r["n"]), dtype=np.int64).astype(np.int32)
        if copies is not None and (stays := ~pc.is_in(keys, copies).to_numpy(zero_copy_only=False)).sum() < len(keys):
            there = stays[doc]
            keys, doc, w, left, number = keys.filter(pa.array(stays)), (np.cumsum(stays, dtype=np.int32) - 1)[doc[there]], w[there], left[there], number[there]
        return keys, doc, w, left, number

    def places(self) -> np.ndarray:
        return (self.number.astype(np.int64) << 16) | ((1 - np.minimum(self.left, 1)) * STEPS).astype(np.int64)


def _reaching(one: _Leading, index: tuple, wide: int, least: float, after: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (of ``one``, of the index) whose shared leading terms add up to SLACK of ``least``. With ``after`` the texts of ``one`` are
    those of the index from that place on, and each meets later ones only.

    Products are added up in cells that several pairs may share, and only those of cells that reach it are told apart.
    """
    place, doc, w = index
    enough = 0.99 * SLACK * least
    order = np.argsort(one.number, kind="stable")
    named = one.number[order].astype(np.int64) << 16
    upto = np.floor((1 - (1 - SLACK) * least / np.maximum(one.left[order].astype(np.float64), 1e-9)) * STEPS).astype(np.int64) + 1
    low = np.searchsorted(place, named)
    stop = np.searchsorted(place, named + np.clip(upto, 0, STEPS), side="right")
    some = np.flatnonzero((stop > low) & (upto >= 0))
    some = some[np.argsort(order[some])]  # by text again
    at, low, many = order[some], low[some], (stop - low)[some]
    mine, weight = one.doc[at], one.w[at]
    ends = np.searchsorted(mine, np.arange(len(one.keys) + 1))
    upto = np.r_[0, np.cumsum(many)]
    cells = 1 << 21

    def products(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(i, j), many[i:j])
        post = np.arange(len(row)) + np.repeat(low[i:j] - (upto[i:j] - upto[i]), many[i:j])
        return mine[row], doc[post], weight[row] * w[post]

    a, n = 0, len(one.keys)
    while a < n:
        end = int(np.searchsorted(upto[ends], upto[ends[a]] + PRODUCTS, side="right")) - 1
        end = min(max(end, a + 1), n)
        i, j = ends[a], ends[end]
        if upto[j] - upto[i] <= PRODUCTS:
            x, y, v = products(i, j)
            if after is not None:
                keep = x + after < y
                x, y, v = x[keep], y[keep], v[keep]
            code = (x - a) * np.int64(wide) + y
            cell = code & (cells - 1)
            keep = np.bincount(cell, weights=v, minlength=cells)[cell] >= enough
            pair, of = np.unique(code[keep], return_inverse=True)
            pair = pair[np.bincount(of, weights=v[keep], minlength=len(pair)) >= enough]
            yield pair // wide + a, pair % wide
        else:  # a single text may make more products than are held at once
            sums = np.zeros(wide)
            while i < j:
                to = min(max(int(np.searchsorted(upto, upto[i] + PRODUCTS, side="right")) - 1, i + 1), j)
                _, y, v = products(i, to)
                sums += np.bincount(y, weights=v, minlength=wide)
                i = to
            y = np.flatnonzero(sums >= enough)
            y = y if after is None else y[y > a + after]
            yield np.full(len(y), a), y
        a = end


def _meet_heads(least: float):
    """Of the heads of two blocks the pairs of vectors that can reach ``least``. Some rows of one block are indexed at a time, those of the other met in turn."""

    def work(t: pa.Table) -> pa.Table:
        kind = t.schema.field("keys").type.value_type
        none = pa.table({"src": pa.array([], kind), "dst": pa.array([], kind)})
        lists, copied = t.column("keys").combine_chunks(), t.column("n").is_null().to_numpy()
        rows = t.drop_columns(["keys"]).to_pylist()
        copies = lists.filter(pa.array(copied)).flatten() if copied.any() else None
        mine = [[i for i, r in enumerate(rows) if r["x"] == b and not copied[i]] for b in dict.fromkeys((rows[0]["px"], rows[0]["py"]))]
        if not all(mine):
            return none
        heads = lambda at: _Leading([rows[i] for i in at], [lists[i].values for i in at], copies)
        portions = lambda at, most: [[at[i] for i in p] for p in _portions([rows[i]["n"] for i in at], most)]
        found = [none]
        for k, some in enumerate(parts := portions(mine[-1], INDEXED)):
            two = heads(some)
            place = two.places()
            order = np.argsort(place)
            two.left = two.number = None
            index, wide = (place[order], two.doc[order], two.w[order]), len(two.keys)
            del place, order
            two.doc = two.w = None
            # Within one block a portion meets those before it and, text by text, what comes later in itself.
            others = [(p, False) for q in (parts[:k] if len(mine) == 1 else [mine[0]]) for p in portions(q, INDEXED // 8)]
            others += [(p, True) for p in portions(some, INDEXED // 8)] if len(mine) == 1 else []
            before = 0
            for at, itself in others if wide else []:
                one = heads(at)
                after = before if itself else None
                before += len(one.keys) if itself else 0
                for x, y in _reaching(one, index, wide, least, after) if len(one.keys) else []:
                    x, y = one.keys.take(pa.array(x)), two.keys.take(pa.array(y))
                    swap = pc.greater(x, y)
                    found.append(pa.table({"src": pc.if_else(swap, y, x), "dst": pc.if_else(swap, x, y)}))
        return pa.concat_tables(found).combine_chunks()

    return work


class _Whole:
    """Whole vectors of some packed rows: keys, ends, numbers, weights."""

    def __init__(self, rows: list[dict], keys: list[pa.Array]):
        self.keys = pa.concat_arrays(keys)
        sizes = [_unpacked(r["sizes"], np.int32, len(k)).astype(np.int64) for r, k in zip(rows, keys)]
        self.number = np.concatenate([np.cumsum(_unpacked(r["steps"], np.int32, r["n"]), dtype=np.int64).astype(np.int32) for r in rows])
        self.weight = np.concatenate([np.asarray(r["levels"])[_unpacked(r["w"], np.int32, r["n"])] / np.repeat(r["lengths"], size) for r, size in zip(rows, sizes)])
        self.ends = np.r_[0, np.cumsum(np.concatenate(sizes))]


def _dots(one: _Whole, two: _Whole, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of vectors x of ``one`` and y of ``two``: a vector is laid out once for all that it is multiplied with."""
    terms, at = np.unique(one.number, return_inverse=True)
    to = np.minimum(np.searchsorted(terms, two.number), len(terms) - 1)
    to[terms[to] != two.number] = len(terms)
    laid, out = np.zeros(len(terms) + 1), np.empty(len(x))
    order = np.lexsort((y, x))
    cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(x[order]) != 0]), len(x)]
    low, many = two.ends[y[order]], np.diff(two.ends)[y[order]]
    for i, j in zip(cuts[:-1], cuts[1:]):
        mine = slice(one.ends[x[order[i]]], one.ends[x[order[i]] + 1])
        laid[at[mine]] = one.weight[mine]
        while i < j:
            upto = np.cumsum(many[i:j])
            n = max(1, int(np.searchsorted(upto, PRODUCTS, side="right")))
            starts = upto[:n] - many[i : i + n]
            post = np.arange(upto[n - 1]) + np.repeat(low[i : i + n] - starts, many[i : i + n])
            out[order[i : i + n]] = np.add.reduceat(laid[to[post]] * two.weight[post], starts)
            i += n
        laid[at[mine]] = 0
    return out


def _multiply(t: pa.Table, asked: pa.Table) -> pa.Table:
    """src, dst, similarity of the candidates of two blocks, from whole vectors."""
    kind = asked.schema.field("src").type
    found = [pa.table({"src": pa.array([], kind), "dst": pa.array([], kind), "similarity": pa.array([], pa.float64())})]
    if not (t.num_rows and asked.num_rows):
        return found[0]
    lists, rows = t.column("keys").combine_chunks(), t.drop_columns(["keys"]).to_pylist()
    sides = [[i for i, r in enumerate(rows) if r["x"] == b] for b in dict.fromkeys((rows[0]["px"], rows[0]["py"]))]
    parts = [[[side[i] for i in p] for p in _portions([rows[i]["n"] for i in side], INDEXED // 2)] for side in sides]
    whole = lambda at: _Whole([rows[i] for i in at], [lists[i].values for i in at])
    src, dst = asked.column("src").combine_chunks(), asked.column("dst").combine_chunks()
    for k, p in enumerate(parts[0]):
        one = whole(p)
        a, b = (pc.index_in(c, one.keys) for c in (src, dst))
        for q in parts[1] if len(parts) > 1 else parts[0][k:]:
            two = one if q is p else whole(q)
            # src may lie on either side.
            for x, y in ((a, pc.index_in(dst, two.keys)), (b, pc.index_in(src, two.keys)))[: 1 if q is p else 2]:
                there = pc.and_(x.is_valid(), y.is_valid())
                if pc.any(there).as_py():
                    dots = _dots(one, two, x.filter(there).to_numpy(), y.filter(there).to_numpy())
                    found.append(pa.table({"src": src.filter(there), "dst": dst.filter(there), "similarity": dots}))
    return pa.concat_tables(found).combine_chunks()


def pairs_of_vectors(vectors: DataFrame, least: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Pairs (src < dst, similarity) of representatives with a cosine of at least ``least`` (above 0), and membership (k, rep).

    ``vectors`` are written rows (k, steps, raw, length) like those of ``tfidf_vectors``. Equal vectors (to nine decimals) are
    one class, compared once by its least key; two members of a class have a similarity of 1, members of two classes that of
    their representatives. Copies cost no pairs.

    Terms are ordered, the rarer the sooner. From a shared term on, a pair adds at most the product of the lengths that are left of
    both vectors there. Terms count as leading where that is (1 - SLACK) of the threshold or more, so what comes behind adds less, and
    a pair that reaches the threshold has SLACK of it in leading terms. A vector's head ends where the rest is too short to lead.
    Heads are dealt as pairs of at most MOST_BLOCKS blocks, so copies are bounded. A task adds up what pairs share in leading terms and answers
    those that have enough; products are never shuffled. Of those candidates the whole vectors are multiplied, which go only where they have one.
    """
    kind, lead = dict(vectors.dtypes)["k"], (1 - SLACK) * least
    named = persist_shared(vectors.mapInArrow(_names(lead), f"k {kind}, name binary, heads long"), "pair-names")
    members = persist_shared(named.select("k", "name").join(named.groupBy("name").agg(F.min("k").alias("rep")), "name").select("k", "rep"), "pair-members")
    n = min(MOST_BLOCKS, max(1, -(-(named.agg(F.sum("heads")).first()[0] or 0) // block)))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(n))
    dealt = lambda df: df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"px": F.least("x", F.col("_o").cast("long")), "py": F.greatest("x", F.col("_o").cast("long"))}).drop("_o")
    heads = vectors.withColumn("x", of("k")).mapInArrow(_pack_heads(lead), f"x long, keys array<{kind}>, sizes binary, steps binary, w binary, lengths binary, behind binary, n long")
    copies = members.where("k <> rep").select(of("k").alias("x"), F.array("k").alias("keys"))
    met = dealt(heads).unionByName(dealt(copies), allowMissingColumns=True).groupBy("px", "py").applyInArrow(_meet_heads(least), f"src {kind}, dst {kind}")
    candidates = persist_shared(met, "pair-candidates")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(NEEDED)).alias("_h")
    ends = candidates.select(F.explode(F.array(*[F.struct(F.col(a).alias("k"), of(b).cast("int").alias("o")) for a, b in (("src", "dst"), ("dst", "src"))])).alias("e"))
    needed = ends.select(place("e.k"), F.expr("shiftleft(1L, e.o)").alias("bit")).groupBy("_h").agg(F.bit_or("bit").alias("mask"))  # NEEDED rows at most
    some = vectors.join(F.broadcast(needed), place("k") == F.col("_h")).withColumn("x", of("k")).drop("_h")
    whole = some.mapInArrow(_pack_whole(n), f"px long, py long, x long, keys array<{kind}>, lengths array<double>, levels array<double>, sizes binary, steps binary, w binary, n long")
    asked = candidates.withColumns({"px": F.least(of("src"), of("dst")), "py": F.greatest(of("src"), of("dst"))})
    dots = whole.groupBy("px", "py").cogroup(asked.groupBy("px", "py")).applyInArrow(_multiply, f"src {kind}, dst {kind}, similarity double")
    return dots.where(F.col("similarity") >= least - 1e-12), members


def all_pairs(vectors: DataFrame, key: str, least: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``pairs_of_vectors`` for unit vectors as rows (key, term, weight)."""
    rows = persist_shared(vectors.select(F.col(key).alias("k"), "term", "weight"), "pair-rows")
    terms, _ = with_row_number(rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")), ["n", "term"], "number")
    lists = rows.join(terms, "term").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("number", "weight"))).alias("v"))
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("v", i - 1)["number"])
    steps = F.transform("v", lambda x, i: (x["number"] - before(i)).cast("int"))
    compact = lists.select("k", steps.alias("steps"), F.col("v.weight").cast("array<double>").alias("raw"), F.lit(1.0).alias("length"))
    return pairs_of_vectors(persist_shared(compact, "pair-vectors"), least, block)


def _report(pairs: DataFrame, members: DataFrame) -> DataFrame:
    copies = members.where("k <> rep").select(F.col("rep").alias("src"), F.col("k").alias("dst"), F.lit(1.0).alias("similarity"), F.lit("copy").alias("kind"))
    return pairs.withColumn("kind", F.lit("pair")).union(copies)


def pair_report(vectors: DataFrame, key: str, least: float, block: int = BLOCK) -> DataFrame:
    """src, dst, similarity, kind: pairs of representatives ('pair') and each other member with its own ('copy')."""
    return _report(*all_pairs(vectors, key, least, block))


def text_pair_report(df: DataFrame, key: str, text: Column, least: float, min_df: int = 2, max_df: float = 0.5, block: int = BLOCK) -> DataFrame:
    """``pair_report`` of the texts' ``tfidf``."""
    return _report(*pairs_of_vectors(tfidf_vectors(df, key, text, min_df, max_df), least, block))


def fuse(layers: list[tuple[DataFrame, float]], key: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """by, key, similarity: each layer's similarities scaled to [0, 1] within the layer (and query), weighted and summed;
    the k best of each query.

    Layers are top lists of k * 5 rows for each query, so the windows over them are small.
    """
    parts = None
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    for hits, weight in layers:
        low, high = F.min("similarity").over(whole), F.max("similarity").over(whole)
        s = F.when(high > low, (F.col("similarity") - low) / (high - low)).otherwise(1.0) * weight
        scored = hits.select(*by, key, s.alias("similarity"))
        parts = scored if parts is None else parts.unionByName(scored)
    fused = parts.groupBy(*by, key).agg(F.round(F.sum("similarity"), 9).alias("similarity"))
    place = F.row_number().over(whole.orderBy(F.col("similarity").desc(), key))
    return fused.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def layer_weights(attribute: float, dense: float, tfidf_: float, bm25_: float, anchored: bool) -> tuple[float, float, float, float]:
    """Without an anchor the attribute weight goes to the other layers in proportion."""
    if anchored:
        return attribute, dense, tfidf_, bm25_
    rest = dense + tfidf_ + bm25_
    if rest <= 0:
        return 0.0, 1 / 3, 1 / 3, 1 / 3
    scale = (attribute + rest) / rest
    return 0.0, dense * scale, tfidf_ * scale, bm25_ * scale
