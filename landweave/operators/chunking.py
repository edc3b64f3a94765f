"""Splitting of long texts into chunks of sentences, each text folded on its own.

The fold is an aggregate over the array of sentences, evaluated in the JVM; only one text is in memory at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.session import spread


def sentences(text: Column) -> Column:
    """Pieces between a full stop, question or exclamation mark and a blank followed by a capital, or at blank lines.

    The split is by a rule, without a trained model; abbreviations such as ``No.`` and ``Sec.`` do not end a sentence."""
    kept = F.regexp_replace(text, r"\b(No|Sec|Art|Ch|Mr|Mrs|Ms|Dr|St|vs|Inc|Corp)\. ", "$1\u0001 ")
    parts = F.split(F.regexp_replace(kept, r"([.!?])\s+(?=[A-Z(\"])|\n\s*\n", "$1\u0002"), "\u0002")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, "\u0001", "."))), lambda s: s != "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def boundaries(parts: Column, target: int, most: int) -> Column:
    """Chunks as arrays of sentences: a chunk ends when it has ``target`` words or the next sentence would bring it
    over ``most``; a longer sentence is a chunk of its own."""
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), none.alias("open"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        k = word_count(x)
        over = (s["n"] > 0) & (s["n"] + k > most)
        done = F.when(over, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
        open_ = F.when(over, F.array(x)).otherwise(F.concat(s["open"], F.array(x)))
        n = F.when(over, k).otherwise(s["n"] + k)
        full = n >= target
        return F.struct(F.when(full, F.concat(done, F.array(open_))).otherwise(done).alias("done"), F.when(full, none).otherwise(open_).alias("open"), F.when(full, F.lit(0)).otherwise(n).alias("n"))

    return F.aggregate(parts, start, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def chunk(documents: DataFrame, key: str = "doc_id", text: str = "text", target: int = 400, most: int = 500, overlap: int = 2) -> DataFrame:
    """(key, chunk_number, chunk_text, words, overlap_text, section): chunks in order; the overlap with the chunk before
    is kept beside the text. Null and blank texts have no chunks."""
    parts = spread(documents.where(F.col(text).isNotNull()).select(key, text)).select(key, boundaries(sentences(F.col(text)), target, most).alias("_c"))
    rows = parts.select(key, "_c", F.posexplode("_c").alias("chunk_number", "_s"))
    before = F.when(F.col("chunk_number") > 0, F.array_join(F.slice(F.element_at("_c", F.greatest(F.col("chunk_number"), F.lit(1))), -overlap, overlap), " "))
    before = F.when(F.size(F.element_at("_c", F.greatest(F.col("chunk_number"), F.lit(1)))) < overlap, F.when(F.col("chunk_number") > 0, F.array_join(F.element_at("_c", F.greatest(F.col("chunk_number"), F.lit(1))), " "))).otherwise(before)
    body = F.array_join("_s", " ")
    section = F.nullif(F.regexp_extract(body, r"(?:SECTION|Section|Sec\.) +([0-9]+(?:[.-][0-9]+)*)", 1), F.lit(""))
    return rows.select(key, "chunk_number", body.alias("chunk_text"), word_count(body).alias("words"), before.alias("overlap_text"), section.alias("section"))


def new_texts(chunks: DataFrame, cached: DataFrame, text: str = "chunk_text", hash_column: str = "content_hash") -> DataFrame:
    """Distinct (hash, text) that the cache does not have yet."""
    fresh = chunks.select(F.md5(F.col(text).cast("binary")).alias(hash_column), F.col(text)).dropDuplicates([hash_column])
    return fresh.join(cached.select(hash_column).distinct(), hash_column, "left_anti")


def hash_embedding(text: Column, dims: int = 16) -> Column:
    """A stand-in for an embedder: counts of words by hash, scaled to length 1. For tests and offline use."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    v = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.coalesce(x / F.nullif(size, F.lit(0.0)), F.lit(0.0)))
