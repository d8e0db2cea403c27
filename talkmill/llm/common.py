"""What the operators of this subpackage share: written tables, checked broadcasts and word shingles."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from talkmill.sources.shared import cut, shared_dir

__all__ = ["cut", "shared_dir"]  # beside what is defined here

#: Words in a shingle, and the similarity from which two texts are near duplicates.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Rows, and bytes by their values, up to which a table is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64_000_000


def release(spark: SparkSession) -> None:
    """Remove the tables that ``cut`` wrote in this application; results not yet written can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def value_bytes(value: Column, kind: DataType) -> Column:
    """About the bytes that a value takes in memory; nested ones count by their parts."""
    if isinstance(kind, (StringType, BinaryType)):
        own = F.octet_length(value) + 16
    elif isinstance(kind, ArrayType) and isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
        own = F.aggregate(value, F.lit(24).cast("long"), lambda a, x: a + F.coalesce(value_bytes(x, kind.elementType).cast("long"), F.lit(8).cast("long")))
    elif isinstance(kind, ArrayType):
        own = F.size(value) * 8 + 24
    elif isinstance(kind, StructType):
        own = sum((F.coalesce(value_bytes(value[f.name], f.dataType).cast("long"), F.lit(8).cast("long")) for f in kind), F.lit(16).cast("long"))
    else:
        own = F.lit(8)
    return own


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a written table if it has at most so many rows and bytes; otherwise it is joined by a shuffle."""
    each = sum((F.coalesce(value_bytes(F.col(f"`{f.name}`"), f.dataType).cast("long"), F.lit(8).cast("long")) for f in df.schema), F.lit(16).cast("long"))
    n, total = df.select(each.alias("b")).limit(rows + 1).agg(F.count("*"), F.sum("b")).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns, cast to the given types; any other column of ``df`` is left out, so names can't clash."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def native_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, as an array (built-in functions only)."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def native_shingles(words: Column, k: int = SHINGLE_WORDS) -> Column:
    """64-bit hashes of every ``k`` consecutive words; a shorter text has one shingle of all its words, an empty one none."""

    def hashes(w: Column) -> Column:
        out = F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])))
        for n in range(1, k):
            out = out.when(F.size(w) == n, F.array(F.xxhash64(*[F.get(w, F.lit(j)) for j in range(n)])))
        return out.otherwise(F.array().cast("array<bigint>"))

    # the one-element array binds the words once; named plainly they would be split anew for each position
    return F.transform(F.array(words), hashes)[0]


def sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows: those whose key hashes below a share of all hashes. Of rows with one key any one counts.

    The share follows from the number of different keys; nothing is sorted, and no task holds more for a larger input.
    """
    hashed = df.withColumn("sample_hash", F.xxhash64(key))
    keys = hashed.agg(F.approx_count_distinct("sample_hash", 0.02)).first()[0]
    if keys > rows:
        hashed = hashed.filter(F.col("sample_hash") < F.lit(-(2**63) + int(rows / keys * 2**64)))
    return hashed.dropDuplicates(["sample_hash"]).drop("sample_hash")


class WordHashes(dict):
    """64-bit hash of a word; emptied at 200,000 words, so that memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of every ``k`` consecutive word hashes; shorter texts have one shingle, empty texts none."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = mix(out + hashes[j : n - k + 1 + j] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (2**64 - 1)))
    return out
