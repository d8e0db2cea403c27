"""Vectors: centroids of conversations and categories, their similarities, and the embedding of new texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.text import cosine
from talkmill.operators.classify import in_window

#: Characters that a token is taken to have, tokens of a batch, texts of a batch.
CHARS, TOKENS, TEXTS = 4, 8192, 32


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid): the element-wise mean, summed on the map side first."""
    return df.groupBy(key).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias("centroid"))


def chunks_with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.join(vectors, "text_sha256")


def conversation_centroids(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The mean over a conversation's chunks; a repeated text counts as often as it stands there."""
    counted = chunks.groupBy("conv_uuid", "text_sha256").agg(F.count("*").alias("n"))
    weighted = counted.join(vectors, "text_sha256")
    mean = Summarizer.mean(array_to_vector(F.col("embedding")), F.col("n").cast("double"))
    return weighted.groupBy("conv_uuid").agg(vector_to_array(mean).alias("centroid"))


def category_centroids(centroids: DataFrame, seeds: DataFrame) -> DataFrame:
    """(slug, centroid): the mean of the centroids of the seed conversations (conv_uuid, slug)."""
    return mean_vectors(centroids.join(seeds, "conv_uuid"), "slug", "centroid")


def centroid_scores(centroids: DataFrame, categories: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(conv_uuid, slug, sim) of every candidate with every category.

    The categories travel as one array in a single broadcast row, whose size is that of the taxonomy: a person's own
    list of categories, however many conversations there are. So this is no join of two large sides.
    """
    if excluded is not None:
        centroids = centroids.join(excluded, "conv_uuid", "left_anti")
    table = categories.agg(F.collect_list(F.struct("slug", F.col("centroid").alias("own"))).alias("all")).withColumn("one", F.lit(1))
    paired = centroids.withColumn("one", F.lit(1)).join(F.broadcast(table), "one").select("conv_uuid", "centroid", F.explode("all").alias("c"))
    return paired.select("conv_uuid", "c.slug", cosine(F.col("centroid"), F.col("c.own")).alias("sim")).filter("sim is not null")


def predictions(centroids: DataFrame, seeds: DataFrame, targets: DataFrame, taxonomy: DataFrame, floor: float = 0.2) -> DataFrame:
    """(conv_uuid, slug, sim, rank) of the target conversations (conv_uuid, created_at): categories whose window holds
    the conversation's day, at a similarity of ``floor`` or more, ranked from the most similar on (ties by slug)."""
    categories = category_centroids(centroids.join(seeds.select("conv_uuid").distinct(), "conv_uuid", "left_semi"), seeds)
    near = centroid_scores(centroids.join(targets, "conv_uuid", "left_semi"), categories).filter(F.col("sim") >= floor)
    dated = near.join(targets.select("conv_uuid", F.to_date("created_at").alias("day")), "conv_uuid").join(taxonomy.select("slug", "date_start", "date_end"), "slug")
    inside = dated.filter(in_window(F.col("day"), F.col("date_start"), F.col("date_end")))
    order = Window.partitionBy("conv_uuid").orderBy(F.desc("sim"), "slug")
    return inside.select("conv_uuid", "slug", "sim", F.row_number().over(order).alias("rank"))


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(text_sha256, text) of each distinct text without a vector."""
    texts = chunks.filter("text != ''").groupBy("text_sha256").agg(F.first("text").alias("text"))
    return texts.join(vectors, "text_sha256", "left_anti")


def embed(texts: DataFrame, model: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(text_sha256, embedding) by ``model``, in batches of like lengths; vectors have length one, zero ones stay zero."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            start = 0
            while start < len(frame):
                size = max(1, min(TEXTS, TOKENS // max(1, len(frame["text"].iloc[start]) // CHARS)))
                some = frame.iloc[start : start + size]
                x = np.asarray(model(some["text"].tolist()), np.float64)
                length = np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({"text_sha256": some["text_sha256"], "embedding": list(x / np.where(length > 0, length, 1))})
                start += size

    return texts.sortWithinPartitions(F.length("text"), "text_sha256").mapInPandas(run, "text_sha256 string, embedding array<double>")


def backfill(chunks: DataFrame, vectors: DataFrame, model: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """The vectors with those of all new texts; texts that have one keep it, so a second run adds nothing."""
    return vectors.unionByName(embed(missing_vectors(chunks, vectors), model))
