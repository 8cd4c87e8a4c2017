"""Embedding articles in batches: a pluggable encoder, loaded once a task; only what the model has not done yet."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import text as tx

#: Gives vectors for texts, one each.
Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def byte_bucket_encoder(size: int = 8) -> Encoder:
    """Bytes summed by place modulo `size`, scaled to length one: a stand-in for a model, the same everywhere."""

    def encode(batch: Sequence[str]) -> list[np.ndarray]:
        out = []
        for text in batch:
            raw = np.frombuffer(text.encode(), dtype=np.uint8).astype(np.float64)
            sums = np.pad(raw, (0, -len(raw) % size)).reshape(-1, size).sum(axis=0)
            length = float(np.sqrt((sums * sums).sum()))
            out.append(sums / length if length else sums)
        return out

    return encode


def pending(articles: DataFrame, done: DataFrame, model: str) -> DataFrame:
    """Articles of which `done` (article_id, embedding_model) has no vector by this model; of rows that share an id, one."""
    have = done.where(F.col("embedding_model") == model).select("article_id")
    return articles.join(have, "article_id", "left_anti").dropDuplicates(["article_id"])


def create_embeddings(articles: DataFrame, make_encoder: Callable[[], Encoder], model: str, version: str, done: DataFrame | None = None, created_at: Column | None = None, batch: int = 64) -> DataFrame:
    """(article_id, embedding, embedding_dimension, embedding_model, embedding_model_version, created_at) of the articles pending for the model.

    `make_encoder` is called once a task, where its first text is, and gets `batch` texts at a time, so a model is
    loaded once for many rows and memory stays bounded. A text is the title and the clean text, the title left out where
    the text has it. Articles without an id are left out; empty texts are encoded like others. Writing the result beside
    `done` makes the next run encode only what is new. created_at is now unless given. Vectors are JSON texts of doubles.
    """
    known = articles.where("article_id IS NOT NULL").select("article_id", "title", "clean_text")
    todo = pending(known, done, model) if done is not None else known.dropDuplicates(["article_id"])
    texts = todo.select("article_id", tx.article_text(F.col("title"), F.col("clean_text")).alias("said"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                encode = encode or make_encoder()
                vectors = [np.asarray(v, dtype=np.float64) for v in encode([t or "" for t in part.column(1).to_pylist()])]
                if len(vectors) != part.num_rows:
                    raise ValueError(f"the encoder gave {len(vectors)} vectors for {part.num_rows} texts")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["article_id", "vector"])

    vectors = texts.mapInArrow(run, f"article_id {texts.schema['article_id'].dataType.simpleString()}, vector array<double>")
    stamp = created_at if created_at is not None else F.current_timestamp()
    return vectors.select("article_id", tx.vector_json(F.col("vector")).alias("embedding"), F.size("vector").cast("long").alias("embedding_dimension"), F.lit(model).alias("embedding_model"), F.lit(version).alias("embedding_model_version"), stamp.alias("created_at"))
