"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become counts of hashed terms (words, two-letter word ends, repeated words and
three-word windows, text length), damped by 1 + log and weighted by inverse document
frequency. The leading eigenvectors of the labelled sample's Gram matrix span the
latent space. The labelled vectors (``LABELLED_PER_CLASS`` of either label at most)
are broadcast; every document takes exact cosine products with all of them, block by
block, and its ``NEIGHBOURS`` nearest vote with their similarity. A labelled text counts
for as many texts of its class as it stands for, in the votes and in the latent space,
so a score means the share of good neighbours whether or not the bound cuts a class.

Rows: NULL and empty texts have a vector of their own (the length term) and are
scored like any other; repeated rows are scored alike; without any label of one of
the classes the score is the share of the other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.features import labelled_sample, remainder
from twinlens.llm.text import Words, mix, slices, words_of

TERMS = 1024
LABELLED_PER_CLASS = 2000  # the broadcast holds 2 * this * LATENT floats (1 MB)
LATENT = 48
NEIGHBOURS = 25
SHARPNESS = 4.0  # votes weigh similarity to this power


@dataclass
class LatentModel:
    idf: np.ndarray
    axes: np.ndarray  #: TERMS x LATENT
    vectors: np.ndarray  #: labelled documents, rows of length 1
    labels: np.ndarray
    weights: np.ndarray  #: number of labelled texts that each one stands for


def _count(into: np.ndarray, doc: np.ndarray, term: np.ndarray) -> None:
    into += np.bincount(doc * TERMS + term, minlength=into.size).reshape(into.shape)


def term_counts(column: pa.Array) -> np.ndarray:
    """texts x TERMS damped counts."""
    w: Words = words_of(column)
    counts = np.zeros((w.texts, TERMS))
    doc = w.doc
    if len(doc):
        width = np.uint64(TERMS // 4)
        _count(counts, doc, (w.hash % width).astype(np.int64))
        ends = (w.data[w.end - 1].astype(np.uint64) << np.uint64(8)) | w.data[np.maximum(w.end - 2, w.start)]
        _count(counts, doc, (mix(ends) % width).astype(np.int64) + TERMS // 4)
        upper = (w.data[w.start] >= 65) & (w.data[w.start] <= 90) & (w.data[w.end - 1] >= 33) & (w.data[w.end - 1] <= 90)
        _count(counts, doc[upper], np.full(int(upper.sum()), TERMS - 2))
        # windows seen before in the same text
        key = mix(w.hash[:-2] + np.uint64(3) * w.hash[1:-1] + np.uint64(5) * w.hash[2:]) if len(doc) > 2 else w.hash[:0]
        inside = doc[: len(key)] == doc[2:] if len(key) else np.zeros(0, bool)
        key, at = mix(key[inside] ^ mix(doc[:-2][inside].astype(np.uint64))), doc[: len(key)][inside]
        order = np.argsort(key, kind="stable")
        again = order[1:][key[order][1:] == key[order][:-1]]
        repeats = np.bincount(at[again], minlength=w.texts)
        share = repeats / np.maximum(w.counts, 1)
        # the share counts in ten steps, so that long and short texts compare
        step = np.minimum((share * 10).astype(np.int64), 9)
        some = w.counts > 0
        _count(counts, np.flatnonzero(some), TERMS - 16 + step[some])
    counts = np.log1p(counts)
    length = np.minimum(np.log2(w.counts + 1).astype(np.int64), 19)
    counts[np.arange(w.texts), TERMS // 2 + length] += 1
    # one-hot facts weigh as much as a frequent term
    counts[:, TERMS - 16 : TERMS - 2] *= 6
    return counts


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _project(counts: np.ndarray, idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return _unit(_unit(counts * idf) @ axes).astype(np.float32)


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            rows = [r.tobytes() for r in term_counts(part.column("text")).astype(np.float32)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), part.column("y"), part.column("weight"), pa.array(rows, pa.binary())],
                names=["doc_id", "y", "weight", "terms"],
            )


def fit(docs: DataFrame, labels: DataFrame) -> LatentModel:
    """Latent space and labelled vectors from the bounded sample."""
    sample = labelled_sample(docs, labels, "quality", LABELLED_PER_CLASS)
    rows = sample.mapInArrow(_sample_rows, "doc_id long, y int, weight double, terms binary").collect()
    rows.sort(key=lambda r: r.doc_id)  # at most 2 * LABELLED_PER_CLASS rows, in one order everywhere
    counts = np.array([np.frombuffer(r.terms, np.float32) for r in rows]).reshape(-1, TERMS)
    weights = np.array([r.weight for r in rows], float)
    idf = np.log((1 + weights.sum()) / (1 + weights @ (counts > 0))) + 0.1
    scaled = _unit(counts * idf) * np.sqrt(weights)[:, None]
    _, vectors = np.linalg.eigh(scaled.T @ scaled)
    axes = vectors[:, ::-1][:, :LATENT]
    # the sign of an eigenvector is free: fix it
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(LATENT)] < 0, -1, 1)
    return LatentModel(idf, axes, _project(counts, idf, axes), np.array([r.y for r in rows], float), weights)


def vote(vectors: np.ndarray, model: LatentModel) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, weighted by similarity and by what they stand for."""
    if len(model.labels) == 0:
        return np.full(len(vectors), 0.5)
    k = min(NEIGHBOURS, len(model.labels))
    out = np.empty(len(vectors))
    for a in range(0, len(vectors), 256):
        near = vectors[a : a + 256] @ model.vectors.T
        index = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, index, 1), 1e-6) ** SHARPNESS * model.weights[index]
        out[a : a + 256] = (weight * model.labels[index]).sum(1) / weight.sum(1)
    return np.clip(out, 0.0, 1.0)


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        for part in slices(batch):
            score = vote(_project(term_counts(part.column("text")), model.idf, model.axes), model)
            index = part.schema.get_field_index("text")
            yield part.remove_column(index).append_column("score", pa.array(score))


def score(docs: DataFrame, labels: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every document (and its text)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    if keep_text:
        rows = rows.withColumn("whole", F.col("text"))
    scored = rows.mapInArrow(partial(_score, shared=shared), f"doc_id {kind}{', whole string' * keep_text}, score double")
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        *([F.col("whole").alias("text")] if keep_text else []),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are predicted good, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                points = vote(_project(term_counts(part.column("text")), model.idf, model.axes), model)
                yield part.filter(pa.array(points >= 0.3))

    return docs.mapInArrow(good, docs.schema)
