"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: share of words in a lexicon of toxic words and in one of toxic
word stems (both learned from the labelled sample), how many of them stand near a
second-person pronoun, capitals, punctuation, exclamation marks, obfuscated words
(letters mixed with digits or symbols) and length. The labelled sample
(``PER_CLASS`` documents of either label at most) is cut into three parts by hash: one
fills the lexicons, one grows the trees, one calibrates their margin.

Rows: NULL text is the empty text and gets the score of a text without any feature;
repeated rows are scored alike; with no toxic or no clean label the score is the share
of the one that is there (0.5 without any); other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.features import labelled_sample, remainder
from twinlens.llm.text import slices, span_hash, words_of
from twinlens.session import durable

PER_CLASS = 4000
LEXICON = 300  # words or stems at most
STEMS = (6, 8)  # bytes of a stem
NEAR = 4  # words
TREES, DEPTH = 20, 3
FEATURES = ("words", "stems", "long_stems", "known_words", "near_you", "capitals", "marks", "shouts", "obfuscated", "length", "hits")

# Second-person pronouns of the corpus languages.
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi",
    "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "vosotros", "tus",
)


def _letters_only(w) -> tuple[np.ndarray, np.ndarray]:
    """Spans of words without marks at either end."""
    letter = np.zeros(256, bool)
    letter[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    start, end = w.start.copy(), w.end.copy()
    for _ in range(8):
        strip = (end > start) & ~letter[w.data[np.maximum(end - 1, 0)]]
        end[strip] -= 1
        strip = (end > start) & ~letter[w.data[np.minimum(start, len(w.data) - 1)]]
        start[strip] += 1
    return start, end


def _hashes(w) -> list[np.ndarray]:
    """Hash of each bare word and of its stems (0 for words no longer than a stem)."""
    if not len(w.start):
        return [np.zeros(0, np.uint64)] * (1 + len(STEMS))
    start, end = _letters_only(w)
    out = [span_hash(w.data, start, end, True)]
    for size in STEMS:
        out.append(np.where(end - start > size, span_hash(w.data, start, np.minimum(end, start + size), True), 0))
    return out


def _hash_text(words: tuple[str, ...]) -> np.ndarray:
    return _hashes(words_of(pa.array([" ".join(words)])))[0]


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words (kind 0) and stems (kind 1, 2) of each sampled text."""
    for batch in batches:
        for part in slices(batch):
            w = words_of(part.column("text"))
            y = part.column("y").to_numpy()
            for kind, hashes in enumerate(_hashes(w)):
                pair = np.unique(np.stack([w.doc.astype(np.uint64), hashes], 1), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[:, 1].view(np.int64)), pa.array(np.full(len(pair), kind, np.int32)),
                     pa.array(y[pair[:, 0].astype(np.int64)].astype(np.int32))],
                    names=["term", "kind", "y"],
                )


def lexicons(sample: DataFrame) -> list[np.ndarray]:
    """Hashes of the words and of the stems that mark toxic texts of the sample."""
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    terms = sample.select("text", "y").mapInArrow(_sample_terms, "term long, kind int, y int").where("term <> 0")
    counted = terms.groupBy("kind", "term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    lift = F.log((F.col("a") + 0.5) / (toxic + 1) / ((F.col("b") + 0.5) / (clean + 1)))
    strong = counted.where(F.col("a") >= 3).withColumn("lift", lift).where(F.col("lift") > math.log(4))
    out = []
    for kind in range(1 + len(STEMS)):
        best = strong.where(F.col("kind") == kind).orderBy(F.desc(F.col("lift") * F.sqrt("a")), "term").limit(LEXICON)
        out.append(np.sort(np.array([r.term for r in best.collect()], np.int64).view(np.uint64)))
    return out


def dense_features(column: pa.Array, known: list[np.ndarray]) -> np.ndarray:
    """texts x len(FEATURES)."""
    w = words_of(column)
    n = w.texts
    out = np.zeros((n, len(FEATURES)))
    if not len(w.start):
        return out
    doc = w.doc
    bare, *stems = _hashes(w)
    hit = np.isin(bare, known[0])
    stem_hits = [np.isin(h, names) for h, names in zip(stems, known[1:], strict=True)]
    any_hit = np.logical_or.reduce([hit, *stem_hits])
    you = np.isin(bare, _hash_text(SECOND_PERSON))
    total = np.maximum(w.counts, 1)

    def per_text(flag: np.ndarray) -> np.ndarray:
        return np.bincount(doc[flag], minlength=n)

    # distance to the nearest pronoun, within the text
    at = np.arange(len(doc))
    before = np.maximum.accumulate(np.where(you, at, -1_000_000))
    after = np.minimum.accumulate(np.where(you, at, 1 << 40)[::-1])[::-1]
    close = ((at - before <= NEAR) & (before >= w.first[doc])) | ((after - at <= NEAR) & (after < w.first[doc + 1]))
    kinds = np.zeros(256, np.uint8)
    kinds[65:91] = 1
    kinds[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
    kinds[33] = 3
    kinds[48:58] = 4
    kind = kinds[w.data]
    size = np.maximum(np.diff(w.offsets), 1)

    def share(*which: int) -> np.ndarray:
        sums = np.append(0, np.cumsum(np.isin(kind, which)))
        return (sums[w.offsets[1:]] - sums[w.offsets[:-1]]) / size

    odd = np.append(0, np.cumsum((kind == 2) | (kind == 4)))
    start, end = _letters_only(w)
    mixed = (odd[end] - odd[start] > 0) & (odd[end] - odd[start] < end - start)
    hits = per_text(hit)
    columns = [
        hits / total,
        *(per_text(h) / total for h in stem_hits),
        per_text(any_hit) / np.sqrt(total),
        per_text(any_hit & close) / total,
        share(1),
        share(2, 3),
        share(3),
        per_text(mixed) / total,
        np.log1p(w.counts),
        np.minimum(hits, 10),
    ]
    out[:] = np.stack(columns, 1)
    return out


def _featured(batches: Iterator[pa.RecordBatch], known: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            values = dense_features(part.column("text"), known)
            offsets = np.arange(0, values.size + 1, len(FEATURES), dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
            yield part.remove_column(part.schema.get_field_index("text")).append_column("values", lists)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    sample = durable(labelled_sample(docs, labels, "toxic", PER_CLASS).withColumn("third", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10))))
    seen = {r.y: r.w for r in sample.groupBy("y").agg(F.sum("weight").alias("w")).collect()}
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = (remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    parts = [sample.where("third < 4"), sample.where("third BETWEEN 4 AND 7"), sample.where("third > 7")]
    mixed = all(p.select("y").distinct().count() == 2 for p in parts)
    if not mixed:
        share = seen.get(1, 0.0) / sum(seen.values()) if seen else 0.5
        return rows.select("doc_id", held, F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    work = partial(_featured, known=lexicons(parts[0]))
    known = sample.select("text", "y", "weight", "third").mapInArrow(
        work, "y int, weight double, third long, values array<double>"
    )
    # a bounded sample: few partitions, in a fixed order
    known = durable(known.coalesce(2).select(F.col("y").cast("double").alias("y"), "weight", "third", array_to_vector("values").alias("features")))
    trees = GBTClassifier(labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=64)
    grown = trees.fit(known.where("third BETWEEN 4 AND 7"))
    margin = vector_to_array("rawPrediction").getItem(1)
    apart = grown.transform(known.where("third > 7")).select("y", "weight", margin.alias("margin"))
    fitted = IsotonicRegression(featuresCol="margin", labelCol="y", weightCol="weight").fit(apart)
    values = rows.mapInArrow(work, f"doc_id {kind}, values array<double>")
    scored = grown.transform(values.select("doc_id", array_to_vector("values").alias("features")))
    scored = fitted.transform(scored.select("doc_id", margin.alias("margin")))
    result = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", held, result.alias("score"), (result >= 0.5).cast("int").alias("predicted"))
