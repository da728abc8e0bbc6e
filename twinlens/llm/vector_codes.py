"""Product quantisation of vectors with exact integer codebooks and norm-of-sum bounds.

Vectors become integers and are cut into ``PARTS`` equal parts; every part position has a
codebook of ``ENTRIES`` entries, refined for ``ROUNDS`` rounds. A part keeps, for every
entry, a distance that the entry had when it was last looked at, and the stamp of that
round. All codebooks so far are kept too: an entry can since have come nearer by no more
than its net way, the distance between its place then and now. That is at most the sum of
its steps (the norm of a sum against a sum of norms), so fewer entries are looked at
again. Each round measures the own entry, lowers the other distances by the net ways, and
rescans exactly the entries that might be as near.

All decisions are made on integers; bounds are rounded away from the decision, so they
only save work. A round is one pass over the written state of the round before; each task
adds one row with the sums of its parts, and the driver holds nothing but codebooks.

Rows: a vector that is NULL or holds NULL or non-finite components is dropped, and so is one
whose length is not that of the kept vector with the smallest id. Lengths that are no
multiple of ``PARTS`` are filled up with zeros. Rows without ``vec_id`` are coded but start
no entry (unless no row has an id); of repeated ids the smaller vector comes first. With
fewer rows than entries the codebooks are smaller. Components beyond ``LARGEST`` / sqrt
(length) are cut to it, as their squared distances fit no 64-bit integer. A table without
kept rows gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.session import durable, new_folder

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 2.0**30  # over the square root of the length: half the root of the largest 64-bit integer
BATCH = 4096  # vectors handled at once
SMALL_LABELS = 100_000  # labels up to this number are sent to all tasks
_NEAR = np.iinfo(np.int32).max
STATE_SCHEMA = "vec_id long, label string, has_label boolean, parts array<long>, codes binary, bounds array<int>, stamps binary, sums array<decimal(38,0)>, rescans long"


def _drop_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, parts: kept rows with integer components, any length."""
    kept = vectors.where(
        F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    )
    most = F.lit(LARGEST) / F.sqrt(F.greatest(F.size("embedding"), F.lit(1)))
    scaled = F.transform("embedding", lambda x: F.floor(F.greatest(-most, F.least(most, x.cast("double") * SCALE))).cast("long"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), scaled.alias("parts"))


@dataclass
class History:
    """The codebooks of all rounds, as ``books[round][part, entry, position]``."""

    books: list[np.ndarray]

    def net_ways(self) -> np.ndarray:
        """[stamp, part, entry]: how far each entry is from where it was in that round, rounded up."""
        steps = np.stack(self.books).astype(np.float64) - self.books[-1]
        return np.sqrt((steps**2).sum(-1)) * (1 + 1e-9) + 1e-6

    def drifts(self) -> np.ndarray:
        """The same with the lengths of all steps added up, for comparison."""
        books = np.stack(self.books).astype(np.float64)
        steps = np.sqrt((np.diff(books, axis=0) ** 2).sum(-1))
        return np.concatenate([np.cumsum(steps[::-1], 0)[::-1], np.zeros_like(steps[:1])]) if len(steps) else np.zeros(books.shape[:3])

    def means(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The next codebooks: floors of the means of the parts; entries without parts stay."""
        sums, counts = sums.reshape(self.books[-1].shape), counts.astype(object)[..., None]
        return np.where(counts > 0, sums // np.maximum(counts, 1), self.books[-1]).astype(np.int64)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books[-1].ravel().tolist())).encode()).hexdigest()


def _squares(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((parts - entries) ** 2).sum(-1)


def first_codes(parts: np.ndarray, history: History) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, own squared distance, bounds, stamps) of parts [vector, part, position] by a full scan."""
    book = history.books[-1]
    square = np.stack([_squares(parts, book[None, :, j]) for j in range(book.shape[1])], -1)
    codes = square.argmin(-1)
    bounds = np.minimum(np.floor(np.sqrt(square.astype(np.float64)) * (1 - 1e-9)), _NEAR).astype(np.int64)
    return codes, square.min(-1), bounds, np.full(square.shape, len(history.books) - 1, np.uint8)


def next_codes(parts, codes, bounds, stamps, history: History, ways: np.ndarray | None = None):
    """(codes, own squared distance, bounds, stamps, rescans): entries are measured again only if
    their bounds, less their net ways since the bounds' rounds, do not exclude them."""
    book, now = history.books[-1], len(history.books) - 1
    ways = history.net_ways() if ways is None else ways
    n, p, k = bounds.shape
    part, entry = np.arange(p)[None, :, None], np.arange(k)[None, None, :]
    own = _squares(parts, book[np.arange(p), codes])
    reach = np.sqrt(own.astype(np.float64)) * (1 + 1e-9) + 1e-6
    rescan = (bounds - ways[stamps, part, entry] <= reach[..., None]) & (entry != codes[..., None])
    bounds, stamps = bounds.copy(), stamps.copy()
    square = np.full(bounds.shape, np.iinfo(np.int64).max)
    square[np.arange(n)[:, None], np.arange(p), codes] = own
    i, q, j = np.nonzero(rescan)
    square[i, q, j] = _squares(parts[i, q], book[q, j])
    seen = rescan | (entry == codes[..., None])
    bounds[seen] = np.minimum(np.floor(np.sqrt(square[seen].astype(np.float64)) * (1 - 1e-9)), _NEAR).astype(np.int64)
    stamps[seen] = now
    return square.argmin(-1), square.min(-1), bounds, stamps, len(i)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width)


def _bytes_column(values: np.ndarray) -> pa.Array:
    """One binary value per row of a byte matrix."""
    n, width = values.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _byte_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _assign(batch: pa.RecordBatch, history: History):
    """Codes, own squared distances, bounds, stamps and rescans of a batch of state rows."""
    p, k, w = history.books[-1].shape
    parts = _matrix(batch.column("parts"), p * w).reshape(-1, p, w)
    if len(history.books) == 1:
        return parts, *first_codes(parts, history), parts.shape[0] * p * k
    codes = _byte_matrix(batch.column("codes"), p).astype(np.int64)
    bounds = _matrix(batch.column("bounds"), p * k).reshape(-1, p, k).astype(np.int64)
    stamps = _byte_matrix(batch.column("stamps"), p * k).reshape(-1, p, k)
    return parts, *next_codes(parts, codes, bounds, stamps, history)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, BATCH) for i in range(0, batch.num_rows, BATCH))


def _round(batches: Iterator[pa.RecordBatch], history: History) -> Iterator[pa.RecordBatch]:
    """The state behind a round's assignment, and one row with the task's sums and counts."""
    p, k, w = history.books[-1].shape
    sums, counts, rescans = np.zeros((p, k, w), object), np.zeros((p, k), np.int64), 0
    decimal = pa.decimal128(38, 0)
    for batch in _pieces(batches):
        parts, codes, _, bounds, stamps, again = _assign(batch, history)
        n, rescans = len(codes), rescans + again
        order = np.argsort(codes, axis=0, kind="stable")
        for q in range(p):
            ordered = parts[order[:, q], q]
            numbers = np.bincount(codes[:, q], minlength=k)
            used = np.flatnonzero(numbers)
            first = (np.cumsum(numbers) - numbers)[used]
            sums[q, used] += np.add.reduceat(ordered, first, axis=0).astype(object)
            counts[q] += numbers
        lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * p * k, pa.array(bounds.ravel().astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in ("vec_id", "label", "has_label", "parts")],
                _bytes_column(codes.astype(np.uint8)), lists, _bytes_column(stamps.reshape(n, p * k)),
                pa.nulls(n, pa.list_(decimal)), pa.nulls(n, pa.int64()),
            ],
            ["vec_id", "label", "has_label", "parts", "codes", "bounds", "stamps", "sums", "rescans"],
        )
    kinds = (pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.binary())
    flat = [int(x) for x in (*sums.ravel(), *counts.ravel())]
    row = pa.array([[Decimal(x) for x in flat]], pa.list_(decimal))
    yield pa.RecordBatch.from_arrays(
        [*[pa.nulls(1, t) for t in kinds], row, pa.array([rescans])],
        ["vec_id", "label", "has_label", "parts", "codes", "bounds", "stamps", "sums", "rescans"],
    )


def _final(batches: Iterator[pa.RecordBatch], history: History) -> Iterator[pa.RecordBatch]:
    digits = np.array(["%02x" % i for i in range(256)], object)
    for batch in _pieces(batches):
        _, codes, own, *_ = _assign(batch, history)
        texts = ["".join(row) for row in digits[codes]]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), batch.column("has_label"), pa.array(texts, pa.string()), pa.array(own.sum(-1))],
            ["vec_id", "label", "has_label", "code", "error"],
        )


@dataclass
class Compressed:
    """Trained codebooks and the state of every kept vector before the last assignment."""

    history: History
    state: DataFrame
    rescans: list[int]  #: distances measured by round, the own entry's not counted after the first


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Compressed | None:
    """Codebooks of ``vectors`` (vec_id, embedding, label); None if no vector is kept."""
    spark = vectors.sparkSession
    kept = integers(vectors)
    order = [F.col("vec_id").asc_nulls_last(), "parts"]
    head = kept.orderBy(*order).select("parts").first()
    if head is None:
        return None
    length = len(head.parts)
    width = -(-length // parts) or 1
    kept = kept.where(F.size("parts") == length)
    if length < parts * width:
        kept = kept.withColumn("parts", F.concat("parts", F.array_repeat(F.lit(0).cast("long"), parts * width - length)))
    with_id = kept.where("vec_id IS NOT NULL") if kept.where("vec_id IS NOT NULL").limit(1).count() else kept
    seeds = with_id.orderBy(*order).select("parts").limit(entries).collect()  # one codebook
    book = np.array([r.parts for r in seeds], np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    history, rescans = History([book]), []
    state, old = kept.withColumn("has_label", F.col("label").isNotNull()), None
    columns = ["vec_id", "label", "has_label", "parts", "codes", "bounds", "stamps"]
    for _ in range(rounds):
        path = new_folder(spark, "codes")
        state.mapInArrow(partial(_round, history=History(list(history.books))), STATE_SCHEMA).write.parquet(path)
        rows = spark.read.schema(STATE_SCHEMA).parquet(path)
        if old:  # the round before is no longer read
            _drop_folder(spark, old)
        told = rows.where("sums IS NOT NULL")
        again, added = told.agg(F.sum("rescans")).first()[0], told.select(F.posexplode("sums").alias("at", "x"))
        # one number for each position of the codebooks and one count for each entry
        numbers = {r.at: int(r.x) for r in added.groupBy("at").agg(F.sum("x").alias("x")).collect()}
        flat = np.array([numbers[i] for i in range(len(numbers))], object)
        size = book.size
        history.books.append(history.means(flat[:size], flat[size:].reshape(book.shape[:2])))
        rescans.append(again)
        state, old = rows.where("sums IS NULL").select(*columns), path
    return Compressed(history, state, rescans)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row per kept vector."""
    done = train(vectors, parts, entries, rounds)
    if done is None:
        schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema)
    schema = "vec_id long, label string, has_label boolean, code string, error long"
    coded = durable(done.state.mapInArrow(partial(_final, history=done.history), schema))
    sums = durable(coded.groupBy("has_label", F.coalesce("label", F.lit("")).alias("name")).agg(F.sum("error").alias("label_error")))
    sums = F.broadcast(sums) if sums.count() <= SMALL_LABELS else sums
    named = coded.withColumn("name", F.coalesce("label", F.lit("")))
    return named.join(sums, ["has_label", "name"]).select(
        "vec_id", "code", "error", "label_error", F.lit(done.history.sha256()).alias("codebooks_sha256")
    )
