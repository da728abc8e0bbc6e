"""Vector best-fit packing of token sequences.

Documents are encoded, an end id is appended, and only documents longer than
``capacity`` are cut into pieces. Pieces go into sequences with three capacities:
tokens, number of pieces, and attention cost (the sum of squared lengths). Pieces are
placed longest first; among all open sequences that a piece fits under every
constraint, the one with the best score is taken: the smallest weighted norm of what
would remain (``rule="norm"``) or the largest weighted dot product of need and
remainder (``rule="dot"``). A piece that fits nowhere opens a sequence.

Packing is cut into groups of about ``GROUP_TOKENS`` tokens by a hash of the piece, so
no task holds more however large the table is; a group leaves at most a few sequences
unfilled.

Rows: NULL text is the empty text (one end id); repeated rows are packed each; a
document's pieces may go to different sequences; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.text import slices
from twinlens.llm.tokens import encoder
from twinlens.session import durable

END_ID = 0
GROUP_TOKENS = 48_000_000
GROUP_PIECES = 1_000_000


@dataclass(frozen=True)
class PackingParams:
    capacity: int = 2048
    most_pieces: int = 2048
    most_attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)  #: tokens, pieces, attention
    rule: str = "norm"


_PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, tie long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    tool = encoder(path, byte_level=False)
    for batch in batches:
        for rows in slices(batch):
            ids, counts = tool.encode(rows.column("text"))
            with_end = np.full(len(ids) + len(counts), END_ID, np.uint32)
            inside = np.ones(len(with_end), bool)
            inside[np.cumsum(counts + 1) - 1] = False
            with_end[inside] = ids
            lengths = counts + 1
            pieces = -(-lengths // capacity)
            doc = np.repeat(np.arange(len(lengths)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(lengths[doc] - start, capacity)
            begin = (np.cumsum(lengths) - lengths)[doc] + start
            raw = memoryview(with_end.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = [
                rows.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                pa.array(crc, pa.int64()), rows.column("tie").take(pa.array(doc)),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "tie"]
            if keep_ids:  # pieces follow each other without gaps
                ends = np.append(0, begin + length).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(with_end.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def best_fit(lengths: np.ndarray, params: PackingParams) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; ``lengths`` must not increase."""
    caps = np.array([params.capacity, params.most_pieces, params.most_attention], float)
    weights = np.array(params.weights)
    rest = np.empty((1024, 3))  # what is left of each open sequence
    bins = 0
    where = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    cuts = np.append(np.flatnonzero(np.append(True, lengths[1:] != lengths[:-1])), len(lengths)) if len(lengths) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        size = int(lengths[a])
        need = np.array([size, 1, size * size], float)
        at = a
        while at < b:
            open_bins = rest[:bins]
            fits = np.flatnonzero((open_bins >= need).all(1))
            if len(fits):
                if params.rule == "norm":
                    score = ((((open_bins[fits] - need) / caps) ** 2) * weights).sum(1)
                else:
                    score = -((open_bins[fits] / caps) * (need / caps) * weights).sum(1)
                take = min(b - at, len(fits))
                if take < len(fits):
                    order = np.argpartition(score, take - 1)[:take]
                    fits, score = fits[order], score[order]
                chosen = fits[np.lexsort((fits, score))]
                where[at : at + take] = chosen
                offset[at : at + take] = params.capacity - rest[chosen, 0]
                rest[chosen] -= need
                at += take
                continue
            # open sequences that hold as many pieces of this size as each can
            per = max(1, int((caps // need).min()))
            left = b - at
            fresh = -(-left // per)
            if bins + fresh > len(rest):
                rest = np.concatenate([rest, np.empty((max(len(rest), fresh), 3))])
            number = np.arange(left)
            where[at:b] = bins + number // per
            offset[at:b] = number % per * size
            used = np.bincount(number // per, minlength=fresh)
            rest[bins : bins + fresh] = caps - used[:, None] * need
            bins += fresh
            at = b
    return where, offset


def _pack(batches: Iterator[pa.RecordBatch], params: PackingParams) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    table = pa.Table.from_batches(held)
    table = table.sort_by([("group", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("tie", "ascending")])
    group = table.column("group").to_numpy()
    lengths = table.column("length").to_numpy()
    sequence, offset = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        where, offset[a:b] = best_fit(lengths[a:b], params)
        sequence[a:b] = (np.int64(group[a]) << 32) + where
    table = table.drop_columns(["group", "tie"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
    yield from table.combine_chunks().to_batches(max_chunksize=10_000)


def pack(docs: DataFrame, tokenizer: str, params: PackingParams | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece (and its ids)."""
    params = params or PackingParams()
    if min(params.most_pieces, params.capacity) < 1 or params.most_attention < params.capacity**2:
        raise ValueError("every capacity must admit one full piece")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ids = ", ids array<int>" if keep_ids else ""
    cut = partial(_pieces, path=tokenizer, capacity=params.capacity, keep_ids=keep_ids)
    pieces = durable(rows.mapInArrow(cut, _PIECE_SCHEMA + ids))
    facts = pieces.agg(F.sum("length"), F.count("*")).first()
    groups = max(1, -(-(facts[0] or 0) // GROUP_TOKENS), -(-facts[1] // GROUP_PIECES))
    group = F.pmod(F.xxhash64("doc_id", "piece", "tie"), F.lit(groups)).cast("int")
    dealt = pieces.withColumn("group", group).repartitionById(groups, F.col("group"))
    schema = _PIECE_SCHEMA.replace(", tie long", "") + ids + ", sequence_id long, offset long"
    return dealt.mapInArrow(partial(_pack, params=params), schema)
