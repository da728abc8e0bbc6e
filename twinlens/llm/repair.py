"""Token ids as binary files, compressed by a Re-Pair grammar per shard.

A shard is a run of whole documents in ascending ``doc_id`` order. Within it the
frequent pairs of neighbouring symbols are replaced by nonterminals, the most frequent
ones first, until no pair occurs ``LEAST_USES`` times. A shard row stores the rules, the expanded length of every
nonterminal, the final sequence (16-bit symbols where they fit) and the number of
symbols and ids of each document. Pairs never cross documents, so one document is
decoded from its own symbols alone.

File format: Parquet rows (see ``SHARD_SCHEMA``) with little-endian binary columns, one
partition per ``doc_id`` range, shards in order.

Rows: NULL text is the empty text (its ids are the end id alone); a NULL ``doc_id``
sorts first; rows with one ``doc_id`` are stored one after the other in text order; an
empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.llm.text import ragged, slices
from twinlens.llm.tokens import encoder

END_ID = 0  # appended to every document
SHARD_IDS = 1 << 20  # a shard closes with the document that reaches this
LEAST_USES = 16  # a pair is replaced as long as it occurs so often in the shard
TOGETHER = 64  # pairs with this part of the most frequent one's uses are replaced in the same round
SHARD_SCHEMA = (
    "part int, shard int, doc_id array<long>, n_ids array<long>, n_symbols array<long>, "
    "terminals int, rules binary, expansions binary, width int, symbols binary"
)
_HASH_BITS = 20
_HASH_SORTED = 1 << 19  # fewer pairs than this are sorted


def _frequent_pairs(sequence: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, names, which): the pairs inside documents that are replaced next, ``names[which]`` being those at the places.

    Pairs with ``LEAST_USES`` or more, as far as they have a ``TOGETHER``-th of the most frequent one's.
    """
    key = (sequence[:-1] << np.uint64(32)) | sequence[1:]
    slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)).view(np.int64)
    # a slot counts at least as often as each of its pairs: only full slots are looked at
    place = np.flatnonzero((np.bincount(slot, minlength=1 << _HASH_BITS) >= LEAST_USES)[slot] & ~last[:-1])
    key = key[place]
    if len(place) < _HASH_SORTED:
        names, which, count = np.unique(key, return_inverse=True, return_counts=True)
        keep = (count >= max(LEAST_USES, int(count.max(initial=0)) // TOGETHER))[which]
        return place[keep], names, which[keep]
    # one pair of each slot is counted by the slot, the few others that fell into it are sorted
    which = slot[place]
    holder = np.zeros(1 << _HASH_BITS, np.uint64)
    holder[which] = key
    others = np.flatnonzero(holder[which] != key)
    names, rest = np.unique(key[others], return_inverse=True)
    which[others] = rest + (1 << _HASH_BITS)
    count = np.bincount(which, minlength=(1 << _HASH_BITS) + len(names))
    often = count >= max(LEAST_USES, int(count.max(initial=0)) // TOGETHER)
    keep = often[which]
    return place[keep], np.concatenate([holder, names])[often], (np.cumsum(often) - 1)[which[keep]]


def compress(ids: np.ndarray, last: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, sequence, last): Re-Pair of ``ids``; ``last`` marks the final symbol of each document.

    ``rules[k]`` are the two symbols of nonterminal ``terminals + k``. Ends when no pair has ``LEAST_USES``.
    """
    rules: list[np.ndarray] = []
    made = 0
    sequence = ids.astype(np.uint64)
    while len(sequence) > 1:
        place, names, which = _frequent_pairs(sequence, last)
        if not len(place):
            break
        # of overlapping pairs in a row every second one is replaced
        opens = np.append(True, place[1:] != place[:-1] + 1)
        run = np.flatnonzero(opens)
        within = np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))
        keep = within % 2 == 0
        place, which = place[keep], which[keep]
        useful = np.bincount(which, minlength=len(names)) >= 4
        if not useful.any():
            break
        number = np.cumsum(useful) - 1 + terminals + made
        keep = useful[which]
        place, which = place[keep], which[keep]
        rules.append(np.stack([names[useful] >> np.uint64(32), names[useful] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        made += int(useful.sum())
        sequence = sequence.copy()
        sequence[place] = number[which]
        last = last.copy()
        last[place] = last[place + 1]
        stay = np.ones(len(sequence), bool)
        stay[place + 1] = False
        sequence, last = sequence[stay], last[stay]
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), sequence.astype(np.uint32), last


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Number of ids of each nonterminal."""
    lengths = np.zeros(len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[k] = (lengths[a - terminals] if a >= terminals else 1) + (lengths[b - terminals] if b >= terminals else 1)
    return lengths


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids of a sequence of symbols."""
    lengths = expansion_lengths(rules, terminals)
    if 0 < lengths.sum() <= len(symbols):  # every rule is expanded once and its ids copied to each of its places
        table = np.concatenate([np.arange(terminals, dtype=np.uint32), _expand(np.arange(terminals, terminals + len(rules)), rules, terminals)])
        size = np.append(np.ones(terminals, np.int64), lengths)
        first = np.cumsum(size) - size
        return table[ragged(first[symbols], size[symbols])]
    return _expand(symbols, rules, terminals)


def _expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    symbols = symbols.astype(np.uint32)
    while True:
        inner = symbols >= terminals
        if not inner.any():
            return symbols
        width = np.where(inner, 2, 1)
        at = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.uint32)
        out[at[~inner]] = symbols[~inner]
        pair = rules[symbols[inner] - terminals]
        out[at[inner]] = pair[:, 0]
        out[at[inner] + 1] = pair[:, 1]
        symbols = out


def _shard(part: int, number: int, doc_ids: list, ids: np.ndarray, lengths: np.ndarray, terminals: int) -> pa.RecordBatch:
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths) - 1] = True
    rules, sequence, last = compress(ids, last, terminals)
    n_symbols = np.diff(np.append(-1, np.flatnonzero(last)))
    width = 2 if terminals + len(rules) <= 1 << 16 else 4
    row = {
        "part": part,
        "shard": number,
        "doc_id": doc_ids,
        "n_ids": lengths.tolist(),
        "n_symbols": n_symbols.tolist(),
        "terminals": terminals,
        "rules": rules.astype("<u4").tobytes(),
        "expansions": expansion_lengths(rules, terminals).astype("<u4").tobytes(),
        "width": width,
        "symbols": sequence.astype(f"<u{width}").tobytes(),
    }
    kinds = [pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))


def _encode(batches: Iterator[pa.RecordBatch], path: str, shard_ids: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    tool = encoder(path, byte_level=True)
    terminals = tool.library.get_vocab_size()
    number = 0
    docs: list = []
    held: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for rows in slices(batch):
            ids, counts = tool.encode(rows.column("text"))
            # one end id behind every document
            with_end = np.full(len(ids) + len(counts), END_ID, np.int32)
            ends = np.cumsum(counts + 1) - 1
            inside = np.ones(len(with_end), bool)
            inside[ends] = False
            with_end[inside] = ids
            docs += rows.column("doc_id").to_pylist()
            held.append(with_end)
            lengths.append(counts + 1)
            size += len(with_end)
            if size >= shard_ids:
                yield _shard(part, number, docs, np.concatenate(held), np.concatenate(lengths), terminals)
                number, docs, held, lengths, size = number + 1, [], [], [], 0
    if docs:
        yield _shard(part, number, docs, np.concatenate(held), np.concatenate(lengths), terminals)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, shard_ids: int = SHARD_IDS) -> None:
    """Encode all texts and write shards in ascending ``doc_id`` order."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # files that are in order already only shuffle between neighbours; ranges hold whole ids
    ordered = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(partial(_encode, path=tokenizer, shard_ids=shard_ids), SHARD_SCHEMA).write.parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(folder)


def _symbols(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    symbols = np.frombuffer(row["symbols"], f"<u{row['width']}")
    ends = np.cumsum(np.array(row["n_symbols"], np.int64))
    return rules, symbols, ends


def decode_document(row: dict, place: int, first: int = 0, count: int | None = None) -> np.ndarray:
    """Ids ``first`` .. ``first + count - 1`` of the ``place``-th document of a shard row.

    Only the symbols whose expansion lengths cover the range are expanded.
    """
    rules, symbols, ends = _symbols(row)
    own = symbols[ends[place] - row["n_symbols"][place] : ends[place]]
    lengths = np.ones(len(own), np.int64)
    inner = own >= row["terminals"]
    lengths[inner] = np.frombuffer(row["expansions"], "<u4")[own[inner] - row["terminals"]]
    upto = np.cumsum(lengths)
    stop = int(upto[-1]) if count is None else min(first + count, int(upto[-1]))
    a = int(np.searchsorted(upto, first, side="right"))
    b = int(np.searchsorted(upto, stop, side="left")) + 1
    if stop <= first:
        return np.zeros(0, np.uint32)
    skipped = int(upto[a] - lengths[a])
    return expand(own[a:b], rules, row["terminals"])[first - skipped : stop - skipped]


def _decode(batches: Iterator[pa.RecordBatch], keep_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rules, symbols, _ = _symbols(row)
            ids = expand(symbols, rules, row["terminals"]).astype("<u4")
            ends = np.cumsum(np.array(row["n_ids"], np.int64))
            raw = memoryview(ids.tobytes())
            n = len(ends)
            starts = np.append(0, ends[:-1])
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            columns = [
                pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()),
                pa.array(row["doc_id"], pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64()),
            ]
            names = ["part", "shard", "doc_id", "place", "n_tokens", "ids_crc32"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def read_documents(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files."""
    shards = read_shards(spark, folder)
    sizes = shards.select("part", "shard", F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    per_part = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    # one row per range of doc_id, as many as the job has shuffle partitions
    part_start = per_part.select("part", F.expr("sum(n) OVER (ORDER BY part) - n").alias("part_start"))
    shard_start = sizes.select("part", "shard", F.expr("sum(n) OVER (PARTITION BY part ORDER BY shard) - n").alias("shard_start"))
    schema = "part int, shard int, doc_id long, place long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    rows = shards.mapInArrow(partial(_decode, keep_ids=keep_ids), schema)
    rows = rows.join(part_start, "part").join(shard_start, ["part", "shard"])
    start = (F.col("part_start") + F.col("shard_start") + F.col("place")).alias("start")
    return rows.select("doc_id", start, "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))
