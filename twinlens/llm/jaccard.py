"""N-gram Jaccard join by universe-partition pigeonhole, exact.

Two sets link when ``100 * |A n B| >= 80 * |A u B|``, that is when their symmetric
difference is at most ``(|A| + |B|) / 9``. The method:

* Texts with the same set are one *class*; only classes are joined.
* Sizes fall into bands so wide that a linked pair lies in one band or in two
  neighbours. Each band cuts the hash universe into ``m`` *segments*; a set's
  subset inside a segment has one signature.
* If a set has ``H`` possible differing elements with any partner, then among any
  ``H + 1`` of its non-empty segments at least one is the same in the partner.
  With all signature frequencies known, each set chooses its cheapest ``H + 1``:
  signatures that no other class has cost nothing, so a set with enough of those
  has no candidates at all; the rest of the quota goes to the smallest groups.
* A set with fewer than ``H + 1`` non-empty segments spends two units on some
  segments: their *one-deletion neighbourhood* finds partners that differ by one
  element there. Bands that hold such sets are indexed with deletions as well, and
  the cheapest segments get the second unit. If even that is too little, the set's
  single elements serve as segments.
* Candidates are verified exactly. First each class meets the hub it shares most
  signatures with. Groups that still hold several components are then settled: small
  ones pair by pair; large ones, merged where they overlap, block by block against
  all members outside the largest component. Blocks yield a spanning forest of their
  links, never pairs: copies do not expand, and no link between components is lost.

Rows: NULL or wordless texts have an empty set and link with nothing; equal
``doc_id`` rows are one document with its largest set; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.llm.text import mix, ragged, slices, stream, words_of
from twinlens.session import durable

BROADCAST_ROWS = 1_000_000  # of two or three numbers; above it the join shuffles
KEYS_PER_FLUSH = 1 << 19
PAIRS_PER_BATCH = 500
SLICE_BYTES = 1 << 19  # text handled at once: an executor runs several Python workers side by side

_LANE = stream(6, 5) | np.uint64(1)


@dataclass(frozen=True)
class JaccardParams:
    """``words``: shingle length; ``share``, ``spare``: segments per element of the band's largest set."""

    words: int = 5
    share: float = 0.32
    spare: int = 6
    small: int = 64  #: bands up to this size have one segment per element
    hot: int = 48  #: classes of one flush that share a signature: their rows are salted
    chunk: int = 2048  #: members of a group in one row
    pairwise: int = 64  #: groups up to this size are compared pair by pair, larger ones block by block
    block: int = 1 << 21  #: elements of the sets in a block, about; a larger set is a block of its own


def bands(params: JaccardParams, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends of the size bands and their numbers of segments."""
    ends, size = [], 0
    while size < largest:
        size = max(size + 1, (size + 1) * 5 // 4)
        ends.append(size)
    hi = np.array(ends, np.int64)
    many = np.where(hi <= params.small, hi, np.ceil(params.share * hi) + params.spare)
    return hi, np.maximum(many, 1).astype(np.int64)


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and their number per text."""
    w = words_of(column)
    counts = w.counts
    hashes = np.append(w.hash, np.zeros(words, np.uint64))
    total = len(w.hash)
    mixed = np.zeros(total, np.uint64)
    for k in range(words):
        mixed += hashes[k : k + total] * _LANE[k]
    mixed = mix(mixed)
    parts, sizes = [], np.zeros(w.texts, np.int64)
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b - a >= words:
            found = np.unique(mixed[a : b - words + 1])
        elif b > a:
            short = np.add.reduce(hashes[a:b] * _LANE[: b - a], dtype=np.uint64)
            found = mix(np.array([short + np.uint64(counts[i])], np.uint64))
        else:
            continue
        parts.append(found)
        sizes[i] = len(found)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes


@dataclass
class Sets:
    """Distinct non-empty sets of a slice."""

    elements: np.ndarray
    sizes: np.ndarray
    identity: np.ndarray  #: int64 class of each set

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def identities(elements: np.ndarray, sizes: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set (0 for the empty set)."""
    before = np.zeros(len(elements) + 1, np.uint64)
    out = []
    for part in (seed, seed + 7919):
        np.cumsum(mix(elements ^ mix(np.array([part], np.uint64))), out=before[1:])
        ends = np.cumsum(sizes)
        value = mix(before[ends] - before[ends - sizes] + sizes.astype(np.uint64))
        out.append(np.where(sizes > 0, value | np.uint64(1), 0).astype(np.uint64).view(np.int64))
    return out[0], out[1]


@dataclass
class Segments:
    """Non-empty segments of sets under the partition of one band each."""

    owner: np.ndarray  #: set of each segment
    first: np.ndarray  #: its first element
    size: np.ndarray
    key: np.ndarray
    number: np.ndarray


def _keys(sums: np.ndarray, band: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mix(sums + mix((band.astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64) + np.uint64(77)))


def segments(sets: Sets, chosen: np.ndarray, band: np.ndarray, many: np.ndarray) -> Segments:
    """Segments of the sets ``chosen``; ``band`` and ``many`` (segments) are per chosen set."""
    sizes = sets.sizes[chosen]
    at = ragged(sets.first[chosen], sizes)
    elements = sets.elements[at]
    owner = np.repeat(np.arange(len(chosen)), sizes)
    number = ((elements >> np.uint64(32)) * many.astype(np.uint64)[owner]) >> np.uint64(32)
    if len(elements) == 0:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, np.zeros(0, np.uint64), none)
    opens = np.ones(len(elements), bool)
    opens[1:] = (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(opens)
    sums = np.add.reduceat(mix(elements), start)
    number = number[start].astype(np.int64)
    owner = owner[start]
    return Segments(owner, at[start], np.diff(np.append(start, len(elements))), _keys(sums, band[owner], number), number)


def roles(sizes: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set, as a member of its own band and as a larger partner of the band below:
    (set, band, differing elements that are possible)."""
    own = np.searchsorted(hi, sizes)
    with_own = (sizes + sizes * 5 // 4) // 9
    index = np.flatnonzero(sizes > 3)  # smaller sets link with equal ones only
    below = index[(own[index] > 0) & (hi[own[index] - 1] * 5 >= sizes[index] * 4)]
    with_below = (sizes[below] + hi[own[below] - 1]) // 9
    return (
        np.concatenate([index, below]),
        np.concatenate([own[index], own[below] - 1]),
        np.concatenate([with_own[index], with_below]),
    )


# ---- passes over the texts -------------------------------------------------

_CLASS_SCHEMA = "doc_id long, n_shingles long, class long, check long, bands array<int>, stuck boolean"


def _classes(batches: Iterator[pa.RecordBatch], params: JaccardParams, seed: int, bound: int) -> Iterator[pa.RecordBatch]:
    """Class of each document, and the bands in which it has too few segments."""
    hi, many = bands(params, bound)
    for batch in batches:
        for part in slices(batch, most=SLICE_BYTES):
            elements, sizes = shingle_sets(part.column("text"), params.words)
            one, two = identities(elements, sizes, seed)
            sets = Sets(elements, sizes, one)
            index, band, differ = roles(sizes, hi)
            seg = segments(sets, index, band, many[band])
            filled = np.bincount(seg.owner, minlength=len(index))
            double = np.bincount(seg.owner[seg.size > 1], minlength=len(index))
            lists: list[list[int]] = [[] for _ in range(part.num_rows)]
            for j in np.flatnonzero(filled < differ + 1).tolist():
                lists[index[j]].append(int(band[j]))
            stuck = np.zeros(part.num_rows, bool)
            stuck[index[filled + double < differ + 1]] = True
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(one), pa.array(two),
                 pa.array(lists, pa.list_(pa.int32())), pa.array(stuck)],
                names=["doc_id", "n_shingles", "class", "check", "bands", "stuck"],
            )


_ROW_SCHEMA = "bucket int, ids binary, opens binary, bands binary, slack binary, counts binary, keys binary, kind int"
PLAIN, SALTED, MARK, DELETION = 0, 1, 2, 3
_KEY_BYTES = 5  # of a key that travel: equal keys stay equal, and two that become equal in one bucket and band are one more candidate


def _narrow(values: np.ndarray, small: type, large: type) -> np.ndarray:
    """``small`` numbers if all fit; the reader tells the width from the number of bytes."""
    return values.astype(small if values.max(initial=0) <= np.iinfo(small).max and values.min(initial=0) >= np.iinfo(small).min else large)


def _wide(raw: bytes, n: int, small: type, large: type) -> np.ndarray:
    return np.frombuffer(raw, small if len(raw) == n * np.dtype(small).itemsize else large)


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    """(ids, bands, slack, keys, kind) of each signature in a row of :class:`_Flush`; a key holds its band."""
    bands = np.frombuffer(row["bands"], np.uint8)
    n = len(bands)
    length = _wide(row["counts"], n, np.uint8, np.uint32).astype(np.int64)
    opens = np.unpackbits(np.frombuffer(row["opens"], np.uint8), count=n)
    ids = np.frombuffer(row["ids"], np.int64)[np.cumsum(opens) - 1]
    slack = _wide(row["slack"], n, np.int16, np.int32).astype(np.int32)
    ids, bands, slack = (np.repeat(x, length) for x in (ids, bands, slack))
    key = np.zeros((len(ids), 8), np.uint8)
    key[:, :_KEY_BYTES] = np.frombuffer(row["keys"], np.uint8).reshape(-1, _KEY_BYTES)
    key[:, _KEY_BYTES] = bands
    return ids, bands, slack, key.view("<u8").ravel().astype(np.uint64), np.full(len(ids), row["kind"], np.uint8)


class _Flush:
    """Signatures gathered by a task and dealt into buckets as a few binary rows."""

    def __init__(self, buckets: int, most: int):
        self.buckets = buckets
        self.most = most
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        self.held.append(columns)
        self.size += len(columns[0])

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        ids, band, slack, key = (np.concatenate([h[i] for h in self.held]) for i in range(4))
        self.held, self.size = [], 0
        order = np.argsort(key, kind="stable")
        opens = np.append(True, key[order][1:] != key[order][:-1])
        group = np.cumsum(opens) - 1
        count = np.bincount(group)
        hot = np.zeros(len(key), bool)
        hot[order] = count[group] >= self.most
        bucket = ((key >> np.uint64(16)) % np.uint64(self.buckets)).astype(np.int64)
        yield from self._emit(PLAIN, bucket[~hot], ids[~hot], band[~hot], slack[~hot], key[~hot])
        if hot.any():
            salt = bucket[hot] + (mix(ids[hot].view(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)
            yield from self._emit(SALTED, salt % self.buckets, ids[hot], band[hot], slack[hot], key[hot])
            marks = order[np.flatnonzero(opens)[count >= self.most]]
            yield from self._emit(MARK, bucket[marks], ids[marks], band[marks], slack[marks], key[marks])

    def _emit(self, kind: int, bucket, ids, band, slack, key) -> Iterator[pa.RecordBatch]:
        order = np.argsort(bucket.astype(np.uint32), kind="stable")
        bucket, ids, band, slack, key = (x[order] for x in (bucket, ids, band, slack, key))
        if not len(bucket):
            return
        opens = np.append(True, (bucket[1:] != bucket[:-1]) | (ids[1:] != ids[:-1]) | (band[1:] != band[:-1]))
        run = np.flatnonzero(opens)
        length = np.diff(np.append(run, len(bucket)))
        names = np.unique(bucket)
        cut_run = np.append(np.searchsorted(bucket[run], names), len(run))
        cut_key = np.append(np.searchsorted(bucket, names), len(bucket))
        fresh = np.append(True, ids[run][1:] != ids[run][:-1])  # a class has a run per band, one after the other
        fresh[cut_run[:-1]] = True
        sent = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 8 * _KEY_BYTES)
        sent = np.ascontiguousarray(sent.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES])
        ids, band, slack = ids[run], band[run].astype(np.uint8), slack[run]
        columns: list[list[bytes]] = [[] for _ in range(6)]
        for (a, b), (x, y) in zip(zip(cut_run[:-1], cut_run[1:], strict=True), zip(cut_key[:-1], cut_key[1:], strict=True), strict=True):
            parts = (
                ids[a:b][fresh[a:b]], np.packbits(fresh[a:b]), band[a:b], _narrow(slack[a:b], np.int16, np.int32),
                _narrow(length[a:b], np.uint8, np.uint32), sent[x:y],
            )
            for column, part in zip(columns, parts, strict=True):
                column.append(part.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names.astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns), pa.array(np.full(len(names), kind, np.int32))],
            names=["bucket", "ids", "opens", "bands", "slack", "counts", "keys", "kind"],
        )


def _signatures(
    batches: Iterator[pa.RecordBatch], params: JaccardParams, seed: int, bound: int, buckets: int
) -> Iterator[pa.RecordBatch]:
    """Signatures of all classes: (class, band, spare quota, key), packed by bucket."""
    hi, many = bands(params, bound)
    flush = _Flush(buckets, params.hot)
    for batch in batches:
        for part in slices(batch, most=SLICE_BYTES):
            elements, sizes = shingle_sets(part.column("text"), params.words)
            one, _ = identities(elements, sizes, seed)
            sets = Sets(elements, sizes, one)
            index, band, differ = roles(sizes, hi)
            _, keep = np.unique(np.stack([one[index], band]), axis=1, return_index=True)
            index, band, differ = index[keep], band[keep], differ[keep]
            seg = segments(sets, index, band, many[band])
            slack = np.bincount(seg.owner, minlength=len(index)) - (differ + 1)
            flush.add(one[index][seg.owner], band[seg.owner], slack[seg.owner], seg.key)
            if flush.size >= KEYS_PER_FLUSH:
                yield from flush.rows()
    yield from flush.rows()


_GROUP_SCHEMA = "gid long, band int, n long, whole boolean, members array<struct<class:long,slack:int>>"


def _groups(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Signature groups of two classes or more in each bucket; equal member lists are one row with their number."""
    buckets: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            buckets.setdefault(row["bucket"], []).append(_unpacked(row))
    for held in buckets.values():
        ids, band, slack, key, kind = (np.concatenate([h[i] for h in held]) for i in range(5))
        held.clear()
        home = kind != SALTED
        marked = np.unique(key[kind == MARK])
        yield from _grouped(ids[~home], band[~home], slack[~home], key[~home], None, chunk)
        home &= kind != MARK
        hot = np.isin(key, marked) & home
        yield from _grouped(ids[hot], band[hot], slack[hot], key[hot], None, chunk)
        cold = home & ~hot
        yield from _grouped(ids[cold], band[cold], slack[cold], key[cold], 2, chunk)


def _grouped(ids, band, slack, key, least: int | None, chunk: int) -> Iterator[pa.RecordBatch]:
    """``least`` None: parts of hot groups, told apart by the key; else whole groups of ``least`` classes or more."""
    if not len(key):
        return
    order = np.argsort(key)
    if least:
        sorted_key = key[order]
        same = np.zeros(len(key), bool)
        same[1:] = sorted_key[1:] == sorted_key[:-1]
        same[:-1] |= same[1:]
        order = order[same]
        if not len(order):
            return
    ids, band, slack, key = ids[order], band[order], slack[order], key[order]
    order = np.lexsort((ids, key))
    ids, band, slack, key = ids[order], band[order], slack[order], key[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))
    ids, band, slack, key = ids[fresh], band[fresh], slack[fresh], key[fresh]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    number = np.ones(len(start), np.int64)
    gid = key[start].view(np.int64)
    if least:
        # one row per distinct (band, member list)
        digest = mix(np.add.reduceat(mix(ids.view(np.uint64)), start) + size.astype(np.uint64) * np.uint64(257) + band[start])
        keep = size >= least
        start, size, digest = start[keep], size[keep], digest[keep]
        gid, sample, number = np.unique(digest, return_index=True, return_counts=True)
        gid, start, size = gid.view(np.int64), start[sample], size[sample]
    if not len(start):
        return
    # long lists are cut into rows of bounded size
    pieces = -(-size // chunk)
    source = np.repeat(np.arange(len(start)), pieces)
    offset = ragged(np.zeros(len(start), np.int64), pieces) * chunk
    begin = start[source] + offset
    length = np.minimum(size[source] - offset, chunk)
    at = ragged(begin, length)
    members = pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum(length)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(ids[at]), pa.array(slack[at])], names=["class", "slack"]),
    )
    yield pa.RecordBatch.from_arrays(
        [pa.array(gid[source]), pa.array(band[start][source].astype(np.int32)), pa.array(number[source]),
         pa.array(np.full(len(source), bool(least))), members],
        names=["gid", "band", "n", "whole", "members"],
    )


_DELETION_SCHEMA = "key long, band int, seg int, class long, whole boolean, missing int, doubles int"


def _deletions(
    batches: Iterator[pa.RecordBatch], params: JaccardParams, seed: int, bound: int, short: frozenset[int]
) -> Iterator[pa.RecordBatch]:
    """Whole segments and one-deletions of them in the bands ``short`` (a subset of the band numbers)."""
    hi, many = bands(params, bound)
    for batch in batches:
        for part in slices(batch, most=SLICE_BYTES):
            elements, sizes = shingle_sets(part.column("text"), params.words)
            one, _ = identities(elements, sizes, seed)
            sets = Sets(elements, sizes, one)
            index, band, differ = roles(sizes, hi)
            _, keep = np.unique(np.stack([one[index], band]), axis=1, return_index=True)
            keep = keep[np.isin(band[keep], list(short))]
            index, band, differ = index[keep], band[keep], differ[keep]
            seg = segments(sets, index, band, many[band])
            missing = differ + 1 - np.bincount(seg.owner, minlength=len(index))
            doubles = np.bincount(seg.owner[seg.size > 1], minlength=len(index))
            long = np.flatnonzero(seg.size > 1)
            at = ragged(seg.first[long], seg.size[long])
            of = np.repeat(long, seg.size[long])
            whole = np.add.reduceat(mix(elements[at]), np.cumsum(seg.size[long]) - seg.size[long]) if len(long) else at
            rest = np.repeat(whole, seg.size[long]) - mix(elements[at]) if len(long) else np.zeros(0, np.uint64)
            key = np.concatenate([seg.key, _keys(rest, band[seg.owner[of]], seg.number[of])])
            which = np.concatenate([np.arange(len(seg.key)), of])
            owner = seg.owner[which]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(band[owner].astype(np.int32)),
                 pa.array(seg.number[which].astype(np.int32)), pa.array(one[index][owner]),
                 pa.array(np.arange(len(which)) < len(seg.key)), pa.array(missing[owner].astype(np.int32)),
                 pa.array(doubles[owner].astype(np.int32))],
                names=["key", "band", "seg", "class", "whole", "missing", "doubles"],
            )


def _set_rows(batches: Iterator[pa.RecordBatch], params: JaccardParams, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=SLICE_BYTES):
            elements, sizes = shingle_sets(part.column("text"), params.words)
            one, _ = identities(elements, sizes, seed)
            cuts = np.append(0, np.cumsum(sizes))
            blobs = [elements[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            columns, names = [pa.array(one), pa.array(sizes), pa.array(blobs, pa.binary())], ["class", "size", "elements"]
            rows = pa.RecordBatch.from_arrays(columns, names=names)
            if "hub" in part.schema.names:  # only the class that the document was looked up for
                rows = rows.append_column("hub", part.column("hub")).filter(pa.array(part.column("class").to_numpy() == one))
            yield rows


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact test of candidate pairs."""
    for batch in batches:
        left, right = batch.column("left"), batch.column("right")
        keep = []
        for i in range(batch.num_rows):
            a = np.frombuffer(left[i].as_buffer(), np.uint64)
            b = np.frombuffer(right[i].as_buffer(), np.uint64)
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            shared = int((b[at] == a).sum())
            keep.append(9 * shared >= 4 * (len(a) + len(b)))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


# ---- the join --------------------------------------------------------------


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows that carry two sets each go to Python workers a few at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), PAIRS_PER_BATCH) if int(before) > 0 else PAIRS_PER_BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _few(rows: DataFrame) -> DataFrame:
    """Broadcast only below a counted bound; otherwise left to a shuffle join."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _semi(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``."""
    return df.join(_few(keys), key, "left_semi")


def connected(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root): smallest node reachable, for all ends of ``links`` (a, b)."""
    both = durable(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    label = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = (
            both.join(label.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        step = label.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("up"))
        jump = label.select(F.col("node").alias("up"), F.col("root").alias("top"))
        after = durable(step.join(jump, "up", "left").select("node", "old", F.least("up", F.coalesce("top", "up")).alias("root")))
        if after.where("root < old").isEmpty():
            return after.select("node", "root")
        label = after.select("node", "root")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets link."""
    left = sets.select(F.col("class").alias("a"), F.col("elements").alias("left"), F.col("size").alias("m"))
    right = sets.select(F.col("class").alias("b"), F.col("elements").alias("right"), F.col("size").alias("n"))
    near = pairs.join(left.select("a", "m"), "a").join(right.select("b", "n"), "b")
    near = near.where((F.col("m") * 5 >= F.col("n") * 4) & (F.col("n") * 5 >= F.col("m") * 4)).select("a", "b")
    return near.join(left.drop("m"), "a").join(right.drop("n"), "b").mapInArrow(_linked, "a long, b long")


def _chosen(groups: DataFrame, chunk: int) -> DataFrame:
    """Cost-based allocation: (gid, class, chosen) of the groups that can hold linked pairs."""
    listed = groups.where("whole").withColumn("long", F.size("members") >= chunk)
    # a list that fits one row is the same row in every bucket; parts of longer ones are told apart by their classes
    once = listed.groupBy("gid", "band").agg(F.sum("n").alias("n"), F.first("members").alias("members"), F.max("long").alias("long"))
    short = once.where("NOT long").select("gid", "band", "n", F.explode("members").alias("x"))
    parts = groups.where("whole").join(once.where("long").select("gid", "band"), ["gid", "band"], "left_semi")

    def classes(rows: DataFrame, number) -> DataFrame:
        rows = rows.select("gid", "band", "n", F.explode("members").alias("x"))
        return rows.groupBy("gid", "band", F.col("x.class").alias("class"), F.col("x.slack").alias("slack")).agg(number.alias("n"))

    members = short.select("gid", "band", "x.class", "x.slack", "n")
    members = members.unionByName(classes(parts, F.sum("n"))).unionByName(classes(groups.where("NOT whole"), F.max("n")))
    members = durable(members)
    sizes = members.groupBy("gid", "band").agg(F.count("*").alias("size"))
    members = members.join(sizes.where("size > 1"), ["gid", "band"])
    by_class = "PARTITION BY class, band"
    quota = members.withColumns(
        {
            "shared": F.expr(f"sum(n) OVER ({by_class})"),
            "before": F.expr(f"sum(n) OVER ({by_class} ORDER BY size, gid ROWS UNBOUNDED PRECEDING) - n"),
        }
    ).where("shared > slack")
    quota = quota.select("gid", "band", "class", "n", (F.col("before") < F.col("shared") - F.col("slack")).alias("chosen"))
    quota = durable(quota)
    useful = quota.groupBy("gid", "band").agg(F.count("*").alias("size"), F.max("chosen").alias("any"))
    return durable(quota.join(useful.where("size > 1 AND any").drop("any"), ["gid", "band"]))


def _deletion_pairs(rows: DataFrame) -> DataFrame:
    """Partners through one-deletions of the cheapest segments of the sets that lack segments."""
    d, w = rows.where("NOT whole"), rows.where("whole")
    at = ["key", "band", "seg"]
    short = F.col("missing") > 0
    # my deletion is your segment, or my segment is your deletion
    one = d.where(short).join(w.select(*at, F.col("class").alias("other")), at)
    two = w.where(short).join(d.select(*at, F.col("class").alias("other")), at)
    hits = one.unionByName(two).where("class <> other").select("class", "band", "seg", "missing", "doubles", "other").distinct()
    costs = hits.groupBy("class", "band", "seg", "missing", "doubles").agg(F.count("*").alias("cost"))
    by_class = "PARTITION BY class, band"
    paid = costs.withColumns(
        {
            "free": F.expr(f"doubles - count(*) OVER ({by_class})"),
            "rank": F.expr(f"row_number() OVER ({by_class} ORDER BY cost, seg)"),
        }
    ).where("rank <= missing - free")
    pairs = hits.join(paid.select("class", "band", "seg"), ["class", "band", "seg"])
    return pairs.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()


def _elements(
    batches: Iterator[pa.RecordBatch], params: JaccardParams, seed: int, most: int, head: bool
) -> Iterator[pa.RecordBatch]:
    """Elements of the sets of at most ``most`` elements, a row each; with ``head`` only the first H + 1."""
    for batch in batches:
        for part in slices(batch, most=SLICE_BYTES):
            elements, sizes = shingle_sets(part.column("text"), params.words)
            one, _ = identities(elements, sizes, seed)
            first = np.cumsum(sizes) - sizes
            keep = np.flatnonzero((sizes > 0) & (sizes <= most))
            length = (sizes[keep] + sizes[keep] * 5 // 4) // 9 + 1 if head else sizes[keep]
            length = np.minimum(length, sizes[keep])
            at = ragged(first[keep], length)
            columns = [pa.array(np.repeat(x[keep], length)) for x in (one, sizes)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(elements[at].view(np.int64))], names=["class", "size", "element"])


def _element_pairs(docs: DataFrame, classes: DataFrame, params: JaccardParams, seed: int) -> DataFrame:
    """Candidates of sets whose segments are too few even twice: any of their first H + 1 elements is shared."""
    stuck = durable(classes.where("stuck").groupBy("class").agg(F.first("n_shingles").alias("size")))
    largest = int(stuck.agg(F.max("size")).first()[0] or 0)
    schema = "class long, size long, element long"

    def elements(most: int, head: bool) -> DataFrame:
        return docs.select("text").mapInArrow(partial(_elements, params=params, seed=seed, most=most, head=head), schema)

    mine = elements(largest, True).join(_few(stuck.select("class")), "class", "left_semi").distinct()
    other = elements(largest * 5 // 4, False).select("element", F.col("class").alias("other"), F.col("size").alias("n"))
    near = mine.join(other, "element").where("class <> other AND 5 * n >= 4 * size AND 5 * size >= 4 * n")
    return near.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()


_BLOCK_SCHEMA = "pool long, rest boolean, block long, outer long, inner long, n_sets long, n_elements long, sets binary"
_BLOCK_NAMES = ["pool", "rest", "block", "outer", "inner", "n_sets", "n_elements", "sets"]


def _packed(table: pa.Table) -> pa.Table:
    """The sets of a block as one row: its distinct elements, and each set as places among them.

    Near copies share most of their places; sets with one smallest element lie side by side, so that they compress well.
    """
    ids = table.column("class").to_numpy()
    blobs = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("elements")]
    order = sorted(range(len(ids)), key=lambda k: (int(blobs[k][0]), len(blobs[k]), int(ids[k])))
    blobs = [blobs[k] for k in order]
    names, place = np.unique(np.concatenate(blobs), return_inverse=True)
    size = np.array([len(x) for x in blobs], np.int64)
    raw = b"".join([ids[order].tobytes(), size.tobytes(), names.tobytes(), place.astype(np.uint32).tobytes()])
    facts = [table.column(c)[0].as_py() for c in _BLOCK_NAMES[:5]]
    kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.binary()]
    values = [*facts, len(ids), len(names), len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)]
    return pa.table([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=_BLOCK_NAMES)


def _unpacked_sets(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """Classes and elements of the sets in a row of :func:`_packed`."""
    n, m, blob = row["n_sets"], row["n_elements"], row["sets"]
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    names = np.frombuffer(raw, np.uint64, m, 16 * n)
    cuts = np.cumsum(np.frombuffer(raw, np.int64, n, 8 * n))[:-1]
    return np.frombuffer(raw, np.int64, n), np.split(names[np.frombuffer(raw, np.uint32, -1, 16 * n + 8 * m)], cuts)


def _forest(table: pa.Table) -> pa.Table:
    """Spanning forest of the links between the two blocks (or inside the one block) of a group."""
    sides = [(row["side"], *_unpacked_sets(row)) for row in table.select(["side", "n_sets", "n_elements", "sets"]).to_pylist()]
    side = np.repeat([x[0] for x in sides], [len(x[1]) for x in sides])
    ids = np.concatenate([x[1] for x in sides])
    blobs = [b for x in sides for b in x[2]]
    size = np.array([len(x) for x in blobs])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (1 if (side == 1).any() else 0))
    elements = np.concatenate([blobs[k] for k in right])
    owner = np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(elements)
    elements, owner = elements[order], owner[order]
    top = list(range(len(ids)))

    def find(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    found = []
    for k in left.tolist():
        low = np.searchsorted(elements, blobs[k], side="left")
        high = np.searchsorted(elements, blobs[k], side="right")
        shared = np.bincount(owner[ragged(low, high - low)], minlength=len(right))
        for j in right[9 * shared >= 4 * (size[k] + size[right])].tolist():
            x, y = find(k), find(j)
            if x != y:
                top[x] = y
                found.append((min(ids[k], ids[j]), max(ids[k], ids[j])))
    ends = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": ends[:, 0], "b": ends[:, 1]})


def _settle(spark: SparkSession, member: DataFrame, sets: DataFrame, params: JaccardParams) -> DataFrame:
    """Links inside the large groups ``member`` (gid, band, class, root) that join components."""
    hub = member.groupBy("gid", "band").agg(F.min("class").alias("b"))
    near = member.join(hub, ["gid", "band"]).select(F.col("class").alias("a"), "b").where("a <> b").distinct()
    pool = connected(spark, near).select(F.col("node").alias("class"), F.col("root").alias("pool"))
    member = member.select("class", "root").distinct().join(pool, "class")
    member = durable(member.join(sets.select("class", "size"), "class"))
    # a packed block travels once for every block it meets: blocks are as large as a task can hold, in elements
    count = member.groupBy("pool", "root").agg(F.sum("size").alias("n"))
    facts = count.groupBy("pool").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("inner"), F.sum("n").alias("all"))
    member = member.join(facts, "pool").withColumn("rest", F.col("root") != F.col("main"))
    size = F.when(F.col("rest"), F.col("all") - F.col("inner")).otherwise(F.col("inner"))
    member = member.withColumn("block", F.pmod(F.xxhash64("class"), F.ceil(size / params.block))).drop("size")
    outer, inner = (F.ceil(x / params.block).alias(n) for x, n in ((F.col("all") - F.col("inner"), "outer"), (F.col("inner"), "inner")))
    member = member.select("pool", "rest", "block", outer, inner, "class").join(sets.select("class", "elements"), "class")
    blocks = durable(member.groupBy("pool", "rest", "block").applyInArrow(_packed, _BLOCK_SCHEMA))
    # blocks of the rest meet each other once, and every block of the main component
    rest, main = blocks.where("rest"), blocks.where("NOT rest")
    sent = ["n_sets", "n_elements", "sets"]
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("outer") - 1)).alias("other")
    one = rest.select("pool", "block", every, *sent).select(
        "pool", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.lit(False).alias("with_main"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), *sent,
    )
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("inner") - 1)).alias("j")
    two = rest.select("pool", F.col("block").alias("i"), met, F.lit(True).alias("with_main"), F.lit(0).alias("side"), *sent)
    three = main.select("pool", every, "block", *sent)
    three = three.select("pool", F.col("other").alias("i"), F.col("block").alias("j"), F.lit(True).alias("with_main"), F.lit(1).alias("side"), *sent)
    return one.unionByName(two).unionByName(three).groupBy("pool", "i", "j", "with_main").applyInArrow(_forest, "a long, b long")


def _pairs(frame: DataFrame) -> DataFrame:
    return frame.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def class_links(docs: DataFrame, params: JaccardParams | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes of all documents, links that connect exactly the classes that any links connect)."""
    params = params or JaccardParams()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bound = max(16, int(docs.agg(F.max(F.octet_length("text"))).first()[0] or 0) // 2 + 2)  # words of any text
    seed = 1
    while True:
        work = partial(_classes, params=params, seed=seed, bound=bound)
        classes = durable(docs.mapInArrow(work, _CLASS_SCHEMA))
        clash = classes.groupBy("class").agg((F.min("check") < F.max("check")).alias("clash")).where("clash")
        if clash.isEmpty():  # two sets with one 64-bit identity: another seed tells them apart
            break
        seed += 1
    facts = classes.agg(
        F.sum("n_shingles"), F.max("stuck"), F.array_distinct(F.flatten(F.collect_set("bands")))
    ).first()
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffles, -(-int(facts[0] or 0) // 3_000_000))
    work = partial(_signatures, params=params, seed=seed, bound=bound, buckets=buckets)
    packed = docs.select("text").mapInArrow(work, _ROW_SCHEMA)
    groups = durable(packed.repartitionById(buckets, F.col("bucket")).mapInArrow(partial(_groups, chunk=params.chunk), _GROUP_SCHEMA))
    member = _chosen(groups, params.chunk)

    extra = None
    if facts[2]:
        work = partial(_deletions, params=params, seed=seed, bound=bound, short=frozenset(facts[2]))
        extra = _deletion_pairs(docs.select("text").mapInArrow(work, _DELETION_SCHEMA).distinct())
    if facts[1]:
        more = _element_pairs(docs, classes, params, seed)
        extra = more if extra is None else extra.unionByName(more)
    involved = member.select("class")
    if extra is not None:
        extra = durable(extra.distinct())
        involved = involved.union(extra.select("a")).union(extra.select("b"))
    # first each class against the hub it shares most signatures with; the hub travels with the set
    lead = member.groupBy("gid", "band").agg(F.min("class").alias("y"))
    first = member.join(lead, ["gid", "band"]).where("class <> y").groupBy("class", "y").agg(F.sum("n").alias("n"))
    first = durable(first.groupBy("class").agg(F.max_by("y", F.struct("n", "y")).alias("hub")))
    wanted = classes.join(involved.distinct(), "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    wanted = durable(wanted.join(first, "class", "left"))
    found = docs.join(_few(wanted), "doc_id").select("text", "class", "hub")
    sets = found.mapInArrow(partial(_set_rows, params=params, seed=seed), "class long, size long, elements binary, hub long")
    if not classes.groupBy("doc_id").count().where("count > 1").isEmpty():  # rows with one id
        sets = sets.dropDuplicates(["class"])
    sets = durable(sets)

    left = sets.where("hub IS NOT NULL").select(F.col("class").alias("a"), F.col("hub").alias("b"), F.col("elements").alias("left"), F.col("size").alias("m"))
    hubs = _semi(sets, first.select(F.col("hub").alias("class")).distinct(), "class")
    right = hubs.select(F.col("class").alias("b"), F.col("elements").alias("right"), F.col("size").alias("n"))
    met = left.join(right, "b").where("m * 5 >= n * 4 AND n * 5 >= m * 4").select("a", "b", "left", "right")
    links = met.mapInArrow(_linked, "a long, b long")
    tested = _pairs(first.select(F.col("class").alias("x"), F.col("hub").alias("y")))
    if extra is not None:
        links, tested = links.union(_verify(extra, sets)), tested.union(extra)
    with _small_batches(spark):
        tested, links = durable(tested.distinct()), durable(links)
    root = connected(spark, links).withColumnRenamed("node", "class")
    named = member.join(root, "class", "left").withColumn("root", F.coalesce("root", "class"))
    mixed = named.groupBy("gid", "band").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    named = durable(named.join(mixed.where("least < most").select("gid", "band"), ["gid", "band"]))
    few = named.where(F.col("size") <= params.pairwise).select("gid", "band", F.col("class").alias("x"), "root", "chosen")
    other = few.select("gid", "band", F.col("x").alias("y"), F.col("root").alias("apart"), F.col("chosen").alias("also"))
    pairs = few.join(other, ["gid", "band"]).where("x < y AND root <> apart AND (chosen OR also)")
    pairs = durable(_pairs(pairs).distinct().join(tested, ["a", "b"], "left_anti"))
    links = links.union(_verify(pairs, sets)).union(_settle(spark, named.where(F.col("size") > params.pairwise), sets, params))
    with _small_batches(spark):
        return classes, durable(links)


def near_duplicates(docs: DataFrame, params: JaccardParams | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every document."""
    classes, links = class_links(docs, params)
    root = connected(docs.sparkSession, links)
    merged = classes.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "class")).alias("top"))
    merged = merged.select("doc_id", "top.n_shingles", "top.class")
    node = merged.join(root.withColumnRenamed("node", "class"), "class", "left")
    node = node.withColumn("node", F.when(F.col("class") != 0, F.coalesce("root", "class")))
    least = node.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    return node.join(least, "node", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
