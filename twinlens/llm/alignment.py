"""Which tokens of two tokenizers cover the same text: groups, links and their corpus-wide counts.

Token ends are byte offsets. A text is one interval; where both tokenizers end a token near
its middle (looked up by bisection, outwards from the middle in rings of doubling width) it
is cut, and both halves are cut in turn. Intervals without a common end are the groups. All
intervals of a batch of texts are cut at once, level by level.

Inside a group a token of one side is linked with each token of the other side whose bytes
it overlaps. How often a pair of ids is linked in the whole corpus says how well the ids
belong together: the counts are a table, summed before the shuffle. Pairs that hold at
least one in ``HEAVY`` of all links, fewer than ``HEAVY`` by that definition, are sent to
all tasks; the others are joined, and none of those can be a hot key.

Rows: NULL and empty texts, and texts that a tokenizer does not give back byte by byte,
have no tokens: zeros and an empty digest. Rows with one ``doc_id``, or without any, are
answered one by one. Very long texts are cut whole; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.text import bytes_of, ragged, slices, span_hash
from twinlens.llm.tokens import encoder
from twinlens.session import durable

HEAVY = 1 << 19  # pairs above this share of all links are sent to all tasks, 20 bytes each
FLUSH_PAIRS = 1 << 20  # pair counts a task holds before it hands them on
KEPT_PIECES = 150_000  # encoded stretches a Python worker remembers on either side
SLICE_BYTES = 1 << 20  # text handled at once; one longer text is handled alone
BLANK = "▁"
COUNTED_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary"
_encoders: dict[str, SentenceEncoder] = {}


class SentenceEncoder:
    """Sentence-piece ids; each distinct stretch between cuts of the text is encoded once.

    No piece of the vocabulary has a blank behind another sign, or a line break inside;
    so no merge crosses the place before a run of blanks or a line break, and the
    stretches are encoded alone. A vocabulary with such pieces is given whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.cuts = not any(re.search(f"[^{BLANK}]{BLANK}|\n", p) for p in pieces)
        self.blank = np.array([self.library.piece_to_id(BLANK)], np.int32).tobytes()
        self.kept: dict[bytes, bytes] = {}
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(BLANK, " ").encode()
            for i, p in enumerate(pieces)
        ]

    def _pieces(self, raws: list[bytes]) -> list[bytes]:
        """int32 ids of each stretch, as bytes; the first blank is the one that the library adds."""
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        kept = self.kept
        later = [r for r in raws if r not in kept]
        texts = [(r[1:] if r[0] == 0x20 else r).decode() for r in later]
        found = self.library.encode(texts, num_threads=1) if later else []
        for raw, text, ids in zip(later, texts, found, strict=True):
            if not text:
                kept[raw] = self.blank
            else:
                kept[raw] = np.array(ids if raw[0] == 0x20 else ids[1:], np.int32).tobytes()
        return [kept[r] for r in raws]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (each opens with the blank to be added) and the number of each text."""
        opens = np.zeros(len(data), bool)
        if self.cuts:
            blank = data == 0x20
            opens[1:] = blank[1:] & ~blank[:-1] | (data[1:] == 0x0A)
        opens[offsets[:-1]] = True
        start = np.flatnonzero(opens)
        end = np.append(start[1:], len(data))
        _, sample, which = np.unique(span_hash(data, start, end, False), return_index=True, return_inverse=True)
        blob = data.tobytes()
        found = self._pieces([blob[a:b] for a, b in zip(start[sample].tolist(), end[sample].tolist(), strict=True)])
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), np.int32)
        per_piece = lengths[which]
        before = np.append(0, np.cumsum(per_piece))
        return ids[ragged((np.cumsum(lengths) - lengths)[which], per_piece)], np.diff(before[np.searchsorted(start, offsets)])


def sentence_encoder(path: str) -> SentenceEncoder:
    """One per Python worker."""
    if path not in _encoders:
        _encoders[path] = SentenceEncoder(path)
    return _encoders[path]


class Spelling:
    """Bytes of every token id, in one array."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.start[ids], self.length[ids])]


def byte_level_spelling(path: str) -> Spelling:
    tool = encoder(path, True)
    letters = {v: k for k, v in tool.letters.items()}
    tokens = [b""] * tool.library.get_vocab_size()
    for token, i in tool.library.get_vocab().items():
        tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return Spelling(tokens)


def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> np.ndarray:
    """For each A token: the index of the B token that ends with it, or -1.

    ``first_*`` are the first tokens of each text, and one more; both sides of a text end
    together. Ends rise over all texts.
    """
    shared = np.full(len(ends_a), -1, np.int64)
    shared[first_a[1:] - 1] = first_b[1:] - 1
    # inner ends that are still open, as ranges of A and of B tokens
    lo, hi, blo, bhi = first_a[:-1], first_a[1:] - 1, first_b[:-1], first_b[1:] - 1
    while len(lo):
        middle = (lo + hi) // 2
        at = np.full(len(lo), -1, np.int64)
        open_, near, far = np.flatnonzero((hi > lo) & (bhi > blo)), 0, 1
        while len(open_):
            low, high, m = lo[open_], hi[open_], middle[open_]
            left = np.maximum(low, m - far)
            right = np.minimum(high, m + near)
            widths = [np.maximum(low, m - near) - left, np.minimum(high, m + far) - right]
            probe = np.concatenate([ragged(left, widths[0]), ragged(right, widths[1])])
            owner = np.concatenate([np.repeat(open_, widths[0]), np.repeat(open_, widths[1])])
            place = np.searchsorted(ends_b, ends_a[probe])
            hit = np.flatnonzero(ends_b[place] == ends_a[probe])
            hit = hit[np.argsort(-np.abs(probe[hit] - middle[owner[hit]]), kind="stable")]
            at[owner[hit]] = probe[hit]  # the nearest to the middle is written last
            shared[probe[hit]] = place[hit]  # the others are found in good time as well
            open_ = open_[(at[open_] < 0) & ((left > low) | (m + far < high))]
            near, far = far, 2 * far
        cut = np.flatnonzero(at >= 0)
        a, b = at[cut], shared[at[cut]]
        lo, hi = np.concatenate([lo[cut], a + 1]), np.concatenate([a, hi[cut]])
        blo, bhi = np.concatenate([blo[cut], b + 1]), np.concatenate([b, bhi[cut]])
        live = (hi > lo) & (bhi > blo)
        lo, hi, blo, bhi = lo[live], hi[live], blo[live], bhi[live]
    return shared


class Aligned:
    """Tokens of one slice of texts on both sides, their groups and links."""

    def __init__(self, texts: pa.Array, path_a: str, path_b: str, spell_a: Spelling, spell_b: Spelling):
        self.n_texts = len(texts)
        self.n_a = np.zeros(self.n_texts, np.int64)
        self.n_b, self.n_groups, self.n_links = self.n_a.copy(), self.n_a.copy(), self.n_a.copy()
        texts = texts.cast(pa.large_string())
        keep = np.flatnonzero(np.asarray(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)))
        keep = keep[~np.asarray(pc.match_substring(texts.take(keep), BLANK))]  # it would come back as a blank
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts.take(keep), pa.scalar(" ", pa.large_string()))
        (self.ids_a, counts_a), (self.ids_b, counts_b), kept = self._tokens(spaced, path_a, path_b, spell_a, spell_b)
        self.texts = keep[kept]
        self.n_a[self.texts], self.n_b[self.texts] = counts_a, counts_b
        self.first_a = np.append(0, np.cumsum(self.n_a[self.texts]))
        self.first_b = np.append(0, np.cumsum(self.n_b[self.texts]))
        self.ends_a, self.ends_b = np.cumsum(spell_a.length[self.ids_a]), np.cumsum(spell_b.length[self.ids_b])
        none = np.zeros(0, np.int64)
        self.shared = shared_ends(self.ends_a, self.ends_b, self.first_a, self.first_b) if len(self.texts) else none
        self.cut_a = np.flatnonzero(self.shared >= 0)  # last A and last B token of each group
        self.cut_b = self.shared[self.cut_a]
        self.n_groups[self.texts] = np.diff(np.searchsorted(self.cut_a, self.first_a))
        # each stretch between neighbouring ends of either side is one link
        alone = np.ones(len(self.ids_b), bool)
        alone[self.cut_b] = False
        order = np.argsort(np.concatenate([self.ends_a, self.ends_b[alone]]), kind="stable")
        side_a = order < len(self.ids_a)
        side_b = ~side_a
        side_b[side_a] = self.shared >= 0
        self.link_a, self.link_b = np.cumsum(side_a) - side_a, np.cumsum(side_b) - side_b
        self.n_links[self.texts] = np.diff(np.searchsorted(self.link_a, self.first_a))

    def _tokens(self, spaced: pa.Array, path_a: str, path_b: str, spell_a: Spelling, spell_b: Spelling):
        """(ids, numbers by text) on both sides of the texts that both give back, and which these are."""
        data, offsets = bytes_of(spaced)
        none = np.zeros(0, np.int64)
        if len(data) == 0:
            return (none, none), (none, none), none
        sides, right = [], np.ones(len(spaced), bool)
        for ids, counts, spell in (
            (*encoder(path_a, True).encode(spaced), spell_a),
            (*sentence_encoder(path_b).encode(data, offsets), spell_b),
        ):
            text = np.repeat(np.arange(len(spaced)), counts)
            long_enough = np.bincount(text, spell.length[ids], len(spaced)).astype(np.int64) == np.diff(offsets)
            some = long_enough[text]
            wanted = data[np.repeat(long_enough, np.diff(offsets))]
            differs = np.flatnonzero(spell.joined(ids[some]) != wanted)
            where = np.append(0, np.cumsum(np.where(long_enough, np.diff(offsets), 0)))
            long_enough[np.searchsorted(where, differs, side="right") - 1] = False
            right &= long_enough
            sides.append((ids, counts, text))
        kept = np.flatnonzero(right)
        return *[(ids[right[text]], counts[kept]) for ids, counts, text in sides], kept

    def digests(self, words_a: Spelling, words_b: Spelling) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of every text; '' without tokens."""
        out = [""] * self.n_texts
        n_a, n_b = len(self.ids_a), len(self.ids_b)
        if not n_a:
            return out
        last_a, last_b = self.shared >= 0, np.zeros(n_b, bool)
        last_b[self.cut_b] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # A tokens of a group come behind the B tokens of all groups before, B tokens behind the A tokens of their own
        place_a = np.arange(n_a) + np.append(0, self.cut_b + 1)[group_a]
        place_b = np.arange(n_b) + (self.cut_a + 1)[group_b]
        length = np.empty(n_a + n_b, np.int64)
        start = np.empty(n_a + n_b, np.int64)
        length[place_a], length[place_b] = words_a.length[self.ids_a], words_b.length[self.ids_b]
        start[place_a], start[place_b] = words_a.start[self.ids_a], words_b.start[self.ids_b] + len(words_a.data)
        text = np.concatenate([words_a.data, words_b.data])[ragged(start, length)]
        ends = np.cumsum(length)
        text[ends[place_a[self.cut_a]] - 1] = ord("|")
        text[ends[place_b[self.cut_b]] - 1] = ord(";")
        bounds = np.append(0, ends[self.first_a[1:] + self.first_b[1:] - 1])
        blob = text.tobytes()
        for row, a, b in zip(self.texts.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[row] = hashlib.sha256(blob[a : b - 1]).hexdigest()
        return out


def _decimal(n: int) -> Spelling:
    """Ids as decimal digits with a comma."""
    return Spelling([b"%d," % i for i in range(n)])


def _pair_type(n_pairs: int) -> type:
    return np.uint32 if n_pairs <= 1 << 32 else np.uint64


class Worker:
    """What a Python worker needs of both tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        self.path_a, self.path_b, self.encode_a = path_a, path_b, encoder(path_a, True)
        self.spell_a, self.spell_b = byte_level_spelling(path_a), Spelling(sentence_encoder(path_b).bytes)
        self.words_a, self.words_b = _decimal(len(self.spell_a.length)), _decimal(len(self.spell_b.length))
        self.side = len(self.spell_b.length)
        self.pair_type = _pair_type(len(self.spell_a.length) * self.side)

    def align(self, texts: pa.Array) -> Aligned:
        return Aligned(texts, self.path_a, self.path_b, self.spell_a, self.spell_b)


_workers: dict[tuple[str, str], Worker] = {}


def worker(path_a: str, path_b: str) -> Worker:
    if (path_a, path_b) not in _workers:
        _workers[path_a, path_b] = Worker(path_a, path_b)
    return _workers[path_a, path_b]


def _count_links(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    """Counts of each text, and its distinct pairs of linked ids with their numbers."""
    tools = worker(path_a, path_b)
    for batch in batches:
        for part in slices(batch, most=SLICE_BYTES):
            if len(tools.encode_a.names) > KEPT_PIECES:
                tools.encode_a.forget()
            found = tools.align(part.column("text"))
            n = found.n_texts
            pair = found.ids_a[found.link_a].astype(np.int64) * tools.side + found.ids_b[found.link_b]
            text = np.repeat(found.texts, found.n_links[found.texts])
            size = len(tools.spell_a.length) * tools.side
            keys, counts = np.unique(text * size + pair, return_counts=True)
            bounds = np.searchsorted(keys, np.arange(n + 1) * size)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    *[pa.array(x) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)],
                    pa.array(found.digests(tools.words_a, tools.words_b)),
                    _blobs((keys % size).astype(tools.pair_type), bounds),
                    _blobs(counts.astype(np.uint32), bounds),
                ],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"],
            )


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value for each range of values."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of binary cells in a row, and how many each cell has."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize


def _sum_pairs(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[pa.RecordBatch]:
    """Counts by pair, combined over the task; handed on when ``FLUSH_PAIRS`` are held."""
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        pairs, counts = _values(batch.column("pairs"), kind)[0], _values(batch.column("counts"), np.uint32)[0]
        keys, which = np.unique(np.concatenate([keys, pairs.astype(np.int64)]), return_inverse=True)
        sums = np.bincount(which, np.concatenate([sums, counts.astype(np.int64)]), len(keys)).astype(np.int64)
        if len(keys) >= FLUSH_PAIRS:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["pair", "n"])
            keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["pair", "n"])


def _look_up(batches: Iterator[pa.RecordBatch], kind: type, heavy) -> Iterator[pa.RecordBatch]:
    """A row for each text with the sums over heavy pairs, and a row for each other pair.

    Rows of texts carry a key of their own below zero, so that they meet no pair in the join.
    """
    keys, totals, best = heavy.value
    for whole in batches:
        for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            (pairs, sizes), counts = _values(batch.column("pairs"), kind), _values(batch.column("counts"), np.uint32)[0]
            pairs, counts = pairs.astype(np.int64), counts.astype(np.int64)
            n = batch.num_rows
            text = np.repeat(np.arange(n), sizes)
            place = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[place] == pairs if len(keys) else np.zeros(len(pairs), bool)
            count_sum, n_best = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(count_sum, text[known], counts[known] * totals[place[known]])
            np.add.at(n_best, text[known], counts[known] * best[place[known]])
            uid = batch.column("uid").to_numpy()
            rest = int((~known).sum())
            nothing = np.zeros(rest, np.int64)
            about = [
                pa.concat_arrays([batch.column(c), pa.nulls(rest, batch.column(c).type)])
                for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([uid, uid[text[~known]]])),
                    pa.array(np.concatenate([-1 - uid, pairs[~known]])),
                    pa.array(np.concatenate([np.zeros(n, np.int64), counts[~known]])),
                    pa.array(np.concatenate([n_best, nothing])),
                    pa.array(np.concatenate([count_sum, nothing])),
                    *about,
                ],
                ["uid", "pair", "times", "n_best", "count_sum", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"],
            )


def linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A written table of each text's counts, its digest and its distinct pairs of linked ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(partial(_count_links, path_a=path_a, path_b=path_b), COUNTED_SCHEMA)
    return durable(found.withColumn("uid", F.monotonically_increasing_id()))  # fixed by writing it


def pair_counts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``(pair, n, best)``: links of each pair of ids (``a * vocabulary of B + b``) in the whole
    corpus, and whether no other pair of that B id has more."""
    tools = worker(path_a, path_b)
    parts = texts.select("pairs", "counts").mapInArrow(partial(_sum_pairs, kind=tools.pair_type), "pair long, n long")
    pairs = durable(parts.groupBy("pair").agg(F.sum("n").alias("n")))
    side = F.lit(tools.side).cast("long")
    top = pairs.groupBy(F.pmod("pair", side).alias("b")).agg(F.max("n").alias("top"))
    # one row for each B id at most: bounded by the vocabulary
    joined = pairs.join(F.broadcast(top), F.pmod("pair", side) == F.col("b"))
    return joined.select("pair", "n", (F.col("n") == F.col("top")).cast("int").alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, heavy: int = HEAVY) -> DataFrame:
    """One row per document: numbers of tokens, groups and links, how many links are the
    best of their B id, the sum of the links' corpus-wide counts, and the groups' digest.

    ``path_a`` is a byte-level tokenizer file, ``path_b`` a sentence-piece model that adds a
    blank; both read the text behind one blank.
    """
    spark = docs.sparkSession
    texts = linked(docs, path_a, path_b)
    pairs = durable(pair_counts(texts, path_a, path_b))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    often = pairs.where(F.col("n") * heavy > total).orderBy("pair").toArrow()  # fewer than ``heavy`` rows
    values = tuple(often.column(c).to_numpy().astype(np.int64) for c in ("pair", "n", "best"))
    kind = worker(path_a, path_b).pair_type
    schema = "uid long, pair long, times long, n_best long, count_sum long, " + COUNTED_SCHEMA.split(", pairs")[0]
    rows = texts.mapInArrow(partial(_look_up, kind=kind, heavy=spark.sparkContext.broadcast(values)), schema)
    rare = pairs.where(F.col("n") * heavy <= total)
    met = rows.join(rare, "pair", "left")
    about = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    gathered = met.groupBy("uid").agg(
        F.max(F.when(F.col("groups_sha256").isNotNull(), F.struct(*about))).alias("about"),
        F.sum(F.col("n_best") + F.coalesce(F.col("times") * F.col("best"), F.lit(0))).alias("n_best"),
        F.sum(F.col("count_sum") + F.coalesce(F.col("times") * F.col("n"), F.lit(0))).alias("count_sum"),
    )
    return gathered.select(*[F.col(f"about.{c}") for c in about[:-1]], "n_best", "count_sum", "about.groups_sha256")
