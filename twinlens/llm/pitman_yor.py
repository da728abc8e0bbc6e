"""Language-model scores by a hierarchical Pitman-Yor model.

Restaurants: one per pair of words before (u, v), its parent one per word before (v),
their shared root over all words, whose base is uniform over the training words and one
unknown word. Contexts are the words themselves (64-bit hashes), the text start counts
as a word before, and their number grows with the corpus.

Seating is sampled by blocked Gibbs: in each sweep every dish reseats its customers given
its parent's current predictive probability, and every new table sends a customer to the
parent. The first ``SEATED`` customers of a dish are seated one by one, later ones in
blocks of doubling size with a Poisson number of new tables. Predictive probabilities of
the sweeps after ``BURN`` are averaged. As in approximate distributed Gibbs sampling, a
bucket's sweeps see its own copy of the root, and the root is then seated once over the
tables of all buckets. Random numbers depend on (bucket, sweep) alone, so sweeps are
replayed instead of stored, and a lost executor changes nothing. Discounts come from the
counts of counts.

Data flow: tokens go to the bucket of the word before them, so both restaurants of a token
are there; words before that hold over 1/4 of a bucket (at most four a bucket) are spread
by u, and their dishes (v, w) are seated next to the root, where all their tables meet.
Buckets ask the root for their distinct words once; token references are shuffled twice
(to seat, to score) instead of stored, and come back as sums per document. There is a
bucket for ``BUCKET_TOKENS`` tokens, or one per shuffle partition if that is more.

Rows: NULL text is the empty text (one end token); repeated rows are scored alike;
without training tokens every probability is that of the one unknown word; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.features import remainder
from twinlens.llm.text import mix, slices, words_of
from twinlens.session import durable

SEATED = 32
SWEEPS, BURN = 4, 1
KEPT = SWEEPS - BURN
CONCENTRATION = 5.0  #: of the root
CONCENTRATION_V, CONCENTRATION_UV = 0.3, 0.1  #: of the words before
BUCKET_TOKENS = 4_000_000
FLUSH_TOKENS = 3_000_000
LISTED = 1 << 16  # frequent words that every task knows, so that messages name them by rank
END = np.uint64(0x2545F4914F6CDD1D)  # the end token
START = np.uint64(0x9FB21C651E98DF25)  # the word before a text


@dataclass
class Totals:
    """What the root and the spread words before hold; bounded, so it lives on the driver."""

    tokens: int
    words: int
    customers: np.ndarray  #: of the root, per sweep kept
    mass: np.ndarray  #: of its tables, each times its discount, per sweep kept
    spread: np.ndarray  #: hashes of the spread words before, ascending
    spread_customers: np.ndarray  #: (word before, sweep kept)
    spread_mass: np.ndarray  #: likewise


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes as the largest needs, byte by byte, compressed."""
    size = len(values)
    top = int(values.max()) if size else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    raw = values.astype(f"<u{width}").view(np.uint8).reshape(size, width).T.tobytes()
    packed = pa.compress(raw, codec="zstd", asbytes=True)
    return np.array([size, width], "<u4").tobytes() + packed


def _unpack(blob: bytes) -> np.ndarray:
    size, width = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    if not size:
        return np.zeros(0, np.int64)
    raw = pa.decompress(blob[8:], size * width, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word, the two words before it (nearest first) and text of every token; each text ends with ``END``."""
    w = words_of(column)
    n = w.texts
    ends = w.first[1:] + np.arange(n)  # place of each end token
    total = len(w.hash) + n
    word = np.full(total, END, np.uint64)
    inside = np.ones(total, bool)
    inside[ends] = False
    word[inside] = w.hash
    first = np.append(0, ends[:-1] + 1)
    near, far = np.full(total, START), np.full(total, START)
    near[1:] = word[:-1]
    near[first] = START
    far[1:] = near[:-1]
    far[first] = START
    return word, near, far, np.repeat(np.arange(n), w.counts + 1)


_COMMON_SCHEMA = "word long, n long"


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words before that occur often enough to be listed or spread, and under 0 the number of all tokens."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        names, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        often = n > 3
        return pa.RecordBatch.from_arrays(
            [pa.array(np.append(names[often].view(np.int64), 0)), pa.array(np.append(n[often], size))], names=["word", "n"]
        )

    for batch in batches:
        for part in slices(batch):
            near = _tokens(part.column("text"))[1]
            held.append(near)
            size += len(near)
            if size >= FLUSH_TOKENS:
                yield flush()
                size = 0
    if size:
        yield flush()


def _places(names: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Place of each hash among some in order, -1 for others."""
    if not len(ascending):
        return np.full(len(names), -1)
    at = np.minimum(np.searchsorted(ascending, names), len(ascending) - 1)
    return np.where(ascending[at] == names, at, -1)


def _bucket(near: np.ndarray, far: np.ndarray, spread: np.ndarray, buckets: int) -> np.ndarray:
    value = near >> np.uint64(20)
    here = np.isin(near, spread)
    value[here] = mix(near[here] ^ mix(far[here])) >> np.uint64(20)
    return (value % np.uint64(buckets)).astype(np.int64)


_ROW_SCHEMA = "bucket int, kind int, flush string, root int, n long, blobs array<binary>, scale array<double>"
_ROW_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.float64())]
_ROW_NAMES = ["bucket", "kind", "flush", "root", "n", "blobs", "scale"]
ROOTS, ASK, OWN, TOTAL = 0, 1, 2, 3  # kinds of row


def _row(bucket: int, kind: int, flush: str, root: int, n: int, blobs: list[bytes], scale: list[float]) -> pa.RecordBatch:
    values = (bucket, kind, flush, root, n, blobs, scale)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _ROW_TYPES, strict=True)], names=_ROW_NAMES)


def _ask(batches: Iterator[pa.RecordBatch], buckets: int, spread: np.ndarray, listed) -> Iterator[pa.RecordBatch]:
    """Tokens of whole texts by bucket, as places in a dictionary of the words of this message, frequent ones first."""
    from pyspark import TaskContext

    by_hash = np.argsort(listed.value)
    ascending = listed.value[by_hash]
    task = TaskContext.get().partitionId()
    number = 0
    held: list = []
    size = docs = 0

    def flush() -> Iterator[pa.RecordBatch]:
        word, near, far, doc, ids, learn = (np.concatenate([h[i] for h in held]) for i in range(6))
        held.clear()
        n, name = len(ids), f"{task}-{number}"
        bucket = _bucket(near, far, spread, buckets)
        names, place, often = np.unique(np.append(word, START), return_inverse=True, return_counts=True)
        at = _places(names, ascending)
        key = np.where(at >= 0, by_hash[at] if len(by_hash) else 0, LISTED + often.max() - often)
        order = np.argsort(key, kind="stable")
        ranks = key[order]
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        names, place = names[order], rank[place].astype(np.int32)
        start = place[-1]
        w = place[:-1]
        # the words before are those of the tokens before, but for the first two of a text
        v, u = np.append(start, w[:-1]), np.append([start, start], w[:-2])
        v[near == START] = start
        u[far == START] = start
        by = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.uint32), kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        flags = np.packbits(learn).tobytes()
        used, local = np.zeros(len(names), bool), np.zeros(len(names), np.int32)
        yield _row(-1, OWN, name, -1, n, [ids.tobytes(), np.bincount(doc, minlength=n).astype(np.int64).tobytes()], [])
        for b in range(buckets):
            own = by[cuts[b] : cuts[b + 1]]
            if not len(own):
                continue
            parts = [w[own], v[own], u[own]]
            used[:] = False
            for p in parts:
                used[p] = True
            have = np.flatnonzero(used)
            local[have] = np.arange(len(have))
            per = np.bincount(doc[own], minlength=n)
            rank = ranks[have]
            short = int((rank < LISTED).sum())
            named = [_pack(np.diff(rank[:short], prepend=0)), names[have[short:]].tobytes()]
            yield _row(b, ASK, name, -1, n, [*named, *(_pack(local[p]) for p in parts), _pack(per), flags], [])

    for batch in batches:
        for part in slices(batch):
            word, near, far, doc = _tokens(part.column("text"))
            learn = part.column("learn").to_numpy(zero_copy_only=False)
            held.append((word, near, far, doc + docs, part.column("row").to_numpy(), learn))
            size += len(word)
            docs += part.num_rows
            if size >= FLUSH_TOKENS:
                yield from flush()
                number, size, docs = number + 1, 0, 0
    if docs:
        yield from flush()


def _group(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples of small non-negative integers in order, and the place of each given one."""
    size = [int(k.max()) + 1 if len(k) else 1 for k in keys]
    if len(keys) > 2 and np.prod([float(s) for s in size]) >= 2.0**63:  # too wide for one number: the first two get their own
        (a, b), left = _group(*keys[:2])
        (first, *others), which = _group(left, *keys[2:])
        return [a[first], b[first], *others], which
    joined = keys[0].astype(np.int64)
    for k, s in zip(keys[1:], size[1:], strict=True):
        joined = joined * s + k
    names, which = np.unique(joined, return_inverse=True)
    out = []
    for s in reversed(size[1:]):
        names, rest = np.divmod(names, s)
        out.append(rest)
    return [names, *reversed(out)], which


def _discount(customers: np.ndarray) -> float:
    ones, twos = int((customers == 1).sum()), int((customers == 2).sum())
    return float(np.clip(ones / (ones + 2 * twos) if ones else 0.5, 0.05, 0.95))


class Bucket:
    """The restaurants of a bucket: types (u, v, w), their rooms (u, v), pairs (v, w) and words w."""

    def __init__(self, names: np.ndarray, v: np.ndarray, u: np.ndarray, w: np.ndarray, count: np.ndarray):
        """Types are in order of (v, u, w), places in the ascending hashes ``names``."""
        self.names, self.v, self.u, self.w, self.count = names, v, u, w, count
        opens = np.append(True, (v[1:] != v[:-1]) | (u[1:] != u[:-1]))[: len(v)]
        self.room = (np.cumsum(opens) - 1).astype(np.int32)
        self.room_v = v[opens]
        (pair_v, pair_w), pair = _group(v, w)
        self.pair_v, self.pair = pair_v.astype(np.int32), pair.astype(np.int32)
        here = np.zeros(len(names), bool)
        here[pair_w] = True
        self.pair_word = (np.cumsum(here) - 1).astype(np.int32)[pair_w]
        self.words = names[here]  # ascending
        self.total = np.bincount(self.pair_word[self.pair], weights=count, minlength=len(self.words)).astype(np.int64)  # within the bucket
        self.many = np.flatnonzero(count > 1)  #: types whose tables are open
        self.roots: tuple | None = None  #: what the root knows of ``words`` and of spread pairs

    def asked(self, roots: int, spread: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(root bucket, its words, its pairs whose word before is spread), for root buckets with words here."""
        root = (mix(self.words) % np.uint64(roots)).astype(np.int64)
        often = np.flatnonzero(_places(self.names[self.pair_v], spread) >= 0)
        of_pair = root[self.pair_word[often]]
        by, by_pair = np.argsort(root, kind="stable"), np.argsort(of_pair, kind="stable")
        out = []
        for r in np.unique(root).tolist():
            a, b = np.searchsorted(root[by], [r, r + 1])
            c, d = np.searchsorted(of_pair[by_pair], [r, r + 1])
            out.append((r, by[a:b], often[by_pair[c:d]]))
        return out

    def sweeps(self, bucket: int):
        """Tables of the types ``many``, customers and tables per pair after each sweep kept, given the bucket's own root.

        A dish with one customer has one table.
        """
        pairs, words, rooms = len(self.pair_v), len(self.words), len(self.room_v)
        count, many = self.count, self.many
        known = self.total > 0
        base = 1.0 / (known.sum() + 1)
        seen = count > 0
        per_pair = np.bincount(self.pair[seen], minlength=pairs)
        self.d_uv, self.d_v = _discount(count), _discount(per_pair)
        per_word = np.bincount(self.pair_word[per_pair > 0], minlength=words)
        d_root = _discount(per_word)
        chance_w = np.where(known, per_word / max(1, per_word.sum()), base)
        of_room, of_pair = self.room[many], self.pair[many]
        chance = chance_w[self.pair_word[of_pair]]
        single_room = np.bincount(self.room[count == 1], minlength=rooms)
        single_pair = np.bincount(self.pair[count == 1], minlength=pairs)
        room_tables = single_room + np.bincount(of_room, minlength=rooms)
        v_tables = np.bincount(self.pair_v[per_pair > 0], minlength=len(self.names))
        root_tables = float(known.sum())

        def seated(customers, discount, concentration, tables, of, parent, parent_of, rng):
            made = (customers > 0).astype(np.float64)
            more = np.flatnonzero(customers > 1)
            at, above = (x if x is None else x[more] for x in (of, parent_of))
            tables = np.full(len(more), tables) if at is None else tables[at]
            parent = np.full(len(more), parent) if above is None else parent[above]
            made[more] = seat(customers[more], np.full(len(more), discount), concentration, tables, parent, rng)
            return made

        for sweep in range(SWEEPS):
            rng = np.random.default_rng([bucket, sweep])
            made = seat(count[many], np.full(len(many), self.d_uv), CONCENTRATION_UV, room_tables[of_room], chance, rng)
            room_tables = single_room + np.bincount(of_room, weights=made, minlength=rooms)
            customers = single_pair + np.bincount(of_pair, weights=made, minlength=pairs)
            tables = seated(customers, self.d_v, CONCENTRATION_V, v_tables, self.pair_v, chance_w, self.pair_word, rng)
            v_tables = np.bincount(self.pair_v, weights=tables, minlength=len(self.names))
            v_customers = np.bincount(self.pair_v, weights=customers, minlength=len(self.names))
            own = np.bincount(self.pair_word, weights=tables, minlength=words)
            root = seated(own, d_root, CONCENTRATION, root_tables, None, base, None, rng)
            root_tables = root.sum()
            chance_w = (own - d_root * root + (CONCENTRATION + d_root * root_tables) * base) / (own.sum() + CONCENTRATION)
            v = self.pair_v[of_pair]
            back = (CONCENTRATION_V + self.d_v * v_tables[v]) * chance_w[self.pair_word[of_pair]]
            chance = (customers[of_pair] - self.d_v * tables[of_pair] + back) / (v_customers[v] + CONCENTRATION_V)
            if sweep >= BURN:
                yield made, customers, tables


def _bucket_of(rows: list[dict], listed: np.ndarray) -> tuple[Bucket, list]:
    """The restaurants of a bucket's messages, and per message the place of each token among the types."""
    parts = []
    for row in rows:
        ranks, rest, w, v, u, per, flags = row["blobs"]
        row["blobs"] = None
        names = np.append(listed[np.cumsum(_unpack(ranks))], np.frombuffer(rest, np.uint64))
        learn = np.unpackbits(np.frombuffer(flags, np.uint8), count=row["n"])
        per = _unpack(per).astype(np.int32)
        (v, u, w), which = _group(_unpack(v), _unpack(u), _unpack(w))
        count = np.bincount(which, weights=np.repeat(learn, per), minlength=len(v)).astype(np.int32)
        kind = np.uint16 if len(v) <= 1 << 16 else np.int32
        parts.append((names, *(x.astype(np.int32) for x in (v, u, w)), count, which.astype(kind), per))
    names = np.unique(np.concatenate([p[0] for p in parts]))
    at = [np.searchsorted(names, p[0]).astype(np.int32) for p in parts]
    v, u, w = (np.concatenate([a[p[i]] for a, p in zip(at, parts, strict=True)]) for i in (1, 2, 3))
    count = np.concatenate([p[4] for p in parts])
    messages = [(row["flush"], row["n"], p[6], p[5]) for row, p in zip(rows, parts, strict=True)]
    cuts = np.cumsum([len(p[1]) for p in parts])[:-1]
    parts.clear()
    types, which = _group(v, u, w)
    v, u, w = (x.astype(np.int32) for x in types)
    count = np.bincount(which, weights=count, minlength=len(v)).astype(np.int64)
    owns = np.split(which.astype(np.int32), cuts)
    return Bucket(names, v, u, w, count), [(*m, own) for m, own in zip(messages, owns, strict=True)]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one bucket after the other; they come in that order."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != current and rows:
                yield current, rows
                rows = []
            current = row["bucket"]
            rows.append(row)
    if rows:
        yield current, rows


def seat(customers: np.ndarray, discount, concentration, tables, parent, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers sat down one after the other.

    ``tables`` is the restaurant's number of tables, ``parent`` the parent's probability
    of the dish: a new table has weight (concentration + discount * tables) * parent, the
    dish's old ones its seated customers less a discount each.
    """
    fresh = (concentration + discount * tables) * parent
    made = (customers > 0).astype(np.float64)
    active = np.flatnonzero(customers > 1)
    for seated in range(1, SEATED):
        active = active[customers[active] > seated]
        if not len(active):
            return made
        new = fresh[active]
        old = np.maximum(seated - discount[active] * made[active], 1e-9)
        made[active] += rng.random(len(active)) < new / (new + old)
    seated = SEATED
    while True:
        active = active[customers[active] > seated]
        if not len(active):
            return made
        upto = np.minimum(customers[active], 2 * seated)
        new = fresh[active]
        level = np.maximum(seated - discount[active] * made[active], 1e-9) + new
        expected = new * np.log((level + upto - seated) / level)
        made[active] = np.minimum(made[active] + rng.poisson(expected), customers[active])
        seated *= 2


def _up(batches: Iterator[pa.RecordBatch], roots: int, spread: np.ndarray, listed) -> Iterator[pa.RecordBatch]:
    """What a bucket tells the root buckets: its words with their tokens and tables, and the customers of spread pairs."""
    for bucket, rows in _by_bucket(batches):
        if bucket < 0:
            continue
        held, _ = _bucket_of(rows, listed.value)
        before = _places(held.names[held.pair_v], spread)
        tables, customers = [], []
        for _, served, made in held.sweeps(bucket):
            tables.append(np.bincount(held.pair_word, weights=np.where(before < 0, made, 0), minlength=len(held.words)).astype(np.int64))
            customers.append(served.astype(np.int64))
        for r, words, pairs in held.asked(roots, spread):
            of = np.searchsorted(words, held.pair_word[pairs])
            blobs = [held.words[words].tobytes(), _pack(held.total[words]), _pack(before[pairs]), _pack(of)]
            blobs += [_pack(t[words]) for t in tables] + [_pack(c[pairs]) for c in customers]
            yield _row(bucket, ROOTS, "", r, len(words), blobs, [])


def _root(batches: Iterator[pa.RecordBatch], roots: int, spread: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Seat the words of a root bucket, and their pairs with spread words before, over the tables of all buckets.

    Answers go back to each bucket in its order; a row of kind ``TOTAL`` has the sums.
    Words are dealt out by hash, so a root bucket's own tables times the number of root buckets stand for all tables.
    """
    held: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            held.setdefault(row["root"], []).append(row)
    for r, rows in held.items():
        rows.sort(key=lambda row: row["bucket"])
        names, which = np.unique(np.concatenate([np.frombuffer(row["blobs"][0], np.uint64) for row in rows]), return_inverse=True)
        cuts = np.cumsum([row["n"] for row in rows])[:-1]
        own = np.split(which, cuts)
        total = np.bincount(which, weights=np.concatenate([_unpack(row["blobs"][1]) for row in rows]), minlength=len(names))
        before = [_unpack(row["blobs"][2]) for row in rows]
        word = [o[_unpack(row["blobs"][3])] for o, row in zip(own, rows, strict=True)]
        (pair_v, pair_w), pair = _group(np.concatenate(before), np.concatenate(word))
        pair_cuts = np.cumsum([len(b) for b in before])[:-1]
        known = int((total > 0).sum())
        base = 1.0 / (known * roots + 1)
        scale, blobs, sums = [], [], [known, int(total.sum())]
        spread_sums = np.zeros((2, KEPT, len(spread)))
        for k in range(KEPT):
            rng = np.random.default_rng([1 << 30, r, k])
            other = np.bincount(which, weights=np.concatenate([_unpack(row["blobs"][4 + k]) for row in rows]), minlength=len(names))
            customers = np.bincount(pair, weights=np.concatenate([_unpack(row["blobs"][4 + KEPT + k]) for row in rows]), minlength=len(pair_v))
            d_v = _discount(customers)
            least = other + np.bincount(pair_w, weights=customers > 0, minlength=len(names))
            chance = least / max(1.0, least.sum() * roots)
            at_v = np.bincount(pair_v, weights=customers > 0, minlength=len(spread)) * roots
            tables = seat(customers, np.full(len(pair_v), d_v), CONCENTRATION_V, at_v[pair_v], np.maximum(chance[pair_w], 1e-300), rng)
            served = other + np.bincount(pair_w, weights=tables, minlength=len(names))
            d = _discount(served)
            made = seat(served, np.full(len(names), d), CONCENTRATION, np.full(len(names), float(known * roots)), np.full(len(names), base), rng)
            scale += [d, d_v]
            blobs.append((served, made, customers, tables))
            sums += [served.sum(), d * made.sum()]
            if len(pair_v):
                spread_sums[0, k] = np.bincount(pair_v, weights=customers, minlength=len(spread))
                spread_sums[1, k] = d_v * np.bincount(pair_v, weights=tables, minlength=len(spread))
        yield _row(-1, TOTAL, "", r, 0, [], [float(s) for s in sums] + spread_sums.ravel().tolist())
        for row, o, p in zip(rows, own, np.split(pair, pair_cuts), strict=True):
            out = [_pack(total[o])]
            for served, made, customers, tables in blobs:
                out += [_pack(served[o]), _pack(made[o]), _pack(customers[p]), _pack(tables[p])]
            yield _row(row["bucket"], ROOTS, "", r, row["n"], out, scale)


def _set_roots(held: Bucket, rows: list[dict], roots: int, spread: np.ndarray) -> None:
    """Give a bucket the answers of the root: tokens of each word, and for each sweep what its words and spread pairs hold themselves."""
    words, pairs = len(held.words), len(held.pair_v)
    total = np.zeros(words, np.int64)
    own, pair_own = np.zeros((KEPT, words)), np.zeros((KEPT, pairs))
    answers = {row["root"]: row for row in rows}
    for r, at, at_pair in held.asked(roots, spread):
        blobs, scale = answers[r]["blobs"], answers[r]["scale"]
        total[at] = _unpack(blobs[0])
        for k in range(KEPT):
            served, made, customers, tables = (_unpack(b) for b in blobs[1 + 4 * k : 5 + 4 * k])
            own[k, at] = served - scale[2 * k] * made
            pair_own[k, at_pair] = customers - scale[2 * k + 1] * tables
    held.roots = total, own, pair_own


def _predictive(bucket: int, word: np.ndarray, context: np.ndarray, held: Bucket, totals: Totals, states_too: bool = True) -> tuple[np.ndarray, list]:
    """Averaged probability of each type, and per sweep kept what unseen ones back off with.

    ``word`` and ``context`` are the types' hashes and numbers (v, u); the rest is in ``held``.
    """
    probability = np.zeros(len(word))
    states = []
    total, own, pair_own = held.roots
    base = 1.0 / (totals.words + 1)
    room_customers = np.bincount(held.room, weights=held.count, minlength=len(held.room_v))
    before = _places(held.names, totals.spread)
    apart = before >= 0
    for k, (open_made, customers, tables) in enumerate(held.sweeps(bucket)):
        unknown = (CONCENTRATION + totals.mass[k]) * base / (totals.customers[k] + CONCENTRATION)
        root = own[k] / (totals.customers[k] + CONCENTRATION) + unknown
        v_customers = np.bincount(held.pair_v, weights=customers, minlength=len(held.names))
        v_mass = held.d_v * np.bincount(held.pair_v, weights=tables, minlength=len(held.names))
        pair = customers - held.d_v * tables
        if apart.any():
            v_customers[apart], v_mass[apart] = totals.spread_customers[before[apart], k], totals.spread_mass[before[apart], k]
            pair = np.where(apart[held.pair_v], pair_own[k], pair)
        back_v = (CONCENTRATION_V + v_mass) / (v_customers + CONCENTRATION_V)
        pair = pair / (v_customers[held.pair_v] + CONCENTRATION_V) + back_v[held.pair_v] * root[held.pair_word]
        made = np.minimum(held.count, 1).astype(np.float64)
        made[held.many] = open_made
        back = CONCENTRATION_UV + held.d_uv * np.bincount(held.room, weights=made, minlength=len(held.room_v))
        back = back / (room_customers + CONCENTRATION_UV)
        made = (held.count - held.d_uv * made) / (room_customers + CONCENTRATION_UV)[held.room]
        made += back[held.room] * pair[held.pair]
        probability += made / KEPT
        if states_too:
            states.append((unknown, root, back_v, pair, back))
    return probability, states


def lookup(word, context, known, totals: Totals) -> tuple[np.ndarray, np.ndarray]:
    """(training count of the word, log10 probability) of each asked (word, context).

    ``known``: (word, context, bucket, probability, states) of a bucket's types; ``context`` is a number as in its types,
    of a room that has any. Words that the bucket has not asked the root for are taken as unknown.
    """
    _, have_c, held, probability, states = known
    total, size = held.roots[0], len(held.names)
    at_word = np.minimum(np.searchsorted(held.words, word), max(len(held.words) - 1, 0))
    hit = held.words[at_word] == word
    place = np.searchsorted(held.names, held.words[at_word])
    v = (context // np.uint64(size)).astype(np.int64)

    def find(have: np.ndarray, asked: np.ndarray, valid) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(have, asked), len(have) - 1)
        return at, (have[at] == asked) & valid

    pair_names = held.pair_v * np.int64(size) + np.searchsorted(held.names, held.words)[held.pair_word]
    pair_at, pair_hit = find(pair_names, v * size + place, hit)
    room_at, room_hit = find(have_c[np.searchsorted(held.room, np.arange(len(held.room_v)))], context, True)
    chance = np.zeros(len(word))
    for unknown, root, back_v, pair, back in states:
        parent = np.where(pair_hit, pair[pair_at], back_v[v] * np.where(hit, root[at_word], unknown))
        chance += np.where(room_hit, back[room_at], 1.0) * parent / KEPT
    # types are in order of (room, word)
    type_at, type_hit = find(held.room * np.int64(size) + held.w, room_at * size + place, hit & room_hit)
    chance[type_hit] = probability[type_at[type_hit]]
    return np.where(hit, total[at_word], 0), np.log10(chance)


_TYPE_SCHEMA = "bucket int, names binary, v binary, u binary, w binary, counts binary, total binary, own binary, pair_own binary"


def _types(batches: Iterator[pa.RecordBatch], roots: int, spread: np.ndarray, listed) -> Iterator[pa.RecordBatch]:
    """One row per bucket: its types with counts, and what the root knows of its words."""
    for bucket, rows in _by_bucket(batches):
        if bucket < 0:
            continue
        held, _ = _bucket_of([row for row in rows if row["kind"] == ASK], listed.value)
        _set_roots(held, [row for row in rows if row["kind"] == ROOTS], roots, spread)
        blobs = [held.names, *(x.astype(np.int64) for x in (held.v, held.u, held.w, held.count)), *held.roots]
        arrays = [pa.array([bucket], pa.int32()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)]
        yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "names", "v", "u", "w", "counts", "total", "own", "pair_own"])


def _row_arrays(row: dict) -> tuple[np.ndarray, np.ndarray, Bucket]:
    """Word, context number and restaurants of a bucket's types."""
    names = np.frombuffer(row["names"], np.uint64)
    held = Bucket(names, *(np.frombuffer(row[k], np.int64) for k in ("v", "u", "w", "counts")))
    own, pair_own = (np.frombuffer(row[k], np.float64).reshape(KEPT, -1) for k in ("own", "pair_own"))
    held.roots = np.frombuffer(row["total"], np.int64), own, pair_own
    return _named(held)


def _named(held: Bucket) -> tuple[np.ndarray, np.ndarray, Bucket]:
    return held.names[held.w], (held.v * np.int64(len(held.names)) + held.u).astype(np.uint64), held


_ANSWER_SCHEMA = "flush string, docs binary, n long, sums binary"


def _answer(batches: Iterator[pa.RecordBatch], roots: int, shared, listed) -> Iterator[pa.RecordBatch]:
    """Sums per document of each message: known tokens, logarithms of counts and of probabilities."""
    totals = shared.value

    def out(*values) -> pa.RecordBatch:
        kinds = (pa.string(), pa.binary(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["flush", "docs", "n", "sums"])

    for bucket, rows in _by_bucket(batches):
        if bucket < 0:
            for row in rows:
                yield out(row["flush"], row["blobs"][0], row["n"], row["blobs"][1])
            continue
        held, messages = _bucket_of([row for row in rows if row["kind"] == ASK], listed.value)
        _set_roots(held, [row for row in rows if row["kind"] == ROOTS], roots, totals.spread)
        rows.clear()
        # every token here is of a type of the bucket, if only with no customers
        chance = np.log10(_predictive(bucket, held.w, held.room, held, totals, states_too=False)[0])
        total = held.roots[0][held.pair_word[held.pair]]
        values = [total > 0, np.log10(total + 1), chance]
        for flush, n, per, which, own in messages:
            has = np.flatnonzero(per)
            start = (np.cumsum(per) - per)[has]
            at = own[which]
            sums = [np.add.reduceat(x[at], start, dtype=np.float64) for x in values]
            blob = np.packbits(per > 0).tobytes() + sums[0].astype("<u4").tobytes() + sums[1].tobytes() + sums[2].astype("<f4").tobytes()
            yield out(flush, b"", n, blob)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the answers to each flush; all answers of a flush are in one partition."""
    held: dict[str, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            n, blob = row["n"], row["sums"]
            entry = held.setdefault(row["flush"], [None, None, np.zeros((3, n))])
            if row["docs"]:
                entry[:2] = np.frombuffer(row["docs"], np.int64), np.frombuffer(blob, np.int64)
                continue
            skip = -(-n // 8)
            has = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, skip), count=n))
            for k, kind in enumerate(("<u4", "<f8", "<f4")):
                entry[2][k, has] += np.frombuffer(blob, kind, len(has), skip)
                skip += len(has) * int(kind[-1])
    for ids, tokens, sums in held.values():
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(tokens), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])],
            names=["doc_id", "n_tokens", "n_known", "logs", "score"],
        )


def _learn(docs: DataFrame, buckets: int | None) -> tuple[DataFrame, Totals, dict]:
    """Messages and root answers by bucket, the totals, and what the tasks need to know; ``docs`` has row, text and learn."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    common = docs.select("text").mapInArrow(_common, _COMMON_SCHEMA).groupBy("word").agg(F.sum("n").alias("n"))
    often = common.orderBy(F.col("word") != 0, F.desc("n"), "word").limit(LISTED + 1).collect()  # bounded; the first has the sum
    tokens = often[0].n if often else 0
    buckets = buckets or max(partitions, -(-tokens // BUCKET_TOKENS))
    words = np.array([r.word for r in often[1:]], np.int64).view(np.uint64)
    spread = np.sort(words[[r.n * 4 * buckets > tokens and buckets > 1 for r in often[1:]]])  # under 4 * buckets words
    listed = spark.sparkContext.broadcast(words)
    asked = docs.mapInArrow(partial(_ask, buckets=buckets, spread=spread, listed=listed), _ROW_SCHEMA)
    partitions = min(partitions, buckets)

    def met(rows: DataFrame) -> DataFrame:
        target = F.when(F.col("bucket") < 0, F.pmod(F.hash("flush"), F.lit(partitions))).otherwise(F.pmod("bucket", F.lit(partitions)))
        return rows.repartitionById(partitions, target.cast("int")).sortWithinPartitions("bucket", "kind", "flush")

    told = met(asked.where("kind = 1")).mapInArrow(partial(_up, roots=buckets, spread=spread, listed=listed), _ROW_SCHEMA)
    told = told.repartitionById(partitions, F.pmod("root", F.lit(partitions)).cast("int"))
    roots = durable(told.mapInArrow(partial(_root, roots=buckets, spread=spread), _ROW_SCHEMA))
    sums = roots.where(F.col("kind") == TOTAL).select(F.posexplode("scale").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    values = np.zeros(2 + 2 * KEPT + 2 * KEPT * len(spread))
    for r in sums:  # a few numbers per spread word
        values[r.k] = r.v
    head, rest = values[2 : 2 + 2 * KEPT].reshape(KEPT, 2), values[2 + 2 * KEPT :].reshape(2, KEPT, len(spread))
    totals = Totals(int(values[1]), int(values[0]), head[:, 0], head[:, 1], spread, rest[0].T, rest[1].T)
    return met(roots.where(F.col("kind") == ROOTS).unionByName(asked)), totals, {"roots": buckets, "listed": listed}


def train(docs: DataFrame, buckets: int) -> tuple[DataFrame, Totals]:
    """Types by bucket and the totals of the sweeps kept; ``docs`` are the training texts."""
    met, totals, facts = _learn(docs.select(F.lit(0).cast("long").alias("row"), "text", F.lit(True).alias("learn")), buckets)
    return met.mapInArrow(partial(_types, spread=totals.spread, **facts), _TYPE_SCHEMA), totals


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    held_out = remainder(F.col("doc_id"), 7) == 2
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    # a row's own key: ids may be NULL or repeated
    nothing = -(2**63)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(nothing)).alias("row"), text, (~held_out).alias("learn"))
    met, totals, facts = _learn(keyed, None)
    shared = docs.sparkSession.sparkContext.broadcast(totals)
    answers = met.mapInArrow(partial(_answer, shared=shared, **facts), _ANSWER_SCHEMA)
    added = answers.repartition(F.col("flush")).mapInArrow(_add, "doc_id long, n_tokens long, n_known long, logs double, score double")
    scale = float(np.log10(totals.tokens + (totals.words + 1)))
    doc_id = F.when(F.col("doc_id") != nothing, F.col("doc_id")).alias("doc_id")
    return added.select(
        doc_id,
        (remainder(doc_id, 7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(totals.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
    )
