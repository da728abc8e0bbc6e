"""Alignment, mixing and vector codes against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from twinlens.llm import alignment, mixing, vector_codes

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def both_sides(text):
    """(id, bytes) of both tokenizers' tokens of one text, or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    from twinlens.llm.tokens import _byte_letters

    if not hasattr(both_sides, "tools"):
        both_sides.tools = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
        both_sides.tools[0].encode_special_tokens = True
    a_tool, b_tool = both_sides.tools
    if not text:
        return None
    letters = {v: k for k, v in _byte_letters().items()}
    found = a_tool.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(letters[c] for c in a_tool.id_to_token(i))) for i in found.ids]
    b = []
    for i in b_tool.encode(text):
        piece = b_tool.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if b_tool.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want and b"".join(x for _, x in b) == want else None


def plain_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text."""
    done, pairs = [], Counter()
    for text in texts:
        sides = both_sides(text)
        if sides is None:
            done.append(None)
            continue
        spans = []
        for side in sides:
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        links = []
        for i, s, e in spans[0]:
            links += [(i, j) for j, s2, e2 in spans[1] if s < e2 and s2 < e]
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, last = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if last < e <= cut) for side in spans))
            last = cut
        pairs.update(links)
        done.append((len(spans[0]), len(spans[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, b), n in pairs.items():
        top[b] = max(top[b], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(pairs[x] == top[x[1]] for x in d[3]), sum(pairs[x] for x in d[3]), d[4])
        for d in done
    ]


def aligned(df):
    rows = df.collect()
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)


ALIGN_TEXTS = [
    "  two  blanks  ", "\n\nline\n next \t tab\r\n", "<|endoftext|> <s> </s> <0x41> <unk>", "▁ own blank", "ﬁne Ａ ñ ñ 　 \U0001f600\U0001f468‍\U0001f469 中文字",
    "a", " ", "\n", "x" * 300, "don't 12345678 ..... ---- CamelCaseWords snake_case", "\x00\x01\x7f\u0085  ", "e" * 7 + " " * 20 + "f",
]


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 20, 0], ids=["all sent", "some joined", "all joined"])
def test_alignment_equals_brute_force(spark, odd_docs, heavy):
    odd = [(r.doc_id, r.text) for r in odd_docs.collect() if r.text is None or len(r.text) < 1000]
    rows = odd + [(200 + i, t) for i, t in enumerate(ALIGN_TEXTS)] + [(None, "no id at all"), (None, "no id at all"), (200, "the id again")]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40 and length(text) < 4000").collect()]
    rows += docs
    want = sorted((d is None, d or 0, *x) for (d, _), x in zip(rows, plain_alignment([t for _, t in rows]), strict=True))
    frame = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, pair int, uid int, n_a string").repartition(3)
    assert aligned(alignment.align(frame, BYTES, PIECES, heavy)) == want


def test_alignment_of_no_rows_and_long_texts(spark, no_docs):
    assert alignment.align(no_docs, BYTES, PIECES).count() == 0
    long = " ".join(random.Random(5).choices(["word", "longer", "x.y", "naïve", "12"], k=40000))
    docs = spark.createDataFrame([(1, long), (2, "word " * 30000)], "doc_id long, text string")
    for row in alignment.align(docs, BYTES, PIECES).collect():
        a, b = both_sides(long if row.doc_id == 1 else "word " * 30000)
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
        assert (row.n_a, row.n_b) == (len(a), len(b)) and row.n_groups == len(ends[0] & ends[1]) and row.n_links == len(ends[0] | ends[1])


def test_shared_ends_of_random_lists():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.02, 0.5):
        first_a, first_b, a, b, at = [0], [0], [], [], 0
        for _ in range(30):
            size = int(rng.integers(1, 400))
            common = rng.random(size) < share
            sides = [np.flatnonzero(common | (rng.random(size) < 0.3) & (np.arange(size) % 2 == k)) for k in (0, 1)]
            for ends, first, side in ((a, first_a, sides[0]), (b, first_b, sides[1])):
                ends.extend({*(side + at).tolist(), at + size})
                ends.sort()
                first.append(len(ends))
            at += size + 1
        a, b = np.array(a), np.array(b)
        found = alignment.shared_ends(a, b, np.array(first_a), np.array(first_b))
        assert (a[found >= 0] == np.intersect1d(a, b)).all() and (b[found[found >= 0]] == a[found >= 0]).all()


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Rows of (vec_id, vector, label) -> sorted (vec_id, code, error, label_error, digest)."""
    import math

    kept = [
        (i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    cut = [[tuple(v[q * w : q * w + w]) for q in range(parts)] for _, v, _ in kept]
    seeds = [c for c, r in zip(cut, kept, strict=True) if r[0] is not None][:entries]
    books = [[s[q] for s in seeds] for q in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for q in range(parts):
            mine = [[] for _ in books[q]]
            for c in cut:
                mine[nearest(c[q], books[q])[1]].append(c[q])
            books[q] = [tuple(sum(z) // len(m) for z in zip(*m, strict=True)) if m else e for m, e in zip(mine, books[q], strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[nearest(c[q], books[q]) for q in range(parts)] for c in cut]
    errors, labels = [sum(d for d, _ in f) for f in found], Counter()
    for e, (_, _, lab) in zip(errors, kept, strict=True):
        labels[lab] += e
    return sorted(
        (r[0] is None, r[0] or 0, "".join(f"{j:02x}" for _, j in f), e, labels[r[2]], digest)
        for r, f, e in zip(kept, found, errors, strict=True)
    )


def coded(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def vectors(seed, n, length=16):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(length)] for _ in range(5)]
    rows = [(rng.randrange(10 * n), [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.choice([0, 1, None])) for _ in range(n)]
    return [(i, np.float32(v).tolist(), lab) for i, v, lab in rows]


def test_vector_codes_equal_brute_force(spark):
    odd = [
        (1, None, 0), (2, [None] + [0.1] * 15, 0), (3, [float("nan")] * 16, 0), (4, [float("inf")] + [0.0] * 15, 1), (None, [0.25] * 16, 5),
        (7000, [0.5] * 16, None), (7000, [0.5] * 16, None), (7000, [-0.5] * 16, None), (7001, [100.0, -100.0] * 8, 1), (7002, [0.1] * 8, 1), (7003, [], 1),
    ]
    for rows in (vectors(1, 300) + odd, vectors(2, 9), [(5, [0.1] * 16, None)] * 40):
        frame = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, code string, parts int")
        assert coded(vector_codes.compress(frame.repartition(3))) == plain_codes(rows)


def test_vector_codes_of_no_rows_and_odd_lengths(spark):
    frame = spark.createDataFrame([(1, None, 0)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(frame).count() == 0 and vector_codes.compress(frame.where("false")).count() == 0
    rows = [(i, [x + i / 50, 0.5, -0.25], 1) for i, x in enumerate([0.0] * 30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = plain_codes([(i, np.float32(v).tolist() + [0.0] * 5, lab) for i, v, lab in rows])
    assert coded(vector_codes.compress(frame)) == want


def test_net_ways_exclude_more_than_drifts():
    """Same codes as a full scan, and fewer entries measured than with the lengths of all steps."""
    rng = np.random.default_rng(4)
    parts = np.floor(4096 * rng.normal(0, 0.2, (4000, 8, 8)).cumsum(2)).astype(np.int64)
    history = vector_codes.History([parts[:16].transpose(1, 0, 2).copy()])
    codes, own, bounds, stamps = vector_codes.first_codes(parts, history)
    other, looked = (codes, bounds, stamps), np.zeros(2, int)
    for _ in range(6):
        sums = np.array([[parts[codes[:, q] == j, q].sum(0) for j in range(16)] for q in range(8)]).astype(object)
        counts = np.array([[(codes[:, q] == j).sum() for j in range(16)] for q in range(8)])
        history.books.append(history.means(sums, counts))
        assert (history.net_ways() <= history.drifts() * (1 + 1e-8) + 1e-5).all()
        codes, own, bounds, stamps, n = vector_codes.next_codes(parts, codes, bounds, stamps, history)
        a, _, b, s, m = vector_codes.next_codes(parts, *other, history, history.drifts() * (1 + 1e-9) + 1e-6)
        other, looked = (a, b, s), looked + (n, m)
        full = vector_codes.first_codes(parts, history)
        assert (codes == full[0]).all() and (own == full[1]).all() and (a == codes).all()
    assert looked[0] < looked[1] < 6 * parts.shape[0] * 8 * 15 * 0.9


def plain_targets(sizes):
    """Targets by resharing what is over, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, shares = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and rest * weight[s] >= 3 * sizes[s] * shares}
        if not over:
            return {s: 3 * sizes[s] if s in full else rest * weight[s] / shares for s in order}
        full |= over


def mixed_rows(seed, n):
    rng = random.Random(seed)
    names = ["b", "a", "ä", "", None, "tiny", "empty", "Z"]
    rows = []
    for i in range(n):
        source = rng.choices(names, [30, 8, 4, 3, 3, 0.5, 0.2, 20])[0]
        words = 0 if source == "empty" else rng.choice([0, 1, 3, 50, 200])
        rows.append((rng.choice([i, i, None]), " ".join(["w"] * words) or rng.choice([None, " ", ""]), source))
    return rows + [(5, "same " * 12, "b")] * 40 + [(None, "x y z", None)] * 30


@pytest.mark.parametrize("block", [1024, 64, 7])
def test_mix_meets_targets(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    rows = mixed_rows(block, 500)
    frame = spark.createDataFrame([(d, t, s, 1, 2) for d, t, s in rows], "doc_id long, text string, source string, size int, start int").repartition(3)
    done = mixing.mix(frame, block)
    taken = done.taken().collect()
    assert Counter((r.doc_id, r["size"]) for r in taken) == Counter((d, len((t or "").split())) for d, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    got, target = Counter(), {r.key: r for r in done.sources.collect()}
    for r in taken:
        assert 0 <= r.taken <= 3 * r["size"]
    for s in sizes:
        row = target["1" if s is None else "0" + s]
        assert row.source_size == sizes[s] and abs(row.target - want[s]) < 1e-6
        got[s] = row.quota
    stretches = done.stretches.where("place is not null").collect()
    words = Counter()
    for r in stretches:
        words[None if r.key == "1" else r.key[1:]] += r.words
        assert 0 < r.words <= r["size"] and 0 <= r.first <= r["size"] - r.words
    assert all(words[s] == got[s] and abs(words[s] - want[s]) <= 0.5 for s in sizes)
    assert sum(r.taken for r in taken) == sum(words.values())
    again = mixing.mix(frame.repartition(5), block).taken().collect()
    assert sorted(map(repr, again)) == sorted(map(repr, taken))


def test_schedule_is_even_everywhere(spark):
    rows = [(i, "w " * (40 + i % 7), "abc"[min(i % 10, 2)]) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sources = mixing.source_targets(mixing.sized(frame))
    slots = sorted((r.place, r.key, r.rank) for r in mixing.schedule(sources, 16, run_slots=50).collect())
    quota = {r.key: r.quota for r in sources.collect()}
    total, seen = sum(quota.values()), Counter()
    for i, (_, key, rank) in enumerate(slots, 1):
        assert rank == seen[key]
        seen[key] += 1
        for k in quota:
            assert abs(seen[k] - i * quota[k] / total) <= len(slots).bit_length() / 3 + 1
    assert len(slots) == sum(-(-q // 16) for q in quota.values())


def test_mix_of_no_rows(spark, no_docs, odd_docs):
    none = no_docs.withColumnRenamed("lang", "source")
    assert mixing.mix(none).taken().count() == 0
    blank = odd_docs.withColumnRenamed("lang", "source").where("text is null or text = ''")
    assert {(r.taken, r.target) for r in mixing.mix(blank).taken().collect()} == {(0, 0.0)}
