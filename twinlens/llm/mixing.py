"""Mix sources to target weights by a low-discrepancy schedule over equal blocks of words.

Every source is a line: its documents in an order shuffled by a digest, one behind the
other, and the whole line again for every further pass. The line is cut into blocks of
``BLOCK`` words. The schedule has as many slots as all quotas hold blocks. Slot i has the
van der Corput point of i (the bits of i behind the binary point, in reverse order), and
belongs to the source into whose stretch of the cumulative quotas the point falls. The
slots of a source are ranked, and slot number r takes its block number r. Any run of slots
so holds each source within about log2(slots) / 3 + 1 blocks of its share. Slots beyond a
source's quota stay empty and missing ones are added at the places that an even spacing
gives them, so a source takes its quota to the word; its last block may be shorter.

A quota is the rounded target. Targets share all words by weight; none exceeds ``PASSES``
times its source, what is over goes to the others by weight until none is above.

Only DataFrame functions are used. Lines are summed in buckets of the digest and slots are
ranked in runs, so a source with a third of all rows spreads over many tasks; equal rows
are counted before they are ordered and told apart again in chunks.

Rows: NULL and empty texts have no words and are never taken; NULL ``doc_id`` and repeated
rows are mixed one by one; NULL is a source of its own, behind all others; an empty table
gives no rows; other columns are ignored. Reruns agree, whatever the partitions: equal
rows differ only in their place on the line, and which copy has which does not show.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.operators.counting import before_run, ordered_runs
from twinlens.session import durable

BLOCK = 1024  # words of a block
PASSES = 3  # a document is read so many times at most
WEIGHTS = (1, 2, 3)  # of the sources in order, repeating
BUCKET_ROWS = 20_000  # documents of a bucket, about
RUN_SLOTS = 1 << 16  # slots of a run that are ranked together
CHUNK = 10_000  # equal rows told apart at once
SMALL_BYTES = 8 << 20  # source tables up to this size are broadcast
_WORD = r"[^\x20\x09-\x0D]+"


def _key(source: Column) -> Column:
    """Sources by code point, NULL behind all of them."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, key, size, order: what the mix needs of each document, written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return durable(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            _key(F.col("source").cast("string")).alias("key"),
            F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"),
            F.md5(F.concat(name, F.lit("|"), F.md5(text))).alias("order"),
        )
    )


def _small(table: DataFrame) -> DataFrame:
    """A table of sources, sent to all tasks if its size was checked."""
    size = table.agg(F.coalesce(F.sum(F.length("key") * 4 + 64), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= SMALL_BYTES else table


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """key, source_size, weight, target, quota, before: one row per source; ``before`` sums earlier quotas."""
    sums = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    runs = durable(ordered_runs(sums.withColumn("one", F.lit(1)), [], "key", ["one"]))
    firsts = runs.groupBy("run").agg(F.min("key").alias("run_first"), F.count("*").alias("run_n"))
    earlier = firsts.select("run", before_run([], "run_n").alias("earlier"))  # one row per partition
    number = F.col("earlier") + F.col("cum_one") - 1
    weight = F.get(F.lit(list(weights)), F.pmod(number, F.lit(len(weights))).cast("int"))
    sources = durable(runs.join(F.broadcast(earlier), "run").select("key", "source_size", weight.cast("long").alias("weight")))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    most = F.col("source_size") * passes
    rest, shares = total, sources.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    while shares:
        full = most <= F.lit(rest) * F.col("weight") / F.lit(shares)
        taken, open_ = sources.agg(F.coalesce(F.sum(F.when(full, most)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if open_ == shares or not open_:
            break
        rest, shares = total - taken, open_
    share = (F.lit(rest) * F.col("weight")).cast("double") / F.lit(max(shares, 1))
    target = F.least(most.cast("double"), share)
    quotas = sources.select("*", target.alias("target"), F.floor(target + 0.5).cast("long").alias("quota"))
    runs = durable(ordered_runs(quotas, [], "key", ["quota"]))
    firsts = runs.groupBy("run").agg(F.min("key").alias("run_first"), F.sum("quota").alias("run_quota"))
    earlier = firsts.select("run", before_run([], "run_quota").alias("earlier"))
    before = F.col("earlier") + F.col("cum_quota") - F.col("quota")
    columns = ["key", "source_size", "weight", "target", "quota"]
    return durable(runs.join(F.broadcast(earlier), "run").select(*columns, before.alias("before")))


def lines(sizes: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, key, size, start: where each document with words lies on its source's line."""
    rows = sizes.where("size > 0")
    buckets = max(1, math.ceil(sizes.count() / bucket_rows))
    head = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    bucket = F.shiftright(head * buckets, 32)
    equal = rows.groupBy("key", bucket.alias("bucket"), "order", "doc_id", "size").agg(F.count("*").alias("copies"))
    words = F.col("size") * F.col("copies")
    inside = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    offsets = sums.select("key", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    placed = equal.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(offsets, ["key", "bucket"])
    placed = durable(placed.select("doc_id", "key", "size", "copies", (F.col("offset") + F.col("inside")).alias("start")))
    one = placed.where("copies = 1").drop("copies")
    chunks = placed.where("copies > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / CHUNK))))
    last = F.least(F.col("copies"), (F.col("chunk") + 1) * CHUNK) - 1
    spread = chunks.repartition("key", "start", "chunk").withColumn("copy", F.explode(F.sequence(F.col("chunk") * CHUNK, last)))
    return one.unionByName(spread.select("doc_id", "key", "size", (F.col("start") + F.col("copy") * F.col("size")).alias("start")))


def van_der_corput(number: Column, bits: int) -> Column:
    """The first ``bits`` bits of a number in reverse order; its own inverse."""
    return F.conv(F.reverse(F.lpad(F.bin(number), bits, "0")), 2, 10).cast("long")


def schedule(sources: DataFrame, block: int = BLOCK, run_slots: int = RUN_SLOTS) -> DataFrame:
    """place, key, rank, words: the slots in order of ``place``, each with the rank-th block of a source.

    A source's slots are the numbers whose points lie in its stretch of the cumulative
    quotas; since the reversal of bits is its own inverse they are read from the points.
    """
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    slots = max(1, math.ceil(total / block))
    bits = max(1, (slots - 1).bit_length())
    grid = 1 << bits

    def point(words: Column) -> Column:
        return F.floor(words / F.lit(float(max(total, 1))) * grid)

    stretch = sources.where("quota > 0").select(
        "key", point(F.col("before")).alias("low"), (point(F.col("before") + F.col("quota")) - 1).alias("high")
    )
    pieces = stretch.where("high >= low").select(
        "*", F.explode(F.sequence(F.floor(F.col("low") / run_slots), F.floor(F.col("high") / run_slots))).alias("run")
    )
    ends = F.greatest(F.col("low"), F.col("run") * run_slots), F.least(F.col("high"), (F.col("run") + 1) * run_slots - 1)
    points = pieces.repartition("key", "run").select("key", F.explode(F.sequence(*ends)).alias("point"))
    number = van_der_corput(F.col("point"), bits)
    scheduled = durable(points.select("key", number.alias("slot")).where(F.col("slot") < slots))
    run = F.floor(F.col("slot") / run_slots).alias("run")
    sizes = scheduled.groupBy("key", run).agg(F.count("*").alias("n"), F.max("slot").alias("last"))
    earlier = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("key", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("key", "run").orderBy("slot")) - 1
    ranked = scheduled.select("key", "slot", run).withColumn("inside", inside).join(offsets, ["key", "run"])
    ranked = ranked.select("key", F.col("slot").cast("double").alias("place"), (F.col("offset") + F.col("inside")).alias("rank"))
    needed = F.ceil(F.col("quota") / block)
    counts = sizes.groupBy("key").agg(F.sum("n").alias("have"), F.max("last").alias("last"))
    short = sources.where("quota > 0").join(counts, "key", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    short = short.where(F.col("have") < needed).withColumn("needed", needed)
    short = short.withColumn("rank", F.explode(F.sequence(F.col("have"), F.col("needed") - 1)))
    even = (F.col("rank") + 0.5) * slots / F.col("needed")
    behind = F.coalesce("last", F.lit(-1)) + (F.col("rank") - F.col("have") + 1) / (F.col("needed") - F.col("have") + 1)
    added = short.select("key", F.greatest(even, behind).alias("place"), "rank")
    quotas = _small(sources.select("key", "quota"))
    words = F.least(F.lit(block).cast("long"), F.col("quota") - F.col("rank") * block)
    both = ranked.unionByName(added).join(quotas, "key").withColumn("words", words)
    return both.where("words > 0").select("place", "key", "rank", "words")


@dataclass
class Mix:
    """All parts of a mix, as tables."""

    sizes: DataFrame  #: doc_id, key, size of every document
    sources: DataFrame  #: one row per source with its target
    stretches: DataFrame  #: key, doc_id, size, start, rank, place, first, words: stretches of documents in slots

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: how many words of each document are in the mix."""
        words = F.sum(F.when(F.col("place").isNotNull(), F.col("words")).otherwise(0)).alias("taken")
        read = self.stretches.groupBy("key", "start", "doc_id", "size").agg(words).drop("start")
        rest = self.sizes.where("size = 0").select("key", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
        about = _small(self.sources.select("key", "source_size", "target"))
        return read.unionByName(rest).join(about, "key").select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> Mix:
    """Mix ``docs``. ``stretches`` in order of (place, key, rank, start) are the mix, word for word:
    ``words`` words of the document from word ``first`` on. Stretches without a place are left out."""
    sizes = sized(docs)
    sources = source_targets(sizes, weights, passes)
    size, quota = F.col("source_size"), F.col("quota")
    placed = lines(sizes).join(_small(sources.select("key", "source_size", "quota")), "key")
    further = F.greatest(F.lit(0), F.floor((quota - F.col("start") - 1) / size))
    placed = placed.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), further)))
    placed = placed.withColumn("at", F.col("pass") * size + F.col("start"))
    placed = placed.withColumn("end", F.least(F.col("at") + F.col("size"), F.greatest(quota, F.col("at"))))
    rank = F.floor(F.col("at") / block)
    last = F.greatest(rank, F.floor((F.col("end") - 1) / block))
    pieces = placed.withColumn("rank", F.explode(F.sequence(rank, last)))
    low = F.greatest(F.col("at"), F.col("rank") * block)
    pieces = pieces.select(
        "key", "doc_id", "size", "start", "rank", (low - F.col("at")).alias("first"),
        (F.least(F.col("end"), (F.col("rank") + 1) * block) - low).alias("words"),
    )
    slots = schedule(sources, block).select("key", "rank", "place")
    met = pieces.join(slots, ["key", "rank"], "left")
    # the last block of a source may end before the documents that begin in it
    return Mix(sizes, sources, met.withColumn("place", F.when(F.col("words") > 0, F.col("place"))))
