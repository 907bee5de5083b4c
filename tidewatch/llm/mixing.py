"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks.

Slot i of the schedule is the van der Corput point of i (its bits reversed); the cumulated weights of the sources, in
blocks, map it to a source. A source's slots are ranked, and rank r takes block r of the source's stream: its documents in
an order shuffled by hash, cut into blocks of `block` words, once per epoch. The slots are a power of two, at least as many
as the blocks of all targets, so every block's share of the unit interval holds a point: each source is hit as often as it
has blocks to give, and its first ranks, the last cut at the target, take its rounded target. Where a document stands in the
mixture, `slot`, follows from the schedule. Everything is DataFrame operations.

Hot sources: ranks and running sums are two-level. The order is cut into CHUNKS pieces per source, pieces are summed with
partial aggregation, and windows run within one piece, or over the at most CHUNKS pieces of a source. Rows that are alike are
counted, numbered and dealt over the pieces by their number, so an id that many rows repeat, or none, is no hot piece.

A document without words, or with null text, has size 0 and is never taken. A null source is a source of its own, last
in order. Rows that repeat an id are documents of their own. Extra columns are ignored. An empty table, or one
without words, gives targets of 0. A schedule has at most 2**MOST_BITS slots (some 2e15 words in blocks of 1,024); a longer one
is a ValueError.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, n_words, written

CHUNKS = 4096
BINS = 4096
#: Products of points and slots, taken in two parts, stay in 64 bits up to so many bits.
MOST_BITS = 41
#: Rows that are alike are numbered in runs of this length.
RUN = 1 << 16


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: key, source, source_size, target. One row per source of the mixture, which is configuration-sized.
    sized: key, source, size and n, the number of such rows.

    Targets follow the weights, stop at `most` times the source's size, and the excess is shared out again by weight:
    in the order of size / weight the first sources are full, the rest share what is left.
    """
    per = sized.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = per.withColumn("weight", weight).withColumn("full", most * F.col("source_size"))
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("place", F.row_number().over(order)).withColumn("level", level)
    free = F.when(F.col("full") > F.col("weight") * F.col("level"), F.col("place"))
    final = F.min(F.when(free.isNotNull(), F.struct(free.alias("place"), "level"))).over(everything)
    return levelled.withColumn("final", final).select(
        "key", "source", "source_size",
        F.when(F.col("final").isNull(), F.col("full")).otherwise(F.least(F.col("full"), F.col("weight") * F.col("final.level"))).alias("target"),
    )


def van_der_corput(i: Column, bits: int) -> Column:
    """The point of i in units of 2**-bits: its last `bits` bits (62 at most) in reverse."""
    x = i
    for by in (1, 2, 4, 8, 16, 32):
        mask = F.lit(sum(((1 << by) - 1) << at for at in range(0, 64, 2 * by)))
        x = F.shiftleft(x.bitwiseAND(mask), by).bitwiseOR(F.shiftright(x, by).bitwiseAND(mask))
    return F.shiftrightunsigned(x, 64 - bits)


def scaled(point: Column, total: int, bits: int) -> Column:
    """floor(point * total / 2**bits) for points below 2**bits and totals up to it; the product is taken in two parts."""
    low = min(20, bits)
    high_part, low_part = F.shiftright(point, low), point.bitwiseAND(F.lit((1 << low) - 1))
    return F.shiftright(high_part * F.lit(total) + F.shiftright(low_part * F.lit(total), low), bits - low)


def schedule(sources: DataFrame, block: int, point: Callable[[Column, int], Column] = van_der_corput) -> DataFrame:
    """(key, rank, slot, epoch, block, used): the slots in use, ranked per source, and the words each takes of its block.

    The interval join of points and sources is an equi-join on bins of the unit interval.
    """
    spark = sources.sparkSession
    size, quota = F.col("source_size"), F.round("target").cast("long")
    blocks = F.ceil(size / F.lit(block)).cast("long")
    needed = F.floor(quota / size) * blocks + F.ceil((quota % size) / F.lit(block))
    plan = sources.where("source_size > 0").select("key", "source", size.alias("size"), quota.alias("quota"), blocks.alias("blocks"), needed.cast("long").alias("needed")).where("needed > 0")
    total = int(plan.agg(F.coalesce(F.sum("needed"), F.lit(0))).first()[0])
    bits = max(1, (total - 1).bit_length())
    if bits > MOST_BITS:
        raise ValueError(f"{total} blocks; a schedule has at most 2**{MOST_BITS} slots: take a larger block")
    order = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    spans = plan.withColumn("high", F.sum("needed").over(order)).withColumn("low", F.col("high") - F.col("needed"))
    in_bin = lambda x: F.floor(x * F.lit(BINS) / F.lit(max(total, 1))).cast("long")
    spans = spans.select("key", "low", "high", F.explode(F.sequence(in_bin(F.col("low")), in_bin(F.col("high") - 1))).alias("bin"))
    # Of 2**bits points each unit 0..total - 1 gets one at least.
    slots = spark.range(1 << bits if total else 0).withColumn("unit", scaled(point(F.col("id"), bits), total, bits))
    placed = slots.withColumn("bin", in_bin(F.col("unit"))).join(spans, "bin").where((F.col("unit") >= F.col("low")) & (F.col("unit") < F.col("high")))
    piece = F.floor(F.col("id") * F.lit(CHUNKS / (1 << bits)))
    placed = placed.select("key", "id", piece.alias("piece"))
    bases = placed.groupBy("key", "piece").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ranked = placed.join(bases.select("key", "piece", "base"), ["key", "piece"])
    ranked = ranked.select("key", F.col("id").alias("slot"), (F.col("base") + F.row_number().over(Window.partitionBy("key", "piece").orderBy("id")) - 1).alias("rank"))
    used = ranked.join(plan, "key").where("rank < needed")
    used = used.withColumn("epoch", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.pmod("rank", "blocks"))
    begin = F.col("epoch") * F.col("size") + F.col("block") * block
    length = F.least(F.lit(block), F.col("size") - F.col("block") * block)
    return used.select("key", "rank", "slot", "epoch", "block", F.greatest(F.lit(0), F.least(length, F.col("quota") - begin)).alias("used")).where("used > 0")


def placed_documents(sized: DataFrame, sources: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Adds the first word's place in the source's shuffled stream, and the source's size and target.

    sized: doc_id, key, size, carry and n, the number of rows that are alike in them. Which of them is which doesn't matter, so
    they are numbered, runs of numbers first, and their places follow from their numbers.
    """
    runs = sized.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    few, many = runs.where(F.col("n") <= RUN), runs.where(F.col("n") > RUN).repartition("doc_id", "key", "size", "run", *carry)
    numbered = few.unionByName(many).withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)))
    shuffled = numbered.drop("n", "run").withColumn("mark", F.xxhash64("doc_id", "size", *carry, "copy", F.lit("shuffle")))
    shuffled = shuffled.withColumn("piece", F.shiftright("mark", 64 - CHUNKS.bit_length() + 1))
    sums = shuffled.groupBy("key", "piece").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    bases = bases.join(sources.select("key", "source_size", "target"), "key")
    running = F.sum("size").over(Window.partitionBy("key", "piece").orderBy("mark", "doc_id", "size", *carry, "copy").rowsBetween(Window.unboundedPreceding, 0))
    return shuffled.join(bases, ["key", "piece"]).select("doc_id", "key", "size", "source_size", "target", (F.col("base") + running - F.col("size")).alias("start"), *carry)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 1024, carry: tuple[str, ...] = (), point: Callable[[Column, int], Column] = van_der_corput
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first, second (words taken in each epoch), first_slot,
    second_slot (where the schedule takes them; null if it does not) and slot, the earlier of the two.

    The columns `carry` follow their row, and order the rows that agree in id and size.
    """
    every = docs.select("doc_id", "source", _key(F.col("source")).alias("key"), n_words(F.col("text")).alias("size"), *carry)
    sized = written(every.groupBy("doc_id", "source", "key", "size", *carry).agg(F.count("*").alias("n")), "sizes")
    sources = written(targets(sized, weights, share, most), "sources")
    placed = written(placed_documents(sized, sources, carry), "placed")
    size, start = F.col("size"), F.col("start")
    cut = F.sequence(F.floor(start / F.lit(block)), F.floor((start + size - 1) / F.lit(block)))
    pieces = placed.where("size > 0").withColumn("block", F.explode(cut))
    joined = pieces.join(schedule(sources, block, point), ["key", "block"], "left")
    begin = F.col("block") * block
    overlap = F.greatest(F.lit(0), F.least(start + size, begin + F.col("used")) - F.greatest(start, begin))
    joined = joined.withColumn("overlap", F.coalesce(F.when(F.col("used").isNotNull(), overlap), F.lit(0)))
    per_epoch = {name: test for name, test in (("first", F.col("epoch") == 0), ("second", F.col("epoch") > 0))}
    taken = joined.groupBy("key", "start", "doc_id", "size", "source_size", "target", *carry).agg(
        *[F.sum(F.when(test, F.col("overlap")).otherwise(0)).alias(name) for name, test in per_epoch.items()],
        *[F.min(F.when(test & (F.col("overlap") > 0), F.col("slot"))).alias(f"{name}_slot") for name, test in per_epoch.items()],
    )
    none = placed.where("size = 0").select("key", "start", "doc_id", "size", "source_size", "target", *carry, *[F.lit(0).cast("long").alias(n) for n in per_epoch], *[F.lit(None).cast("long").alias(f"{n}_slot") for n in per_epoch])
    every = taken.unionByName(none)
    return every.select("doc_id", "size", "source_size", "target", (F.col("first") + F.col("second")).alias("taken"), "first", "second", "first_slot", "second_slot", F.least("first_slot", "second_slot").alias("slot"), *carry)


def mixed_documents(docs: DataFrame, slot: str | None = None, **options) -> DataFrame:
    """The mixture as rows of docs: a row stands once for each epoch that takes half of its words or more. With `slot` each row
    has its place in the schedule as a column of that name; rows come in no order, as a written table would not keep one.

    Whole documents keep their texts intact; a source's words then differ from its target by less than one document.
    Texts without words are in no mixture. Rows with a null id, and each of the rows that repeat an id, stand as often as
    they are taken themselves: copies are counted by the id and a digest of source and text, and stand at the earliest slot
    of their epoch. Only where rows that agree in these are taken unequally often are they ranked, by their other columns.
    """
    digest = F.unhex(F.sha2(F.concat(F.sha2(_key(F.col("source")), 256), "text"), 256))
    taken = mix(docs.select("doc_id", "source", "text", digest.alias("digest")), carry=("digest",), **options)
    id_, mark, own, n, once, twice, times, slots = (free_name(docs, c) for c in ("id", "mark", "own", "rows", "once", "twice", "times", "slots"))
    half = {name: 2 * F.col(name) >= F.col("size") for name in ("first", "second")}
    copies = taken.where("size > 0").groupBy(F.col("doc_id").alias(id_), F.col("digest").alias(mark)).agg(
        F.count("*").alias(n), F.count_if(half["first"] | half["second"]).alias(once), F.count_if(half["first"] & half["second"]).alias(twice),
        *[F.min(F.when(test, F.col(f"{name}_slot"))).alias(f"{name}_slot") for name, test in half.items()],
    ).withColumn(slots, F.sort_array(F.array_compact(F.array("first_slot", "second_slot")))).drop("first_slot", "second_slot")
    copies = written(copies.where(F.col(once) > 0), "copies")
    rows = docs.withColumn(own, digest)
    unequal = (F.col(once) < F.col(n)) | F.col(twice).between(1, F.col(n) - 1)
    alike, ranked = copies.where(~unequal).hint("shuffle_hash"), copies.where(unequal)
    out = rows.join(alike, rows["doc_id"].eqNullSafe(alike[id_]) & (rows[own] == alike[mark])).withColumn(times, F.when(F.col(twice) > 0, 2).otherwise(1))
    if not ranked.isEmpty():
        orderable = [F.col(f"`{f.name}`") for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
        place = F.row_number().over(Window.partitionBy(id_, mark).orderBy(*orderable))
        some = rows.join(ranked, rows["doc_id"].eqNullSafe(ranked[id_]) & (rows[own] == ranked[mark]))
        out = out.unionByName(some.withColumn(times, F.when(place <= F.col(twice), 2).when(place <= F.col(once), 1)).where(F.col(times).isNotNull()))
    place = free_name(docs, "place")
    copy = out.withColumn(place, F.explode(F.slice(slots, 1, F.col(times)))).drop(own, id_, mark, n, once, twice, times, slots)
    return copy.withColumnRenamed(place, slot) if slot else copy.drop(place)
