"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in the order of a hash. Word ``p`` of a queue, which holds every document once and then its second
copy, finishes at virtual time ``p / target``. Words of all sources are put in order of that time by range: an entry adds its words
to the slices of virtual time that it spans, the running total over the slices shows the one in which the budget is reached, that
one is cut finer until it holds few words, and those are sorted. What stands before the cut is the mix. The budget is the whole
words of all targets.

Targets share the budget by weight; a target over ``repeats`` times its source stops there and the rest is shared again,
which in the end is ``least(cap, level * weight)`` for one level. Null sources make a source, the last; null texts have
size 0; rows of one id are told apart by their text's hash, and repeated rows stand in the queue each; an empty table gives an
empty one; other columns pass through ``mix_documents`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import keep, row_key, words

#: Documents of one source in one block of the queue, about.
QUEUE_BLOCK = 20_000

#: Slices of virtual time of one running total, and the words that one task sorts.
SLICES, SORTED_WORDS = 256, 50_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """``source, source_size, target`` from ``(source, size)`` rows; windows hold one row per source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = by.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int")))
    weighted = weighted.withColumn("cap", F.col("source_size") * float(repeats)).withColumn("r", F.col("cap") / F.col("w"))
    up = W.orderBy("r", F.col("source").asc_nulls_last())
    rest = up.rowsBetween(0, W.unboundedFollowing)
    done = F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    everything = F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * share
    levels = weighted.withColumn("level", (everything - done) / F.sum("w").over(rest))
    # The first source, by cap per weight, whose share is within its cap sets the level for all.
    # Of sources with equal caps per weight it is the first again, whose share is the greatest.
    level = F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", (-F.col("level")).alias("less")))).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["less"]
    return levels.withColumn("best", -level).select("source", "source_size", F.coalesce(F.least("cap", F.col("best") * F.col("w")), F.col("cap")).alias("target"))


def queue(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Each row of ``docs (doc_id, source, text)`` with ``size, source_size, target, begins`` (words of its source before it) and ``block, slot`` (its place)."""
    # The text in the ticket keeps rows of one id, or of none, apart.
    ticket = F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":mix:"), F.md5(F.coalesce(docs["text"], F.lit("")))))
    sized = keep(docs.select(docs["doc_id"], docs["source"], F.size(words(docs["text"])).cast("long").alias("size"), row_key(docs["text"]).alias("row_hash"), ticket.alias("ticket")))
    blocks = min(65536, max(64, sized.count() // QUEUE_BLOCK))
    placed = sized.withColumn("block", F.floor(F.conv(F.substring("ticket", 1, 4), 16, 10).cast("long") * blocks / 65536).cast("int"))
    cells = placed.groupBy("source", "block").agg(F.sum("size").alias("size"))
    cells = keep(cells)
    targets = source_targets(cells, weights, share, repeats)
    before = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.select("source", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("off"))
    starts = starts.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    order = W.partitionBy("source", "block").orderBy("ticket", "doc_id", "row_hash")
    inside = placed.withColumns({"slot": F.row_number().over(order), "own": F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")})
    s = starts.select(F.col("source").alias("s"), F.col("block").alias("b"), "off", "source_size", "target")
    joined = inside.join(s, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return keep(joined.withColumn("begins", F.col("off") + F.col("own")).drop("s", "b", "off", "own", "ticket"))


def entries(queued: DataFrame, repeats: int = 2) -> DataFrame:
    """A row per document and copy that has words, with the words of its queue before it."""
    copies = queued.filter("size > 0 AND target > 0").withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
    return copies.withColumn("begins", F.col("begins") + F.col("copy") * F.col("source_size"))


def _slices(rows: DataFrame, low: float, width: float) -> DataFrame:
    """``rows`` by slice of virtual time, ``SLICES`` from ``low`` on: words ``first + 1`` to ``last`` of the queue finish in ``slice``."""
    at = lambda position: (position / F.col("target") - F.lit(low)) / F.lit(width)
    bound = lambda k: F.floor(F.col("target") * (F.lit(low) + k * F.lit(width)))
    # One slice more on both ends makes up for the rounding of the quotient; slices without words go.
    span = F.sequence(F.greatest(F.lit(0), F.floor(at(F.col("begins"))) - 1), F.least(F.lit(SLICES), F.greatest(F.lit(0), F.ceil(at(F.col("begins") + F.col("size"))) + 1)))
    near = rows.filter((at(F.col("begins") + F.col("size")) >= -1) & (at(F.col("begins")) <= SLICES + 1))
    cut = near.withColumn("slice", F.explode(span)).withColumns({
        "first": F.greatest(F.col("begins"), bound(F.col("slice"))), "last": F.least(F.col("begins") + F.col("size"), bound(F.col("slice") + 1))})
    return cut.filter("last > first")


def cut_at_budget(rows: DataFrame) -> DataFrame:
    """``source, sent``: how many words of each queue stand before the place where the running total reaches the budget."""
    targets = keep(rows.groupBy("source").agg(F.max("target").alias("target")))
    budget = targets.agg(F.sum(F.floor("target"))).first()[0] or 0
    low, width, before = 0.0, 1.0 / SLICES, 0
    while True:
        sums = _slices(rows, low, width).groupBy("slice").agg(F.sum(F.col("last") - F.col("first")).alias("words"))
        total = F.sum("words").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, 0)) + before
        found = sums.withColumn("total", total).filter(F.col("total") >= budget).orderBy("slice").first()
        if found is None:  # no words at all
            return targets.select("source", F.lit(0).cast("long").alias("sent"))
        before = found["total"] - found["words"]
        if found["words"] <= SORTED_WORDS or width < 1e-15:
            break
        low, width = low + found["slice"] * width, width / SLICES
    held = _slices(rows, low, width).filter(F.col("slice") == found["slice"])
    each = held.select("source", "target", F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("position"))
    place = F.row_number().over(W.orderBy(F.col("position") / F.col("target"), F.col("source").asc_nulls_last(), "position"))
    last = each.withColumn("place", place).filter(F.col("place") <= budget - before).groupBy("source").agg(F.count("*").alias("more"))
    last = last.select(F.col("source").alias("s"), "more")
    whole = F.floor(F.col("target") * (F.lit(low) + found["slice"] * F.lit(width)))
    return targets.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select("source", (whole + F.coalesce("more", F.lit(0))).alias("sent"))


def schedule(queued: DataFrame, repeats: int = 2) -> DataFrame:
    """The mix: entries with the words that stand before the cut."""
    rows = entries(queued, repeats)
    sent = keep(cut_at_budget(rows)).select(F.col("source").alias("s"), "sent")
    rows = rows.join(sent, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return rows.withColumn("words", F.least(F.col("size"), F.col("sent") - F.col("begins"))).filter("words > 0")


def mixed_sizes(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row."""
    queued = queue(docs, **how)
    sent = schedule(queued).groupBy("source", "block", "slot").agg(F.sum("words").alias("taken"))
    sent = sent.select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("slot").alias("n"), "taken")
    rows = queued.join(sent, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")) & (F.col("slot") == F.col("n")), "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: a copy stays, whole, if the mix takes at least half of it."""
    taken = schedule(queue(docs, **how)).filter("2 * words >= size")
    taken = taken.groupBy("source", "doc_id", "row_hash", "block", "slot").agg(F.max(F.col("copy") + 1).alias("copies"))
    # Rows that are equal here are told apart by their number only.
    same = ["source", "doc_id", "row_hash"]
    taken = taken.withColumn("number", F.row_number().over(W.partitionBy(*same).orderBy("block", "slot"))).select(*(F.col(c).alias(f"t_{c}") for c in same), "number", "copies")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["source"].alias("source"), docs["doc_id"].alias("doc_id"), row_key(docs["text"]).alias("row_hash"))
    rows = rows.withColumn("at", F.row_number().over(W.partitionBy(*same).orderBy(F.xxhash64("row"))))
    on = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in same] + [F.col("at") == F.col("number")]
    joined = rows.join(taken, on)
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
