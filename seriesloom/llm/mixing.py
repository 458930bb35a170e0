"""Mixing sources to target weights, block by block, as a tree of exact splits.

The sources hang in a Huffman tree of their weights. A node that has had n slots gives
its left child round(n * weight of the child / weight of the node) of them and the
right child the rest, so every slot goes to one source, the target weights hold
without a period or a least share, and the distance from them does not grow with the
input: it is at most half a block for each node between root and source, times the
source's part of that node, less than 1.7 blocks in any Huffman tree. The slot of any block
follows from the integers on its path by divisions, without a schedule that is worked out slot by slot.

A source whose blocks are used up leaves: from the next slot on a new tree of the
remaining weights holds. So the order covers every document.

``period_schedule`` works out a repeating Pfair schedule for callers that want one: a
source with weight w and blocks 1, 2, 3, … releases block i at (i - 1) / w and has to
be served by i / w; the earliest deadline is served first. Its weights are multiples
of 1 / ``period``.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

PERIOD, BLOCK_ROWS = 1000, 4
MAX_SOURCES = 1000
ADDED = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "in_mix")


def integer_shares(weights: DataFrame, period: int) -> DataFrame:
    """(source_key, share): whole numbers that sum to ``period``, at least 1 each.

    Every source gets 1; the rest goes out by largest remainder, ties to the
    smaller key. ``weights`` has a row per source, at most MAX_SOURCES of them.
    """
    everything = Window.partitionBy()
    spare = period - F.count(F.lit(1)).over(everything)
    exact = F.col("weight") / F.sum("weight").over(everything) * spare
    parts = weights.withColumn("__exact", F.round(exact, 9)).withColumn("__whole", F.floor("__exact"))
    left = spare - F.sum("__whole").over(everything)
    place = F.row_number().over(Window.partitionBy().orderBy((F.col("__whole") - F.col("__exact")), "source_key"))
    return parts.withColumn("__left", left).withColumn("__place", place).select(
        "source_key", (1 + F.col("__whole") + F.when(F.col("__place") <= F.col("__left"), 1).otherwise(0)).cast("int").alias("share")
    )


def period_schedule(shares: DataFrame, period: int) -> DataFrame:
    """(source_key, share, turn, release, deadline, slot) of the blocks of one period, all from 0.

    Block number ``turn`` of a source with ``share`` blocks a period is released at
    floor(turn * period / share) and due by ceil((turn + 1) * period / share). The fold
    below serves the earliest deadline in each slot; ties go to the smaller key.
    """
    gathered = shares.agg(F.sort_array(F.collect_list(F.struct("source_key", "share"))).alias("s"))

    def release(turn: Column, share: Column) -> Column:
        return F.floor(turn * period / share)

    def deadline(turn: Column, share: Column) -> Column:
        return F.ceil((turn + 1) * period / share)

    served = F.aggregate(
        F.sequence(F.lit(0), F.lit(period - 1)),
        F.struct(
            F.transform("s", lambda x: F.lit(0)).alias("turns"),
            F.array().cast("array<int>").alias("order"),
        ),
        lambda state, slot: _serve(state, slot, release, deadline),
    )
    slots = gathered.withColumn("__state", served).select(
        "s", F.posexplode("__state.order").alias("slot", "who")
    )
    slots = slots.select(
        F.col("s")[F.col("who")]["source_key"].alias("source_key"), F.col("s")[F.col("who")]["share"].alias("share"), "slot"
    )
    turn = (F.row_number().over(Window.partitionBy("source_key").orderBy("slot")) - 1).alias("turn")
    return slots.select("source_key", "share", turn, "slot").select(
        "source_key", "share", "turn",
        release(F.col("turn"), F.col("share")).cast("long").alias("release"),
        deadline(F.col("turn"), F.col("share")).cast("long").alias("deadline"),
        F.col("slot").cast("long").alias("slot"),
    )


def _serve(state: Column, slot: Column, release, deadline) -> Column:
    due = F.transform(
        F.zip_with("s", state["turns"], lambda x, t: F.struct(x["share"].alias("e"), t.alias("t"))),
        lambda x, i: F.when(
            (x["t"] < x["e"]) & (release(x["t"], x["e"]) <= slot),
            F.struct(deadline(x["t"], x["e"]).alias("d"), i.alias("i")),
        ),
    )
    # The weights fill every slot, so some block is always released.
    who = F.array_min(F.filter(due, lambda x: x.isNotNull()))["i"]
    return F.struct(
        F.transform(state["turns"], lambda t, i: F.when(i == who, t + 1).otherwise(t)).alias("turns"),
        F.concat(state["order"], F.array(who)).alias("order"),
    )


def split_paths(weights: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each weight the splits from its leaf up to the root of a Huffman tree.

    A split is (weight of the node, weight of the child on the path, 1 if that is the left one).
    """
    heap = [(w, i, [i]) for i, w in enumerate(weights)]
    paths: list[list[tuple[int, int, int]]] = [[] for _ in weights]
    heapq.heapify(heap)
    number = len(weights)
    while len(heap) > 1:
        (v, _, small), (w, _, large) = heapq.heappop(heap), heapq.heappop(heap)
        for i in small:
            paths[i].append((v + w, v, 0))
        for i in large:
            paths[i].append((v + w, w, 1))
        heapq.heappush(heap, (v + w, number, small + large))
        number += 1
    return paths


def slot_of(block: int, path: list[tuple[int, int, int]]) -> int:
    """Slot of a source's block, both from 0."""
    for node, child, left in path:
        block = (node * (2 * block + 1) - left) // (2 * child)
    return block


def blocks_before(slot: int, path: list[tuple[int, int, int]]) -> int:
    """Blocks of a source in the slots before ``slot``."""
    for node, child, left in reversed(path):
        slot = (2 * slot * child + node - 1 + left) // (2 * node)
    return slot


def phases(sizes: list[int], weights: list[float]) -> list[tuple[int, int, int, int, float, list[tuple[int, int, int]]]]:
    """(source, first block, end block, first slot, weight, path) of each source in each phase.

    A phase ends with the slot that uses up a source; the weights of a phase sum to 1.
    """
    left, used, start, out = list(sizes), [0] * len(sizes), 0, []
    while any(left):
        active = [i for i, n in enumerate(left) if n and weights[i] > 0]
        if not active:  # sources of weight 0 come after all others
            active = [i for i, n in enumerate(left) if n]
            weights = [1.0] * len(sizes)
        total = sum(weights[i] for i in active)
        # Products with block numbers stay below 2 ** 63.
        scale = min(1 << 40, (1 << 60) // (sum(left) + 1))
        whole = [max(1, round(weights[i] / total * scale)) for i in active]
        paths = split_paths(whole)
        length = min(slot_of(left[i] - 1, path) for i, path in zip(active, paths, strict=True)) + 1
        for i, path in zip(active, paths, strict=True):
            taken = blocks_before(length, path)
            if taken:
                out.append((i, used[i], used[i] + taken, start, weights[i] / total, path))
            used[i] += taken
            left[i] -= taken
        start += length
    return out


def mix_sources(
    documents: DataFrame,
    *,
    weights: Mapping[str | None, float] | None = None,
    temper: float = 0.5,
    block_rows: int = BLOCK_ROWS,
    period: int = PERIOD,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """All documents with their place in the mixed order, further columns kept.

    ``weights`` gives target weights by source; without it a source of n documents
    weighs n ** ``temper``, which lowers the share of very large sources. Documents of
    a source are put in the order of the MD5 of their id (then id, then the text's MD5 if there
    is a text column) and cut
    into blocks of ``block_rows``; the last block may be shorter. Added columns:
    ``mix_block`` (from 0 within the source), ``mix_release`` and ``mix_deadline`` (first
    slot and end of the block's turn by the exact weight), ``mix_slot`` (of the block) and
    ``in_mix``: whether all sources still take part, so that over these rows every source
    is at its target weight. A used-up source leaves and the others go on at their
    remaining weights, with ``in_mix`` false. The slots of a table run from 0 without gaps.

    A null source is a source of its own. Sources missing from given ``weights`` raise
    an error, as do negative or infinite weights and more than MAX_SOURCES sources or half
    of ``period``, which bounds the sources and nothing else. Sources of weight 0 come last.
    Repeated rows take places of their own; ties are only between equal rows. An
    empty table gives an empty result.
    """
    # Null and the text "null" stay apart.
    key = F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source)))
    digest = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    # The first two hex digits cut every source, hot or not, into 256 ranges of its order.
    ranges = documents.select(key.alias("source_key"), F.substring(digest, 1, 2).alias("range"))
    sizes = materialise(ranges.groupBy("source_key", "range").agg(F.count(F.lit(1)).alias("rows")))
    totals = sizes.groupBy("source_key").agg(F.sum("rows").alias("rows"))
    count = totals.count()
    if count > MAX_SOURCES or 2 * count > period:
        raise ValueError(f"{count} sources; at most {min(MAX_SOURCES, period // 2)} fit a period of {period}")
    if not count:
        nothing = {c: F.lit(None).cast("long") for c in ADDED[:4]} | {"in_mix": F.lit(False)}
        return documents.withColumns(nothing).where(F.lit(False))
    if weights is None:
        weighed = totals.select("source_key", F.pow(F.col("rows").cast("double"), F.lit(temper)).alias("weight"))
    else:
        given = documents.sparkSession.createDataFrame(
            [("-" if k is None else "+" + k, float(v)) for k, v in weights.items()], "source_key string, weight double"
        )
        weighed = totals.join(given, "source_key", "left").select(
            "source_key",
            F.coalesce("weight", F.raise_error(F.concat(F.lit("no weight for source "), F.col("source_key")))).alias("weight"),
        )
    # At most MAX_SOURCES rows.
    known = totals.select("source_key", F.ceil(F.col("rows") / block_rows).alias("blocks")).join(weighed, "source_key")
    known = sorted((r["source_key"], r["blocks"], r["weight"]) for r in known.collect())
    if not all(0 <= w < float("inf") for _, _, w in known):
        raise ValueError("weights must be finite and not negative")
    turns = phases([n for _, n, _ in known], [w for _, _, w in known])
    end = min((start for _, _, _, start, _, _ in turns if start), default=sum(n for _, n, _ in known))
    plan = documents.sparkSession.createDataFrame(
        [(known[i][0], *rest) for i, *rest in turns],
        "__key string, __first long, __stop long, __start long, __weight double, "
        "__path array<struct<node: long, child: long, left: long>>",
    )
    before = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("source_key", "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__offset"))
    full = documents.withColumns({"__key": key, "__digest": digest})
    full = full.withColumn("__range", F.substring("__digest", 1, 2))
    order = Window.partitionBy("__key", "__range").orderBy(
        "__digest", F.col(id_column), *([F.md5(F.col(text))] if text in documents.columns else [])
    )
    full = full.withColumn("__row", F.row_number().over(order) - 1)
    offsets = offsets.withColumnsRenamed({"source_key": "__key", "range": "__range"})
    place = F.floor((F.col("__row") + F.col("__offset")) / block_rows).cast("long")
    turn = F.col("__block") - F.col("__first")
    slot = F.aggregate(
        "__path", turn, lambda n, x: F.call_function("div", x["node"] * (2 * n + 1) - x["left"], 2 * x["child"])
    )
    placed = full.join(offsets, ["__key", "__range"]).withColumn("__block", place)
    placed = placed.join(
        F.broadcast(plan.withColumnRenamed("__key", "__of")),
        (F.col("__key") == F.col("__of")) & (F.col("__block") >= F.col("__first")) & (F.col("__block") < F.col("__stop")),
    )
    return placed.select(
        *[c for c in documents.columns if c not in ADDED],
        F.col("__block").alias("mix_block"),
        (F.col("__start") + F.floor(turn / F.col("__weight"))).cast("long").alias("mix_release"),
        (F.col("__start") + F.ceil((turn + 1) / F.col("__weight"))).cast("long").alias("mix_deadline"),
        (F.col("__start") + slot).alias("mix_slot"),
        (F.col("__start") + slot < end).alias("in_mix"),
    )


def documents_in_mix(documents: DataFrame, **options) -> DataFrame:
    """All documents in mixed order: the columns of the input and ``mix_slot``, sorted by it.

    A column of that name, or of one that ``mix_sources`` adds, is replaced or left out.
    """
    mixed = mix_sources(documents, **options)
    kept = [c for c in documents.columns if c in mixed.columns and c not in ADDED]
    return mixed.select(*kept, "mix_slot").orderBy("mix_slot")
