"""Balanced shards of linked documents by label propagation under quotas.

Documents with equal texts are one unit; units are linked by lines they share.
Starting from hashed shards, every round lets each line take the shard that most of
its units are in, and each unit ask for the shard that most of its lines are in.
Requests are granted by pair of shards: as many rows may go from i to j as come back,
plus what j has free. At the end the row counts are made exact: units keep their
shard while it has room, and the rest fills the places that are left.

Lines stand between documents, so a line in a million documents is a million rows of
an edge table and never pairs; running sums go over hash buckets, so no shard, unit
or line is one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

SHARDS, ROUNDS = 16, 4
LINE_BYTES = 40
UNIT_ROWS = 100_000
_BUCKETS = 256


def _places(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, name: str, tie: Sequence[str]) -> DataFrame:
    """Add ``name``: the sum of ``size`` over the rows before this one within ``keys``.

    Rows are ordered by ``order`` (columns of few values), then by a hash bucket of
    ``tie``, then by ``tie``. Buckets are summed first; only they are put in a row.
    """
    bucket = F.pmod(F.xxhash64(F.lit(5), *tie), F.lit(_BUCKETS)).cast("int")
    tagged = df.withColumn("__bucket", bucket)
    cells = [*keys, *order, "__bucket"]
    sums = tagged.groupBy(*cells).agg(F.sum(size).alias("__sum"))
    over = Window.partitionBy(*keys).orderBy(*order, "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(over), F.lit(0))).drop("__sum")
    inner = Window.partitionBy(*cells).orderBy(*tie).rowsBetween(Window.unboundedPreceding, -1)
    inside = tagged.withColumn("__inside", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    return inside.join(before, cells).withColumn(name, F.col("__before") + F.col("__inside")).drop(
        "__bucket", "__before", "__inside"
    )


def _node(id_column: str, text: str) -> Column:
    """Equal texts get equal nodes; a null text is a node by its id."""
    return F.when(F.col(text).isNull(), F.concat(F.lit("id:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))).otherwise(
        F.md5(F.col(text).cast("binary"))
    )


def line_links(documents: DataFrame, units: DataFrame, *, id_column: str, text: str, line_bytes: int) -> DataFrame:
    """(line, unit) for lines of at least ``line_bytes`` bytes that several units have."""
    lines = (
        documents.where(F.col(text).isNotNull())
        .select(_node(id_column, text).alias("node"), F.explode(F.split(text, "\n")).alias("line"))
        .where(F.octet_length("line") >= line_bytes)
        .select("node", F.xxhash64("line").alias("line"))
    )
    spread = lines.groupBy("line").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    shared = lines.join(spread.select("line"), "line", "left_semi").distinct()
    # Units of one large group of equal texts are linked by the text itself.
    own = units.where("pieces > 1").select(F.xxhash64(F.lit(6), "node").alias("line"), "unit")
    return shared.join(units.select("node", "unit"), "node").select("line", "unit").union(own)


def propagate(units: DataFrame, links: DataFrame, shards: int, rounds: int) -> DataFrame:
    """(unit, shard) after ``rounds`` rounds of requests and granted moves."""
    spark = units.sparkSession
    weighted = materialise(links.join(units.select("unit", "rows"), "unit"))
    labels = materialise(
        units.select("unit", "rows", F.pmod(F.xxhash64(F.lit(7), "unit"), F.lit(shards)).cast("int").alias("shard"))
    )
    total = labels.agg(F.sum("rows")).first()[0] or 0
    for r in range(rounds):
        at = weighted.join(labels.select("unit", "shard"), "unit")
        votes = at.groupBy("line", "shard").agg(F.sum("rows").alias("votes"))
        lead = votes.groupBy("line").agg(
            F.max(F.struct("votes", "shard")).alias("top"), F.sum("votes").alias("all")
        )
        asked = (
            weighted.join(lead, "line")
            .groupBy("unit", F.col("top.shard").alias("goal"))
            .agg(F.sum(F.col("top.votes") / F.col("all")).alias("pull"))
            .groupBy("unit")
            .agg(F.max(F.struct("pull", "goal")).alias("best"))
            .select("unit", F.col("best.goal").alias("goal"))
        )
        wish = materialise(labels.join(asked, "unit", "left").withColumn("goal", F.coalesce("goal", "shard")))
        # At most shards * shards rows come here.
        flow = {(x["shard"], x["goal"]): x["rows"] for x in wish.groupBy("shard", "goal").agg(F.sum("rows").alias("rows")).collect()}
        load = {s: sum(v for (i, _), v in flow.items() if i == s) for s in range(shards)}
        into = {s: sum(v for (i, j), v in flow.items() if j == s and i != s) for s in range(shards)}
        grant = []
        for (i, j), v in flow.items():
            if i != j:
                free = max(0.0, total / shards - load[j]) * v / max(into[j], 1)
                grant.append((i, j, min(1.0, (min(v, flow.get((j, i), 0)) + free) / v)))
        if not grant:
            break
        table = spark.createDataFrame(grant, "shard int, goal int, chance double")
        draw = F.pmod(F.xxhash64(F.lit(100 + r), "unit"), F.lit(1_000_000)) / 1e6
        moved = wish.join(F.broadcast(table), ["shard", "goal"], "left")  # shards * shards rows
        labels = materialise(
            moved.select("unit", "rows", F.when(draw < F.col("chance"), F.col("goal")).otherwise(F.col("shard")).alias("shard"))
        )
    return labels


def shard_rows(
    documents: DataFrame,
    *,
    shards: int = SHARDS,
    rounds: int = ROUNDS,
    line_bytes: int = LINE_BYTES,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(id, node, copy, size, text_crc32, shard, slot) of every document.

    Shards hold equally many rows, to within one; equal texts stay together unless
    there are more of them than a shard's share, or they meet the border of one.
    ``slot`` counts the rows of a shard from 0 without gaps. ``size`` is the UTF-8
    length of the text plus 1. A null text has no bytes and is grouped with nothing;
    an empty one is a text like others. Repeated rows are placed one by one (``copy``
    numbers equal (id, text) pairs from 0). An empty table gives an empty result.
    """
    rows = materialise(
        documents.select(
            id_column,
            _node(id_column, text).alias("node"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        )
    )
    total = rows.count()
    quota = -(-total // shards)
    largest = max(1, min(UNIT_ROWS, quota // 2))
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "pieces", F.ceil(F.col("rows") / largest).cast("int")
    )
    # Groups of equal texts beyond a shard's share are dealt into pieces by the hash of the id.
    piece = F.pmod(F.xxhash64(F.lit(8), id_column), F.col("pieces"))
    unit = F.when(F.col("pieces") > 1, F.concat_ws("/", "node", piece.cast("string"))).otherwise(F.col("node"))
    rows = materialise(rows.join(nodes.drop("rows"), "node").withColumn("unit", unit))
    units = materialise(rows.groupBy("node", "unit", "pieces").agg(F.count(F.lit(1)).alias("rows")))
    links = materialise(line_links(documents, units, id_column=id_column, text=text, line_bytes=line_bytes))
    labels = propagate(units, links, shards, rounds)

    # Larger units first, then linked ones, so that what has to move is single and unlinked.
    linked = links.select("unit").distinct().withColumn("linked", F.lit(True))
    rank = F.when(F.col("rows") > 1, 20 - F.least(F.lit(20), F.floor(F.log2("rows")))).when(F.col("linked"), 21).otherwise(22)
    ranked = labels.join(linked, "unit", "left").select("unit", "rows", "shard", rank.cast("int").alias("rank"))
    placed = materialise(_places(ranked, ["shard"], ["rank"], "rows", "place", ["unit"]))
    share = F.lit(total // shards) + F.when(F.col("shard") < total % shards, 1).otherwise(0)
    stays = F.col("place") + F.col("rows") <= share
    kept = placed.where(stays).select("unit", "shard")
    # A row per shard: where its free places begin when all shards' free places are counted through.
    used = {r["shard"]: r["rows"] for r in placed.where(stays).groupBy("shard").agg(F.sum("rows").alias("rows")).collect()}
    begin, holes = 0, []
    for s in range(shards):
        free = total // shards + (s < total % shards) - used.get(s, 0)
        if free:
            holes.append((s, begin, begin + free))
            begin += free
    over = placed.where(~stays).select("unit", "rows", "rank").withColumn("all", F.lit(0))
    over = _places(over, ["all"], ["rank"], "rows", "place", ["unit"]).select("unit", F.col("place").alias("from"))
    first = rows.join(kept, "unit").select(id_column, "node", "size", "text_crc32", "shard")
    inner = Window.partitionBy("unit").orderBy(id_column)
    second = rows.join(over, "unit").withColumn("at", F.col("from") + F.row_number().over(inner) - 1)
    target = F.lit(None).cast("int")
    for s, lo, hi in holes:
        target = F.when((F.col("at") >= lo) & (F.col("at") < hi), s).otherwise(target)
    second = second.select(id_column, "node", "size", "text_crc32", target.alias("shard"))
    both = materialise(first.unionByName(second).withColumn("one", F.lit(1)))
    slots = _places(both, ["shard"], [], "one", "slot", [id_column, "node"])
    copy = F.row_number().over(Window.partitionBy("node", id_column).orderBy("slot")) - 1
    return slots.select(
        id_column, "node", copy.cast("long").alias("copy"), "size", "text_crc32",
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
    )


def shard_documents(documents: DataFrame, *, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with all their columns, and ``shard`` and ``slot`` (see ``shard_rows``)."""
    placed = materialise(shard_rows(documents, id_column=id_column, text=text, **options)).select(
        F.col("node").alias("__node"), F.col(id_column).alias("__id"), F.col("copy").alias("__copy"),
        F.col("shard").alias("__shard"), F.col("slot").alias("__slot"),
    )
    tagged = documents.withColumn("__n", _node(id_column, text))
    tagged = tagged.withColumn("__c", F.row_number().over(Window.partitionBy("__n", id_column).orderBy(F.lit(0))) - 1)
    joined = tagged.join(
        placed,
        (F.col("__n") == F.col("__node")) & F.col(id_column).eqNullSafe(F.col("__id")) & (F.col("__c") == F.col("__copy")),
    )
    kept = [c for c in documents.columns if c not in ("shard", "slot")]
    return joined.select(*kept, F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
