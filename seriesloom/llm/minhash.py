"""MinHash near-duplicates with DartMinHash signatures.

A text is the weighted set of its word shingles, a shingle weighing as often as it
occurs. Darts are thrown, by hashing, at the half-plane of weight and rank above
each shingle; those that land below the shingle's weight count, each belongs to one
coordinate of the signature, and each coordinate keeps its dart of lowest rank. Two
texts agree in a coordinate with probability equal to their weighted Jaccard
similarity. Only as many darts are looked at as the signature needs, about
``k * ln k`` for any text, so the cost is that of reading the shingles.

Texts with equal word sequences are one node. Nodes that agree in all coordinates
of a band meet in a bucket; in each bucket the node with most company leads, and
members are compared with leaders, not with each other, by exact similarity. Where a
bucket's members still lie in different components, they are compared with further
leaders that share a rare shingle with them (prefix and position filter of set joins),
which loses no link and keeps texts apart that only have common passages in common.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .graph import connected_components
from .text import mix, ragged, sequence_hashes, signed, salted, window_hashes, word_slices

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_SIZE = 24, 5
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])
_UNIT = 2.0**-53


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * _UNIT


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The dart kept by each of ``k`` coordinates (zeros for an empty set).

    The plane above an element is cut into unit cells; the number of darts in a cell
    is Poisson with mean 1 and, like every dart's place and coordinate, a function of
    element and cell alone, so equal parts of two sets see equal darts.
    """
    out = np.zeros(k, dtype=np.uint64)
    if not len(elements):
        return out
    high = np.ceil(weights).astype(np.int64)
    cells = np.repeat(elements, high)
    limit = np.repeat(weights, high)
    floor = np.arange(len(cells)) - np.repeat(np.cumsum(high) - high, high)
    cells = salted(cells, 1) ^ salted(floor, 2)
    needed = k * (math.log(k) + 4)
    done, top = 0, max(1, math.ceil(needed / weights.sum()))
    cut = needed / weights.sum()
    filled = np.zeros(k, dtype=bool)
    while not filled.all():
        ranks = np.arange(done, top)
        grid = mix(np.repeat(cells, len(ranks)) ^ np.tile(salted(ranks, 3), len(cells)))
        number = np.searchsorted(_POISSON, _uniform(mix(grid)), side="right")
        dart = np.repeat(grid, number)
        dart = mix(dart + (np.arange(len(dart)) - np.repeat(np.cumsum(number) - number, number)).astype(np.uint64))
        weight = np.repeat(np.repeat(floor, len(ranks)), number) + _uniform(salted(dart, 4))
        rank = np.repeat(np.tile(ranks, len(cells)), number) + _uniform(salted(dart, 5))
        under = weight < np.repeat(np.repeat(limit, len(ranks)), number)
        if cut < 1 and done == 0:  # long texts: the lowest part of the first row usually suffices
            low = under & (rank < cut)
            if len(np.unique(dart[low] % np.uint64(k))) == k:
                under = low
        dart, rank = dart[under], rank[under]
        order = np.argsort(rank, kind="stable")
        dart = dart[order]
        where, first = np.unique((dart % np.uint64(k)).astype(np.int64), return_index=True)
        new = ~filled[where]
        out[where[new]] = dart[first[new]]
        filled[where] = True
        done, top = top, 2 * top
    return out


def _weighted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, counts = np.unique(hashes, return_counts=True)
    return values, counts.astype(np.float64)


def _shingles(words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts of a slice, and where each text's begin; a text of
    fewer than ``k`` words, but not none, is one shingle."""
    counts = words.counts
    room = np.maximum(counts - k + 1, 0)
    at = words.starts_of_windows(k)
    long = window_hashes(words.hashes(), k)[at] if len(at) else np.zeros(0, dtype=np.uint64)
    short = (counts > 0) & (counts < k)
    size = np.where(short, 1, room)
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(ends[-1], dtype=np.uint64)
    whole = sequence_hashes(words)[0]
    is_short = np.repeat(short, size)
    out[~is_short] = long
    out[is_short] = salted(whole[short], 6)
    return out, ends


def signatures(documents: DataFrame, *, text: str, id_column: str, bands: int, rows: int, k: int) -> DataFrame:
    """(id, node, check, n_shingles, buckets) of every text.

    ``node`` hashes the word sequence (of texts without words: the text itself; of a
    null text it is null), ``check`` is a second, independent hash of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            missing = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            nodes, checks, sizes, sig = [], [], [], []
            for w in word_slices(batch.column(1)):
                one, two = _identity(w)
                shingles, ends = _shingles(w, k)
                for i in range(len(w.counts)):
                    own = shingles[ends[i] : ends[i + 1]]
                    if len(own):
                        coordinates = dart_signature(*_weighted(own), bands * rows).reshape(bands, rows)
                        h = salted(np.arange(bands), 7)
                        for c in range(rows):
                            h = mix(h + coordinates[:, c])
                        sig.append(h)
                    else:
                        sig.append(np.zeros(0, dtype=np.uint64))
                nodes.append(one)
                checks.append(two)
                sizes.append(np.diff(ends))
            if not nodes:
                continue
            at = np.concatenate(([0], np.cumsum([len(s) for s in sig])))
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(signed(np.concatenate(nodes)), mask=missing),
                    pa.array(signed(np.concatenate(checks)), mask=missing),
                    pa.array(np.concatenate(sizes), pa.int64()),
                    ragged(signed(np.concatenate(sig)), at, pa.int64()),
                ],
                names=[id_column, "node", "check", "n_shingles", "buckets"],
            )

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, text).mapInArrow(
        run, f"{id_column} {kind}, node long, check long, n_shingles long, buckets array<bigint>"
    )


def _identity(words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes per text: of its word sequence, or of its bytes where it has no word."""
    one, two = sequence_hashes(words)
    bare = np.flatnonzero(words.counts == 0)
    if len(bare):
        raw = words.span_hashes(words.at[bare], words.at[bare + 1] - 1)
        one[bare], two[bare] = salted(raw, 8), salted(raw, 9)
    return one, two


def with_node(documents: DataFrame, *, text: str) -> DataFrame:
    """The documents with ``__node``, the hash of their word sequence."""
    columns = documents.columns
    place = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            missing = batch.column(place).is_null().to_numpy(zero_copy_only=False)
            nodes = [_identity(w)[0] for w in word_slices(batch.column(place))]
            if nodes:
                yield pa.record_batch(
                    [*batch.columns, pa.array(signed(np.concatenate(nodes)), mask=missing)],
                    names=[*columns, "__node"],
                )

    schema = T.StructType([*documents.schema.fields, T.StructField("__node", T.LongType())])
    return documents.mapInArrow(run, schema)


def _shingle_sets(documents: DataFrame, *, text: str, k: int) -> DataFrame:
    """(node, shingles): hashes of (shingle, how-manieth occurrence), so that sizes of plain
    intersections are sums of minimum weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in word_slices(batch.column(0)):
                shingles, ends = _shingles(w, k)
                for i in range(len(w.counts)):
                    own = np.sort(shingles[ends[i] : ends[i + 1]])
                    fresh = np.concatenate(([True], own[1:] != own[:-1]))[: len(own)]
                    begin = np.flatnonzero(fresh)
                    nth = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
                    shingles[ends[i] : ends[i + 1]] = own ^ salted(nth, 10)
                yield pa.record_batch(
                    [pa.array(signed(_identity(w)[0])), ragged(signed(shingles), ends, pa.int64())],
                    names=["node", "shingles"],
                )

    return documents.select(text).mapInArrow(run, "node long, shingles array<bigint>")


def _compare(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose weighted Jaccard similarity reaches the limit."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("__both", both)
        .where(F.col("__both") >= F.lit(similarity) * (F.size("sa") + F.size("sb") - F.col("__both")))
        .select("a", "b")
    )


def _merge(parts: DataFrame, found: DataFrame) -> DataFrame:
    """The components ``parts`` (node, part) after the links ``found``, of which only those
    between different components matter."""
    joined = (
        found.join(parts.select(F.col("node").alias("a"), F.col("part").alias("u")), "a")
        .join(parts.select(F.col("node").alias("b"), F.col("part").alias("v")), "b")
        .select("u", "v")
    )
    merged = connected_components(joined, "u", "v").withColumnRenamed("node", "part")
    return materialise(parts.join(merged, "part", "left").select("node", F.coalesce("component", "part").alias("part")))


def _rare_shingles(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(bucket, node, n_shingles, degree, pos, early): the rarest shingles of each node.

    With shingles in order of rarity, two sets of similarity t have a common one among
    the first n - ceil(t * n) + 1 of each, and in the smaller set (``early``) even among
    the first n - ceil(2 * t / (1 + t) * n) + 1. A shingle of a single node starts no pair.
    """
    tokens = nodes.join(sets, "node").select("node", F.explode("shingles").alias("bucket"))
    often = tokens.groupBy("bucket").agg(F.count(F.lit(1)).alias("often"))
    n = F.col("n_shingles")
    first = n - F.ceil(F.lit(similarity) * n - 1e-9) + 1
    early = n - F.ceil(F.lit(2 * similarity / (1 + similarity)) * n - 1e-9) + 1
    # The list of a node is as long as its text.
    ordered = tokens.join(often, "bucket").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "bucket"))).alias("s"))
    return (
        ordered.join(nodes, "node")
        .select("node", "n_shingles", "degree", early.alias("__early"), F.posexplode(F.slice("s", F.lit(1), first.cast("int"))).alias("pos", "t"))
        .where("t.often > 1")
        .select(F.col("t.bucket").alias("bucket"), "node", "n_shingles", "degree", "pos", (F.col("pos") < F.col("__early")).alias("early"))
    )


def near_duplicates(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = BAND_SIZE,
) -> DataFrame:
    """One row per document: id, ``node``, ``class_id``, ``n_links``.

    ``class_id`` is the smallest id among the documents that are linked, directly or
    over others, by equal word sequences or a similarity of at least ``similarity``;
    ``n_links`` counts the links to different texts that were needed to join its class. Words
    are those of ``text.ALNUM``. Texts without a word are equal only to equal texts.
    A null text is alone and its own class; a null id never names a class unless the
    class has no other. Ties and repeated rows share their class, each row is
    returned, further columns are ignored, an empty table gives an empty result.

    Texts of similarity s share a bucket with probability 1 - (1 - s**rows)**bands,
    0.9999 at s = 0.8 with the defaults.
    """
    spark = documents.sparkSession
    signed_ = materialise(
        signatures(documents, text=text, id_column=id_column, bands=bands, rows=rows, k=shingle)
    )
    texts = materialise(
        signed_.where(F.col("node").isNotNull())
        .groupBy("node", "check")
        .agg(F.min(id_column).alias("first_id"), F.min("n_shingles").alias("n_shingles"), F.min("buckets").alias("buckets"))
    )
    entries = texts.select("node", "n_shingles", F.explode("buckets").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("company")).where("company > 1")
    members = materialise(entries.join(shared, "bucket"))
    company = members.groupBy("node").agg(F.sum("company").alias("degree"))
    members = materialise(members.join(company, "node").drop("company"))
    # Only texts that share a bucket with another one are read again.
    ids = members.select("node").distinct().join(texts.select("node", "first_id"), "node").select("first_id").distinct()
    chosen = documents.select(id_column, text).where(F.col(text).isNotNull())
    chosen = chosen.join(ids, chosen[id_column].eqNullSafe(ids["first_id"]), "left_semi")
    sets = materialise(_shingle_sets(chosen, text=text, k=shingle).dropDuplicates(["node"]))

    # Round one: every bucket has one leader, the node with most company.
    leaders = members.groupBy("bucket").agg(F.max(F.struct("degree", "node", "n_shingles")).alias("l"))
    leaders = leaders.select("bucket", F.col("l.node").alias("b"), F.col("l.n_shingles").alias("nb"))
    small, large = F.least("n_shingles", "nb"), F.greatest("n_shingles", "nb")
    pairs = (
        members.join(leaders, "bucket")
        .where((F.col("node") != F.col("b")) & (small >= F.lit(similarity) * large))
        .select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
        .distinct()
    )
    links = materialise(_compare(pairs, sets, similarity))
    # ``part`` is the component a node belongs to so far, at first the node itself.
    parts = _merge(texts.select("node", F.col("node").alias("part")), links)
    # A bucket is open while its nodes lie in different components. Members of open buckets are
    # compared by their rarest shingles, which misses no link.
    members = members.join(parts, "node")
    open_ = members.groupBy("bucket").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y")
    unsettled = materialise(
        members.join(open_.select("bucket"), "bucket", "left_semi").select("node", "n_shingles", "degree").distinct()
    )
    entries = materialise(_rare_shingles(unsettled, sets, similarity))
    count = 16  # leaders per shingle in a round; they grow, so few rounds settle any group
    while True:
        entries = entries.join(parts, "node")
        # Only a shingle that comes early in the shorter of two sets can be their first common one.
        open_ = (
            entries.groupBy("bucket")
            .agg(F.min("part").alias("x"), F.max("part").alias("y"), F.max("early").alias("any"))
            .where("x < y and any")
        )
        entries = materialise(entries.join(open_.select("bucket"), "bucket"))
        if entries.isEmpty():
            break
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("degree"), "node"))
        leaders = materialise(
            entries.where("early").withColumn("__place", place).where(F.col("__place") <= count).select(
                "bucket", F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("pos").alias("pb"),
                F.col("part").alias("part_b"),
            )
        )
        needed = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n_shingles") + F.col("nb")) - 1e-9)
        pairs = (
            entries.join(leaders, "bucket")
            .where(
                (F.col("part") != F.col("part_b")) & (F.col("n_shingles") >= F.col("nb"))
                & (F.col("nb") >= F.lit(similarity) * F.col("n_shingles"))
                & (F.col("n_shingles") - F.col("pos") >= needed) & (F.col("nb") - F.col("pb") >= needed)
            )
            .select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
            .distinct()
        )
        found = materialise(_compare(pairs, sets, similarity))
        links = links.union(found)
        parts = _merge(parts, found)
        led = leaders.select("bucket", F.col("b").alias("node"), F.lit(True).alias("__led"))
        entries = entries.drop("part").join(led, ["bucket", "node"], "left")
        entries = entries.withColumn("early", F.col("early") & F.col("__led").isNull()).drop("__led")
        count *= 16
    links = links.distinct()
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("node")).agg(
        F.count(F.lit(1)).alias("n_links")
    )
    named = (
        texts.join(parts, "node")
        .join(degree, "node", "left")
        .select("node", "check", "first_id", F.col("part").alias("component"),
                F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    )
    classes = named.groupBy("component").agg(F.min("first_id").alias("class_id"))
    named = materialise(named.join(classes, "component").select("node", "check", "class_id", "n_links"))
    return (
        signed_.select(id_column, "node", "check")
        .join(named, ["node", "check"], "left")
        .select(
            id_column,
            "node",
            F.when(F.col("node").isNull(), F.col(id_column)).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        )
    )


def keep_first_of_class(documents: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates: of each class the row that names it.

    Rows with a null text are all kept. Columns are those of the input.
    """
    classes = near_duplicates(documents, id_column=id_column, text=text)
    named = classes.where(F.col("node").isNotNull() & F.col("class_id").eqNullSafe(F.col(id_column)))
    times = named.groupBy("node", id_column).agg(F.count(F.lit(1)).alias("__times"))
    times = times.withColumnRenamed(id_column, "__id").withColumnRenamed("node", "__n")
    tagged = with_node(documents, text=text)
    kept = tagged.join(times, (F.col("__node") == F.col("__n")) & F.col(id_column).eqNullSafe(F.col("__id")))
    once = kept.where("__times = 1").select(*documents.columns)
    # The same id and text several times: one of the rows, whichever, as they only may differ elsewhere.
    rest = kept.where("__times > 1").dropDuplicates(["__node", "__id"]).select(*documents.columns)
    empty = documents.where(F.col(text).isNull())
    return once.unionByName(rest).unionByName(empty)
