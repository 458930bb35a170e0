"""Merkle manifests that store only every few levels and work out the rest when asked.

The digests of a group stand in a row, and every ``FANOUT`` consecutive ones become one
node of the level above. Stored are only the levels 0, STRIDE, 2 * STRIDE, …, as blocks:
a block holds the FANOUT**STRIDE nodes below one node of the next stored level, an
aligned subtree. The levels between two stored ones are regenerated from a block inside
its row, once to build the next level and once to emit the siblings of its nodes, and
are not kept. Proofs go from the top down: the path of a node is the part inside its
block and then the path of the block's own node.

A block is a row of bounded size, so neither a hot group nor a large one is gathered
anywhere; leaves are shuffled twice (sorted, packed into blocks), texts never.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .ordinals import with_ordinals

FANOUT, STRIDE = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts joined without a separator."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of a record: each field as byte count, colon and value, or ``-`` if null."""

    def framed(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(*[framed(f) for f in fields])


@dataclass
class Manifest:
    """Stored levels of the trees of all groups, lowest first, and each group's ``root``.

    A level has rows (group, block, n, nodes): ``n`` is the number of nodes that the group
    has on this level, ``nodes`` the block's (at, digest, payload) in order.
    """

    group: str
    stride: int
    levels: list[DataFrame]
    roots: DataFrame


def _blocks(nodes: DataFrame, group: str, size: int) -> DataFrame:
    """Rows (group, at, n, digest, payload) packed by aligned blocks of ``size``."""
    block = F.floor(F.col("at") / size).cast("long").alias("block")
    return nodes.groupBy(F.col(group), block, "n").agg(
        F.sort_array(F.collect_list(F.struct("at", "digest", "payload"))).alias("nodes")
    )


def _parents(level: Column) -> Column:
    """The nodes over a run of nodes that starts at a multiple of ``FANOUT``."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda run: F.sha2(F.array_join(F.slice(level, run * FANOUT + 1, FANOUT), ""), 256))


def _regenerated(blocks: DataFrame, stride: int) -> DataFrame:
    """The blocks with the digests of their levels: ``__level0`` (stored) to ``__level<stride>``.

    A level of which the group has only one node is the last; it is carried on as it is.
    """
    out = blocks.withColumns({"__level0": F.col("nodes.digest"), "__n0": F.col("n")})
    for step in range(stride):
        below, count = F.col(f"__level{step}"), F.col(f"__n{step}")
        out = out.withColumns(
            {
                f"__level{step + 1}": F.when(count > 1, _parents(below)).otherwise(below),
                f"__n{step + 1}": F.ceil(count / FANOUT).cast("long"),
            }
        )
    return out


def build_manifest(leaves: DataFrame, group: str, order: Sequence[str], stride: int = STRIDE) -> Manifest:
    """Stored levels and roots of one tree for each group.

    ``leaves`` has the group, the columns of ``order``, ``digest`` and ``payload`` (any type
    that can be ordered). Null groups are a group; equal rows are leaves of their own.
    """
    size = FANOUT**stride
    level = materialise(_blocks(with_ordinals(leaves, group, order), group, size))
    levels = [level]
    most = level.agg(F.max("n")).first()[0] or 0
    while most > size:
        top = _regenerated(level, stride)
        nodes = top.select(
            group, F.col("block").alias("at"), F.col(f"__n{stride}").alias("n"),
            F.col(f"__level{stride}")[0].alias("digest"), F.lit(None).cast("int").alias("payload"),
        )
        level = materialise(_blocks(nodes, group, size))
        levels.append(level)
        most = -(-most // size)
    roots = _regenerated(level, stride).select(group, F.col(f"__level{stride}")[0].alias("root"))
    return Manifest(group, stride, levels, materialise(roots))


def _step(step: int, place: Column) -> Column:
    """Siblings left and right of the node over ``place`` in a regenerated level of its block.

    An array of one (left, right), or an empty one on the level of the root.
    """
    level, at = F.col(f"__level{step}"), F.floor(place / FANOUT**step).cast("int")
    before = at % FANOUT
    left = F.array_join(F.slice(level, at - before + 1, before), "")
    right = F.array_join(F.slice(level, at + 2, FANOUT - 1 - before), "")
    siblings = F.array(F.struct(left.alias("left"), right.alias("right")))
    return F.when(F.col(f"__n{step}") > 1, siblings).otherwise(F.array().cast("array<struct<left:string,right:string>>"))


def _descend(blocks: DataFrame, upper: DataFrame, manifest: Manifest, top: bool) -> DataFrame:
    """Rows (group, at, digest, payload, path) of a level, given the paths of the level above it.

    ``upper`` has (__group, __at, __path); the top level has one block per group.
    """
    same = F.col(manifest.group).eqNullSafe(F.col("__group"))
    joined = blocks.join(upper, same if top else same & (F.col("block") == F.col("__at")))
    grown = _regenerated(joined, manifest.stride)
    paths = F.transform(
        "nodes",
        lambda node, place: F.struct(
            node["at"].alias("at"), node["digest"].alias("digest"), node["payload"].alias("payload"),
            F.concat(*[_step(s, place) for s in range(manifest.stride)], F.col("__path")).alias("path"),
        ),
    )
    return grown.select(manifest.group, F.explode(paths).alias("__e")).select(manifest.group, "__e.*")


def extract_proofs(manifest: Manifest, above: DataFrame) -> DataFrame:
    """Rows (group, at, digest, payload, path): the siblings of every leaf, level by level.

    ``path`` is an array of (left, right), digests joined without a separator, from the
    leaf's own level up. ``above`` has (group, path): what follows after the group's root.
    """
    path = above.select(
        F.col(manifest.group).alias("__group"), F.lit(0).cast("long").alias("__at"), F.col("path").alias("__path")
    )
    found = None
    for i, blocks in enumerate(reversed(manifest.levels)):
        found = _descend(blocks, path, manifest, top=i == 0)
        path = found.select(
            F.col(manifest.group).alias("__group"), F.col("at").alias("__at"), F.col("path").alias("__path")
        )
    return found


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a digest and its siblings."""
    return F.aggregate(path, start, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def path_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest_with_audit(documents: DataFrame, tampered: Column | None = None, stride: int = STRIDE) -> DataFrame:
    """doc_id, leaf, subroot, root, path, audited (leaf of the audited copy), one row per document.

    A tree per language, its leaves by ``doc_id``, and a tree over the languages' roots.
    ``tampered`` gives the text of the audited copy (null: the text as it is).

    Nulls: a null field is written ``-``, so it differs from an empty text; null languages
    are one group, first in order; null ids come first in their group. Repeated ids stand in
    the order of their digests, repeated rows are leaves of their own. Texts are read whole,
    further columns are ignored. An empty table gives an empty result.
    """
    text = F.col("text")
    other = F.lit(None).cast("string") if tampered is None else tampered
    plain = [F.col(c) for c in FIELDS[:-1]]
    leaves = documents.select(
        F.col("lang").alias("tree"), "doc_id", leaf_digest(*plain, text).alias("digest"),
        F.when(other.isNotNull(), leaf_digest(*plain, other)).alias("payload"),
    )
    named = F.struct("doc_id", F.col("payload").alias("audited")).alias("payload")
    # Stored first: sorting into ranges reads its input twice, and texts are to be hashed once.
    manifest = build_manifest(
        materialise(leaves).select("tree", "doc_id", "digest", named), "tree", ["doc_id", "digest"], stride
    )
    subroots = manifest.roots.select(
        F.lit(0).alias("all"), "tree", F.col("root").alias("digest"), F.col("tree").alias("payload")
    )
    upper = build_manifest(subroots, "all", ["tree"], stride)
    none = F.array().cast("array<struct<left:string,right:string>>")
    to_root = extract_proofs(upper, upper.roots.select("all", none.alias("path")))
    trees = materialise(
        to_root.join(upper.roots, "all").select(F.col("payload").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    )
    proofs = extract_proofs(manifest, trees.select("tree", "path"))
    roots = trees.select(F.col("tree").alias("__tree"), "subroot", "root")
    return proofs.join(roots, F.col("tree").eqNullSafe(F.col("__tree"))).select(
        F.col("payload.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "path",
        F.coalesce("payload.audited", "digest").alias("audited"),
    )
