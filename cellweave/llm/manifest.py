"""Merkle manifest of a dataset in van Emde Boas layout (operator 12)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import in_order
from cellweave.session import cut_lineage

HEIGHT = 10  # levels of a block below its root: 1024 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ALONE, LEFT, RIGHT = 0, 1, 2  # where the sibling of a node stands; a step of a path is one of these and 32 bytes


@lru_cache
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """Address of every node of a perfect binary tree of ``levels`` levels, by depth from the root.

    The tree is split at half height: the upper part comes first, then the lower trees from left to right, each laid
    out the same way. A path from leaf to root so crosses few stretches of memory, whatever the size of a cache line.
    """
    if levels == 1:
        return (np.zeros(1, np.int64),)
    top, low = levels // 2, levels - levels // 2
    start = ((1 << top) - 1) + np.arange(1 << top) * ((1 << low) - 1)
    return (*addresses(top), *[(start[:, None] + at).ravel() for at in addresses(low)])


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def build_block(leaves: list[str]) -> bytes:
    """The tree over up to 2^HEIGHT leaves, 32 bytes a node at its address; missing nodes are zero.

    A node without a sibling is hashed alone. The root is at address 0.
    """
    height = max(len(leaves) - 1, 0).bit_length()
    at = addresses(height + 1)
    tree, level = bytearray(32 * ((2 << height) - 1)), leaves
    for depth in range(height, -1, -1):
        for a, node in zip(at[depth].tolist(), level):
            tree[32 * a : 32 * a + 32] = bytes.fromhex(node)
        level = [digest("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return bytes(tree)


def block_paths(tree: bytes, n: int) -> list[bytes]:
    """The siblings of each of the ``n`` leaves from the leaf level up to below the root of the block."""
    height = max(n - 1, 0).bit_length()
    levels = [at.tolist() for at in addresses(height + 1)]
    paths = []
    for i in range(n):
        steps, left, node = [], n, i
        for depth in range(height, 0, -1):
            other = node ^ 1
            if other >= left:
                steps.append(bytes(33))
            else:
                a = 32 * levels[depth][other]
                steps.append(bytes([LEFT if other < node else RIGHT]) + tree[a : a + 32])
            node, left = node >> 1, left + 1 >> 1
        paths.append(b"".join(steps))
    return paths


def _steps(path: bytes) -> list[tuple[int, str]]:
    return [(path[i], path[i + 1 : i + 33].hex()) for i in range(0, len(path), 33)]


def fold(leaf: str, steps: list[tuple[int, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for side, other in steps:
        leaf = sha256((leaf if side == ALONE else other + leaf if side == LEFT else leaf + other).encode()).hexdigest()
    return leaf


@dataclass
class Manifest:
    """Written tables of blocks: (key, block, n, tree, root), leaf blocks also with the ids and digests seen at their leaves."""

    leaves: DataFrame
    layers: list[DataFrame]  # over the block roots of each group, until one block a group is left
    groups: DataFrame  # (key, rank, digest): the root of each group in order
    tops: list[DataFrame]  # over the roots of the groups
    root: str | None  # of everything; none for an empty table


def _encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """sha256 over the fields, each ``-`` for null, otherwise byte count, colon and value; as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[_encoded(c) for c in fields]).cast("binary"), 256))


def _lone(n: int, block: int) -> int:
    """Levels between the root of a block's own tree and its full height; the first block of a group ends at its own root.

    A later block stands for a whole subtree, so its root is hashed alone up to full height.
    """
    return HEIGHT - max(n - 1, 0).bit_length() if block else 0


def _blocks(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """One row per 2^HEIGHT nodes (key, rank, digest) that follow each other: (key, block, n, tree, root).

    Columns ``carried`` become arrays in the order of the nodes.
    """
    names = ["key", "block", "n", "tree", "root", *carried]

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows, number = rows.sort_by("rank"), key[1].as_py()
        leaves = [d.hex() for d in rows.column("digest").to_pylist()]
        tree = build_block(leaves)
        root = fold(tree[:32].hex(), [(ALONE, "")] * _lone(len(leaves), number))
        lists = [pa.array([rows.column(c).to_pylist()], pa.list_(rows.schema.field(c).type)) for c in carried]
        return pa.Table.from_arrays([pa.array([key[0].as_py()]), *[pa.array([v], pa.int64()) for v in (number, len(leaves))], pa.array([tree]), pa.array([bytes.fromhex(root)]), *lists], names)

    schema = "key string, block long, n long, tree binary, root binary" + "".join(f", `{c}` array<{nodes.schema[c].dataType.simpleString()}>" for c in carried)
    return cut_lineage(nodes.withColumn("block", F.expr(f"shiftright(rank, {HEIGHT})")).groupBy("key", "block").applyInArrow(build, schema))


def _layers(nodes: DataFrame, carried: Sequence[str] = ()) -> list[DataFrame]:
    """Blocks over the nodes, blocks over their roots and so on, until every key has one block."""
    layers = [_blocks(nodes, carried)]
    while not layers[-1].filter("block > 0").isEmpty():
        layers.append(_blocks(_roots(layers[-1])))
    return layers


def _roots(blocks: DataFrame) -> DataFrame:
    return blocks.select("key", F.col("block").alias("rank"), F.col("root").alias("digest"))


def build(docs: DataFrame, fields: Sequence[str] = FIELDS, seen: dict[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "lang") -> Manifest:
    """The manifest of ``docs``: a leaf for each row, a tree for each group, a tree over the groups.

    Leaves of a group ascend by id (null first), then by digest; repeated rows are leaves of their own. Groups are
    ordered by name, null first; a null group is one. ``seen`` replaces fields by what is found at a later time; the
    digests of such rows are kept beside the leaves for :func:`audit`. Null and empty texts and nulls in any field have
    digests like others. An empty table has no root. Columns that are not named are not read.

    Rows are hashed where they are read; ranks come from :func:`in_order`, so a group of any share spreads over tasks.
    2^HEIGHT neighbouring leaves make a block in one task, its nodes in van Emde Boas order, and the roots of the
    blocks are the leaves of the next layer, which is 2^HEIGHT times smaller.
    """
    own = [F.col(c) for c in fields]
    later = leaf_digest([(seen or {}).get(c, F.col(c)) for c in fields]) if seen else F.lit(None).cast("binary")
    name = F.col(group_col).cast("string")
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("id"), F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name)).alias("key"),
        leaf_digest(own).alias("digest"), later.alias("seen"), F.monotonically_increasing_id().alias("row")))
    ranked = in_order(rows, "key", ["id", "digest", "row"])
    layers = _layers(ranked.select("key", "rank", "digest", "id", F.when(F.col("seen") != F.col("digest"), F.col("seen")).alias("seen")), ["id", "seen"])
    subroots = cut_lineage(_roots(layers[-1]).select("key", "digest"))
    groups = cut_lineage(in_order(subroots.withColumn("all", F.lit("")), "all", ["key"]).select("key", "rank", "digest"))
    tops = _layers(groups.select(F.lit("").alias("key"), "rank", "digest"))
    root = _roots(tops[-1]).first()
    return Manifest(layers[0], layers[1:], groups, tops, bytes(root["digest"]).hex() if root else None)


def _descend(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Paths (key, block, path, subroot) of the nodes below, from the paths of the blocks of one layer."""

    def walk(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _below(left, right)
        return pa.table({"key": pa.array([key[0].as_py()] * len(rows)), "block": pa.array([r[0] for r in rows], pa.int64()), "path": pa.array([r[1] for r in rows], pa.binary()), "subroot": pa.array([r[2] for r in rows], pa.binary())})

    return blocks.groupBy("key", "block").cogroup(above.groupBy("key", "block")).applyInArrow(walk, "key string, block long, path binary, subroot binary")


def _below(block: pa.Table, above: pa.Table) -> list[tuple[int, bytes, bytes | None]]:
    """(rank, whole path, subroot) of each leaf of one block; lone nodes above its tree are steps without a sibling."""
    number, n, tree = (column_value(block, c) for c in ("block", "n", "tree"))
    upper = bytes(33 * _lone(n, number)) + column_value(above, "path")
    return [((number << HEIGHT) + i, path + upper, column_value(above, "subroot")) for i, path in enumerate(block_paths(tree, n))]


def column_value(rows: pa.Table, name: str):
    return rows.column(name)[0].as_py()


def audit(manifest: Manifest, id_col: str = "doc_id") -> DataFrame:
    """One row per leaf: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    The siblings of a leaf are read from its block by address, then come those of the block's root in the layers
    above, down to each leaf block by one join a layer. Folding what was seen at a leaf (the leaf itself if nothing
    else was) with them must give the root.
    """
    root, kind = manifest.root, manifest.leaves.schema["id"].dataType.elementType.simpleString()
    paths = manifest.tops[-1].select("key", "block", F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"))
    for layer in reversed(manifest.tops):
        paths = cut_lineage(_descend(layer, paths))
    named = manifest.groups.withColumnRenamed("digest", "sub").join(paths.select(F.col("block").alias("rank"), "path"), "rank")
    paths = named.select("key", F.lit(0).cast("long").alias("block"), "path", F.col("sub").alias("subroot"))
    for layer in reversed(manifest.layers):
        paths = cut_lineage(_descend(layer, paths))
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        n, tree = column_value(left, "n"), column_value(left, "tree")
        at = addresses(max(n - 1, 0).bit_length() + 1)[-1].tolist()
        ids, out = left.column("id").combine_chunks().flatten(), []
        for i, ((_, path, sub), seen) in enumerate(zip(_below(left, right), column_value(left, "seen"))):
            leaf, steps = tree[32 * at[i] : 32 * at[i] + 32].hex(), _steps(path)
            folded = fold(seen.hex() if seen is not None else leaf, steps)
            out.append((leaf, sub.hex(), root, digest("".join(other for side, other in steps if side != ALONE)), folded, folded == root))
        return pa.Table.from_arrays([ids, *[pa.array(c) for c in zip(*out)]], names)

    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    pairs = manifest.leaves.groupBy("key", "block").cogroup(paths.groupBy("key", "block"))
    return pairs.applyInArrow(check, schema).withColumnRenamed("id", id_col)
