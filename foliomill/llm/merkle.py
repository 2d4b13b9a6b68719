"""Merkle manifest of a dataset: a leaf for every row, a tree for every language, one root, and proofs.

Leaves are SHA-256 digests in lower-case hex. In each tree they ascend by doc_id; while more than one
node remains, every `fanout` consecutive ones (the last run: what is left, even one) become the digest
of their joined hex. The roots of the languages, null first and then by their bytes, form the top tree
in the same way.

Positions are global: leaves are dealt by ranges, sorted and written once with their place in their
range, and counts of the ranges give each range its offset. A tree is then cut in aligned blocks of
`fanout ** k` leaves. A block's nodes are one contiguous byte matrix of 64-byte rows; a level is that
matrix reshaped by the fanout and hashed row by row, and the siblings of node i are the rows beside it
in its run, found by index arithmetic. Block roots are the nodes of the next, a thousand times smaller
table, until one node is left; on the way down each block gets the path of its root, so that every row
is proved within its block's task. No task holds more than a block, and the driver holds counts only.

Defined cases: nulls in any column have a mark of their own in the leaf; leaves of equal doc_id (null
ones come first) are ordered by digest, so that equal rows have neighbouring places and any of their
proofs; a null doc_id is never tampered with; a language of one row is its own leaf; a table of one
row has an empty proof; an empty table gives an empty result; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .text import forget, sent, written

FANOUT = 2
#: Leaves of a block, at most.
BLOCK_LEAVES = 1024
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def marked(value: Column) -> Column:
    """The value with its length in bytes before it; null as a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(n_chars: Column) -> Column:
    """The leaf of a row of documents, with this number of characters."""
    values = {c: F.col(c) for c in COLUMNS} | {"n_chars": n_chars}
    return F.sha2(F.concat(*[marked(values[c]) for c in COLUMNS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, spoiled): `spoiled` is the leaf after tampering, null where there is none."""
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return docs.select(
        # Null sorts before every language, and an empty name apart from it.
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        "doc_id",
        leaf_digest(F.col("n_chars")).alias("leaf"),
        F.when(chosen, leaf_digest(more)).alias("spoiled"),
    )


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """The rows with `pos`, from 0 within their tree, and `n`, the tree's size; written before they are numbered."""
    places = (
        rows.repartitionByRange("tree", *order)
        .sortWithinPartitions("tree", *order)
        .withColumn("at", F.monotonically_increasing_id())
    )
    placed = written(places, name)
    part = F.shiftright("at", 33)
    # A row for each range and tree in it: there are about as many as ranges, or trees.
    ranges = placed.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    by_tree = Window.partitionBy("tree")
    before = by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        F.col("tree").alias("of"),
        "part",
        (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("held").over(by_tree).alias("n"),
    )
    small = sent(written(offsets, f"{name}-offsets"))
    joined = placed.join(small, (F.col("tree") == F.col("of")) & (part == F.col("part")))
    return joined.withColumn("pos", F.col("at") + F.col("shift")).drop("of", "part", "shift", "at")


def block_levels(fanout: int) -> int:
    """Levels of a block: the most with at most BLOCK_LEAVES leaves, one at least."""
    levels = 1
    while fanout ** (levels + 1) <= BLOCK_LEAVES:
        levels += 1
    return levels


def height(n: int, fanout: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def matrix(digests: pa.ChunkedArray) -> np.ndarray:
    """Hex digests as a contiguous matrix of bytes, a row for each."""
    return np.frombuffer("".join(digests.to_pylist()).encode("ascii"), np.uint8).reshape(-1, HEX)


def hash_level(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The nodes above: whole runs are rows of the reshaped matrix, the last run is what is left."""
    whole = len(nodes) // fanout
    rows = [r.tobytes() for r in nodes[: whole * fanout].reshape(whole, fanout * HEX)]
    if whole * fanout < len(nodes):
        rows.append(nodes[whole * fanout :].tobytes())
    return np.frombuffer("".join(hashlib.sha256(r).hexdigest() for r in rows).encode("ascii"), np.uint8).reshape(-1, HEX)


def build(nodes: np.ndarray, fanout: int, levels: int) -> list[np.ndarray]:
    """The nodes of each level from the given one upwards."""
    made = [nodes]
    for _ in range(levels):
        made.append(hash_level(made[-1], fanout))
    return made


def steps(made: list[np.ndarray], i: int, fanout: int) -> list[tuple[bytes, bytes]]:
    """For each level, the siblings before and after the node above leaf i."""
    found = []
    for level in made[:-1]:
        run = i - i % fanout
        found.append((level[run:i].tobytes(), level[i + 1 : run + fanout].tobytes()))
        i //= fanout
    return found


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and the siblings on its path lead to."""
    for before, after in path:
        node = hashlib.sha256(before + node + after).hexdigest().encode("ascii")
    return node


def _in_order(group: pa.Table) -> pa.Table:
    return group.sort_by("pos")


def _grown(group: pa.Table, column: str, fanout: int, most: int) -> list[np.ndarray]:
    """The levels of a block, given its nodes in order; as many as the whole tree has, `most` at most."""
    return build(matrix(group.column(column)), fanout, min(most, height(group.column("n")[0].as_py(), fanout)))


def _block(fanout: int) -> Column:
    return F.floor(F.col("pos") / F.lit(fanout ** block_levels(fanout))).cast("long")


def block_roots(nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, pos, n, digest) of the block roots of such a table."""
    most = block_levels(fanout)

    def root(group: pa.Table) -> pa.Table:
        group = _in_order(group)
        top = _grown(group, "digest", fanout, most)[-1]
        n = -(-group.column("n")[0].as_py() // fanout**most)
        return pa.table(
            {
                "tree": group.column("tree")[:1],
                "pos": group.column("block")[:1],
                "n": pa.array([n], pa.int64()),
                "digest": [top.tobytes().decode("ascii")],
            }
        )

    grouped = nodes.select("tree", "pos", "n", "digest", _block(fanout).alias("block")).groupBy("tree", "block")
    return grouped.applyInArrow(root, "tree string, pos long, n long, digest string")


def climb(nodes: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """Tables of nodes, each of the block roots of the one before, up to one node for each tree."""
    made = [nodes]
    while True:
        made.append(written(block_roots(made[-1], fanout), name))
        if (made[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return made


PATHS = "tree string, pos long, before array<string>, after array<string>, subroot string, root string"


def _path(group: pa.Table) -> list[tuple[bytes, bytes]]:
    pairs = zip(group.column("before")[0].as_py(), group.column("after")[0].as_py())
    return [(a.encode("ascii"), b.encode("ascii")) for a, b in pairs]


def block_paths(nodes: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """The paths of nodes to the root, from those of their blocks' roots."""
    most = block_levels(fanout)

    def down(group: pa.Table, top: pa.Table) -> pa.Table:
        group = _in_order(group)
        made = _grown(group, "digest", fanout, most)
        upper = _path(top)
        paths = [steps(made, i, fanout) + upper for i in range(len(group))]
        n = len(group)
        return pa.table(
            {
                "tree": group.column("tree"),
                "pos": group.column("pos"),
                "before": pa.array([[a.decode("ascii") for a, _ in p] for p in paths], pa.list_(pa.string())),
                "after": pa.array([[b.decode("ascii") for _, b in p] for p in paths], pa.list_(pa.string())),
                "subroot": pa.array([top.column("subroot")[0].as_py()] * n, pa.string()),
                "root": pa.array([top.column("root")[0].as_py()] * n, pa.string()),
            }
        )

    left = nodes.select("tree", "pos", "n", "digest", _block(fanout).alias("block")).groupBy("tree", "block")
    right = above.withColumnRenamed("pos", "block").groupBy("tree", "block")
    return left.cogroup(right).applyInArrow(down, PATHS)


def descend(tables: list[DataFrame], tops: DataFrame, fanout: int, name: str) -> DataFrame:
    """The paths of the nodes of the first table, from those of the last one, a table at a time."""
    paths = tops
    for nodes in reversed(tables[:-1]):
        paths = written(block_paths(nodes, paths, fanout), name)
    return paths


def prove(placed: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """The proof of every leaf and what it folds to, tampered leaves included."""
    most = block_levels(fanout)
    kind = StructType(
        [StructField("doc_id", placed.schema["doc_id"].dataType)]
        + [StructField(c, placed.schema["leaf"].dataType) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    )

    def down(group: pa.Table, top: pa.Table) -> pa.Table:
        group = _in_order(group)
        made = _grown(group, "leaf", fanout, most)
        upper = _path(top)
        proofs, folded = [], []
        for i, (leaf, spoiled) in enumerate(zip(group.column("leaf").to_pylist(), group.column("spoiled").to_pylist())):
            path = steps(made, i, fanout) + upper
            proofs.append(hashlib.sha256(b"".join(a + b for a, b in path)).hexdigest())
            folded.append(fold((spoiled or leaf).encode("ascii"), path).decode("ascii"))
        n = len(group)
        return pa.table(
            {
                "doc_id": group.column("doc_id"),
                "leaf": group.column("leaf"),
                "subroot": pa.array([top.column("subroot")[0].as_py()] * n, pa.string()),
                "root": pa.array([top.column("root")[0].as_py()] * n, pa.string()),
                "proof_sha256": proofs,
                "folded_root": folded,
            }
        )

    left = placed.withColumn("block", _block(fanout)).groupBy("tree", "block")
    right = above.withColumnRenamed("pos", "block").groupBy("tree", "block")
    return left.cogroup(right).applyInArrow(down, kind)


def manifest(docs: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed leaves, the paths of their blocks' roots, and (tree, subroot, root) for each language."""
    if fanout < 2:
        raise ValueError("fanout is 2 or more")
    # Written first: finding the ranges reads the rows once more, and should not hash the texts again.
    told = written(leaves(docs), "told")
    placed = numbered(told, "leaves", "doc_id", "leaf")
    forget(told)
    trees = climb(placed.select("tree", "pos", "n", F.col("leaf").alias("digest")), fanout, "nodes")
    # The languages' roots are the leaves of one more tree, without a name.
    roots = numbered(
        trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), "digest"), "subroots", "lang_tree"
    )
    tops = climb(roots.select("tree", "pos", "n", "digest"), fanout, "topnodes")
    nothing = F.array().cast("array<string>")
    root = tops[-1].select(
        "tree", "pos", nothing.alias("before"), nothing.alias("after"),
        F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
    )
    ways = descend([roots, *tops[1:]], root, fanout, "toppaths").select("pos", "before", "after", "root")
    subroots = roots.select(F.col("lang_tree").alias("tree"), F.col("digest").alias("subroot"), "pos")
    starts = written(
        subroots.join(ways, "pos").select("tree", F.lit(0).cast("long").alias("pos"), "before", "after", "subroot", "root"),
        "starts",
    )
    return placed, descend(trees[1:], starts, fanout, "paths"), starts.select("tree", "subroot", "root")


def report(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Every row's leaf, proof digest, and whether its leaf, tampered with where chosen, still leads to the root."""
    placed, paths, _ = manifest(docs, fanout)
    return prove(placed, paths, fanout).withColumn("verified", F.col("folded_root") == F.col("root"))
