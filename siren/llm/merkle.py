"""Merkle manifest of a table of documents: a tree per language, a tree over their roots, and every row's proof.

Leaves are numbered by a range sort, so no tree is ever in one task. A superblock is an aligned run of 2^levels nodes of a
tree. Its nodes reduce to one head, heads are the nodes of the next round, and after a few rounds each tree is one node.
On the way back the outer nodes that a superblock's proofs need are the same for all its nodes: one short path. Nodes and
path are cogrouped by superblock, and one call reduces the superblock again, joins the proofs and folds them.

A node at an even place is hashed with the node behind it, the last of an odd run alone. All digests are lowercase hex.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siren.llm.rows import written

#: A superblock is 2^LEVELS nodes wide.
LEVELS = 12
#: The one tree over the languages' roots.
TOP = ""
#: Before a sibling's digest in a path: it stands left, it stands right; ALONE: the node has none and is hashed alone.
LEFT, RIGHT, ALONE = "<", ">", "-"

_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: str) -> str:
    """H: sha256 of the concatenated parts."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_levels(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the ``levels`` levels above them."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(*below[k : k + 2]) for k in range(0, len(below), 2)])
    return out


def path_of(levels: list[list[str]], k: int) -> list[str]:
    """The siblings of node ``k`` from the lowest level up to the highest but one."""
    path = []
    for row in levels[:-1]:
        other = k ^ 1
        path.append(ALONE if other >= len(row) else (RIGHT if other > k else LEFT) + row[other])
        k >>= 1
    return path


def folded(node: str, path: list[str]) -> str:
    """The root that a node and the siblings on its path give."""
    for step in path:
        side, other = step[0], step[1:]
        node = digest(node) if side == ALONE else digest(other, node) if side == LEFT else digest(node, other)
    return node


def proof_of(path: list[str]) -> str:
    """H of the siblings on a path."""
    return digest(*[step[1:] for step in path])


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, node, tampered) of each row: its leaf, and for tampered rows the leaf with ``n_chars`` one higher."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    def leaf(**other: Column) -> Column:
        return F.sha2(F.concat(*[field(other.get(name, F.col(name))) for name in _COLUMNS]), 256)

    rows = docs.select([F.col(name) for name in _COLUMNS])
    # NULL comes before every language, and languages are ordered by their bytes.
    tree = F.coalesce(F.concat(F.lit("s"), F.col("lang").cast("string")), F.lit("n"))
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)
    return rows.select(
        tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("node"),
        F.when(hit & F.col("n_chars").isNotNull(), changed).alias("tampered"),
    )


def numbered(rows: DataFrame, order: list[str], levels: int) -> DataFrame:
    """Give each row's run of ``copies`` nodes its place: adds ``at`` (from 0), ``n`` (nodes of the tree) and ``block``.

    (tree, *order) must be unique. A range sort deals the rows out; each task counts its own, and only the counts of
    tasks and trees are added up. A run that lies in several superblocks becomes a row for each.
    """
    spread = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    schema = ", ".join(f"{name} {kind}" for name, kind in spread.dtypes) + ", _task int, _at long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tree, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            trees = batch.column("tree").dictionary_encode()
            codes = trees.indices.to_numpy()
            copies = batch.column("copies").to_numpy()
            before = np.cumsum(copies) - copies
            heads = np.flatnonzero(np.diff(codes, prepend=-1))
            base = np.repeat(before[heads], np.diff(np.append(heads, len(codes))))
            first = trees.dictionary[codes[0]].as_py()
            carried = np.zeros(len(codes), np.int64)
            if first == tree:
                carried[codes == codes[0]] = at
            places = before - base + carried
            tree, at = trees.dictionary[codes[-1]].as_py(), int(places[-1] + copies[-1])
            arrays = [*batch.columns, pa.array(np.full(len(codes), task, np.int32)), pa.array(places)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "_task", "_at"])

    placed = written(spread.mapInArrow(count, schema), "placed")
    counts = placed.groupBy("tree", "_task").agg(F.sum("copies").alias("_sum"))
    of_tree = Window.partitionBy("tree")
    offsets = counts.select(
        "tree", "_task", F.sum("_sum").over(of_tree).alias("n"),
        (F.sum("_sum").over(of_tree.orderBy("_task")) - F.col("_sum")).alias("_offset"),
    )
    at = F.col("_at") + F.col("_offset")
    found = placed.join(offsets, ["tree", "_task"]).withColumn("_first", at).drop("_task", "_at", "_offset")
    width = 1 << levels
    last = F.col("_first") + F.col("copies") - 1
    cut = found.withColumn("_last", last).withColumn(
        "block", F.explode(F.sequence(F.shiftright("_first", levels), F.shiftright("_last", levels)))
    )
    begins = F.greatest(F.col("_first"), F.col("block") * width)
    ends = F.least(F.col("_last"), F.col("block") * width + width - 1)
    return cut.withColumns({"at": begins, "copies": ends - begins + 1}).drop("_first", "_last")


def _block(frame: pd.DataFrame, levels: int) -> tuple[pd.DataFrame, list[list[str]]]:
    """A superblock's rows in order, one for each node, and its levels: all of them where the tree goes on above."""
    frame = frame.sort_values("at", kind="stable")
    frame = frame.loc[frame.index.repeat(frame["copies"])]
    n = int(frame["n"].iloc[0])
    height = levels if n > 1 << levels else (n - 1).bit_length()
    return frame, tree_levels(frame["node"].tolist(), height)


def _rounds(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every round, lowest first, and each tree's root (tree, node)."""
    width = 1 << levels

    def head(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame, rows = _block(frame, levels)
        n = -(-int(frame["n"].iloc[0]) // width)
        return pd.DataFrame({"tree": [key[0]], "at": [key[1]], "n": [n], "node": [rows[-1][0]]})

    rounds, most = [nodes], (nodes.agg(F.max("n")).first()[0] or 0)
    while True:
        blocks = rounds[-1].select("tree", "block", "at", "copies", "n", "node").groupBy("tree", "block")
        heads = written(blocks.applyInPandas(head, "tree string, at long, n long, node string"), "heads")
        most = -(-most // width)
        if most <= 1:
            return rounds, heads.select("tree", "node")
        rounds.append(heads.withColumns({"copies": F.lit(1).cast("long"), "block": F.shiftright("at", levels)}))


_OUTER = "tree string, block long, path array<string>, subroot string"
_RESULT = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def _down(rounds: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """From the outer path of each tree to that of each superblock of the lowest round."""

    def spread(key: tuple, nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        frame, rows = _block(nodes, levels)
        path, subroot = list(above["path"].iloc[0]), above["subroot"].iloc[0]
        paths = [path_of(rows, k) + path for k in range(len(frame))]
        return pd.DataFrame({"tree": key[0], "block": frame["at"].to_numpy(), "path": paths, "subroot": subroot})

    for nodes in reversed(rounds[1:]):
        below = nodes.select("tree", "block", "at", "copies", "n", "node").groupBy("tree", "block")
        outer = written(below.cogroup(outer.groupBy("tree", "block")).applyInPandas(spread, _OUTER), "outer")
    return outer


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``docs`` has doc_id, source, lang, n_chars and text; other columns are not read. In a language, leaves ascend by
    doc_id (NULL first), rows that repeat an id by their digest; equal rows have equal leaves, and each gets a place of
    its own. NULL in a column is ``-``, so that it differs from an empty text. A table without rows gives none.
    ``levels`` sets the width of superblocks and changes no result.
    """
    # Equal rows are one run, so that not even a third of all rows being copies makes a hot range.
    runs = leaves(docs).groupBy("tree", "doc_id", "node", "tampered").agg(F.count(F.lit(1)).alias("copies"))
    bottom = written(numbered(runs, ["doc_id", "node"], levels), "leaves")
    rounds, subroots = _rounds(bottom, levels)
    tops = subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "node", F.lit(1).cast("long").alias("copies"))
    tops = written(numbered(tops, ["name"], levels), "tops")
    top_rounds, roots = _rounds(tops, levels)
    spark = docs.sparkSession
    found = roots.first()
    if found is None:
        return spark.createDataFrame([], _RESULT)
    root = found["node"]
    start = spark.createDataFrame([(TOP, 0, [], "")], _OUTER)
    outer = _down(top_rounds, start, levels)

    def enter(key: tuple, nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        """The path above each language's root."""
        frame, rows = _block(nodes, levels)
        path = list(above["path"].iloc[0])
        paths = [path_of(rows, k) + path for k in range(len(frame))]
        return pd.DataFrame({"tree": frame["name"].to_numpy(), "block": 0, "path": paths, "subroot": frame["node"].to_numpy()})

    entered = tops.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    outer = _down(rounds, written(entered.applyInPandas(enter, _OUTER), "outer"), levels)

    def prove(key: tuple, nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        """Reduce a superblock, join the proofs of its leaves, fold each leaf or its tampered form."""
        frame, rows = _block(nodes, levels)
        outer_path, subroot = list(above["path"].iloc[0]), above["subroot"].iloc[0]
        proofs, folds = [], []
        for k, (leaf, tampered) in enumerate(zip(frame["node"], frame["tampered"], strict=True)):
            path = path_of(rows, k) + outer_path
            proofs.append(proof_of(path))
            folds.append(folded(tampered if isinstance(tampered, str) else leaf, path))
        return pd.DataFrame({
            "doc_id": frame["doc_id"].to_numpy(), "leaf": frame["node"].to_numpy(), "subroot": subroot,
            "proof_sha256": proofs, "folded_root": folds,
        })

    # Ids go through pandas as text, which keeps NULL apart from numbers.
    sides = bottom.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("tree", "block")
    proven = sides.cogroup(outer.groupBy("tree", "block")).applyInPandas(
        prove, "doc_id string, leaf string, subroot string, proof_sha256 string, folded_root string"
    )
    return proven.select(
        F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256",
        "folded_root", (F.col("folded_root") == root).alias("verified"),
    )


