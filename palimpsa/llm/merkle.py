"""Merkle manifest of a dataset: streaming aligned append with witnesses that grow as siblings complete.

Leaves of a tree are appended in order. A leaf starts with an empty witness; whenever a run of siblings is complete,
every leaf below it gets that run as its next step, and the run's hash is appended one level up. Trees are cut into
aligned blocks, each appended by itself wherever it lies; the roots of blocks are appended in the same way, so their
witnesses are what the witnesses of the leaves below still lack. Subroots of trees are the leaves of a last tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsa.llm.common import ranked, runs, settle

FAN = 16
BLOCK_LEVELS = 3  # a block holds FAN ** BLOCK_LEVELS leaves: 4,096 thin rows
FLUSH_ROWS = 4096

NODES = "_tree string, _n long, _at long, _node string"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field_text(name: str, value: Column | None = None) -> Column:
    """``-`` for a missing value, else the number of its UTF-8 bytes, a colon and the value."""
    written = (F.col(f"`{name}`") if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def height(n: int, fan: int = FAN) -> int:
    """Levels above the leaves of a tree of n."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


class Appender:
    """The open right edge of an aligned subtree, and a witness for every leaf appended so far."""

    def __init__(self, levels: int, fan: int = FAN):
        self.fan = fan
        self.open: list[list[str]] = [[] for _ in range(levels)]
        self.below: list[list[range]] = [[] for _ in range(levels)]
        self.witness: list[list[tuple[int, list[str]]]] = []
        self.root: str | None = None

    def append(self, node: str) -> None:
        self.witness.append([])
        self._put(0, node, range(len(self.witness) - 1, len(self.witness)))

    def _put(self, level: int, node: str, leaves: range) -> None:
        if level == len(self.open):
            self.root = node
            return
        self.open[level].append(node)
        self.below[level].append(leaves)
        if len(self.open[level]) == self.fan:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """Its siblings are known now: the partial witness of every leaf below this run gets them."""
        run, below = self.open[level], self.below[level]
        self.open[level], self.below[level] = [], []
        for place, leaves in enumerate(below):
            step = (place, run)
            for leaf in leaves:
                self.witness[leaf].append(step)
        self._put(level + 1, digest(run), range(below[0].start, below[-1].stop))

    def close(self) -> str:
        """No further leaf comes: last runs are complete with fewer nodes."""
        for level, run in enumerate(self.open):
            if run:
                self._complete(level)
        return self.root


def siblings(witness: list[tuple[int, list[str]]]) -> str:
    """All siblings, level by level, left to right."""
    return "".join("".join(run[:place]) + "".join(run[place + 1 :]) for place, run in witness)


def fold(node: str, witness: list[tuple[int, list[str]]]) -> str:
    """The root that follows from a leaf and its witness."""
    for place, run in witness:
        node = digest([*run[:place], node, *run[place + 1 :]])
    return node


def _written(witness: list[tuple[int, list[str]]]) -> str:
    return ",".join(f"{place}:{''.join(run)}" for place, run in witness)


def _read(text: str) -> list[tuple[int, list[str]]]:
    out = []
    for step in text.split(",") if text else []:
        place, _, run = step.partition(":")
        out.append((int(place), [run[i : i + 64] for i in range(0, len(run), 64)]))
    return out


def _appended(rows: list[dict], fan: int, levels: int) -> Appender:
    """A block's leaves in order. A tree that fits into a block ends at its own height, others at the block's."""
    total = rows[0]["_n"]
    block = Appender(levels if total > fan**levels else height(total, fan), fan)
    for row in rows:
        block.append(row["_node"])
    block.close()
    return block


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("_block", F.floor(F.col("_at") / size).cast("long"))


def _stood(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("_tree", "_block").sortWithinPartitions("_tree", "_block", "_at")


def _climb(nodes: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of the blocks of those, until each tree has one root."""
    size = fan**levels

    def raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_tree", pa.string()), ("_n", pa.int64()), ("_at", pa.int64()), ("_node", pa.string())])
        out = []
        for rows in runs(batches, ["_tree", "_block"]):
            left = -(-rows[0]["_n"] // size)
            out.append(
                {"_tree": rows[0]["_tree"], "_n": left, "_at": rows[0]["_block"],
                 "_node": _appended(rows, fan, levels).root}
            )
            if len(out) >= FLUSH_ROWS:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    stages = [nodes]
    while True:
        thin = _blocks(stages[-1].select("_tree", "_n", "_at", "_node"), size)
        stages.append(settle(_stood(thin).mapInArrow(raised, NODES), "roots"))
        if stages[-1].filter("_n > 1").isEmpty():
            return stages


def _extended(
    nodes: DataFrame, upper: DataFrame, finish: Callable, schema: str, fan: int, levels: int
) -> DataFrame:
    """Witnesses of nodes within their block, extended by the witness of the block's root.

    ``upper`` has a row per block: ``_tree, _at`` (the block), ``_steps``, ``_subroot``. ``finish`` makes a row of
    a node's row, its witness and its tree's root.
    """
    size = fan**levels
    arrow = pa.schema([(f.name, _arrow_type(f.dataType.typeName())) for f in nodes.sparkSession.createDataFrame([], schema).schema])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in runs(batches, ["_tree", "_block"]):
            lead, members = rows[0], rows[1:]  # the block's own witness stands first
            rest = _read(lead["_steps"])
            for row, own in zip(members, _appended(members, fan, levels).witness, strict=True):
                out.append(finish(row, own + rest, lead["_subroot"]))
                if len(out) >= FLUSH_ROWS:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        yield pa.RecordBatch.from_pylist(out, arrow)

    leads = upper.select(
        "_tree", F.col("_at").alias("_block"), F.lit(-1).cast("long").alias("_at"), "_steps", "_subroot"
    )
    both = _blocks(nodes, size).unionByName(leads, allowMissingColumns=True)
    return _stood(both).mapInArrow(extend, schema)


def _arrow_type(name: str) -> pa.DataType:
    return {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[name]


WITNESSES = "_tree string, _at long, _steps string, _subroot string"


def _handed_down(row: dict, witness: list, subroot: str) -> dict:
    return {"_tree": row["_tree"], "_at": row["_at"], "_steps": _written(witness), "_subroot": subroot}


def _descend(stages: list[DataFrame], upper: DataFrame, finish: Callable, schema: str, fan: int, levels: int) -> DataFrame:
    for nodes in reversed(stages[1:-1]):
        upper = settle(_extended(nodes, upper, _handed_down, WITNESSES, fan, levels), "witnesses")
    return _extended(stages[0], upper, finish, schema, fan, levels)


@dataclass
class Manifest:
    """The written levels of all trees and of the tree of their subroots; ``root`` is None for no rows."""

    stages: list[DataFrame]
    top: list[DataFrame]
    root: str | None
    fan: int
    levels: int

    def subroots(self) -> DataFrame:
        return self.stages[-1].select(F.col("_tree").alias("tree"), F.col("_node").alias("subroot"))

    def witnessed(self, finish: Callable, schema: str) -> DataFrame:
        """A row of ``finish(row, witness, subroot)`` for every leaf; the witness goes up to ``root``."""
        top = self.top[-1].select("_tree", "_at", F.lit("").alias("_steps"), F.col("_node").alias("_subroot"))
        ends = _descend(self.top, top, _tree_witness, WITNESSES, self.fan, self.levels)
        return _descend(self.stages, settle(ends, "ends"), finish, schema, self.fan, self.levels)


def _tree_witness(row: dict, witness: list, _: str) -> dict:
    """What a tree's only root hands down: its witness in the tree of trees."""
    return {"_tree": row["_name"], "_at": 0, "_steps": _written(witness), "_subroot": row["_node"]}


def build_manifest(
    leaves: DataFrame, tree: str, order: list[str], node: str, fan: int = FAN, levels: int = BLOCK_LEVELS
) -> Manifest:
    """Trees of ``node`` values, one for each value of ``tree`` (missing counts as a value), ordered by ``order``.

    Other columns of ``leaves`` are kept for ``witnessed``. Rows equal in ``order`` are ordered by their hash, so
    the manifest does not depend on how rows are stored; a lone leaf is its tree's root. Every tree is dealt out by
    ranges of its order and then by aligned blocks, so one with a third of all rows is as many tasks as it needs.
    """
    rows = leaves.withColumns({"_tree": F.col(tree).cast("string"), "_node": F.col(node)})
    rows = settle(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    stages = _climb(ranked(rows, "_tree", [*order, "_node", "_row"], "ordered").drop("_row"), fan, levels)
    ends = stages[-1].select(F.lit("").alias("_tree"), F.col("_tree").alias("_name"), "_node")
    top = _climb(ranked(ends, "_tree", ["_name"], "trees"), fan, levels)
    last = top[-1].first()
    return Manifest(stages, top, last and last["_node"], fan, levels)


def audit(docs: DataFrame, key: str, tree: str, fields: list[str], altered: dict[str, Column], where: Column) -> DataFrame:
    """Manifest of ``docs``, and whether each row as stored still proves membership.

    Columns: key, leaf, subroot, root, proof_sha256 (hash of all siblings on the way up), folded_root, verified. The
    leaf is the hash of ``fields``; where ``where`` is true, the stored row has the values ``altered`` instead, and
    the root is folded from that leaf and the original siblings. A missing key comes first in its tree and a missing
    ``where`` is false. An empty table gives an empty table; other columns are ignored.
    """
    plain = {name: field_text(name) for name in fields}
    stored = plain | {name: field_text(name, value) for name, value in altered.items()}
    leaves = docs.select(
        F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{tree}`").cast("string").alias("_source"),
        leaf_of(list(plain.values())).alias("_leaf"),
        F.when(where, leaf_of(list(stored.values()))).alias("_other"),
    )
    manifest = build_manifest(leaves, "_source", ["_key"], "_leaf")
    root = manifest.root

    def finish(row: dict, witness: list, subroot: str) -> dict:
        folded = fold(row["_other"] or row["_leaf"], witness)
        return {
            "_key": row["_key"], "leaf": row["_leaf"], "subroot": subroot, "root": root,
            "proof_sha256": digest([siblings(witness)]), "folded_root": folded, "verified": folded == root,
        }

    schema = "_key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return manifest.witnessed(finish, schema).withColumnRenamed("_key", key)
