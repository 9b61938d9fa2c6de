"""Merkle manifest of a dataset: one hash tree for each group of rows, and one over the groups' roots.

Trees are cut into aligned blocks of arity ** LEVELS nodes. A block's root is made in one task from its own
nodes; the roots of all blocks are the nodes of the next tier, and so on until every tree has a single node.
On the way back each node learns its path: for each level above it the hashes of its siblings before and behind.

The trees are persistent. A changed leaf makes a version of its own that shares every node but its ancestors
with the tree: within the block they are copied from the block's nodes, and above it the version continues in
the same task along the block's own path, so no version passes another and no task holds a tree.

Defined cases: a group's rows ascend by the order column, nulls first, rows that tie there by their leaf, so
repeated rows are leaves each. A null group comes first and is none of the others. A lone leaf is its group's
root, a lone group's root the root of all. Nulls of any column count as ``-``, empty and very long texts as they
are. An empty table has no rows and no root. Further columns of any name are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, attach, running, settled

#: Levels of a tree that one block holds.
LEVELS = 3

NODE = "_key string, _at long, top string, full string"
PLACE = "_key string, _at long, alone boolean, path array<struct<before:string,after:string>>, subroot string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


class PersistentTree:
    """The nodes of an aligned block, level by level; versions copy what lies above a changed leaf."""

    def __init__(self, leaves: list[str], arity: int, levels: int | None):
        """With levels None up to a single node, else exactly that many levels."""
        self.arity, self.levels = arity, [leaves]
        while (len(self.levels[-1]) > 1) if levels is None else len(self.levels) <= levels:
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i : i + arity])) for i in range(0, len(below), arity)])

    def path(self, at: int) -> list[tuple[str, str]]:
        """For each level below the top, the siblings before and behind, joined."""
        out = []
        for nodes in self.levels[:-1]:
            first = at - at % self.arity
            out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + self.arity])))
            at //= self.arity
        return out


def copy_path(value: str, path: list[tuple[str, str]]) -> list[str]:
    """The nodes above a leaf of that value, which are all that its version does not share."""
    out = []
    for before, after in path:
        value = digest(before + value + after)
        out.append(value)
    return out


def _block(arity: int) -> Column:
    return F.floor(F.col("_at") / arity**LEVELS).cast("long")


def _places(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes: _key, _at, top (the hash if it is the only node of its key), full (else). PLACE of every node."""
    most = nodes.agg(F.max("_at")).first()[0]
    if not most:  # each key has one node, or there is none
        none = F.array().cast("array<struct<before:string,after:string>>")
        return nodes.select("_key", "_at", F.lit(True).alias("alone"), none.alias("path"), F.col("top").alias("subroot"))
    blocked = nodes.withColumn("_up", _block(arity))

    def rise(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_at")
        one = len(f) == 1 and key[1] == 0
        top = f["top"].iloc[0] if one else PersistentTree(f["full"].tolist(), arity, None).levels[-1][0]
        return pd.DataFrame({"_key": [key[0]], "_at": [key[1]], "top": [top], "full": [PersistentTree(f["full"].tolist(), arity, LEVELS).levels[-1][0]]})

    above = settled(_places(settled(blocked.groupBy("_key", "_up").applyInPandas(rise, NODE)), arity))

    def descend(key: tuple, f: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        f, u = f.sort_values("_at"), up.iloc[0]
        lone = bool(u["alone"]) and len(f) == 1
        tree = PersistentTree(f["full"].tolist(), arity, None if u["alone"] else LEVELS)
        rest = [(p["before"], p["after"]) for p in u["path"]]
        own = [tree.path(i) + rest for i in range(len(f))]
        return pd.DataFrame({"_key": f["_key"], "_at": f["_at"], "alone": lone, "path": [[{"before": b, "after": a} for b, a in p] for p in own], "subroot": u["subroot"]})

    return blocked.groupBy("_key", "_up").cogroup(above.withColumnRenamed("_at", "_up").groupBy("_key", "_up")).applyInPandas(descend, PLACE)


def manifest(docs: DataFrame, group: str, order: str, fields: list[str], tampered: dict[str, Column] | None = None, changed: Column | None = None, arity: int = 16, with_nodes: bool = False) -> DataFrame:
    """order, leaf, subroot, root, proof_sha256 (the siblings up to the root, hashed), folded_root, verified, and,
    if with_nodes, siblings (before and after, level by level) and copied (the nodes that the row's version has of
    its own, from above the leaf to its root); both null else.

    A leaf hashes ``fields`` in their order. Where ``changed`` holds, the row makes a version in which the columns
    named by ``tampered`` have those values; folded_root is the root of that version, else of the tree.

    Rows are numbered by ranges, so that a group may spread over many tasks; text is read once and only hashes are
    shuffled. A block is a task's group of at most arity ** LEVELS rows."""
    known = docs.select(*dict.fromkeys([group, order, *fields]))
    own = leaf([F.col(f) for f in fields])
    other = leaf([(tampered or {}).get(f, F.col(f)) for f in fields])
    changes = F.coalesce(changed, F.lit(False)) if changed is not None else F.lit(False)
    key = F.coalesce(F.concat(F.lit("k"), F.col(group).cast("string")), F.lit(""))
    rows = settled(known.select(key.alias("_key"), F.col(order).alias("_order"), own.alias("leaf"), F.when(changes, other).alias("version")))
    kind = rows.schema["_order"].dataType.simpleString()
    ranked = settled(running(rows, ["_key"], ["_order", "leaf"], {}, "_n").select("*", (F.col("_n") - 1).alias("_at")).drop("_n"))
    names = [order, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "siblings", "copied"]
    out = f"{order} {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, siblings array<struct<before:string,after:string>>, copied array<string>"
    blocked = ranked.withColumn("_up", _block(arity))

    def rise(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        leaves = f.sort_values("_at")["leaf"].tolist()
        full = PersistentTree(leaves, arity, LEVELS).levels[-1][0]
        return pd.DataFrame({"_key": [key[0]], "_at": [key[1]], "top": [PersistentTree(leaves, arity, None).levels[-1][0]], "full": [full]})

    blocks = settled(_places(settled(blocked.select("_key", "_up", "_at", "leaf").groupBy("_key", "_up").applyInPandas(rise, NODE)), arity))
    subroots = blocks.where("_at = 0").select("_key", "subroot")
    numbered = running(subroots, [], ["_key"], {}, "_n")
    groups = numbered.select(F.lit("").alias("_key"), (F.col("_n") - 1).alias("_at"), F.col("subroot").alias("top"), F.col("subroot").alias("full"), F.col("_key").alias("_group"))
    groups = settled(groups)
    placed = _places(groups.drop("_group"), arity).select("_at", F.col("path").alias("above"), F.col("subroot").alias("root"))
    paths = placed.join(groups.select("_at", F.col("_group").alias("_key")), "_at").drop("_at")
    ways = attach(blocks, settled(paths), ["_key"]).withColumnRenamed("_at", "_up")

    def fold(key: tuple, f: pa.Table, way: pa.Table) -> pa.Table:
        f, u = f.sort_by("_at"), way.to_pylist()[0]
        leaves, versions = f["leaf"].to_pylist(), f["version"].to_pylist()
        tree = PersistentTree(leaves, arity, None if u["alone"] else LEVELS)
        upper = [(p["before"], p["after"]) for part in (u["path"], u["above"]) for p in part]
        beyond = "".join(b + a for b, a in upper)
        proofs, folded, siblings, copied = [], [], [], []
        for i, (own, version) in enumerate(zip(leaves, versions)):
            path = tree.path(i)
            proofs.append(digest("".join(b + a for b, a in path) + beyond))
            start = own if version is None else version
            nodes = copy_path(start, path + upper)  # without a version of its own, a row is checked by the same walk
            folded.append(nodes[-1] if nodes else start)
            siblings.append([{"before": b, "after": a} for b, a in path + upper] if with_nodes else None)
            copied.append(nodes if with_nodes and version is not None else None)
        root = u["root"]
        columns = [f["_order"], f["leaf"], pa.array([u["subroot"]] * len(leaves)), pa.array([root] * len(leaves)), pa.array(proofs), pa.array(folded), pa.array([x == root for x in folded])]
        step = pa.struct([("before", pa.string()), ("after", pa.string())])
        return pa.Table.from_arrays([*columns, pa.array(siblings, pa.list_(step)), pa.array(copied, pa.list_(pa.string()))], names=names)

    return blocked.groupBy("_key", "_up").cogroup(ways.groupBy("_key", "_up")).applyInArrow(fold, out)


def op11_merkle_manifest(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = manifest(docs, "source", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"text": ascii_lower(F.col("text"))}, changed)
    return out.drop("siblings", "copied")
