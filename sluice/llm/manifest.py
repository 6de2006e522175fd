"""A Merkle manifest of a dataset, with a witness for every document.

Documents of a group (a language) are the leaves of a tree of ARITY children a node,
in the order of their ids; the groups' subroots, in the order of their names, are the
leaves of one more tree, whose root stands for the dataset. A document's witness holds,
level by level up to the root, what stands before and after its node in its run: whoever
has the document, the witness and the root can check that the document is as it was.

Trees are built by aligned append. Leaves stream in order into the open subtrees of
their block (ARITY ** BLOCK_LEVELS leaves, aligned). A leaf that is appended has an
empty witness; when a subtree gets its last child, each child's leaves learn their
siblings, so partial witnesses grow with every completion until the block's root is
known. Block roots are appended in the same way to the blocks above them, whatever
task they come from, until one node is left. On the way down a block gets what its root
has learnt above as its first row, so that its leaves' witnesses are whole: no table
of witnesses is kept, only the digests of leaves and of blocks' roots.

A task holds one block: at most ARITY ** BLOCK_LEVELS leaves, whatever the group's size.

Defined cases: a null column is spelled `-`, so null and empty texts differ. Null
groups and null ids come first. Rows that repeat an id stand in the order of their
leaves; whole repeats are leaves of their own with the same digest. Of an empty table
nothing is returned. Extra columns are ignored. Texts of any length are digested where
they are read and never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, ranked, settled, ship_code, tidy

ARITY, BLOCK_LEVELS = 8, 3
#: Columns of a document that its leaf covers, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Groups with their first rank and size are broadcast up to this many.
BROADCAST_GROUPS = 100_000
#: Rows that a task gathers before it sends them on; of large blocks one at a time.
OUT_ROWS = 500


def spelled(c: Column) -> Column:
    """A value with its length in bytes, so that neighbours can't run into one another."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(spelled, columns)), 256)


def levels(leaves: int) -> int:
    """How many levels a tree of so many leaves has above them."""
    height, most = 0, 1
    while most < leaves:
        height, most = height + 1, most * ARITY
    return height


class OpenTree:
    """Subtrees that still wait for children, one run a level. A child brings the
    witnesses of the leaves below it, which are lists that grow."""

    def __init__(self, height: int):
        self.runs: list[list[tuple[str, list[list[tuple[str, str]]]]]] = [[] for _ in range(height)]
        self.root = ""

    def append(self, digest: str, witness: list[tuple[str, str]]) -> None:
        self._add(0, digest, [witness])

    def _add(self, level: int, digest: str, witnesses: list[list[tuple[str, str]]]) -> None:
        if level == len(self.runs):
            self.root = digest
            return
        run = self.runs[level]
        run.append((digest, witnesses))
        if len(run) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        digests = [d for d, _ in run]
        for i, (_, witnesses) in enumerate(run):
            siblings = "".join(digests[:i]), "".join(digests[i + 1 :])
            for w in witnesses:
                w.append(siblings)
        self._add(level + 1, sha256("".join(digests).encode()).hexdigest(), [w for _, witnesses in run for w in witnesses])

    def close(self) -> None:
        """The last runs may be shorter than others."""
        for level, run in enumerate(self.runs):
            if run:
                self._complete(level)


STEPS = "before array<string>, after array<string>"


def _in_blocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / size)).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def block_roots(nodes: DataFrame, block_levels: int) -> DataFrame:
    """Of nodes (tree, pos, n: how many the tree has, digest) the roots of their blocks,
    as nodes of the same trees further up."""
    size = ARITY**block_levels

    def appended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, tree = None, OpenTree(0)
        for b in batches:
            for name, block, n, digest in zip(*(b.column(c).to_pylist() for c in ("tree", "block", "n", "digest")), strict=True):
                if now is None or now[:2] != (name, block):
                    if now is not None:
                        tree.close()
                        out.append((*now, tree.root))
                    now, tree = (name, block, -(-n // size)), OpenTree(min(block_levels, levels(n)))
                tree.append(digest, [])
            if len(out) >= OUT_ROWS:
                yield _roots_batch(out)
                out = []
        if now is not None:
            tree.close()
            yield _roots_batch([*out, (*now, tree.root)])

    rows = _in_blocks(nodes.select("tree", "pos", "n", "digest"), size)
    return rows.mapInArrow(tidy(appended), "tree string, pos long, n long, digest string")


def _roots_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["tree", "pos", "n", "digest"])


def witnessed(nodes: DataFrame, above: DataFrame | None, block_levels: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """nodes (tree, pos, n, digest and the columns of keep) with before and after: the
    siblings, level by level, up to the root, and top. above holds what the blocks' roots
    have learnt: (tree, pos: the block, before, after, top)."""
    size = ARITY**block_levels
    nothing = F.lit(None)
    rows = nodes.select("tree", F.floor(F.col("pos") / size).alias("block"), "pos", "n", "digest", *[nothing.cast("array<string>").alias(c) for c in ("before", "after")], nothing.cast("string").alias("top"), *keep)
    if above is not None:
        first = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), nothing.cast("long").alias("n"), nothing.cast("string").alias("digest"), "before", "after", "top", *[nothing.cast(nodes.schema[c].dataType).alias(c) for c in keep])
        rows = rows.unionByName(first)
    rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    passed = ("tree", "pos", "n", "digest", *keep)

    def appended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        out: list[tuple] = []
        now, tree, upper, open_rows = None, OpenTree(0), ([], [], None), []

        def finished() -> None:
            tree.close()
            for row, w in open_rows:
                out.append((*row, [x for x, _ in w] + upper[0], [x for _, x in w] + upper[1], upper[2]))

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            types = [*kinds, pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], [*passed, "before", "after", "top"])

        for b in batches:
            kinds = [b.schema.field(c).type for c in passed]
            columns = [b.column(c).to_pylist() for c in passed]
            before, after, top = (b.column(c) for c in ("before", "after", "top"))
            for k, (block, row) in enumerate(zip(b.column("block").to_pylist(), zip(*columns, strict=True), strict=True)):
                name, pos, n, digest = row[:4]
                if now != (name, block):
                    finished()
                    now, tree, upper, open_rows = (name, block), None, ([], [], None), []
                    if len(out) >= OUT_ROWS:
                        yield batch()
                        out = []
                if pos < 0:
                    upper = (before[k].as_py(), after[k].as_py(), top[k].as_py())
                    tree = OpenTree(0)
                    continue
                if not open_rows:
                    tree = OpenTree(min(block_levels, levels(n)))
                witness: list[tuple[str, str]] = []
                open_rows.append((row, witness))
                tree.append(digest, witness)
        if now is not None:
            finished()
        if out:
            yield batch()

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in passed)
    return rows.mapInArrow(tidy(appended), f"{kinds}, {STEPS}, top string")


def lifted(nodes: DataFrame, block_levels: int) -> list[DataFrame]:
    """nodes, the roots of their blocks, those blocks' blocks' roots and so on, until
    each tree has one node."""
    rounds = [nodes]
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        nodes = settled(block_roots(nodes, block_levels))
        rounds.append(nodes)
    return rounds


def lowered(rounds: list[DataFrame], above: DataFrame | None, block_levels: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The first of the rounds, with whole witnesses."""
    for nodes in rounds[-2:0:-1]:
        above = settled(witnessed(nodes, above, block_levels).select("tree", "pos", "before", "after", "top"))
    return witnessed(rounds[0], above, block_levels, keep)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", candidate: Column | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per document: doc_id, group, leaf, candidate, subroot, root and the witness
    as before and after, arrays of one text a level. candidate, an expression over docs,
    is any digest to be checked against the document's witness, or null."""
    ship_code(docs.sparkSession)
    other = candidate if candidate is not None else F.lit(None).cast("string")
    leaves = docs.select(F.col(group_col).cast("string").alias("tree"), F.col(id_col).alias("doc_id"), leaf_digest(*map(F.col, columns)).alias("digest"), other.alias("candidate"))
    # The row's number keeps equal rows from being one key of the ranges.
    leaves = settled(leaves.withColumn("row", F.monotonically_increasing_id()))
    placed = ranked(leaves, F.asc_nulls_first("tree"), F.asc_nulls_first("doc_id"), F.asc("digest"), F.asc("row"))
    trees = settled(placed.groupBy("tree").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("n")))
    sizes = trees.select(F.col("tree").alias("__sl_tree"), "start", "n")
    nodes = placed.join(hinted(sizes, BROADCAST_GROUPS), F.col("tree").eqNullSafe(F.col("__sl_tree"))).select("tree", (F.col("rank") - F.col("start")).alias("pos"), "n", "digest", "doc_id", "candidate")
    below = lifted(nodes, block_levels)

    subroots = below[-1].select("tree", "digest")
    n = trees.count()
    named = ranked(subroots, F.asc_nulls_first("tree")).select(F.lit(None).cast("string").alias("tree"), F.col("rank").alias("pos"), F.lit(n).cast("long").alias("n"), "digest", F.col("tree").alias("name"))
    upper = lifted(named, block_levels)
    top = upper[-1].first()
    root = F.lit(top["digest"] if top else None).cast("string")
    learnt = settled(lowered(upper, None, block_levels, ("name",)).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "before", "after", F.col("digest").alias("top")))
    found = lowered(below, learnt, block_levels, ("doc_id", "candidate"))
    return found.select("doc_id", F.col("tree").alias("group"), F.col("digest").alias("leaf"), "candidate", F.col("top").alias("subroot"), root.alias("root"), "before", "after")


def proof_digest(before: str = "before", after: str = "after") -> Column:
    """The digest of all of a witness's siblings, in order."""
    return F.sha2(F.array_join(F.zip_with(before, after, lambda a, z: F.concat(a, z)), ""), 256)


def folded(leaf: Column, before: str = "before", after: str = "after") -> Column:
    """The root that leaf has under the witness."""
    return F.aggregate(F.arrays_zip(before, after), leaf, lambda node, s: F.sha2(F.concat(s[before], node, s[after]), 256))
