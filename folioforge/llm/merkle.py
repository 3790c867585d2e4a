"""A Merkle manifest of a dataset, and membership proofs by octopus multiproofs.

Each row is a leaf. Within a tree (the rows of one language) leaves ascend by id; runs of eight consecutive nodes become
the hash of their digests, level by level, until one node remains: the tree's subroot. The subroots, ordered by tree,
are the leaves of one more tree, whose last node is the root of the dataset.

Proofs: a leaf partition holds ``8 ** levels`` neighbouring leaves of a tree. From the coordinates of all its leaves it
computes level by level which nodes it can derive itself and which siblings it lacks (the octopus: a coordinate that two
paths share is wanted once, one that lies on another leaf's path not at all). The union of the missing coordinates is
joined once with the table of nodes. The partition then derives the interiors that its leaves share, and expands the
proof of each leaf from them: the suffix of a proof above a node is made once per node.

Scale: the text is read once, by the hashes; from then on a leaf is some 150 bytes. Positions come from one range
partitioning over (tree, id, leaf) and from the sums of its partitions' counts, so a hot language is spread over many
tasks; no task and no driver holds a tree. The nodes above the leaf partitions are climbed in groups of
``8 ** LEVELS``, so with n leaves there are about log(n) / 12 bits rounds. A coordinate near the root is wanted by
every leaf partition, which is one small row for each 4,096 leaves; skew join handling splits it.

Edge cases: a null field is ``-``; a null tree is a tree of its own, before all others; rows with null ids come first;
rows that repeat are leaves of their own; an empty table has no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.llm.common import dropped, lower_ascii, written

ARITY = 8
#: Levels that one task climbs at a time: groups of 4,096 digests.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODES = "tree string, n long, block long, level int, at long, digest string, is_root boolean"
_NODE_TYPES = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("block", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("digest", pa.string()), ("is_root", pa.bool_())])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(n: int, arity: int = ARITY) -> int:
    """Levels above the leaves of a tree with n leaves."""
    d = 0
    while n > 1:
        n, d = -(-n // arity), d + 1
    return d


def width(n: int, level: int, arity: int = ARITY) -> int:
    for _ in range(level):
        n = -(-n // arity)
    return n


def climb(digests: list[str], steps: int) -> list[list[str]]:
    """The nodes of ``steps`` levels above neighbouring nodes whose first is the first of its run; level 0 included."""
    levels = [digests]
    for _ in range(steps):
        below = levels[-1]
        levels.append([digest("".join(below[k : k + ARITY])) for k in range(0, len(below), ARITY)])
    return levels


def missing(n: int, known: set[int], level: int = 0) -> list[tuple[int, int]]:
    """(level, position) of the nodes that known nodes of one level lack on their way to the root: the octopus."""
    lacking = []
    for k in range(level, depth(n)):
        parents = {x // ARITY for x in known}
        lacking += [(k, x) for p in sorted(parents) for x in range(p * ARITY, min((p + 1) * ARITY, width(n, k))) if x not in known]
        known = parents
    return lacking


# ---------------------------------------------------------------- leaves and their positions


def field(c: Column) -> Column:
    """``-`` for null, else UTF-8 bytes, a colon and the value."""
    v = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaf_digest(fields: tuple[str, ...] = FIELDS, **instead: Column) -> Column:
    """The leaf of a row; ``instead`` gives other values for some of its fields."""
    return F.sha2(F.concat(*[field(instead.get(c, F.col(c))) for c in fields]), 256)


def leaves(docs: DataFrame, *, tree: str = "lang", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, claimed: Column | None = None) -> DataFrame:
    """(tree, id, leaf, claimed): ``claimed`` is the digest that a row is later verified with, its own if not given.

    The tree's name has a sign before it, so that null (the empty name) comes first and differs from the empty string.
    """
    own = leaf_digest(fields)
    return docs.select(F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("tree"), F.col(id_col).cast("long").alias("id"), own.alias("leaf"), (own if claimed is None else claimed).alias("claimed"))


def placed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """The rows with ``at``, their place in their tree by ``order``, and ``n``, the rows of the tree; written.

    Rows are dealt by ranges of (tree, order) and numbered inside their partition; what stands before a partition is the
    sum of the counts of those before it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order).withColumn("row", F.monotonically_increasing_id())
    dealt = written(dealt, "placed").withColumn("part", F.shiftright("row", 33))
    counts = dealt.groupBy(tree, "part").agg(F.min("row").alias("first"), F.count("*").alias("c"))
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(tree, "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(Window.partitionBy(tree)).alias("n"))
    return dealt.join(starts, [tree, "part"]).withColumn("at", F.col("row") + F.col("shift")).drop("row", "part", "shift")


# ---------------------------------------------------------------- nodes


def _node_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODE_TYPES, strict=True)] if rows else [pa.array([], f.type) for f in _NODE_TYPES], schema=_NODE_TYPES)


def partitions(ranked: DataFrame, levels: int, root: bool = False) -> DataFrame:
    """The top node of each leaf partition, and as rows without digest the coordinates that it lacks (``root``: and the root's)."""
    span = ARITY**levels

    def plan(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        tree, n, at = table.column("tree")[0].as_py(), table.column("n")[0].as_py(), table.column("at").to_pylist()
        d, block = depth(n), at[0] // span
        steps = min(levels, d)
        top = climb(table.column("leaf").to_pylist(), steps)[-1][0]
        rows = [(tree, n, block, steps, at[0] // ARITY**steps, top, steps == d)]
        return _node_table(rows + [(tree, n, block, k, x, None, False) for k, x in missing(n, set(at)) + [(d, 0)] * root])

    return ranked.select("tree", "n", "at", "leaf").groupBy("tree", F.floor(F.col("at") / span)).applyInArrow(plan, NODES)


def grown(base: DataFrame, level: int, deepest: int) -> DataFrame:
    """The nodes of ``level`` and all above them, by groups that lie below one node ``LEVELS`` higher."""
    out, group = base, ARITY**LEVELS

    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        tree, n, below, first = (table.column(c)[0].as_py() for c in ("tree", "n", "level", "at"))
        steps = min(LEVELS, depth(n) - below)
        levels = climb(table.column("digest").to_pylist(), steps)
        return _node_table([(tree, n, None, below + k, first // ARITY**k + x, v, below + k == depth(n)) for k in range(1, steps + 1) for x, v in enumerate(levels[k])])

    while level < deepest:
        higher = written(base.groupBy("tree", F.floor(F.col("at") / group)).applyInArrow(up, NODES), "nodes")
        out, level = out.unionByName(higher), level + LEVELS
        base = higher.where(F.col("level") == level)
    return out


def fetched(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """The wanted coordinates with their digests."""
    return wanted.drop("digest").join(nodes.select("tree", "level", "at", "digest"), ["tree", "level", "at"])


# ---------------------------------------------------------------- proofs

PROOFS = "doc_id long, tree string, leaf string, subroot string, root string, proof string, folded_root string"
_PROOF_TYPES = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("tree", "leaf", "subroot", "root", "proof", "folded_root"))])


def _expand(own: pa.Table, got: pa.Table, levels: int) -> pa.Table:
    """The proofs of one leaf partition from its leaves and the nodes that it fetched."""
    own = own.sort_by("at")
    tree, n = own.column("tree")[0].as_py(), own.column("n")[0].as_py()
    ids, at, leaf, claimed = (own.column(c).to_pylist() for c in ("id", "at", "leaf", "claimed"))
    steps, d = min(levels, depth(n)), depth(n)
    nodes = {(t, k, x): v for t, k, x, v in zip(*(got.column(c).to_pylist() for c in ("upper", "level", "at", "digest")), strict=True)}
    place, count = next((p, c) for u, p, c in zip(*(got.column(x).to_pylist() for x in ("upper", "place", "count")), strict=True) if u)
    root = nodes[True, depth(count), 0]

    def sides(level: int, x: int, total: int, find) -> tuple[str, str]:
        """The siblings left and right of node x."""
        first = x - x % ARITY
        run = range(first, min(first + ARITY, width(total, level)))
        return "".join(find(level, y) for y in run if y < x), "".join(find(level, y) for y in run if y > x)

    local = climb(leaf, steps)
    first = [at[0] // ARITY**k for k in range(steps + 1)]
    above, subroot, x = [], local[steps][0], first[steps]
    for k in range(steps, d):  # shared by all leaves: within the tree, then among the trees
        left, right = sides(k, x, n, lambda k, y: nodes[False, k, y])
        above.append((left, right))
        subroot, x = digest(left + subroot + right), x // ARITY
    x = place
    for k in range(depth(count)):
        above.append(sides(k, x, count, lambda k, y: nodes[True, k, y]))
        x //= ARITY
    # siblings of every interior node of the partition, once; the suffix of a proof above a node likewise
    beside = [[sides(k, first[k] + i, n, lambda k, y: local[k][y - first[k]]) for i in range(len(local[k]))] for k in range(steps)]
    suffix = ["".join(a + b for a, b in above)]
    for k in reversed(range(steps)):
        suffix = [a + b + suffix[i // ARITY] for i, (a, b) in enumerate(beside[k])]

    def fold(value: str, i: int) -> str:
        for k in range(steps):
            left, right = beside[k][i]
            value, i = digest(left + value + right), i // ARITY
        for left, right in above:
            value = digest(left + value + right)
        return value

    folded = [fold(v, i) for i, v in enumerate(claimed)]
    same = len(ids)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((ids, [tree] * same, leaf, [subroot] * same, [root] * same, suffix if steps else suffix * same, folded), _PROOF_TYPES, strict=True)], schema=_PROOF_TYPES)


def prove(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, tree, leaf, subroot, root, proof, folded_root) of each leaf of ``leaves``.

    ``proof`` joins the siblings' digests from the leaf's run up to the root; ``folded_root`` is what they and the
    ``claimed`` digest fold to.
    """
    numbered = written(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    ranked = placed(numbered, "tree", "id", "leaf", "tie").drop("tie")
    dropped(numbered)
    planned = written(partitions(ranked, levels), "planned")
    nodes = grown(planned.where("digest is not null"), levels, _deepest(planned))

    # the tree over the subroots: each of its leaves is a leaf partition of its own
    subroots = nodes.where("is_root").select("tree", F.col("digest").alias("leaf"), F.lit("").alias("all"))
    top = placed(subroots, "all", "tree").select(F.col("tree").alias("name"), F.col("all").alias("tree"), "n", "at", "leaf")
    top_planned = written(partitions(top, 0, root=True), "planned")
    path = fetched(top_planned.where("digest is null"), grown(top_planned.where("digest is not null"), 0, _deepest(top_planned)))
    path = path.join(top.select("name", F.col("at").alias("block")), "block").select(F.col("name").alias("tree"), F.lit(True).alias("upper"), "level", "at", "digest", F.col("block").alias("place"), F.col("n").alias("count"))

    lower = fetched(planned.where("digest is null"), nodes).select("tree", "block", F.lit(False).alias("upper"), "level", "at", "digest", F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("count"))
    upper = planned.where("digest is not null").select("tree", "block").join(path, "tree")
    span = ARITY**levels
    own = ranked.withColumn("block", F.floor(F.col("at") / span).cast("long")).groupBy("tree", "block")
    return own.cogroup(lower.unionByName(upper).groupBy("tree", "block")).applyInArrow(lambda a, b: _expand(a, b, levels), PROOFS)


def _deepest(planned: DataFrame) -> int:
    return depth(planned.agg(F.max("n")).first()[0] or 0)


def manifest(docs: DataFrame, *, levels: int = LEVELS, **parameters) -> DataFrame:
    """The proofs of all rows of ``docs``; parameters as of ``leaves``."""
    return prove(leaves(docs, **parameters), levels)


def tampered(id_col: str = "doc_id", text: str = "text", fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf of a row whose text was lower-cased (A-Z) where 3 divides the CRC-32 of the decimal id, else its own."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0
    return F.when(hit, leaf_digest(fields, **{text: lower_ascii(F.col(text))})).otherwise(leaf_digest(fields))
