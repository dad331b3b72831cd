"""Merkle manifest of a table by a rollup into nested structs.

A leaf is the hash of a row's fields.  The leaves of a group are ranked; the rank's lowest digits (radix 16) number a leaf in its block of
``16 ** DIGITS`` leaves.  A block is rolled up by grouping its digits away one after another: each step nests the child structs of one
digit with the hashes of the four binary levels above them.  The roots of the blocks are the next round's leaves, and so on until a
group has one node, its subroot; the subroots are rolled up likewise to the root.  Proofs go the other way: a block takes the path above its
root into the same rollup, and a transform over the nested structs and an explode give every leaf its siblings, without a join.

A level's nodes are hashed in pairs while a group has more than one; the last may be hashed alone.  Hashes are lower-case hex sha256.

Defined results: a null field is ``-`` in a leaf, an empty one ``0:``; null groups are one group, the first; leaves ascend by id, null
first, and equal ids by leaf, so repeated rows are leaves of their own; a null id is never tampered with; a table of one row has that
leaf as its root and an empty proof; an empty table gives an empty one; columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadsift.functions.durable import stored
from roadsift.functions.ordered import row_index

DIGITS = 3  # 4096 leaves a block
RADIX_BITS = 4
PATH = "array<struct<sibling: string, left: boolean>>"
ABOVE = f"struct<path: {PATH}, subroot: string, root: string>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _shifted(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value.cast("int"), by.cast("int"))


def _pairs(nodes: Column) -> Column:
    """The next level: the hash of every two nodes, of one where the last has no partner."""
    return F.transform(F.sequence(F.lit(0), F.size(nodes) - 1, F.lit(2)),
                       lambda i: F.sha2(F.concat(F.get(nodes, i), F.coalesce(F.get(nodes, i + 1), F.lit(""))), 256))


def _levels(nodes: Column, height: Column) -> Column:
    """The nodes and the ``height`` levels above them."""
    above = F.aggregate(F.sequence(F.lit(1), height), F.array(nodes), lambda levels, _: F.concat(levels, F.array(_pairs(F.element_at(levels, -1)))))
    return F.when(height == 0, F.array(nodes)).otherwise(above)


def _height(is_whole: Column, size: Column) -> Column:
    """Levels above the nodes of one digit: all of a digit's, or as many as it takes to one node where these are all nodes of a tree."""
    needed = F.ceil(F.log2(size.cast("double"))).cast("int")
    return F.when(is_whole & (size < 1 << RADIX_BITS), needed).otherwise(RADIX_BITS)


def _steps(levels: Column, place: Column) -> Column:
    """Siblings of the node at ``place``, from the lowest level up; null where it is hashed alone."""
    heights = F.slice(F.sequence(F.lit(0), F.size(levels) - 1), F.lit(1), F.size(levels) - 1)

    def step(h: Column) -> Column:
        at = _shifted(place, h)
        return F.struct(F.get(F.get(levels, h), at.bitwiseXOR(F.lit(1))).alias("sibling"), (at.bitwiseAND(F.lit(1)) == 1).alias("left"))

    return F.transform(heights, step)


def rolled_up(nodes: DataFrame, digits: int, above: DataFrame | None = None) -> DataFrame:
    """Blocks of ``nodes`` (key, rank, hash[, item]): key, block, hash; with ``above`` (key, block, above) also the nested structs and that path.

    One shuffle by (key, block) serves all steps."""
    def digit(k: int) -> Column:
        return F.call_function("shiftright", F.col("rank"), F.lit(RADIX_BITS * k)).bitwiseAND(F.lit((1 << RADIX_BITS) - 1)).cast("int")

    place = [digit(k).alias(f"d{k}") for k in range(digits)]
    block = F.call_function("shiftright", F.col("rank"), F.lit(RADIX_BITS * digits)).alias("block")
    proving = above is not None
    carried = ["item"] if proving else []
    rows = nodes.select("key", block, *place, F.struct(F.col("hash"), *carried).alias("node"))
    if proving:
        rows = rows.withColumn("above", F.lit(None).cast(ABOVE))
        empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in ("key", "block", "above")]
        rows = rows.unionByName(above.select("key", "block", *empty, "above"))
    rows = rows.repartition("key", "block")
    for k in range(digits):
        higher = [f"d{j}" for j in range(k + 1, digits)]
        child = F.when(F.col(f"d{k}").isNotNull(), F.struct(F.col(f"d{k}").alias("at"), "node"))  # rows that carry a path have no digits
        grouped = rows.groupBy("key", "block", *higher).agg(F.sort_array(F.collect_list(child)).alias("kids"),
                                                            *([F.first("above", ignorenulls=True).alias("above")] if proving else []))
        whole = F.col("block") == 0
        for c in higher:
            whole &= F.col(c) == 0
        hashes = F.transform("kids", lambda c: c["node"]["hash"])
        leveled = grouped.withColumn("levels", F.when(F.size("kids") > 0, _levels(hashes, _height(whole, F.size("kids")))))
        top = F.get(F.element_at("levels", -1), F.lit(0)).alias("hash")
        inner = F.struct(top, *([F.col("levels"), F.col("kids")] if proving else []))
        rows = leveled.select("key", "block", *higher, inner.alias("node"), *(["above"] if proving else []))
    return rows.select("key", "block", "node.*", *(["above"] if proving else []))


def proofs(nodes: DataFrame, digits: int, above: DataFrame) -> DataFrame:
    """For each node (key, rank, hash, item): item, and the path, subroot and root above it."""
    blocks = rolled_up(nodes, digits, above)

    def leaves(node_kids: Column, node_levels: Column, depth: int, path_above: Column) -> Column:
        def one(c: Column) -> Column:
            path = F.concat(_steps(node_levels, c["at"]), path_above)
            if depth == 1:
                return F.struct(c["node"]["item"].alias("item"), path.alias("path"))
            return leaves(c["node"]["kids"], c["node"]["levels"], depth - 1, path)

        out = F.transform(node_kids, one)
        return out if depth == 1 else F.flatten(out)

    found = blocks.select("key", F.coalesce("above.subroot", "hash").alias("subroot"), F.coalesce("above.root", "hash").alias("root"),
                          F.explode(leaves(F.col("kids"), F.col("levels"), digits, F.coalesce("above.path", F.array().cast(PATH)))).alias("leaf"))
    return found.select("key", "leaf.item", F.struct("leaf.path", "subroot", "root").alias("above"))


def _rounds(most_rank: int, digits: int) -> int:
    """Rounds of blocks until one block is left."""
    n = 1
    while most_rank >> (RADIX_BITS * digits):
        most_rank >>= RADIX_BITS * digits
        n += 1
    return n


class Tree:
    """The rounds of the trees over ``leaves`` (key, rank, hash, item), one tree per key."""

    def __init__(self, leaves: DataFrame, digits: int):
        self.digits = digits
        most = leaves.agg(F.max("rank")).first()[0]
        self.rounds = [leaves]
        for _ in range(_rounds(most or 0, digits) - 1):
            up = rolled_up(self.rounds[-1], digits).select("key", F.col("block").alias("rank"), "hash", F.col("block").alias("item"))
            self.rounds.append(stored(up, "merkle-round"))

    def subroots(self) -> DataFrame:
        return rolled_up(self.rounds[-1], self.digits).select("key", "hash")

    def proofs(self, above: DataFrame) -> DataFrame:
        """``above`` (key, above) is what lies over each subroot."""
        above = above.select("key", F.lit(0).cast("long").alias("block"), "above")
        for nodes in self.rounds[:0:-1]:
            above = proofs(nodes, self.digits, above).select("key", F.col("item").alias("block"), "above")
        return proofs(self.rounds[0], self.digits, above)


def manifest(docs: DataFrame, fields: Sequence[str], group: str = "lang", id: str = "doc_id", tampered: Mapping[str, Column] | None = None,
             when: Column | None = None, digits: int = DIGITS) -> DataFrame:
    """``id``, ``leaf``, ``subroot``, ``root``, ``path`` (siblings from the leaf up), ``folded_root``, ``verified`` of each row.

    ``folded_root`` is computed from the leaf as it is with the values of ``tampered`` where ``when`` holds."""
    changed = [(tampered or {}).get(f, F.col(f)) for f in fields]
    bent = F.when(F.coalesce(when, F.lit(False)), leaf_hash(changed)) if tampered and when is not None else F.lit(None).cast("string")
    leaves = docs.select(F.col(group).cast("string").alias("key"), F.col(id).alias("id"), F.unhex(leaf_hash([F.col(f) for f in fields])).alias("leaf"), F.unhex(bent).alias("bent"))
    ranked = stored(row_index(leaves, ["key"], ["id", "leaf", "bent"], out="rank"), "merkle-leaves")
    text = lambda c: F.lower(F.hex(c))
    nodes = ranked.select("key", "rank", text("leaf").alias("hash"), F.struct("id", "bent", text("leaf").alias("leaf")).alias("item"))
    trees = Tree(nodes, digits)
    subroots = stored(trees.subroots(), "merkle-subroots")
    ordered = row_index(subroots, [], ["key"], out="rank").select(F.lit("").alias("key"), "rank", "hash", F.struct(F.col("key").alias("name")).alias("item"))
    roots = Tree(stored(ordered, "merkle-roots"), digits)
    nothing = subroots.sparkSession.createDataFrame([], f"key string, above {ABOVE}")
    above = roots.proofs(nothing).select(F.col("item.name").alias("key"), F.struct("above.path", F.lit(None).cast("string").alias("subroot"), "above.root").alias("above"))
    found = trees.proofs(stored(above, "merkle-above"))
    start = F.coalesce(text(F.col("item.bent")), F.col("item.leaf"))
    folded = F.aggregate("above.path", start, lambda h, s: F.sha2(F.when(s["left"], F.concat(s["sibling"], h)).otherwise(F.concat(h, F.coalesce(s["sibling"], F.lit("")))), 256))
    out = found.select(F.col("item.id").alias(id), F.col("item.leaf").alias("leaf"), "above.subroot", "above.root", "above.path", folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
