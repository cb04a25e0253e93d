"""Sharding by a hierarchical weighted hash tree.

Each level draws for each child -ln(u) / weight, u from a hash of (key, child),
and descends to the least. A child's draw does not depend on its siblings, so a
changed weight moves rows only into or out of that child's subtree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. Inner nodes weigh as much as what they hold."""

    name: str
    weight: float = 1.0
    children: tuple["Node", ...] = ()
    shard: int | None = None

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def tree(shards: int, racks: int = 2, per_rack: int = 5, built: int | None = None) -> Node:
    """Regions of ``racks`` x ``per_rack`` shards for the first ``built`` shards (all by default).

    Each further shard is a region of its own, so it takes rows only into itself
    while every other weight stays as it was.
    """
    built = shards if built is None else min(built, shards)
    leaf = [Node(f"s{i}", shard=i) for i in range(shards)]
    regions = []
    for r, a in enumerate(range(0, built, racks * per_rack)):
        last = min(a + racks * per_rack, built)
        regions.append(Node(f"r{r}", children=tuple(Node(f"r{r}.k{k}", children=tuple(leaf[b : min(b + per_rack, last)])) for k, b in enumerate(range(a, last, per_rack)))))
    regions += [Node(f"x{i}", children=(Node(f"x{i}.k0", children=(leaf[i],)),)) for i in range(built, shards)]
    return Node("root", children=tuple(regions))


def draw(key: Column, name: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from the first 13 hexadecimal digits of an MD5."""
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", key, name).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.ln((digits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def drawn(df: DataFrame, key: Column, node: Node, out: str) -> DataFrame:
    """Adds column ``out``, the shard that ``key`` comes to.

    The tree is a literal map from a node to its children, so the expression has
    one draw a level, whatever the number of nodes. All leaves lie equally deep.
    """
    level, held = [node], f"__{out}_key"
    at = F.lit(node.name)
    df = df.withColumn(held, key)
    while level[0].children:
        table = []
        for n in level:
            live = [c for c in n.children if c.total > 0]
            if not live:
                raise ValueError(f"{n.name} has no weight")
            table += [F.lit(n.name), F.array(*(F.struct(F.lit(c.name).alias("n"), F.lit(float(c.total)).alias("w")) for c in live))]
        least = F.array_min(F.transform(F.create_map(*table)[at], lambda c: F.struct(draw(F.col(held), c["n"], c["w"]).alias("d"), c["n"].alias("n"))))
        at = least["n"]
        level = [c for n in level for c in n.children if c.total > 0]
        if len({bool(n.children) for n in level}) > 1:
            raise ValueError("leaves lie at different depths")
    numbers = F.create_map(*(F.lit(x) for n in level for x in (n.name, n.shard)))
    return df.withColumn(out, numbers[at].cast("int")).drop(held)


def assign(docs: DataFrame, node: Node, grown: Node | None = None, key: str = "doc_id", text: str = "text", blocks: int = 64) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row.

    Native columns only, and texts are never shuffled. Size is the UTF-8 length
    plus 16 (null text: 16, checksum 0). A null key is drawn as the empty string.
    Rows that repeat get slots of their own. Slots are gapless from 0 in each
    shard: rows are numbered within (shard, block), a block being a hash range of
    the key, and shifted by the sizes of the blocks before; those counts are at
    most shards x ``blocks`` rows, whatever the input.
    """
    sized = docs.select(
        F.col(key).alias("__key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(F.col(text), "utf-8")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    name = F.coalesce(F.col("__key").cast("string"), F.lit(""))
    placed = drawn(sized, name, node, "shard")
    placed = drawn(placed, name, grown, "grown_shard") if grown is not None else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    placed = placed.withColumn("__block", F.conv(F.substring(F.md5(F.concat(F.lit("block|"), name, F.lit("|"), F.col("text_crc32").cast("string")).cast("binary")), 1, 6), 16, 10).cast("long") % blocks)
    counts = placed.groupBy("shard", "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("shard", "__block").orderBy("__key", "text_crc32", "size")
    return (
        placed.withColumn("__row", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "__block"])
        .select(F.col("__key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__before") + F.col("__row") - 1).cast("long").alias("slot"), "grown_shard")
    )
