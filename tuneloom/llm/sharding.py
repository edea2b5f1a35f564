"""Sharding by a hierarchical weighted hash tree.

Shards hang in racks, racks in regions. A document descends from the root: at each level every child draws a number from
the hash of the document's key and the child's name, as if it waited for a time with its weight as rate, and the child
that comes first takes the document. A node weighs what the shards below it weigh. Draws belong to a child's name alone,
so a changed weight changes no other child's draw: documents move only into or out of the subtrees whose weights changed,
and keep their place within all others. A shard that joins as a region of its own takes documents only into itself.

Only DataFrame functions are used. The tree is a literal of the plan; the expressions do not grow with it. Placing needs
no shuffle; slots number the rows of each shard in the order of their keys, by ranges, so that a shard may hold any
number of rows.

Cases: null and empty texts are documents of size 1 with the checksum 0. A null doc_id is a key of its own and the first
in its shard. Rows with the same doc_id go to the same shard, by the law, and get slots of their own in the order of
checksum and size. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneloom.llm.ranks import numbered, ranked
from tuneloom.llm.text import written

LAW = "key"
SHARDS = 16
REGIONS, RACKS = 2, 2
#: Hexadecimal digits of a draw: 52 bits, exact in a double.
DIGITS = 13


class Shard(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int = SHARDS, regions: int = REGIONS, racks: int = RACKS) -> list[Shard]:
    """Shards of weight 1, dealt out evenly over the racks of the regions."""
    return [Shard(f"region{(s * regions) // shards}", f"rack{(s * regions * racks) // shards}", s) for s in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a rack and a region of its own."""
    new = max((s.shard for s in tree), default=-1) + 1
    return [*tree, Shard(f"region-of-{new}", f"rack-of-{new}", new, weight)]


def _children(tree: Iterable[Shard]) -> dict[str, dict[str, float]]:
    """The weights of each node's children, by the node's path; children without weight take nothing and are left out."""
    found: dict[str, dict[str, float]] = {}
    seen = set()
    for s in tree:
        if s.weight < 0 or s.shard in seen or any("/" in x for x in (s.region, s.rack)):
            raise ValueError(f"a shard needs a number of its own, a weight that isn't negative and names without '/': {s}")
        seen.add(s.shard)
        path = ""
        for name in (s.region, s.rack, str(s.shard)) if s.weight else ():
            found.setdefault(path, {}).setdefault(name, 0.0)
            found[path][name] += s.weight
            path = f"{path}/{name}"
    if not found:
        raise ValueError("no shard has any weight")
    return found


def waited(key: Column, path: Column, child: Column) -> Column:
    """How long the child at this path waits for the key: -ln of a number in (0, 1), its weight not yet counted."""
    drawn = F.conv(F.substring(F.md5(F.concat(path, F.lit("/"), child, F.lit(":"), key)), 1, DIGITS), 16, 10).cast("double")
    return -F.log((drawn + 0.5) / float(16**DIGITS))


def place(key: Column, tree: list[Shard]) -> Column:
    """The shard number of each key."""
    nodes = _children(tree)
    said = F.create_map(*chain.from_iterable(
        (F.lit(path), F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight")) for name, weight in sorted(children.items()))))
        for path, children in nodes.items()))

    def first_of(path: Column) -> Column:
        times = F.transform(F.element_at(said, path), lambda c: F.struct((waited(key, path, c["name"]) / c["weight"]).alias("time"), c["name"].alias("name")))
        return F.array_min(times)["name"]

    def below(path: Column) -> Column:
        # a one-row array binds the chosen path, so that a level is drawn once
        return F.transform(F.array(path), lambda p: F.concat(p, F.lit("/"), first_of(p)))[0]

    return F.element_at(F.split(below(below(below(F.lit("")))), "/"), -1).cast("int")


def key_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("-"))


def sharded(docs: DataFrame, tree: list[Shard] | None = None, after: list[Shard] | None = None) -> DataFrame:
    """One row per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (its shard in the tree `after`)."""
    tree = tree or even_tree()
    after = after or grown(tree)
    text, key = F.coalesce(F.col("text").cast("string"), F.lit("")), key_of(F.col("doc_id").cast("long"))
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        place(key, tree).alias("shard"), place(key, after).alias("grown_shard"), numbered(docs).alias("row"))
    slots = ranked(written(placed, "shard-rows"), ["shard"], ["doc_id", "text_crc32", "size", "row"], "shard-order")
    return slots.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("rank").alias("slot"), "grown_shard")
