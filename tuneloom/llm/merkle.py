"""Merkle manifest of a table: levels built bottom-up, and a proof for every row by a recursive query that climbs them.

A row is a leaf: the digest of its columns. The leaves of a language, in the order of doc_id, form a tree in which every
`RUN` consecutive nodes of a level become one node of the next; its last node is the subroot. The subroots, in the order
of the languages, form the tree of the root in the same way.

`build` writes each level as rows that link to their parent: the place of the node, the digests of its children, its own
place among its parent's children, its parent. Two joins of that table with itself then string `HOP` ancestors together,
so that `climb`, a recursive query, ascends `HOP` levels in each of its steps: every leaf appends the digests of its
siblings to its proof and folds its own digest, which may be that of a tampered row, with them up to the root. A proof
that has come to the root is put down to its digest. Spark shuffles the rows of each step of a recursive query; a step of
one level would move every proof as often as the tree has levels.

Nodes near the root are met by every leaf below them. Such a node stands in the climbed table once for every `SPREAD`
leaves below it, and the leaves are dealt out over these copies, so no key of the join holds more than `SPREAD` rows; the
copies are at most as many as the nodes `SPREAD` leaves above the ground.

H is the lowercase hex sha256 of the concatenated inputs, digests as hex text. Tables hold digests as 32 bytes.

Cases: null is `-` in any column, so null differs from an empty text. A null doc_id is the first of its language; rows
with the same doc_id are ordered by their digest, and equal rows are leaves of their own with neighbouring places. A null
language is a tree of its own and the first. A language of one row has its leaf as subroot, one language its subroot as
root, one row its leaf as root, with an empty proof. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneloom.llm.ranks import numbered, ranked, written_rows
from tuneloom.llm.text import sent_if_few, written
from tuneloom.session import shuffle_width

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 8
#: Levels that a step of the recursive query climbs, a power of two.
HOP = 4
SPREAD = 1 << 15
_ROWS = "spark.sql.cteRecursionRowLimit"


def digest(parts: Column) -> Column:
    return F.unhex(F.sha2(parts, 256))


def as_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf_digest(values: dict[str, Column]) -> Column:
    """The digest of a row from its columns as text."""
    said = (F.coalesce(F.concat(F.octet_length(values[c]).cast("string"), F.lit(":"), values[c]), F.lit("-")) for c in COLUMNS)
    return digest(F.concat(*said))


def leaves_of(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, lang, leaf, tampered_leaf (null where nothing changes) and a number of its own for each row.

    `tampered` chooses the rows whose text loses its upper case A-Z.
    """
    values = {c: F.col(c).cast("string") for c in COLUMNS}
    lowered = values | {"text": F.translate(values["text"], string.ascii_uppercase, string.ascii_lowercase)}
    changed = F.lit(False) if tampered is None else tampered
    made = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), values["lang"].alias("lang"), leaf_digest(values).alias("leaf"),
        F.when(changed, leaf_digest(lowered)).alias("tampered_leaf"), numbered(docs).alias("row"))
    return written(made, "merkle-leaves")


_NODE = "struct<tree:long,level:int,place:long>"


def node(tree: Column, level: Column, place: Column) -> Column:
    return F.struct(tree.cast("long").alias("tree"), level.cast("int").alias("level"), place.cast("long").alias("place"))


def _levels(ground: DataFrame, nodes: int, most: int, trees: int, label: str) -> Iterator[tuple[DataFrame, int]]:
    """The written levels above the `nodes` rows of `ground` (tree, place, digest, below, width) and about their rows; the widest tree has `most` nodes."""
    level = ground
    for height in range(1, 64):
        if most <= 1:
            return
        parent = F.floor(F.col("place") / RUN).cast("long")
        children = F.array_sort(F.collect_list(F.struct("place", "digest")))["digest"]
        runs = level.where("width > 1").groupBy("tree", parent.alias("place"), F.ceil(F.col("width") / RUN).cast("long").alias("width")).agg(
            F.concat_ws("", F.transform(children, F.hex)).alias("_run"), F.sum("below").alias("below"))
        most, nodes = -(-most // RUN), nodes // RUN + trees
        level = written_rows(runs.select(
            "tree", F.lit(height).alias("level"), "place", F.unhex("_run").alias("run"), digest(F.lower("_run")).alias("digest"), "below", "width"), f"{label}-{height}", nodes)
        yield level, nodes


class Manifest(NamedTuple):
    """The built trees: `leaves` (with tree and place), about `count` `nodes`, `subroots` (tree, digest) and `root` as hex text, None without rows."""

    leaves: DataFrame
    nodes: DataFrame
    count: int
    subroots: DataFrame
    trees: int
    root: str | None


def build(leaves: DataFrame) -> Manifest:
    """The trees over `leaves` (written; doc_id, lang, leaf, row and any others)."""
    placed = ranked(leaves, ["lang"], ["doc_id", "leaf", "row"], "merkle-order")
    langs = written(placed.groupBy("lang").agg(F.first("members").alias("size")), "merkle-langs")
    trees, total, most = langs.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    named = written_rows(ranked(langs, [], ["lang"], "merkle-lang-order").select(F.col("lang").alias("_lang"), (F.col("rank") + 1).alias("tree")), "merkle-trees", trees)
    placed = placed.join(sent_if_few(named), F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang").withColumnsRenamed({"rank": "place", "members": "width"})
    ground = placed.select("tree", "place", F.col("leaf").alias("digest"), F.lit(1).cast("long").alias("below"), "width")
    low = list(_levels(ground, total, most, trees, "merkle-level"))
    top = ["tree", "digest", "below"]
    subroots = ground.where("width = 1").select(*top)
    for level, _ in low:
        subroots = subroots.unionByName(level.where("width = 1").select(*top))
    subroots = written_rows(subroots, "merkle-subroots", trees)
    high = list(_levels(subroots.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("place"), "digest", "below", F.lit(trees).cast("long").alias("width")), trees, trees, 1, "merkle-top"))
    last = (high[-1][0] if high else subroots).select("digest").first()
    nodes = leaves.sparkSession.createDataFrame([], f"node {_NODE}, run binary, up long, parent {_NODE}, below long")
    for level, _ in [*low, *high]:
        nodes = nodes.unionByName(level.select(node(F.col("tree"), F.col("level"), F.col("place")).alias("node"), "run", *_link(F.col("level"), trees), "below"))
    count = sum(n for _, n in [*low, *high])
    return Manifest(placed, written_rows(nodes, "merkle-nodes", count), count, subroots.select("tree", "digest"), trees, last["digest"].hex() if last else None)


def _link(level: Column, trees: int) -> tuple[Column, Column]:
    """The place among the parent's children, and the parent: of the last node of a language the one above the subroots."""
    tree, place, width = F.col("tree"), F.col("place"), F.col("width")
    over = (tree > 0) & F.lit(trees > 1)
    up = F.when(width > 1, place % RUN).when(over, (tree - 1) % RUN)
    parent = F.when(width > 1, node(tree, level + 1, F.floor(place / RUN))).when(over, node(F.lit(0), F.lit(1), F.floor((tree - 1) / RUN)))
    return up.alias("up"), parent.alias("parent")


def hops(nodes: DataFrame, count: int) -> DataFrame:
    """For each of `count` nodes and each copy the `HOP` runs above its children, as far as the tree goes, and the node to go on with."""
    made = nodes.select("node", F.array(F.struct("run", "up")).alias("steps"), F.col("parent").alias("next"), "below")
    for _ in range(HOP.bit_length() - 1):
        above = made.select(F.col("node").alias("next"), F.col("steps").alias("_more"), F.col("next").alias("_next"))
        made = written_rows(made.join(above, "next", "left").select(
            "node", F.when(F.col("_more").isNull(), F.col("steps")).otherwise(F.concat("steps", "_more")).alias("steps"), F.col("_next").alias("next"), "below"), "merkle-hops", count)
    sizes = nodes.select(F.col("node").alias("next"), _copies(F.col("below")).alias("next_copies"))
    made = made.join(sizes, "next", "left").select("node", "steps", "next", F.coalesce("next_copies", F.lit(1).cast("long")).alias("next_copies"), "below")
    return written_rows(made.select("node", F.explode(F.sequence(F.lit(0).cast("long"), _copies(F.col("below")) - 1)).alias("copy"), "steps", "next", "next_copies"), "merkle-climb", count)


def _copies(below: Column) -> Column:
    return F.ceil(below / SPREAD).cast("long")


_CLIMB = """
WITH RECURSIVE climb (doc_id, row, tree, leaf, next, copies, up, folded, proof) AS (
  SELECT doc_id, row, tree, leaf, next, CAST(1 AS BIGINT), up, folded, if(next IS NULL, unhex(sha2('', 256)), CAST('' AS BINARY)) FROM {leaves}
  UNION ALL
  SELECT doc_id, row, tree, leaf, next, copies, went.up, went.folded, if(next IS NULL, unhex(sha2(lower(hex(went.proof)), 256)), went.proof) FROM (
    SELECT c.doc_id, c.row, c.tree, c.leaf, h.next, h.next_copies AS copies, aggregate(
      h.steps, named_struct('up', c.up, 'folded', c.folded, 'proof', c.proof), (a, s) -> named_struct(
        'up', s.up,
        'folded', unhex(sha2(lower(hex(concat(substring(s.run, 1, CAST(32 * a.up AS INT)), a.folded, substring(s.run, CAST(32 * a.up + 33 AS INT))))), 256)),
        'proof', concat(a.proof, substring(s.run, 1, CAST(32 * a.up AS INT)), substring(s.run, CAST(32 * a.up + 33 AS INT))))) AS went
    FROM climb c JOIN {hops} h ON h.node = c.next AND h.copy = c.row % c.copies)
)
SELECT doc_id, tree, leaf, lower(hex(folded)) AS folded_root, lower(hex(proof)) AS proof_sha256 FROM climb WHERE next IS NULL
"""


@contextmanager
def _all_rows(spark: SparkSession) -> Iterator[None]:
    """The recursive query's limit on rows is lifted as long as it runs."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, "-1")
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def climb(made: Manifest) -> DataFrame:
    """doc_id, tree, leaf, folded_root and proof_sha256 of every leaf: folded from tampered_leaf where it is not null."""
    spark = made.leaves.sparkSession
    start = made.leaves.withColumn("level", F.lit(0)).select(
        "doc_id", "row", "tree", "leaf", *_link(F.lit(0), made.trees), F.coalesce("tampered_leaf", "leaf").alias("folded")).withColumnRenamed("parent", "next")
    with _all_rows(spark):
        proofs = spark.sql(_CLIMB, leaves=start, hops=hops(made.nodes, made.count))
        return written(proofs.coalesce(shuffle_width(spark)), "merkle-proofs")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (see the module)."""
    made = build(leaves_of(docs, tampered))
    proofs = climb(made).join(sent_if_few(made.subroots.withColumnRenamed("digest", "_subroot")), "tree")
    root = F.lit(made.root).cast("string")
    return proofs.select("doc_id", as_text(F.col("leaf")).alias("leaf"), as_text(F.col("_subroot")).alias("subroot"), root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
