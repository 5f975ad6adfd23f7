"""A Merkle manifest of a dataset: digests of rows, one tree a group, one tree over the groups, and proofs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

RUN = 16  # neighbouring nodes that make one of the next level
DEPTH = 2  # levels that a block collapses
BLOCK = RUN**DEPTH  # nodes of a block
_PATH = "array<struct<left: string, right: string>>"


def _field(value: Column) -> Column:
    """`-` of a null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values' fields behind one another."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def positions(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes with pos, the place of each among its key's in the given order, and n, how many the key has.

    Rows are dealt by ranges of (key, *order), so a key with a third of all rows lies in many tasks; of each task only the number of rows
    of each key is summed over the tasks before it. Rows that are equal in `order` need a last column that tells them apart."""
    ranged = nodes.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "ranged")
    parts = ranged.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("key")
    before = F.sum("rows").over(whole.orderBy("part")) - F.col("rows")
    parts = parts.select("key", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    return ranged.join(parts, ["key", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _runs(nodes: Column) -> Column:
    """The digests of every RUN neighbouring nodes."""
    starts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / F.lit(RUN)).cast("int"))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(nodes, i * RUN + 1, RUN), ""), 256))


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """Blocks of BLOCK neighbouring nodes: key, n (nodes of the key on this level), block, rows (the nodes in order, with the columns `more`), levels (the
    block's nodes, then each level above them), root. A key's last block climbs as high as the others, even with one node; a lone node stays as it is."""
    row = F.struct("pos", "node", *more)
    rows = nodes.groupBy("key", "n", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    depth = F.when(F.col("n") <= 1, 0).when(F.col("n") <= RUN, 1).otherwise(DEPTH)
    climbs = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    first = F.array(F.transform("rows", lambda r: r["node"]))
    levels = F.aggregate(climbs, first, lambda found, _: F.concat(found, F.array(_runs(F.element_at(found, -1)))))
    return rows.withColumn("levels", levels).withColumn("root", F.element_at(F.element_at("levels", -1), 1))


def climb(nodes: DataFrame, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """(written tables of blocks, each built on the roots of the one before; key, node: the root of each key's tree). A round divides the nodes by BLOCK."""
    tables = [written(_blocks(nodes, *more), "blocks")]
    while True:
        up = tables[-1].where(F.col("n") > BLOCK)
        if up.isEmpty():
            break
        above = F.expr(f"(n + {BLOCK - 1}) div {BLOCK}")
        tables.append(written(_blocks(up.select("key", F.col("block").alias("pos"), F.col("root").alias("node"), above.alias("n"))), "blocks"))
    roots = [t.where(F.col("n") <= BLOCK).select("key", F.col("root").alias("node")) for t in tables]
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return tables, out


def _siblings(levels: Column, j: Column) -> Column:
    """What stands left and right of node j's ancestors within their runs, level by level; j counts within the block."""

    def of(nodes: Column, d: Column) -> Column:
        i = F.floor(j / F.pow(F.lit(RUN), d)).cast("int")
        k = i % RUN
        return F.struct(F.array_join(F.slice(nodes, i - k + 1, k), "").alias("left"), F.array_join(F.slice(nodes, i + 2, RUN - 1 - k), "").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), of)


def descend(tables: list[DataFrame], tops: DataFrame) -> DataFrame:
    """One row per node of the lowest level: key, row, path (left and right siblings up to the root) and the columns of tops.

    tops: key, path (siblings above the key's own tree) and columns to carry down. Paths of blocks are joined from above, level by level."""
    carried = [c for c in tops.columns if c not in ("key", "path")]
    known = None
    for k in range(len(tables) - 1, -1, -1):
        own = tables[k].where(F.col("n") <= BLOCK).select("key", "block").join(tops, "key")
        known = own if known is None else own.unionByName(known)
        met = tables[k].drop("root").join(known, ["key", "block"])
        paths = F.transform("rows", lambda r, j: F.struct(r.alias("row"), F.concat(_siblings(F.col("levels"), j), F.col("path")).alias("path")))
        met = met.select("key", F.explode(paths).alias("x"), *carried).select("key", "x.row", "x.path", *carried)
        if k:
            known = written(met.select("key", F.col("row.pos").alias("block"), "path", *carried), "paths")
    return met


def fold(path: Column, node: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(path, node, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(
    docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "source", order: str = "doc_id"
) -> DataFrame:
    """One row per row of docs: doc_id, leaf (the digest of the columns), tampered (that of the row with lower-case text, for every fifth id
    by crc32; else null), path, subroot, root.

    Leaves of one key ascend by `order`; nodes are digests of RUN neighbours until one remains, the subroot. Subroots in the order of their
    keys make the root in the same way. Fixed blocks of ordered digests collapse DEPTH levels each, and the roots of blocks make the next
    blocks, so trees of any size need no task with more than a block; a key that holds a third of all rows is dealt by ranges (see
    `positions`). Texts are read once, and only digests are shuffled.

    Nulls of any column count as `-`, a null key comes first, null ids first within their key, and are never tampered with. Rows of equal
    key and id stand by digest; equal rows are interchangeable. A lone leaf is its key's subroot; a lone subroot is the root. Empty table:
    no rows. Other columns are not read."""
    fields = {c: docs[c].cast("long") if c in ("doc_id", "n_chars") else docs[c].cast("string") for c in columns}
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    chosen = F.crc32(fields[order].cast("string").cast("binary")) % 5 == 0
    changed = fields | {"text": F.translate(fields["text"], upper, lower)}
    # a key's own mark keeps null apart from, and before, the empty string
    marked = F.coalesce(F.concat(F.lit("k"), docs[key].cast("string")), F.lit(""))
    leaves = docs.select(
        fields[order].alias("id"), marked.alias("key"), digest(*fields.values()).alias("node"),
        F.when(chosen, digest(*changed.values())).alias("tampered")
    )
    leaves = written(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    tables, subroots = climb(positions(leaves, "id", "node", "tie"), "id", "tampered")
    # the subroots are the leaves of one tree, whose rows keep their own key
    leads = positions(subroots.select(F.lit("").alias("key"), F.col("key").alias("name"), "node"), "name")
    over, root = climb(leads, "name")
    known = descend(over, root.select("key", F.array().cast(_PATH).alias("path"), F.col("node").alias("root")))
    tops = known.select(F.col("row.name").alias("key"), "path", F.col("row.node").alias("subroot"), "root")
    rows = descend(tables, written(tops, "tops"))
    return rows.select(F.col("row.id").alias("doc_id"), F.col("row.node").alias("leaf"), F.col("row.tampered").alias("tampered"), "path", "subroot", "root")


def verified(rows: DataFrame) -> DataFrame:
    """Rows of `manifest` with proof_sha256 (of all siblings), folded_root (from the tampered leaf, where there is one, and the original
    siblings) and verified."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    rows = rows.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": fold(F.col("path"), F.coalesce("tampered", "leaf"))})
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
