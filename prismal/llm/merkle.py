"""Merkle manifest of a dataset over a radix-ranked trie.

Rows are leaves.  Within a group they are ranked by id without a global sort:
histograms over the digits of the ids give every cell of ids the number of rows
before it, summed digit by digit from the root of the digits' tree down; rows are
ordered only within their cell, and cells that hold too many rows get further
digits, of the id, then of the leaf's digest.  The digits of a rank to the base of
the fanout are the key of a node: nodes that share all digits but the last ``DEPTH``
are reduced together, level by level, and what they give is reduced the same way
by its shorter prefix.  Subroots of the groups are the leaves of a last trie.

The siblings on the way up are handed down the same prefixes, so every row gets
its proof, which is folded from a possibly altered leaf to a root again.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismal.llm.common import BROADCAST_IDS, _arrow_schema, ranked, release, ship, written

#: Levels that one task reduces at once: 4096 nodes at most with a fanout of 8.
DEPTH = 4
#: Rows a cell of ids should hold, and beyond which it gets a further digit.
CELL, HEAVY = 1 << 10, 1 << 14
#: Bits of a digit.
DIGIT = 8
#: Copies of a row that one task writes out.
COPIES = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

STEP = "array<struct<l:string,r:string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value; integers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """The 32 bytes of a leaf's SHA-256."""
    return F.unhex(F.sha2(F.concat(*map(encoded, values)), 256))


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def _cells(rows: DataFrame) -> DataFrame:
    """Rows with ``cell``, the digits of their id's prefix: arrays that ascend as ids do, few rows to each."""
    known = rows.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).first()
    low, high = known.low or 0, known.high or 0
    # one bit at least stays, so that the sign orders the cells
    shift = min(63, math.ceil(math.log2(max(1, (high - low + 1) * CELL / max(1, known.n)))))
    # rows without an id follow the largest one
    own = F.coalesce("id", F.lit(high))
    first = F.shiftright(own, shift) - (low >> shift)
    rows = rows.withColumn("cell", F.array(first.cast("long")))
    digits = []
    while shift:
        step = min(DIGIT, shift)
        shift -= step
        digits.append(F.shiftright(own, shift).bitwiseAND((1 << step) - 1))
    digits.append(F.col("id").isNull().cast("long"))
    digits += [F.conv(F.hex(F.substring("leaf", i + 1, 1)), 16, 10).cast("long") for i in range(32)]
    for digit in digits:
        heavy = rows.groupBy("grp", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY)
        heavy = written(heavy.select("grp", "cell", F.lit(True).alias("heavy")), "cells")
        n = heavy.count()
        if not n:
            break
        both = rows.join(F.broadcast(heavy) if n <= BROADCAST_IDS else heavy, ["grp", "cell"], "left")
        deeper = F.when(F.col("heavy"), F.concat("cell", F.array(digit.cast("long")))).otherwise(F.col("cell"))
        rows = written(both.withColumn("cell", deeper).select(*rows.columns), "digits")
    return rows


def _starts(rows: DataFrame) -> DataFrame:
    """``grp, cell, start, total``: rows of the group before a cell, and in all, by histograms of ever fewer digits."""
    cells = written(rows.groupBy("grp", "cell", F.get("cell", F.lit(0)).alias("d0")).agg(F.sum("n").alias("n")), "histogram")
    top = cells.agg(F.max("d0")).first()[0] or 0

    def before(*key: str) -> Column:
        order = W.partitionBy(*key[:-1]).orderBy(key[-1]).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(order), F.lit(0))

    levels = [cells.withColumn("inner", before("grp", "d0", "cell"))]
    counts, depth = cells.groupBy("grp", "d0").agg(F.sum("n").alias("n")), 0
    while True:
        counts = counts.withColumn("up", F.shiftright("d0", DIGIT))
        levels.append(counts.withColumn("inner", before("grp", "up", "d0")))
        counts = counts.groupBy("grp", F.col("up").alias("d0")).agg(F.sum("n").alias("n"))
        depth += 1
        if top >> (DIGIT * depth) == 0:
            break
    at = counts.select("grp", "d0", F.lit(0).cast("long").alias("start"), F.col("n").alias("total"))
    for level in levels[:0:-1]:
        at = level.join(at.withColumnRenamed("d0", "up"), ["grp", "up"]).select("grp", "d0", (F.col("start") + F.col("inner")).alias("start"), "total")
    return levels[0].join(at, ["grp", "d0"]).select("grp", "cell", (F.col("start") + F.col("inner")).alias("start"), "total")


def ranks(rows: DataFrame) -> DataFrame:
    """``grp, id, leaf, other, rank, total`` of rows ``grp, id, leaf, other``: their place in the group by id, null last, then digest.

    Equal rows are folded to one with their number before anything is ordered and
    written out again at the end, many by several tasks.
    """
    once = written(rows.groupBy("grp", "id", "leaf", "other").agg(F.count("*").alias("n")), "leaves")
    placed = _cells(once)
    order = W.partitionBy("grp", "cell").orderBy(F.col("id").asc_nulls_last(), "leaf", "other").rowsBetween(W.unboundedPreceding, -1)
    own = placed.withColumn("inner", F.coalesce(F.sum("n").over(order), F.lit(0))).join(_starts(placed), ["grp", "cell"])
    own = own.select("grp", "id", "leaf", "other", "n", (F.col("start") + F.col("inner")).alias("rank"), "total")
    many = once.filter(F.col("n") > COPIES).limit(1).count()
    few = own.filter(F.col("n") <= COPIES) if many else own
    out = few.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    if many:
        hot = own.filter(F.col("n") > COPIES).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
        part = F.sequence(F.col("part") * COPIES, F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1)
        out = out.unionByName(hot.repartition("grp", "rank", "part").withColumn("copy", F.explode(part)).drop("part"))
    return out.select("grp", "id", "leaf", "other", (F.col("rank") + F.col("copy")).alias("rank"), "total")


def reduced(nodes: list[bytes], levels: int, fanout: int) -> list[list[bytes]]:
    """The nodes of every level from ``nodes`` up, hexadecimal digests; ``levels`` times runs become their digest."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([sha256(b"".join(last[i : i + fanout])).hexdigest().encode() for i in range(0, len(last), fanout)])
    return out


def path(levels: list[list[bytes]], at: int, fanout: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of the node ``at`` in its run, then of its parent, up to the root of ``levels``."""
    out = []
    for level in levels[:-1]:
        run = at - at % fanout
        out.append((b"".join(level[run:at]), b"".join(level[at + 1 : run + fanout])))
        at //= fanout
    return out


def fold(leaf: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, right in steps:
        leaf = sha256(left + leaf + right).hexdigest().encode()
    return leaf


def proof_digest(steps: list[tuple[bytes, bytes]]) -> str:
    return sha256(b"".join(x for step in steps for x in step)).hexdigest()


def _mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` of each row, a dictionary, yields rows of ``schema``, tuples."""
    ship(df.sparkSession)
    shape = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(fn(batch.slice(i, 1).to_pylist()[0]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)
        release()

    return df.mapInArrow(run, schema)


def _height(total: int, fanout: int) -> int:
    height = 0
    while fanout**height < total:
        height += 1
    return height


class Trie:
    """Nodes ``grp, rank, node`` (bytes) and ``total``, reduced prefix by prefix; further columns ride along at the bottom."""

    def __init__(self, leaves: DataFrame, fanout: int, riders: tuple[str, ...] = ()):
        self.fanout = fanout
        self.width = fanout**DEPTH
        #: Tables of blocks from the leaves up: ``grp, block, total, nodes``.
        self.blocks: list[DataFrame] = []
        nodes, riders = leaves, ("node", *riders)
        while True:
            block = F.floor(F.col("rank") / self.width).cast("long")
            found = nodes.groupBy("grp", block.alias("block")).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("rank", *riders))).alias("nodes"))
            found = written(found, "blocks")
            self.blocks.append(found)
            roots = written(self._roots(found), "roots")
            if not roots.filter(F.col("total") > 1).limit(1).count():
                break
            nodes, riders = roots.select("grp", F.col("block").alias("rank"), "node", "total"), ("node",)
        #: Root of each group, once its prefix is empty: a group that is whole early is carried up unchanged.
        self.roots = roots.select("grp", "node")

    def _roots(self, blocks: DataFrame) -> DataFrame:
        fanout, width = self.fanout, self.width

        def root(row: dict) -> Iterator[tuple]:
            total = row["total"]
            levels = reduced([n["node"].hex().encode() for n in row["nodes"]], min(DEPTH, _height(total, fanout)), fanout)
            yield row["grp"], row["block"], bytes.fromhex(levels[-1][0].decode()), -(-total // width)

        return _mapped(blocks.select("grp", "block", "total", F.transform("nodes", lambda x: F.struct(x["node"].alias("node"))).alias("nodes")), root, "grp string, block long, node binary, total long")

    def steps(self, above: DataFrame, finish, schema: str) -> DataFrame:
        """Hand ``above`` (``grp, steps, subroot``: a group root's own way up) down to the leaves; ``finish(node, steps, subroot)`` gives their rows."""
        fanout = self.fanout
        down = above.select("grp", F.lit(0).cast("long").alias("block"), "steps", "subroot")
        for depth in range(len(self.blocks) - 1, -1, -1):
            last = depth == 0

            def hand(row: dict, last=last) -> Iterator[tuple]:
                upper = [(s["l"].encode(), s["r"].encode()) for s in row["steps"]]
                levels = reduced([n["node"].hex().encode() for n in row["nodes"]], min(DEPTH, _height(row["total"], fanout)), fanout)
                for at, node in enumerate(row["nodes"]):
                    own = path(levels, at, fanout) + upper
                    if last:
                        yield finish(node, own, row["subroot"])
                    else:
                        yield row["grp"], node["rank"], [{"l": a.decode(), "r": b.decode()} for a, b in own], row["subroot"]

            given = _mapped(self.blocks[depth].join(down, ["grp", "block"]), hand, schema if last else f"grp string, block long, steps {STEP}, subroot string")
            down = given if last else written(given, "steps")
        return down


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, altered: dict[str, Column] | None = None, fanout: int = 8) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root that its present values fold to.

    Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.
    A leaf is the digest of ``fields``; leaves of a group ascend by id, and groups
    by name, a null first, byte by byte.  ``altered`` gives present values of
    fields that are checked against the manifest: where they differ from what was
    recorded, the folded root differs and ``verified`` is false.

    Nulls in any field have a form of their own.  Rows with a null id stand last
    in their group; rows that share an id are ordered by their digests; equal
    rows are leaves each.  A group of one row is its leaf, a table of one group
    its subroot.  Texts count whole.  Other columns are ignored, whatever their
    names; an empty table gives no row.
    """
    now = {f: F.col(f) for f in fields} | (altered or {})
    leaf, other = leaf_digest(*(F.col(f) for f in fields)), leaf_digest(*(now[f] for f in fields))
    # a null group sorts before all named ones
    group = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    changed = ~F.lit(False)
    if altered:
        changed = F.lit(False)
        for f, value in altered.items():
            changed = changed | ~value.eqNullSafe(F.col(f))
    rows = docs.select(group.alias("grp"), F.col(id_col).cast("long").alias("id"), leaf.alias("leaf"), (F.when(changed, other) if altered else F.lit(None).cast("binary")).alias("other"))
    trie = Trie(ranks(rows).withColumnRenamed("leaf", "node"), fanout, ("id", "other"))
    groups = ranked(trie.roots, "grp").withColumn("total", F.lit(trie.roots.count()))
    upper = Trie(groups.select(F.lit("").alias("grp"), "rank", "node", "total", F.col("grp").alias("name")), fanout, ("name",))
    found = upper.roots.first()
    root = found.node.hex() if found else ""

    def climb(node: dict, own: list, _: str) -> tuple:
        return node["name"], [{"l": a.decode(), "r": b.decode()} for a, b in own], node["node"].hex()

    top = docs.sparkSession.createDataFrame([("", [], "")], f"grp string, steps {STEP}, subroot string")
    above = written(upper.steps(top, climb, f"grp string, steps {STEP}, subroot string"), "above")

    def close(node: dict, own: list, subroot: str) -> tuple:
        folded = fold((node["other"] or node["node"]).hex().encode(), own).decode()
        return node["id"], node["node"].hex(), subroot, root, proof_digest(own), folded, folded == root

    return trie.steps(above, close, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampered_text(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, A-Z lower-cased where 3 divides the CRC-32 of the decimal id."""
    return F.when(F.crc32(F.col(id_col).cast("string")) % 3 == 0, lower_ascii(F.col(text_col))).otherwise(F.col(text_col))


def manifest_sql(levels: int = 8, tops: int = 3, fanout: int = 8) -> str:
    """The manifest of table ``documents``, texts tampered with by the rule above, as DuckDB SQL; for ``fanout ** levels`` rows a group at most."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def digest(text: str) -> str:
        coded = " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in (*FIELDS[:-1], text))
        return f"sha256({coded})"

    def trie(name: str, n: int) -> str:
        """Levels ``{name}1`` to ``{name}{n}`` over ``{name}0`` (grp, rank, node); each with what stands left and right."""
        out = []
        for j in range(n):
            run = f"PARTITION BY grp, rank // {fanout} ORDER BY rank"
            out.append(f"""
{name}{j}s AS (SELECT grp, rank, node, count(*) OVER (PARTITION BY grp) > 1 AS more,
  coalesce(string_agg(node, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(node, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{j}),
{name}{j + 1} AS (SELECT grp, rank // {fanout} AS rank, CASE WHEN bool_or(more) THEN sha256(string_agg(node, '' ORDER BY rank)) ELSE min(node) END AS node FROM {name}{j}s GROUP BY 1, 2)""")
        return ",".join(out)

    def climb(of: str, name: str, n: int) -> str:
        """Steps ``{of}1`` to ``{of}{n}``: rows of ``{of}0`` (key, grp, rank, folded, proof) through the levels of a trie."""
        return ",".join(f"""
{of}{j + 1} AS (SELECT w.row, w.grp, w.rank // {fanout} AS rank, CASE WHEN s.more THEN sha256(s.l || w.folded || s.r) ELSE w.folded END AS folded,
  CASE WHEN s.more THEN w.proof || s.l || s.r ELSE w.proof END AS proof FROM {of}{j} w JOIN {name}{j}s s ON s.rank = w.rank AND s.grp = w.grp)""" for j in range(n))

    return f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
summed AS (SELECT d.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS sum FROM documents d, crc),
leaves AS (SELECT doc_id, coalesce('+' || lang, '') AS grp, {digest("text")} AS node,
  {digest(f"CASE WHEN sum % 3 = 0 THEN translate(text, '{upper}', '{upper.lower()}') ELSE text END")} AS other FROM summed),
placed AS (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS LAST, node) - 1 AS rank FROM leaves),
a0 AS (SELECT grp, rank, node FROM placed),{trie("a", levels)},
b0 AS (SELECT '' AS grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS rank, node, grp AS name FROM a{levels}),{trie("b", tops)},
u0 AS (SELECT row, grp, rank, other AS folded, '' AS proof FROM placed),{climb("u", "a", levels)},
v0 AS (SELECT u.row, b.grp, b.rank, u.folded, u.proof FROM u{levels} u JOIN b0 b ON b.name = u.grp),{climb("v", "b", tops)}
SELECT p.doc_id, p.node AS leaf, s.node AS subroot, t.node AS root, sha256(v.proof) AS proof_sha256, v.folded AS folded_root, v.folded = t.node AS verified
FROM placed p JOIN v{tops} v USING (row) JOIN a{levels} s ON s.grp = p.grp, b{tops} t"""
