"""SimHash near-duplicates, linked exactly through vantage-point trees.

Fingerprints are 64-bit sums of XXH64 shingle hashes.  Distinct fingerprints
are dealt to shards by a vantage-point tree over the Hamming metric that is
built from a bounded sample; a fingerprint has one home shard, and the triangle
bound says which other shards it has to visit because their region comes within
the radius.  Within a shard the same tree search goes on in NumPy.  Shards give
spanning links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import BROADCAST_IDS, connected_components, join_split, map_rows, ship, written

SEED = 42
#: Fingerprints the driver may hold while it places vantage points.
SAMPLE = 20_000
#: Rows that a shard should hold; leaves are split or salted until they do.
SHARD_ROWS = 64_000
#: Homes below which a shard compares directly.
DIRECT = 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, repeats included, in blocks of bounded size."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return
    xx, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < size:
        yield np.array([xx(join(words), SEED)], np.uint64)
        return
    n = len(words) - size + 1
    for at in range(0, n, 1 << 16):
        stop = min(n, at + (1 << 16))
        yield np.fromiter((xx(join(words[i : i + size]), SEED) for i in range(at, stop)), np.uint64, stop - at)


def simhash(text: str | None, size: int = 3) -> int:
    """Fingerprint of one text as an unsigned integer; without words it is zero."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, size):
        n += len(h)
        b = h.view(np.uint8).reshape(-1, 8)
        if len(h) < 1500:
            ones += np.unpackbits(b, axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:
            ones += np.concatenate([np.bincount(b[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Columns ``doc_id``, ``t`` (the text's XXH64) and ``fp`` (the fingerprint's bits as a signed long) for every row."""

    def run(cols: list[list]) -> dict[str, list]:
        ids, texts, t = cols
        return {"doc_id": ids, "t": t, "fp": np.array([simhash(x, size) for x in texts], np.uint64).view(np.int64)}

    text = F.col(text_col)
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t")), run, "doc_id long, t long, fp long")


def hamming(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """A vantage-point tree whose leaves are shards, grown from a sample.

    A node is ``(vantage, mu, inner, outer)``: fingerprints at distance ``mu``
    or less from the vantage point have their home inside.  Two kinds of rows go
    down: homes, and guests that only look for partners among homes.  A link
    between an inner and an outer home is looked for by the inner one, which
    visits the outer side when its distance is over ``mu - reach``.
    """

    def __init__(self, sample: np.ndarray, total: int, reach: int, rows: int):
        self.reach = reach
        self.nodes: list[tuple] = []
        self.chunks: list[int] = []
        scale, rng = total / max(1, len(sample)), np.random.default_rng(7)

        def grow(homes: np.ndarray, guests: np.ndarray, depth: int) -> int:
            weight = (len(homes) + len(guests)) * scale
            if weight > rows and len(homes) >= 16 and depth < 48 and (split := best_split(homes, rng)):
                inner, outer = deal(homes, guests, *split, reach)
                if max(sum(map(len, inner)), sum(map(len, outer))) < 0.95 * (len(homes) + len(guests)):
                    at = len(self.nodes)
                    self.nodes.append(())
                    self.nodes[at] = (*split, grow(*inner, depth + 1), grow(*outer, depth + 1))
                    return at
            self.chunks.append(max(1, round(weight / (4 * rows))))
            return -len(self.chunks)

        self.root = grow(sample, sample[:0], 0)

    def route(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, homes, guests) for every shard that these fingerprints live in or have to visit."""

        def down(at: int, homes: np.ndarray, guests: np.ndarray):
            if not len(homes) and not len(guests):
                return
            if at < 0:
                yield -at - 1, homes, guests
                return
            v, mu, inner, outer = self.nodes[at]
            a, b = deal(homes, guests, v, mu, self.reach)
            yield from down(inner, *a)
            yield from down(outer, *b)

        yield from down(self.root, fps, fps[:0])


def best_split(homes: np.ndarray, rng: np.random.Generator, tries: int = 6):
    """The vantage point among a few homes whose distances spread most, and their median; None if no split exists."""
    best = None
    for v in homes[rng.integers(0, len(homes), tries)]:
        d = hamming(homes, v)
        mu = int(np.median(d))
        if d.max() == mu:
            mu -= 1
        inside = int((d <= mu).sum())
        if 0 < inside < len(homes):
            cost = abs(2 * inside - len(homes)) / len(homes) - 0.1 * float(d.std())
            if best is None or cost < best[0]:
                best = cost, v, mu
    return best and best[1:]


def deal(homes: np.ndarray, guests: np.ndarray, v, mu: int, reach: int):
    """((inner homes, inner guests), (outer homes, outer guests)) by the triangle bound."""
    d, g = hamming(homes, v).astype(np.int16), hamming(guests, v).astype(np.int16)
    inside = d <= mu
    across = homes[inside & (d > mu - reach)]
    return (homes[inside], guests[g <= mu + reach]), (homes[~inside], np.concatenate([across, guests[g > mu - reach]]))


class Groups:
    """Union-find over positions, fed with arrays of links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if np.array_equal(s, r):
                return r
            r = s

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            open_ = ra != rb
            if not open_.any():
                break
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))
        self.up = self.up[self.up]


def link_shard(homes: np.ndarray, guests: np.ndarray, reach: int, among: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fingerprint, smallest fingerprint of its group) over one shard's homes and guests.

    Every pair of a home with a guest within ``reach`` is found, and with
    ``among`` every pair of homes; the search goes down local vantage-point splits and compares blocks below
    ``DIRECT`` homes.
    """
    fps = np.concatenate([homes, guests])
    groups, rng = Groups(len(fps)), np.random.default_rng(11)
    stack = [(np.arange(len(homes)), np.arange(len(homes), len(fps)))]
    while stack:
        h, g = stack.pop()
        if not len(h) or len(h) * among + len(g) < 1 + among:
            continue
        split = best_split(fps[h], rng) if len(h) > DIRECT else None
        if split:
            v, mu = split
            d, e = hamming(fps[h], v).astype(np.int16), hamming(fps[g], v).astype(np.int16)
            inside = d <= mu
            a = h[inside], g[e <= mu + reach]
            b = h[~inside], np.concatenate([h[inside & (d > mu - reach)][: None if among else 0], g[e > mu - reach]])
            if max(len(a[0]) + len(a[1]), len(b[0]) + len(b[1])) < 0.9 * (len(h) + len(g)):
                stack += [a, b]
                continue
        q = np.concatenate([h, g]) if among else g
        for i in range(0, len(h), 512):
            hs = h[i : i + 512]
            for j in range(0, len(q), 4096):
                qs = q[j : j + 4096]
                y, x = np.nonzero(hamming(fps[qs][:, None], fps[hs][None, :]) <= reach)
                if len(x):
                    groups.link(hs[x], qs[y])
    root = groups.find(np.arange(len(fps)))
    low = np.full(len(fps), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, root, fps)
    low = low[root]
    keep = low != fps
    return fps[keep], low[keep]


def near_links(fps: DataFrame, reach: int = 3, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning links ``src``, ``dst`` between distinct fingerprints (column ``fp``) at most ``reach`` bits apart.

    Exact: the tree only deals out work.  The sample that places the vantage
    points is bounded by ``sample``; shards that no vantage point divides are
    salted, their homes copied to each salt and every row asking in one.
    """
    spark = fps.sparkSession
    ship(spark)
    total = fps.count()
    rows = fps.orderBy(F.xxhash64("fp")).limit(sample).collect()
    tree = Tree(np.array([r.fp for r in rows], np.int64).view(np.uint64), total, reach, shard_rows)
    known = spark.sparkContext.broadcast(tree)
    out = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), ("homes", pa.binary()), ("asking", pa.binary())])

    def route(batches):
        # a row for each shard that a batch reaches: the batch's homes there, and the fingerprints that look for partners
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            rows: dict[str, list] = {c: [] for c in out.names}
            for shard, homes, guests in known.value.route(f):
                k = known.value.chunks[shard]
                for salt in range(k):
                    asking = np.concatenate([homes[homes % np.uint64(k) == salt], guests[guests % np.uint64(k) == salt]])
                    for c, v in zip(out.names, (shard, salt, homes.tobytes(), asking.tobytes())):
                        rows[c].append(v)
            yield pa.RecordBatch.from_pydict(rows, out)

    def links(table: pa.Table) -> pa.Table:
        homes, asking = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint64) for c in ("homes", "asking"))
        guests = np.setdiff1d(asking, homes, assume_unique=True)
        # in an unsalted shard every home asks; comparing homes among themselves then takes half the visits
        whole = len(guests) + len(homes) == len(asking)
        a, b = link_shard(homes, guests if whole else asking, reach, whole)
        return pa.table({"src": a.view(np.int64), "dst": b.view(np.int64)})

    dealt = fps.select("fp").mapInArrow(route, "shard int, salt int, homes binary, asking binary")
    return dealt.groupBy("shard", "salt").applyInArrow(links, "src long, dst long")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, reach: int = 3
) -> DataFrame:
    """SimHash fingerprint and component of every document.

    Returns ``doc_id``, ``fingerprint`` (16 lowercase hex digits) and
    ``component_id``: the smallest id reachable over links of at most ``reach``
    differing bits, itself included.  A null text counts as empty; texts
    without words have fingerprint zero and link like any other.  Rows with a
    null id get a fingerprint and, where their group has an id, its smallest;
    repeated rows are returned as often as they come.  Other columns are
    ignored; an empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    heads = written(prints.groupBy("fp").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")), "heads")
    comp = connected_components(near_links(heads.select("fp"), reach))
    joined = heads.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("head").alias("component_id"))
    by_print = written(joined.join(least, "root").select("fp", "component_id", "n"), "by_print")
    return join_split(prints, by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def fingerprint_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, reach: int = 3) -> DataFrame:
    """``doc_id, t, root`` of rows whose fingerprint's component holds several rows; ``t`` is the text's XXH64.

    Components are those of ``simhash_groups``.  Rows equal in id and text count
    once; a null id is one of its own; a null text counts as empty.
    """
    prints = written(fingerprints(docs, id_col, text_col, size).distinct(), "fingerprints")
    heads = written(prints.groupBy("fp").agg(F.count("*").alias("n")), "heads")
    comp = connected_components(near_links(heads.select("fp"), reach))
    joined = heads.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    several = joined.groupBy("root").agg(F.sum("n").alias("_all")).filter("_all > 1")
    by_print = written(joined.join(several, "root").select("fp", "root", "n"), "by_print")
    return written(join_split(prints, by_print, "fp").select("doc_id", "t", "root"), "grouped")


def keep_first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, reach: int = 3) -> DataFrame:
    """One row of each group: that with the smallest id; columns stay as they are.

    Rows are decided by id and text: of differing texts under one id each stands
    in its own group, rows equal in both become one.  Rows without an id all
    stay, as nothing names them.  A null text is an empty one.
    """
    longest = "_" * max(len(c) for c in docs.columns)
    own, text, c_id, c_t = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")), f"{longest}id", f"{longest}t"
    prints = written(fingerprints(docs.select(own.alias("doc_id"), text.alias("text")).filter("doc_id is not null"), size=size), "fingerprints")
    comp = written(connected_components(near_links(prints.select("fp").distinct(), reach)).withColumnRenamed("node", "fp"), "components")
    rows = written(prints.groupBy("doc_id", "t", "fp").agg(F.count("*").alias("n")).join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rows")
    order = F.struct("doc_id", "t")
    first = rows.groupBy("root").agg(F.min(order).alias("first"))
    gone = rows.join(first, "root").filter(order != F.col("first")).select(F.col("doc_id").alias(f"{c_id}_gone"), F.col("t").alias(f"{c_t}_gone"))
    gone = written(gone, "gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    tagged = docs.withColumns({c_id: own, c_t: F.xxhash64(text)})
    kept = tagged.join(side, (F.col(c_id) == F.col(f"{c_id}_gone")) & (F.col(c_t) == F.col(f"{c_t}_gone")), "left_anti")
    if rows.filter("n > 1").limit(1).count():
        kept = kept.filter(F.col(c_id).isNotNull()).dropDuplicates([c_id, c_t]).unionByName(kept.filter(F.col(c_id).isNull()))
    return kept.select(docs.columns)
