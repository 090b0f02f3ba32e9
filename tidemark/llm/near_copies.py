"""Near copies by what they share: sets of five words in a row, of which two texts have four fifths in common.

Texts of the same words are one node. A node has several SimHash fingerprints of its set. Nodes are dealt out by the
size of their sets, since sizes of near copies differ by a fifth at most, and by vantage-point trees over each
fingerprint; nodes of a shard that fingerprints within the radius lead to share a bucket. Each is compared with two
leads of its bucket. Where a bucket has several components after that, its nodes are compared with those of other
components with which they share one of their rarest shingles, which every pair of that similarity does. Comparisons
are exact, on the whole sets, so a wrong bucket costs time only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, bounded, cut, pieces, runs, text_of, utf8
from .components import connected_components
from .simhash import SAMPLE, SHARD, TopTree, shard_links
from .wordhash import mix, slice_hashes

SHINGLE = 5
SIMILARITY = 0.8
TABLES = 8  # fingerprints of a node
RADIUS = 12  # of 64 bits; at similarity 0.8 about 10 differ, and one fingerprint finds 0.83 of the pairs
MARGIN = 3  # how near to a boundary of the trees a fingerprint visits the other side
AT_ONCE = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(58)
_TIMES = _rng.integers(0, 1 << 63, TABLES, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, TABLES, np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of each run of so many words (all words of a shorter text), and a hash of all words of each row."""
    n = len(offsets) - 1
    data = _LOWER[data]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts, ends, row = runs(~space, offsets)
    whole = np.zeros(n, np.uint64)
    if not len(starts):
        return np.zeros(0, np.uint64), row, whole
    # one space after each word; what stands between words is dropped
    keep = ~space
    inner = ends[ends < len(data)]
    keep[inner[space[inner]]] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    flat = np.where(space, np.uint8(32), data)[keep]
    starts, ends = at[starts], at[ends]
    last = np.searchsorted(row, row, side="right") - 1  # last word of the same row
    first = np.searchsorted(row, row, side="left")
    word = np.arange(len(row))
    own = word == first
    whole[row[own]] = slice_hashes(flat, starts[own], ends[last[own]])
    full = (word + size - 1 <= last) | (own & (last - first + 1 < size))
    return slice_hashes(flat, starts[full], ends[np.minimum(word + size - 1, last)[full]]), row[full], whole


def prints(hashes: np.ndarray, row: np.ndarray, chunk: int = 255 << 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that have shingles, how many different ones, and their SimHash in each table (rows x TABLES)."""
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.diff(row, prepend=-1) != 0
    new[1:] |= hashes[1:] != hashes[:-1]
    hashes, row = hashes[new], row[new]
    at = np.flatnonzero(np.diff(row, prepend=-1))
    sizes = np.diff(at, append=len(row))
    votes = np.zeros((len(at), TABLES, 64), np.int64)
    place = np.arange(len(row)) - np.repeat(at, sizes)
    which = np.repeat(np.arange(len(at)), sizes)
    for i in range(0, len(row), chunk):
        part = slice(i, i + chunk)
        start = place[part] % 255 == 0  # so many bits add up in a byte
        start[0] = True
        start = np.flatnonzero(start)
        for table in range(TABLES):
            bits = np.unpackbits(mix(hashes[part] * _TIMES[table] + _PLUS[table]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(votes[:, table], which[part][start], np.add.reduceat(bits.view(np.uint64), start, axis=0).view(np.uint8))
    packed = np.packbits(votes * 2 > sizes[:, None, None], axis=2, bitorder="little")
    return row[at], sizes, np.ascontiguousarray(packed).view(np.uint64).reshape(-1, TABLES)


def _over(docs: DataFrame, schema: str, of) -> DataFrame:
    """of(rows, data, offsets) over docs, whose last column is a text, in pieces of bounded size; it returns a record batch's columns."""
    bound_batches(docs.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            for a, b in pieces(offsets, 1 << 18):
                yield pa.RecordBatch.from_arrays(of(batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), names)

    return docs.mapInArrow(run, schema)


def _nodes(source: DataFrame) -> DataFrame:
    """(doc_id, digest, node, size, prints): prints are the fingerprints, as bytes; none for a text without words."""

    def of(rows, data, offsets):
        hashes, row, whole = shingles(data, offsets)
        at, sizes, found = prints(hashes, row)
        held, size = [b""] * rows.num_rows, np.zeros(rows.num_rows, np.int32)
        size[at] = sizes
        for r, k in zip(at.tolist(), found):
            held[r] = k.tobytes()
        return [rows.column(0), rows.column(1), pa.array(whole.view(np.int64)), pa.array(size), pa.array(held, pa.binary())]

    return _over(source, "doc_id long, digest binary, node long, size int, prints binary", of)


def _near_prints(nodes: DataFrame, similarity: float, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(band, key, node, n): buckets of n nodes that fingerprints within the radius lead to, of rows (node, size, prints).

    Sets of that similarity are in the same class of sizes or in the next one, which the smaller visits as a guest.
    """
    width = -math.log(similarity) * (1 + 1e-9) if similarity < 1 else 1e-9
    kinds = nodes.filter("size > 0").select("node", F.floor(F.log("size") / F.lit(width)).alias("kind"), "prints")
    depth = {k: max(0, math.ceil(math.log2(n / shard))) for k, n in kinds.groupBy("kind").count().collect()}
    deep = [k for k, d in depth.items() if d]
    seen = {k: np.zeros((0, TABLES), np.uint64) for k in depth}
    if deep:
        some = kinds.filter(F.col("kind").isin(deep)).orderBy(F.xxhash64("node"), "node").limit(min(sample, sum(64 << depth[k] for k in deep))).select("kind", "prints").toPandas()
        seen |= {k: np.frombuffer(b"".join(map(bytes, x)), np.uint64).reshape(-1, TABLES) for k, x in some.groupby("kind")["prints"]}
    trees = {k: [TopTree(seen[k][:, table], d) for table in range(TABLES)] for k, d in depth.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, kind = (batch.column(k).to_numpy() for k in (0, 1))
            fps = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, TABLES)
            for table in range(TABLES):
                to, who, home = [], [], []
                for k in np.unique(kind).tolist():
                    own = np.flatnonzero(kind == k)
                    for other in (k, k + 1):
                        if other in trees:
                            leaf, at, at_home = trees[other][table].route(fps[own, table], MARGIN, other != k)
                            to.append((np.int64(other * TABLES + table) << 24) + leaf)
                            who.append(own[at])
                            home.append(at_home)
                who = np.concatenate(who)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to).astype(np.int64)), pa.array(node[who]), pa.array(fps[who, table].view(np.int64)), pa.array(np.concatenate(home))], ["band", "node", "fp", "home"])

    def search(table: pa.Table) -> pa.Table:
        band, node, fp, home = (table.column(k).to_numpy() for k in range(4))
        fps, at = np.unique(fp, return_inverse=True)
        own = np.zeros(len(fps), bool)
        own[at[home]] = True
        key = shard_links(fps.view(np.uint64), own, RADIUS)[at]
        n = np.bincount(key)[key]
        return pa.table({"band": band[n > 1], "key": key[n > 1], "node": node[n > 1], "n": n[n > 1]})

    bound_batches(nodes.sparkSession)
    dealt = kinds.mapInArrow(deal, "band long, node long, fp long, home boolean")
    return dealt.groupBy("band").applyInArrow(search, "band long, key long, node long, n long")


def _sets(source: DataFrame, members: DataFrame) -> DataFrame:
    """(node, held) of the members, rows of (digest, node): the different shingles in order, as bytes."""

    def of(rows, data, offsets):
        hashes, row, whole = shingles(data, offsets)
        cuts = np.searchsorted(row, np.arange(rows.num_rows + 1))
        return [pa.array(whole.view(np.int64)), pa.array([np.unique(hashes[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())]

    one = cut(members.groupBy("node").agg(F.min("digest").alias("digest")).select("digest"))
    texts = source.select("digest", "text").join(bounded(one), "digest", "left_semi").dropDuplicates(["digest"])
    return _over(texts, "node long, held binary", of)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if min(len(p), len(q)) < similarity * max(len(p), len(q)):
                    ok.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("held").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("held").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _rare_in_common(held: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may have the similarity; no pair that has it is lost.

    In one order of all shingles, what two sets have in common can't be more than what is left of either from their
    first common shingle on. The order is by how many nodes have a shingle: what many texts share comes last, and pairs
    them only if it is long enough to make them alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, component, held in zip(batch.column(0), batch.column(1), batch.column(2)):
                hashes = np.frombuffer(held.as_py(), np.int64)
                same = [pa.array(np.full(len(hashes), x, kind)) for x, kind in ((node.as_py(), np.int64), (component.as_py(), np.int64), (len(hashes), np.int32))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(hashes)], ["node", "component", "size", "shingle"])

    each = cut(held.select("node", "component", "held").mapInArrow(run, "node long, component long, size int, shingle long"))
    # a shingle of one component only can't link two, but counts in the order
    often = each.groupBy("shingle").agg(F.count("*").alias("n"), (F.min("component") < F.max("component")).alias("between"))
    order = Window.partitionBy("node").orderBy("n", "shingle")
    placed = each.join(cut(often), "shingle").withColumn("left", F.col("size") - F.row_number().over(order) + 1)
    # sizes fall into classes; what must be in common, at least, depends on both sizes, and so does how far to look
    share, width = similarity / (1 + similarity), math.log(1.03)
    kind = lambda size: F.floor(F.log(size) / width).cast("int")
    size = F.col("size")
    partners = F.sequence(kind(F.ceil(size * similarity - 1e-6)), kind(F.floor(size / similarity + 1e-6)))
    first = placed.filter((F.col("left") >= size * similarity - 1e-6) & F.col("between")).select("shingle", "node", "component", "size", "left", kind(size).alias("own"), F.explode(partners).alias("partner"))
    first = cut(first.filter(F.col("left") >= share * (size + F.exp(F.col("partner") * width)) - 1e-3))
    one = first.filter("own <= partner").withColumnsRenamed({"node": "a", "component": "here", "size": "m", "left": "p"})
    two = first.filter("own >= partner").select("shingle", F.col("partner").alias("own"), F.col("own").alias("partner"), F.col("node").alias("b"), F.col("component").alias("there"), F.col("size").alias("n"), F.col("left").alias("q"))
    needed = share * (F.col("m") + F.col("n")) - 1e-3
    both = one.join(two, ["shingle", "own", "partner"]).filter("here <> there AND (own < partner OR a < b)").filter((F.least("p", "q") >= needed) & (F.least("m", "n") >= similarity * F.greatest("m", "n") - 1e-6))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def digest(text: str = "text"):
    """What tells texts apart."""
    return F.unhex(F.md5(text_of(text)))


def _grouped(docs: DataFrame, doc_id: str, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, node), and the first row (absent, doc_id, digest) of each node's component; absent ids come last."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest(text).alias("digest"), text_of(text).alias("text"))
    rows = cut(_nodes(source))
    who = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "digest")
    distinct = cut(rows.groupBy("node").agg(F.min(who).alias("least"), F.first("size").alias("size"), F.first("prints").alias("prints")))

    # what a join meets is written first wherever a key may be hot: aggregated sides can't be split
    shared = cut(_near_prints(distinct, similarity))
    # whoever shares its buckets with most nodes is likely what the others were made from
    central = cut(shared.groupBy("node").agg(F.sum("n").alias("met")))
    leads = shared.join(central, "node").groupBy("band", "key").agg(
        F.max(F.struct("met", "node")).alias("middle"),
        # another order in each band, so that nodes meet several leads
        F.min(F.struct(F.xxhash64("node", "band").alias("o"), "node")).alias("other"),
    )
    leads = cut(leads.select("band", "key", F.array_distinct(F.array("middle.node", "other.node")).alias("leads")))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    stars = shared.join(leads, ["band", "key"]).select(F.col("node").alias("a"), F.explode("leads").alias("b")).filter("a <> b").select(*ordered).distinct()

    sets = cut(_sets(source, rows.join(shared.select("node").distinct(), "node", "left_semi").select("digest", "node")))

    links = cut(_alike(stars, sets, similarity))
    found = connected_components(links, at_once=AT_ONCE)
    placed = cut(shared.join(found, "node", "left").select("band", "key", "node", F.coalesce("component", "node").alias("component")))
    torn = placed.groupBy("band", "key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("band", "key")
    left = cut(placed.join(cut(torn), ["band", "key"], "left_semi").select("node", "component").distinct())
    more = _rare_in_common(sets.join(left, "node"), similarity)
    found = connected_components(links.unionByName(_alike(more, sets, similarity)), at_once=AT_ONCE)

    grouped = cut(distinct.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")))
    label = cut(grouped.groupBy("component").agg(F.min("least").alias("first")))
    return rows.select("doc_id", "digest", "node"), grouped.join(label, "component").select("node", "first")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for each row of docs; the smallest doc_id of all that links of that similarity lead to.

    Null and empty texts are copies of each other. A row whose doc_id is null keeps it. An empty table gives no rows.
    """
    rows, first = _grouped(docs, doc_id, text, similarity)
    return rows.join(cut(first), "node").select("doc_id", F.col("first.doc_id").alias("component_id"))


def firsts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, digest) of one row of each group of near copies: that with the smallest doc_id, of these the smallest digest."""
    return _grouped(docs, doc_id, text, similarity)[1].select("first.doc_id", "first.digest").distinct()
