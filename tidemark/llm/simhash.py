"""Near duplicates by SimHash: fingerprints within a few bits, found through vantage-point trees.

Fingerprints are split by their Hamming distance from vantage points. The upper levels of the tree, made on the
driver from a bounded sample, deal the fingerprints out into shards; a fingerprint so close to a boundary that a
partner may lie beyond it visits the shard on the other side as well (of two partners that a boundary parts, only the
inner one has to). Inside a shard the tree goes on, and branches that the triangle inequality rules out are not
compared. A shard returns its links as stars, not as pairs, so that a large group costs one row a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, fresh, pieces, runs, text_of, utf8
from .components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 3
SHARD = 1 << 14  # fingerprints that a shard calls its own
SAMPLE = 1 << 16  # fingerprints that the upper levels are made from, at most
LEAF = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, chunk: int = 1 << 16) -> np.ndarray:
    """SimHash of each row of UTF-8 bytes."""
    n = len(offsets) - 1
    votes, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    data = _LOWER[data]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts, ends, row = runs(~space, offsets)
    if len(starts):
        # one space after each word; what stands between words is dropped
        keep = ~space
        inner = ends[ends < len(data)]
        keep[inner[space[inner]]] = True
        at = np.concatenate(([0], np.cumsum(keep)))
        flat = np.where(space, np.uint8(32), data)[keep].tobytes()
        starts, ends = at[starts], at[ends]
        last = np.searchsorted(row, row, side="right") - 1  # last word of the same row
        first = np.searchsorted(row, row, side="left")
        word = np.arange(len(row))
        full = (word + shingle - 1 <= last) | ((word == first) & (last - first + 1 < shingle))
        a, b, row = starts[full], ends[np.minimum(word + shingle - 1, last)[full]], row[full]
        digest = xxhash.xxh64_intdigest
        for i in range(0, len(a), chunk):
            part = slice(i, i + chunk)
            h = np.fromiter((digest(flat[s:e], SEED) for s, e in zip(a[part].tolist(), b[part].tolist())), np.uint64)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cut_at = np.flatnonzero(np.diff(row[part], prepend=-1))
            np.add.at(votes, row[part][cut_at], np.add.reduceat(bits, cut_at, axis=0, dtype=np.int64))
        total = np.bincount(row, minlength=n)
    packed = np.packbits(votes * 2 > total[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).ravel()


def with_fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null and empty texts have fingerprint 0."""
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            done = [fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle) for a, b in pieces(offsets, 1 << 20)]
            fp = np.concatenate(done) if done else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return source.mapInArrow(run, "doc_id long, fp long")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class TopTree:
    """Upper levels of a vantage-point tree, as arrays: the children of node i are 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        size = (1 << depth) - 1
        self.vantage, self.mu = np.zeros(size, np.uint64), np.full(size, 32, np.int16)
        parts = [np.sort(sample)]
        for node in range(size):
            own = parts[node]
            if len(own):
                some = own[:: max(1, len(own) // 8)][:8]
                spread = [_distance(own, v).std() for v in some]
                self.vantage[node] = v = some[int(np.argmax(spread))]
                d = _distance(own, v)
                self.mu[node] = m = int(np.median(d))
                parts += [own[d <= m], own[d > m]]
            else:
                parts += [own, own]

    def route(self, fps: np.ndarray, radius: int, guests: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard, index and whether at home, for each place that each fingerprint goes to; guests are at home nowhere."""
        every, none = np.arange(len(fps)), np.zeros(0, np.int64)
        level = {0: (none, every) if guests else (every, none)}
        for _ in range(self.depth):
            below = {}
            for node, (home, guest) in level.items():
                m, v = int(self.mu[node]), self.vantage[node]
                dh, dg = _distance(fps[home], v), _distance(fps[guest], v)
                inner = dh <= m
                below[2 * node + 1] = (home[inner], guest[dg <= m + radius])
                below[2 * node + 2] = (home[~inner], np.concatenate((guest[dg > m - radius], home[inner & (dh > m - radius)])))
            level = {k: x for k, x in below.items() if len(x[0]) or len(x[1])}
        shard = [np.full(len(h) + len(g), k, np.int32) for k, (h, g) in level.items()]
        at = [np.concatenate(x) for x in level.values()]
        own = [np.repeat([True, False], [len(h), len(g)]) for h, g in level.values()]
        return (np.concatenate(shard), np.concatenate(at), np.concatenate(own)) if shard else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool))


class _Sets:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if np.array_equal(r, s):
                self.up[x] = r
                return r
            r = s

    def join_all(self, x: np.ndarray) -> None:
        r = self.find(x)
        self.up[r] = r.min()

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def shard_links(fps: np.ndarray, home: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint, the index of the smallest one that links within the shard lead to.

    Finds every link of two fingerprints of which one is at home here.
    """
    sets = _Sets(len(fps))
    stack = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while stack:
        own, guest = stack.pop()
        if not len(own) or len(own) + len(guest) < 2:
            continue
        every = np.concatenate((own, guest))
        roots = sets.find(every)
        if (roots == roots[0]).all():
            continue
        v = fps[own[len(own) // 2]]
        do, dg = _distance(fps[own], v), _distance(fps[guest], v)
        if len(own) <= LEAF or do.min() == do.max() or (do > 0).sum() < 2:
            step = max(1, (1 << 20) // len(every))
            for i in range(0, len(own), step):
                part = own[i : i + step]
                x, y = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[every][None, :]) <= radius)
                sets.join(part[x], every[y])
            continue
        sets.join_all(np.concatenate((own[do <= radius], guest[dg <= radius])))
        m = int(np.median(do))
        m -= m == do.max()
        inner = do <= m
        stack.append((own[inner], guest[dg <= m + radius]))
        stack.append((own[~inner], np.concatenate((guest[dg > m - radius], own[inner & (do > m - radius)]))))
    return sets.find(np.arange(len(fps)))


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(a, b): stars whose components are those of all pairs of fingerprints (column fp) within the radius."""
    n = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / shard)))))
    most = min(sample, 64 << depth)
    seen = distinct.orderBy(F.xxhash64("fp"), "fp").limit(most).toPandas()["fp"].to_numpy(np.int64).view(np.uint64) if depth else np.zeros(0, np.uint64)
    tree = TopTree(seen, depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array(batch.column(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
            to, at, own = tree.route(fps, radius)
            for i in range(0, len(to), 1 << 18):
                part = slice(i, i + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(to[part]), pa.array(fps[at[part]].view(np.int64)), pa.array(own[part])], ["shard", "fp", "home"])

    def search(table: pa.Table) -> pa.Table:
        fps = np.array(table.column("fp").to_numpy(), np.int64)
        home = np.array(table.column("home").to_numpy(), bool)
        order = np.argsort(fps, kind="stable")
        fps, home = fps[order], home[order]
        root = shard_links(fps.view(np.uint64), home, radius)
        moved = root != np.arange(len(fps))
        return pa.table({"a": fps[moved], "b": fps[root[moved]]})

    dealt = distinct.select("fp").mapInArrow(deal, "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs; other columns don't matter.

    Null and empty texts have fingerprint zero and are linked like others. Repeated rows stay; each gets its result.
    A row whose doc_id is null keeps it and gets the component of its fingerprint. An empty table gives no rows.
    """
    fps = cut(with_fingerprint(docs, doc_id, text, shingle))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(links(distinct, radius))
    grouped = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    grouped = cut(grouped)
    # written, since a join with an aggregated side can't be split where a component is large
    label = cut(grouped.groupBy("component").agg(F.min("least").alias("component_id")))
    named = grouped.join(label, "component").select("fp", "component_id")
    out = fps.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns: that with the smallest doc_id, null ids last.

    Groups are those of near_copies: fingerprints of five-word shingles find candidates through vantage-point trees, the
    exact similarity decides. Rows are told apart by doc_id and text, so null and repeated ids are rows like others; of
    rows equal in both one stays. Null and empty texts are one group. An empty table gives no rows.
    """
    from .near_copies import digest, firsts

    own, kept = (fresh(docs.columns, name) for name in ("_own", "_kept"))
    found = firsts(docs, doc_id, text).select(F.col("doc_id").alias(kept), F.col("digest").alias(own))
    both = (digest(text) == F.col(own)) & F.col(doc_id).cast("long").eqNullSafe(F.col(kept))
    return docs.join(found, both, "left_semi").withColumn(own, digest(text)).dropDuplicates([doc_id, own]).drop(own)
