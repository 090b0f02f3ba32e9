"""Documents that contain benchmark items, up to a fifth of an item's characters edited.

A CGK walk reads a text from some place on: at each step the current letter is written, and the walk stays or moves on
as a random bit of step and letter says. Walks over nearly equal texts fall into step again after an edit, so a small
edit distance becomes a small Hamming distance, and a few sampled steps are a locality-sensitive key. Far into a long
item many edits would add up, so the walk starts afresh at every letter: the embedding of an item-sized window is that
of all walks which begin in it, and each of them gives a key for each sample of steps.

Items keep a fixed number of their keys, the rarest among all items. Documents look up the keys of all their places in
a bitmap of bounded size; what meets is joined by key, and windows about as long as the item in which enough different
keys stand in place are compared exactly: the best place for the whole item among the letters there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, bounded, cut, fresh, pieces, runs, text_of, utf8
from .wordhash import WORD

SIMILARITY = 0.8
SAMPLES = 2  # of the steps of a walk
KEYS = 36  # that an item keeps, for each sample
VOTES = 3  # different keys of an item in place, or a sixteenth of what it keeps
PARTS = 16  # stretches of an item; keys must be in place in two of them, else one common phrase would do
SCALES = ((40, 24), (16, 10), (8, 5), (5, 3), (4, 4), (3, 3), (2, 2), (1, 1))  # least letters of an item, steps of its walks
MAP_BITS = 24  # a bitmap has at most two to the power of this many places
CHUNK = 1 << 14  # letters embedded at a time
_rng = np.random.default_rng(20250)
_SIGN = _rng.integers(0, 1 << 32, 256, np.uint32)
_ODD = _rng.integers(0, 1 << 31, (SAMPLES, 32), np.uint32) * np.uint32(2) + np.uint32(1)


def _sampled(steps: int) -> np.ndarray:
    """Whether a sample has a step: half of the steps of long walks, all of short ones."""
    out = np.ones((SAMPLES, steps), bool)
    if steps > 8:
        rng = np.random.default_rng(steps)
        for sample in out:
            sample[rng.choice(steps, steps // 2, replace=False)] = False
    return out


_SAMPLED = {steps: _sampled(steps) for _, steps in SCALES}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def keys(text: np.ndarray, steps: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each sample the key of the walk from every byte of text, and how many bytes further its last step reads.

    The walk is taken backwards: what it writes from step j on depends on the byte and on the rest of the walk from
    there or from the next byte. Beyond the end there are zeros.
    """
    n = len(text)
    totals, ahead = [np.empty(n, np.uint32) for _ in range(SAMPLES)], np.empty(n, np.uint8)
    text = np.concatenate((text, np.zeros(steps + 1, np.uint8)))
    sampled = _SAMPLED[steps]
    for i in range(0, n, CHUNK):
        m = min(CHUNK, n - i)
        sign = _SIGN[text[i : i + m + steps]]
        rest = [np.zeros(m + steps + 1, np.uint32) for _ in range(SAMPLES)]
        moved = np.zeros(m + steps + 1, np.uint8)
        for j in range(steps - 1, -1, -1):
            w = m + j
            moves = (sign[:w] << np.uint32(31 - j)).view(np.int32) >> np.int32(31)
            goes = moves.view(np.uint32)
            for k in range(SAMPLES):
                stay, go = rest[k][:w], rest[k][1 : w + 1]
                new = stay ^ ((stay ^ go) & goes)
                if sampled[k, j]:
                    new += sign[:w] * _ODD[k, j]
                rest[k] = new
            if j < steps - 1 and i + m >= n - steps:  # elsewhere no walk reaches the end
                moved = np.where(moves, moved[1 : w + 1] + np.uint8(1), moved[:w])
            else:
                moved = moved[:w]
        for k in range(SAMPLES):
            totals[k][i : i + m] = _mixed(rest[k][:m])
        ahead[i : i + m] = moved[:m]
    return totals, ahead


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each row, a space after each; what stands between words is dropped."""
    word = WORD[data]
    _, ends, _ = runs(word, offsets)
    flat = np.where(word, data, np.uint8(32))
    size = np.ones(len(data), np.int64) * word
    last = ends - 1  # a space is written after the last byte of a word
    size[last] = 2
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.repeat(flat, size)
    out[at[last] + 1] = 32
    return out, at[offsets]


def best_distance(item: str, text: str, masks: dict[str, int] | None = None) -> int:
    """Smallest edit distance between the item and any part of the text; bit-parallel, exact."""
    if item in text:
        return 0
    m = len(item)
    if masks is None:
        masks = letter_masks(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(h | up)), up & h
        score += bool(plus & top) - bool(minus & top)
        best = min(best, score)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(x | plus)), plus & x
    return best


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _scale(size: int) -> int:
    return next(k for k, (least, _) in enumerate(SCALES) if size >= least)


def _map(df: DataFrame, schema: str, of) -> DataFrame:
    """mapInArrow with of(batch), which yields lists of columns."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in of(batch):
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)


def _bodies(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, node, body) of the items that have words; node is a digest of the body."""

    def of(batch):
        data, offsets = utf8(batch.column(1))
        for a, b in pieces(offsets, 1 << 20):
            flat, at = normal(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            raw = flat.tobytes()
            yield [batch.column(0).slice(a, b - a), pa.array([raw[x : max(x, y - 1)].decode(errors="replace") for x, y in zip(at.tolist(), at[1:].tolist())], pa.string())]

    source = items.select(F.col(item_id).cast("long").alias("item_id"), F.lower(text_of(text)).alias("text"))
    return _map(source, "item_id long, body string", of).filter("body <> ''").withColumn("node", F.unhex(F.md5("body")))


def _picked(bodies: DataFrame) -> DataFrame:
    """(key, node, place, size, need, own, other, part): the rarest keys of each body; need is how many must be in place.

    own and other have one bit for each key of a body, in the first sample and the second; part has one bit for the
    stretch of the body that the key is in.
    """

    def of(batch):
        for node, body in zip(batch.column(0), batch.column(1)):
            x = np.frombuffer(body.as_py().encode(), np.uint8)
            scale = _scale(len(x))
            totals, ahead = keys(x, SCALES[scale][1])
            inside = np.flatnonzero(np.arange(len(x)) + ahead < len(x))
            for k, total in enumerate(totals):
                key = total[inside].astype(np.int64) + ((scale * SAMPLES + k) << 32)
                yield [pa.array(key), pa.array([node.as_py()] * len(inside), pa.binary()), pa.array(inside.astype(np.int32)), pa.array(np.full(len(inside), len(x), np.int32))]

    every = cut(_map(bodies, "key long, node binary, place int, size int", of))
    often = cut(every.groupBy("key").agg(F.count_distinct("node").alias("items")))
    order = Window.partitionBy("node", F.shiftright("key", 32)).orderBy("items", F.xxhash64("key"), "place")
    first = every.join(often, "key").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= KEYS)
    kept = F.count("*").over(Window.partitionBy("node"))
    # items of less than five letters bear no edit
    need = F.when(F.col("size") < 5, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(VOTES), F.ceil(kept / 16)))).cast("int")
    bit = F.expr("shiftleft(1L, nth - 1)")
    even = F.shiftright("key", 32) % SAMPLES == 0
    return cut(first.select("key", "node", "place", "size", need.alias("need"), F.when(even, bit).otherwise(0).alias("own"), F.when(even, 0).otherwise(bit).alias("other"), F.expr(f"shiftleft(1, cast(floor(place * {PARTS} / size) as int))").alias("part")))


def _bitmaps(picked: DataFrame) -> tuple[int, dict[int, np.ndarray]]:
    """Bits of each table of keys (scale and sample), as bytes; its places are the upper bits of the keys there."""
    table, low = F.shiftright("key", 32), F.col("key").bitwiseAND(F.lit((1 << 32) - 1))
    most = max((r["count"] for r in picked.groupBy(table.alias("t")).count().collect()), default=0)
    bits = min(MAP_BITS, max(16, math.ceil(math.log2(256 * most + 1))))
    slot = F.shiftright(low, 32 - bits) + 1
    found = picked.groupBy(table.alias("t"), F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out: dict[int, np.ndarray] = {}
    for r in found:
        whole = out.setdefault(r["t"], np.zeros((1 << bits) // 8, np.uint8))
        own = np.frombuffer(r["bits"], np.uint8)
        begin = (r["b"] - 1) * len(own)
        whole[begin : begin + len(own)] = own[: len(whole) - begin]
    return bits, out


def _hits(source: DataFrame, picked: DataFrame) -> DataFrame:
    """(t, key, at): places of documents, t being the digest of their text, where an item's key may be."""
    bits, maps = _bitmaps(picked)
    held = source.sparkSession.sparkContext.broadcast(maps)
    wide: dict[int, np.ndarray] = {}

    def of(batch):
        if not wide:
            wide.update((t, np.unpackbits(x, bitorder="little").astype(bool)) for t, x in held.value.items())
        data, offsets = utf8(batch.column(1))
        for a, b in pieces(offsets, 1 << 20):
            flat, begin = normal(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            digests = batch.column(0).slice(a, b - a)
            for scale in sorted({t // SAMPLES for t in wide}):
                for k, total in enumerate(keys(flat, SCALES[scale][1])[0]):
                    t = scale * SAMPLES + k
                    if t in wide:
                        p = np.flatnonzero(wide[t][total >> np.uint32(32 - bits)])
                        row = np.searchsorted(begin, p, side="right") - 1
                        yield [digests.take(pa.array(row)), pa.array(total[p].astype(np.int64) + (t << 32)), pa.array((p - begin[row]).astype(np.int32))]

    return _map(source.select("t", "text"), "t binary, key long, at int", of)


def _step(size: Column) -> Column:
    """Half of a window in which the keys of an item must be; edits move them by less."""
    return F.greatest(F.lit(16), F.floor(size / 4))


def _windows(texts: DataFrame) -> DataFrame:
    """(t, node, part): the letters around each window. texts: (t, text, windows)."""

    def of(batch):
        data, offsets = utf8(batch.column(1))
        for a, b in pieces(offsets, 1 << 20):
            flat, begin = normal(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out: tuple[list, list, list] = ([], [], [])
            for r in range(a, b):
                first, end = int(begin[r - a]), int(begin[r - a + 1])
                places: dict[bytes, list] = {}
                for w in batch.column(2)[r].as_py():
                    slack = w["size"] // 4 + 8
                    x, y = first + w["low"] - slack, first + w["high"] + w["size"] + slack
                    own = places.setdefault(w["node"], [])
                    if own and x <= own[-1][1]:
                        own[-1][1] = max(y, own[-1][1])
                    else:
                        own.append([x, y])
                for node, found in places.items():
                    for x, y in found:
                        out[0].append(batch.column(0)[r].as_py())
                        out[1].append(node)
                        out[2].append(flat[max(first, x) : max(first, min(end, y))].tobytes().decode(errors="ignore"))
            yield [pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.string())]

    return _map(texts, "t binary, node binary, part string", of)


def _compared(parts: DataFrame, similarity: float) -> DataFrame:
    """(t, node, distance, similarity) of the parts that are near enough. parts: (t, node, part, body)."""

    def of(batch):
        good, found, alike = [], [], []
        masks: tuple[str, dict] = ("", {})
        for i, (part, body) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            if masks[0] != body:
                masks = body, letter_masks(body)
            d = best_distance(body, part, masks[1])
            if d <= int((1 - similarity) * len(body) + 1e-9):
                good.append(i)
                found.append(d)
                alike.append(1 - d / len(body))
        rows = batch.take(pa.array(good, pa.int64()))
        yield [rows.column(0), rows.column(1), pa.array(found, pa.int64()), pa.array(alike, pa.float64())]

    return _map(parts.select("t", "node", "part", "body"), "t binary, node binary, distance long, similarity double", of)


def _digest(text: str) -> Column:
    return F.unhex(F.md5(text_of(text)))


def _contained(docs: DataFrame, known: DataFrame, text: str, similarity: float) -> DataFrame:
    """(t, node, distance, similarity): which item is in which text, t being the digest of the text."""
    bound_batches(docs.sparkSession)
    bodies = cut(known.select("node", "body").dropDuplicates(["node"]))
    picked = _picked(bodies)
    source = docs.select(_digest(text).alias("t"), text_of(text).alias("text"))
    lower = F.lower("text").alias("text")
    met = _hits(source.select("t", lower), picked).join(bounded(picked), "key").withColumn("from", F.col("at") - F.col("place"))
    cell = F.floor((F.col("from") + F.col("size")) / _step(F.col("size"))).cast("int")
    seen = met.select("t", "node", "size", "need", "own", "other", "part", "from", F.explode(F.array(cell - 1, cell)).alias("cell"))
    votes = seen.groupBy("t", "node", "cell", "size", "need").agg(*[F.bit_or(c).alias(c) for c in ("own", "other", "part")], F.min("from").alias("low"), F.max("from").alias("high"))
    good = (F.bit_count("own") + F.bit_count("other") >= F.col("need")) & (F.bit_count("part") >= F.least(F.lit(2), "need"))
    enough = cut(votes.filter(good).select("t", "node", "size", "low", "high"))
    windows = cut(enough.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("node", "low", "high", "size"))).alias("windows")))
    texts = source.join(bounded(windows.select("t")), "t", "left_semi").dropDuplicates(["t"])
    parts = _windows(texts.join(windows, "t").select("t", lower, "windows"))
    found = _compared(parts.join(bodies, "node"), similarity)
    best = F.min_by(F.struct("distance", "similarity"), "distance").alias("b")
    return cut(found.groupBy("t", "node").agg(best).select("t", "node", "b.*"))


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, distance, similarity) for each row of docs and item that it contains.

    Both sides are compared in lower case, words (letters and digits) joined by one space; distance is the least edit
    distance between the item and a part of the document, similarity is 1 - distance / length of the item. Items
    without words and null items match nothing, null and empty documents contain nothing; repeated rows and items
    each get their results; null ids stay null. An empty table on either side gives no rows, other columns don't
    matter. Items of less than 40 bytes have short keys that many places share; they are dear, but not left out.
    """
    bound_batches(docs.sparkSession)
    known = cut(_bodies(items, item_id, item_text))
    found = _contained(docs, known, text, similarity)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _digest(text).alias("t"))
    return rows.join(bounded(found), "t").join(known.select("item_id", "node"), "node").select("doc_id", "item_id", "distance", "similarity")


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs whose text contains no item, with all their columns; ids don't matter, so null and repeated ones are kept."""
    bound_batches(docs.sparkSession)
    name = fresh(docs.columns, "_found")
    found = _contained(docs, cut(_bodies(items, "item_id", "text")), text, SIMILARITY).select(F.col("t").alias(name)).distinct()
    return docs.join(bounded(cut(found)), _digest(text) == F.col(name), "left_anti")
