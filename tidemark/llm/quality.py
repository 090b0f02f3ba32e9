"""Quality of documents: random-indexing word vectors, pooled, and a small network with calibrated probabilities.

Every token has a sparse ternary index vector made from its hash; a token's word vector is the sum of the index
vectors of the tokens around it in the training texts. A document's word vectors are pooled: their mean, their spread,
the mean of the products of neighbours, and the mean times the logarithm of their number; that goes through a two-layer
network written with numpy. A temperature found on held-back rows calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, map_arrow, pieces, runs, text_of, utf8
from .wordhash import WORD, mix, slice_hashes

THRESHOLD = 0.3
TRAIN_ROWS = 4000  # labelled rows that the model is fitted on, at most
TRAIN_BYTES = 32 << 20  # of their texts, at most; rows beyond that aren't learned from
VOCABULARY = 1 << 15  # word vectors that are kept, the commonest; other tokens share one
DIM, NONZERO, WINDOW = 64, 6, 2
POOLED = 4 * (DIM + 1)
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 3e-3, 1e-4
_SPACE = np.zeros(256, bool)
_SPACE[[9, 11, 12, 13, 32]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and kind of each token: runs of letters and digits (0), of other signs (1), of newlines (2)."""
    found = []
    line = data == 10
    for kind, good in enumerate((WORD[data], ~(WORD[data] | _SPACE[data] | line), line)):
        s, e, row = runs(good, offsets)
        found.append((s, slice_hashes(data, s, e), row, np.full(len(s), kind, np.int8)))
    order = np.argsort(np.concatenate([x[0] for x in found]), kind="stable")
    return tuple(np.concatenate([x[k] for x in found])[order] for k in (1, 2, 3))


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """Ternary vectors with NONZERO signs each, places and signs drawn from the hash."""
    out = np.zeros((len(hashes), DIM), np.int8)
    for k in range(NONZERO):
        h = mix(hashes + np.uint64(0x1F123BB5 * (k + 1)))
        out[np.arange(len(hashes)), (h % np.uint64(DIM)).astype(np.int64)] += np.where(h >> np.uint64(63), 1, -1)
    return out


class Vectors:
    """Word vectors of the commonest tokens of the training texts."""

    def __init__(self, hashes: np.ndarray, row: np.ndarray):
        seen, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
        keep = np.sort(np.argsort(-count, kind="stable")[:VOCABULARY])
        keep = keep[count[keep] > 1]
        self.known = seen[keep]
        place = np.full(len(seen), -1)
        place[keep] = np.arange(len(keep))
        index, total = index_vectors(seen), np.zeros((len(keep), DIM))
        inverse = inverse.astype(np.int32)
        word = place[inverse].astype(np.int32)
        for off in range(1, WINDOW + 1):
            for a, b in ((slice(off, None), slice(None, -off)), (slice(None, -off), slice(off, None))):
                ok = (word[a] >= 0) & (row[a] == row[b])
                own, other = word[a][ok], inverse[b][ok]
                for d in range(DIM):
                    total[:, d] += np.bincount(own, weights=index[:, d][other], minlength=len(keep))
        # one more dimension, and a last vector along it, for tokens without a vector of their own
        self.vectors = np.zeros((len(keep) + 1, DIM + 1), np.float32)
        self.vectors[:-1, :DIM] = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
        self.vectors[-1, DIM] = 1

    def features(self, data: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 11) -> np.ndarray:
        """The pooled vectors of each text; zeros for a text without tokens."""
        n = len(offsets) - 1
        h, row, _ = tokens(data, offsets)
        at = np.searchsorted(self.known, h)
        inside = np.minimum(at, max(0, len(self.known) - 1))
        at = np.where((self.known[inside] == h) if len(self.known) else False, inside, len(self.known))
        mean, square, beside = (np.zeros((n, DIM + 1), np.float32) for _ in range(3))
        for i in range(0, len(h), chunk):
            begin = max(0, i - 1)  # the last token of the chunk before is the first one's neighbour
            r, x = row[begin : i + chunk], self.vectors[at[begin : i + chunk]]
            both = x[1:] * x[:-1]
            both[r[1:] != r[:-1]] = 0
            for total, values, rows in ((mean, x[i - begin :], r[i - begin :]), (square, x[i - begin :] ** 2, r[i - begin :]), (beside, both, r[1:])):
                edge = np.flatnonzero(np.diff(rows, prepend=-1))
                if len(edge):
                    total[rows[edge]] += np.add.reduceat(values, edge, axis=0)
        size = np.bincount(row, minlength=n)[:, None]
        for total in (mean, square, beside):
            total /= np.maximum(size, 1)
        return np.concatenate((mean, np.sqrt(np.maximum(square - mean**2, 0)), beside, mean * np.log1p(size).astype(np.float32)), axis=1)

    def all_features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """features(), piece by piece, so that memory stays small."""
        done = [self.features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in pieces(offsets, 1 << 19)]
        return np.concatenate(done) if done else np.zeros((0, POOLED), np.float32)


class Network:
    """Two layers, trained by Adam on the logistic loss; probabilities are divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.w, self.temperature = w, 1.0
        fit = np.flatnonzero(~held)
        m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        z = (x - self.mean) / self.scale
        for _ in range(EPOCHS):
            rng.shuffle(fit)
            for i in range(0, len(fit), 64):
                b = fit[i : i + 64]
                hidden = np.tanh(z[b] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-(hidden @ w[2] + w[3][0]))) - y[b]) / len(b)
                back = np.outer(d, w[2]) * (1 - hidden**2)
                step += 1
                for k, g in enumerate((z[b].T @ back + DECAY * w[0], back.sum(0), hidden.T @ d + DECAY * w[2], np.array([d.sum()]))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        at = np.flatnonzero(held) if held.any() else fit
        logits, best = self.logits(x[at]), np.inf
        for t in np.geomspace(0.25, 8, 60):
            loss = np.logaddexp(0, np.where(y[at] == 1, -1, 1) * logits / t).mean()
            if loss < best:
                best, self.temperature = loss, float(t)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def held_out(doc_id):
    """Whether a document's label is kept from training."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> tuple[Vectors, Network]:
    """A model from at most so many labelled rows and TRAIN_BYTES of text, taken in the order of a hash of their doc_id.

    Labels that are null, or contradict each other for one doc_id, aren't used; of the texts that share a doc_id the
    least is. Without usable labels, or with labels of one kind only, the score is 0.5.
    """
    chosen = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    chosen = chosen.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_top")).filter("_y = _top").drop("_top")
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # the limit bounds what is broadcast
    texts = docs.select(F.col(doc_id).alias("_doc"), text_of(text).alias("_t"))
    one = cut(texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id", "_y").agg(F.min("_t").alias("_t")))
    up_to = F.sum("_n").over(Window.orderBy(F.xxhash64("_id"), "_id"))  # over at most so many lengths
    taken = one.select("_id", F.octet_length("_t").cast("long").alias("_n")).withColumn("_n", up_to).filter(F.col("_n") <= TRAIN_BYTES)
    table = one.join(F.broadcast(taken.select("_id")), "_id", "left_semi").select("_id", "_y", "_t").toArrow().sort_by("_id")
    column = table.column("_t").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    y = np.array(table.column("_y").to_pylist(), float)
    data, offsets = utf8(column)
    parts = pieces(offsets, 1 << 20)
    read = [tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in parts]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    vectors = Vectors(np.concatenate([none[0], *(x[0] for x in read)]), np.concatenate([none[1], *(x[1] + a for x, (a, _) in zip(read, parts))]))
    if len(set(y.tolist())) < 2:
        return vectors, None
    x = vectors.all_features(data, offsets)
    held = (mix(np.array(table.column("_id").to_pylist()).astype(np.int64).view(np.uint64)) % np.uint64(5)) == 0
    return vectors, Network(x, y, held)


def score(docs: DataFrame, model: tuple[Vectors, Network], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of each row from its text alone; null and empty texts are scored as texts without tokens."""
    spark = docs.sparkSession
    bound_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = held.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            x = vectors.all_features(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.score(x) if network else np.full(len(x), 0.5))], ["doc_id", "score"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: tuple[Vectors, Network], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs that score the threshold or more, with all their columns, without a shuffle.

    Each row counts for itself: null and repeated ids don't matter, null and empty texts are scored as texts without
    tokens, an empty table stays empty. Without a network all rows stay.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    held = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = held.value
        for batch in batches:
            column = batch.column(place).fill_null("")
            data, offsets = utf8(column)
            if network:
                batch = batch.filter(pa.array(network.score(vectors.all_features(data, offsets)) >= threshold))
            yield batch

    return map_arrow(docs, run)
