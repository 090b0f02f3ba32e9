"""SentencePiece encoding and decoding with a given model; forward states are shared between words with a prefix.

Text is cut into marked words (the mark stands for a space). The distinct words of a batch are sorted, which makes
them the leaves of a trie met depth first: a word keeps the forward states of the prefix that it shares with the word
before, and only the rest is computed. The forward state of a prefix is its last piece and where that begins; going
back from the end gives the pieces.

In a unigram model the state is the best-scoring last piece (Viterbi). In a BPE model scores are merge ranks, whose
sums mean nothing, and the best path isn't what the tokenizer returns; there the state is the one last piece that
stays apart from the piece before it when both are merged by rank, which gives the tokenizer's own result.
"""

from __future__ import annotations

import heapq
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bound_batches, map_arrow, pieces, quoted, utf8

MODEL = os.environ.get("TIDEMARK_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
CACHE = 8 << 20  # letters of words and bytes of ids that each of two generations of a worker's memory holds
PAIRS = 1 << 18  # tested pairs that it remembers, and steps


class Codec:
    """The pieces of a model, and what encodes with them."""

    def __init__(self, texts: list[str], scores: list[float], byte_ids: list[int], unknown: int, bpe: bool):
        self.texts, self.byte_ids, self.unknown, self.bpe = texts, byte_ids, unknown, bpe
        special = set(byte_ids) | {i for i, t in enumerate(texts) if not t}
        self.ids = {t: i for i, t in enumerate(texts) if i not in special}
        self.scores = {t: scores[i] for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min(self.scores.values(), default=0.0) - 10
        self.heads = {t[:i] for t in self.ids for i in range(1, len(t) + 1)} if bpe else set()
        self.steps: dict[str, tuple[str, list[tuple[str, int]]]] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0  # letters and bytes in words
        self.pairs: dict[tuple[str, str], bool] = {}
        pairs = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        inside = {c for pair in pairs for c in pair}
        # signs that no piece has within it, and signs that no piece has right after a letter, begin a word
        alone = "".join(c for c in "\n\t\r" if c not in inside)
        after = {pair[1] for pair in pairs if re.match(f"[{LETTER}]", pair[0])}
        hard = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in after)
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("a piece of this model goes on after a mark within it; words can't be encoded apart")
        other, soft = rf"[^{LETTER}{MARK}{alone}]", rf"[^{LETTER}{MARK}{alone}{re.escape(hard)}]"
        self.cut = re.compile((f"[{alone}]|" if alone else "") + rf"(?=.){MARK}*{other}*(?:[{LETTER}]+(?:{soft}{other}*)?)*", re.S)
        self.bytes = [bytes([byte_ids.index(i)]) if i in byte_ids else t.replace(MARK, " ").encode() for i, t in enumerate(texts)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.table = np.frombuffer(b"".join(self.bytes), np.uint8)

    @classmethod
    def load(cls, path: str) -> Codec:
        """On the driver; what the workers need is sent to them, so they don't read the file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if model.normalize("  Aﬁ① b ") != f"{MARK}{MARK}{MARK}Aﬁ①{MARK}b{MARK}":
            raise ValueError("only models that leave text as it is and add a space in front are known here")
        byte_at = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        out = [model.id_to_piece(i) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) else "" for i in range(n)]
        # merge ranks are whole numbers; log-probabilities aren't
        bpe = all(float(model.get_score(i)).is_integer() for i in range(n))
        return cls(out, [model.get_score(i) for i in range(n)], [byte_at[b] for b in range(256)] if len(byte_at) == 256 else [], model.unk_id(), bpe)

    def merged(self, word: str) -> list[str]:
        """Plain merging: again and again the best pair, the leftmost of equals. A heap of pairs keeps long words cheap."""
        parts, scores, n = list(word), self.scores, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                both = parts[i] + parts[after[i]]
                s = scores.get(both)
                if s is not None:
                    heapq.heappush(heap, (-s, i, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if j >= n or not parts[i] or parts[i] + parts[j] != both:
                continue  # one of the two has been merged with something else since
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [p for p in parts if p]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts that a piece of the model is merged from at last; None for a single letter."""
        if piece not in self.halves:
            found = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in self.ids and piece[i:] in self.ids]
            self.halves[piece] = next((h for h in found if len(found) == 1 or self.apart(*h, self.scores[piece])), None)
        return self.halves[piece]

    def apart(self, a: str, b: str, over: float = np.inf) -> bool:
        """Whether pieces a and b stay as they are side by side, or were so before merges of the score over.

        Their last merges are taken back, the later one first; the parts that meet then must not have been merged before.
        """
        scores, limit, strict = self.scores, -np.inf, False
        if over != np.inf:
            limit, strict = over, True
        while True:
            both = scores.get(a + b)
            if both is not None and (both > limit or both == limit and not strict):
                return False
            x, y = self.split(a) if len(a) > 1 else None, self.split(b) if len(b) > 1 else None
            if x is None and y is None:
                return True
            # of merges with equal rank the left one comes first, so the right one is taken back first
            if y is None or x is not None and scores[a] < scores[b]:
                limit, strict, a = scores[a], True, x[1]
            else:
                limit, strict, b = scores[b], False, y[0]

    def step(self, state: str, letter: str) -> tuple[str, list[tuple[str, int]]]:
        """The longest end of state and letter that some piece begins with, and the pieces that end there, the longest first."""
        if len(self.steps) >= PAIRS:
            self.steps.clear()
        at = state + letter
        while at and at not in self.heads:
            at = at[1:]
        fit = [(at[i:], len(at) - i) for i in range(len(at)) if at[i:] in self.ids]
        if not fit or fit[-1][1] > 1:
            fit.append((letter, 1))
        known = self.steps[state + letter] = at, fit
        return known

    def test_pair(self, a: str, b: str) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[a, b] = self.apart(a, b)
        return known

    def encode_words(self, words: list[str]) -> list[list[str]]:
        """Pieces of each of the sorted, distinct words."""
        out, before, last, score, states = [], "", [""], [0.0], [""]
        longest, bpe, steps, pairs = self.longest, self.bpe, self.steps, self.pairs
        for w in words:
            if bpe and w.startswith(MARK + MARK):  # runs of spaces have merges of equal rank
                out.append(self.merged(w))
                continue
            keep = 0
            for x, y in zip(before, w):
                if x != y:
                    break
                keep += 1
            del last[keep + 1 :], score[keep + 1 :], states[keep + 1 :]
            state = states[-1] if bpe else ""
            for end in range(keep + 1, len(w) + 1):
                if bpe:
                    state, fit = steps.get(state + w[end - 1]) or self.step(state, w[end - 1])
                    states.append(state)
                    for piece, size in fit:  # a single letter is left over
                        if size == end:
                            break
                        pair = last[end - size], piece
                        known = pairs.get(pair)
                        if known or known is None and self.test_pair(*pair):
                            break
                    last.append(piece)
                else:
                    top, piece = -np.inf, w[end - 1]
                    for begin in range(max(0, end - longest), end):
                        s = self.scores.get(w[begin:end], self.worst if end - begin == 1 else -np.inf) + score[begin]
                        if s > top:
                            top, piece = s, w[begin:end]
                    last.append(piece)
                    score.append(top)
            parts, end = [], len(w)
            while end:
                parts.append(last[end])
                end -= len(last[end])
            out.append(parts[::-1])
            before = w
        return out

    def packed(self, parts: list[str]) -> bytes:
        """Ids of the pieces, four bytes each."""
        return array("i", self.to_ids(parts)).tobytes()

    def to_ids(self, parts: list[str]) -> list[int]:
        try:
            return [self.ids[p] for p in parts]
        except KeyError:
            pass
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if self.held > CACHE:  # words that weren't met since the last time are forgotten
            self.older, self.words, self.held = self.words, {}, 0
        known, older = self.words, self.older
        here = {w for c in cut for w in c} - known.keys()
        again = here & older.keys()
        known.update((w, older[w]) for w in again)
        new = sorted(here - again)
        known.update(zip(new, map(self.packed, self.encode_words(new))))
        self.held += sum(100 + len(w) + len(known[w]) for w in here)  # a word and its entry take about that much besides
        return [b"".join([known[w] for w in c]) for c in cut]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [array("i", x).tolist() for x in self.encode_packed(texts)]

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of several lists of ids, laid end to end."""
        size = self.sizes[ids]
        to = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(to[-1]) + np.repeat(self.begins[ids] - to[:-1], size)
        raw = self.table[at]
        begin, end = to[ends[:-1]], to[ends[1:]]
        if len(raw):  # the space that was added in front
            begin = begin + ((end > begin) & (raw[np.minimum(begin, len(raw) - 1)] == 32))
        flat = raw.tobytes()
        return pa.array([flat[a:b].decode("utf-8", "replace") for a, b in zip(begin.tolist(), end.tolist())], pa.string())

    def decode(self, ids) -> str:
        return self.decode_batch(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


def encode(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """docs with a column ids array<int>: the tokenizer's ids of each whole text. Null and empty texts have none.

    The text column itself is kept. All rows stay; nothing is shuffled. A column ids that is there already is replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    held = spark.sparkContext.broadcast(Codec.load(model))
    kept = [c for c in docs.columns if c != "ids"]
    source = docs.select(*quoted(kept))
    place = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held.value
        for batch in batches:
            column = batch.column(place).fill_null("")
            _, offsets = utf8(column)
            for a, b in pieces(offsets, 1 << 19):
                packed = codec.encode_packed(column.slice(a, b - a).to_pylist())
                size = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed])))
                ids = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), ids], names=[*batch.schema.names, "d0"])

    return map_arrow(source, run, T.StructField("ids", T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with a column of the text that the ids stand for; null and empty ids stand for an empty text.

    All rows stay, repeated ones too; a column of that name that is there already is replaced. An empty table stays empty.
    """
    spark = encoded.sparkSession
    bound_batches(spark)
    held = spark.sparkContext.broadcast(Codec.load(model))
    kept = [c for c in encoded.columns if c != text]
    source = encoded.select(*quoted(kept))
    place = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held.value
        for batch in batches:
            column = batch.column(place)
            ends = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            done = [codec.decode_batch(flat[ends[a] : ends[b]], ends[a : b + 1] - ends[a]) for a, b in pieces(ends, 1 << 17)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(done) if done else pa.array([], pa.string())], names=[*batch.schema.names, "d0"])

    return map_arrow(source, run, T.StructField(text, T.StringType()))
