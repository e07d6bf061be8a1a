"""Toxicity by compression: zstandard dictionaries of ordinary and of toxic text, windows compared by length.

A window is three consecutive words, and every second word begins one, in a frame that ends with a fixed pad
(zstandard begins no match in the last bytes of its input). Two dictionaries are compared: one trained on ordinary windows and
again on those that it compresses worst, and the same one with a dictionary of toxic windows before it, so that a
window is shorter under the second only by what toxic text adds.

Toxic texts are ordinary for the most part, so the windows that the toxic dictionary is trained on are found by
compression too, in rounds over two folds: windows of toxic texts that no ordinary text has and that the ordinary
dictionary compresses unusually badly train a dictionary for one fold; in the other, the windows that gain more from it
than ordinary windows do are kept; the next round trains on texts that have none yet. No word list is involved.

Each cell of (raw length, length under the first, gain) is calibrated on the training texts as the log ratio of the
shares of toxic and ordinary texts that hold it, gains coming from the other fold's dictionary. A text's counts of
windows in cells of rising ratio, and of rising gain, go into a logistic score, corrected to the labels' shares in
the corpus.

Training takes a bounded sample of labelled rows (FIT_ROWS, FIT_CHARS); scoring takes every window of every text, a batch of
texts at a time, and no text's score depends on the others. Null and empty texts have no windows and get the score of a
text without toxic windows. Without labels of both kinds each score is 0. Contradicting labels of one id are settled by
the larger. A score of exactly 0.5 is toxic. Repeated rows give repeated results, empty tables empty ones. Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import byte_slices, hash_share, sampled_labels, uncollected

#: Bounds of the labelled sample (in expectation; half of each label): rows, and characters of their texts.
FIT_ROWS, FIT_CHARS = 5_000, 16_000_000
#: Windows that a dictionary is trained on at most.
FIT_WINDOWS = 60_000
#: Bytes of each of the two ordinary dictionaries, of a round's toxic one, and of the last one.
ORDINARY_BYTES, ROUND_BYTES, TOXIC_BYTES = 32_768, 1024, 2048
WORDS, STRIDE = 3, 2
LEVEL, MIN_MATCH, SEGMENT = 6, 3, 20
ROUNDS, FOLDS = 3, 2
#: Share of ordinary windows that count as badly compressed; windows and surplus that a gain must have to be kept.
BAD, LEAST_WINDOWS, SURPLUS = 0.03, 30, 4.0
TIERS = (0.7, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0)
GAINS = (1, 2, 3, 4, 5, 6, 7, 8)
#: Characters of texts that are scored at a time (a longer text is by itself).
SLICE = 1 << 20
#: Windows that are compressed at a time.
BATCH = 100_000
_PAD = bytes(range(33, 49))
_LETTER = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])
_LONGEST = 255

SCHEMA = "doc_id long, score double, predicted int"


@dataclass
class Windows:
    """Framed windows of texts: places in one buffer, raw lengths, and the text of each."""

    buffer: bytes
    start: np.ndarray
    size: np.ndarray
    text: np.ndarray

    def __getitem__(self, i: int) -> bytes:
        """Without the pad."""
        return self.buffer[self.start[i] : self.start[i] + self.size[i] - len(_PAD)]

    def raw(self) -> np.ndarray:
        return np.minimum(self.size - len(_PAD) - 2, _LONGEST).astype(np.int32)


def windows(texts: list[str]) -> Windows:
    """Each window is a blank, WORDS words with a blank between, a blank, and the pad; a short text is one window."""
    raw = [t.lower().encode() + b" " for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    x = np.frombuffer(b"".join(raw), np.uint8)
    x = np.where(_LETTER[x], x, 32).astype(np.uint8)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    text_ends = np.cumsum(keep)[ends - 1] if len(ends) else ends
    x = x[keep]
    letter = x != 32
    first = np.flatnonzero(letter & np.concatenate([[True], ~letter[:-1]]))
    last = np.flatnonzero(letter & np.concatenate([~letter[1:], [True]])) + 1
    text = np.searchsorted(text_ends, first, side="right")
    many = np.bincount(text, minlength=len(texts))
    place = np.arange(len(first)) - (np.cumsum(many) - many)[text]
    # A window for every STRIDE words, as long as words are left that the window before does not hold.
    begins = np.flatnonzero((place % STRIDE == 0) & ((place == 0) | (place + WORDS - STRIDE < many[text])))
    stop = np.minimum(begins + WORDS, np.cumsum(many)[text[begins]]) - 1
    start, size = first[begins], last[stop] - first[begins]
    total = size + 2 + len(_PAD)
    new = np.cumsum(total) - total  # places in the buffer
    out = np.full(int(total.sum()), 32, np.uint8)
    before = np.cumsum(size) - size
    each = np.arange(int(size.sum()), dtype=np.int32)
    out[each + np.repeat((new + 1 - before).astype(np.int32), size)] = x[each + np.repeat((start - before).astype(np.int32), size)]
    out[((new + size + 2)[:, None] + np.arange(len(_PAD))).ravel()] = np.tile(np.frombuffer(_PAD, np.uint8), len(size))
    return Windows(out.tobytes(), new, total, text[begins])


def joined_windows(texts: list[str]) -> Windows:
    """windows of many texts, made a slice at a time."""
    buffers, parts, held = [], [], 0
    for a, b in byte_slices([len(t) for t in texts], SLICE):
        w = windows(texts[a:b])
        buffers.append(w.buffer)
        parts.append((w.start + held, w.size.astype(np.int32), (w.text + a).astype(np.int32)))
        held += len(w.buffer)
    return Windows(b"".join(buffers), *(np.concatenate([p[i] for p in parts]) for i in range(3)))


class Compressor:
    """Lengths of windows under a dictionary of plain content."""

    def __init__(self, content: bytes):
        import zstandard as zs

        params = zs.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=False, write_dict_id=False, write_checksum=False, format=zs.FORMAT_ZSTD1_MAGICLESS)
        self.segments = zs.BufferWithSegments
        self.compressor = zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=params)

    def __call__(self, w: Windows, at: np.ndarray | None = None) -> np.ndarray:
        start, size = (w.start, w.size) if at is None else (w.start[at], w.size[at])
        lengths = np.zeros(len(start), np.int32)
        for a in range(0, len(start), BATCH):
            place = np.column_stack([start[a : a + BATCH], size[a : a + BATCH]]).astype(np.uint64).tobytes()
            out = self.compressor.multi_compress_to_buffer(self.segments(w.buffer, place), threads=1)
            lengths[a : a + len(out)] = np.fromiter((len(out[i]) for i in range(len(out))), np.int32, len(out))
        return lengths


def trained(samples: list[bytes], size: int, segment: int = 0) -> bytes:
    """A dictionary of at most `size` bytes; of too few samples, these themselves."""
    import zstandard as zs

    try:
        return zs.train_dictionary(size, samples, level=LEVEL, **({"k": segment, "d": 6} if segment else {})).as_bytes()
    except zs.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass
class ToxicModel:
    ordinary: bytes = b""
    toxic: bytes = b""  # toxic content before the ordinary
    tiers: np.ndarray = None  # number of TIERS that each cell reaches
    weights: np.ndarray = None
    bias: float = 0.0


class CellReader:
    """Raw length, length under the ordinary dictionary, and gain of windows."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.a, self.b = Compressor(ordinary), Compressor(toxic)

    def __call__(self, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.a(w)
        return w.raw(), a, a - self.b(w)


def cells(raw: np.ndarray, a: np.ndarray, gain: np.ndarray) -> np.ndarray:
    return (np.minimum(raw, 31) * 64 + np.minimum(a, 63)) * 16 + np.clip(gain, -1, 14) + 1


_CELLS = 32 * 64 * 16


def counted(text: np.ndarray, n: int, tier: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """log(1 + windows) of each of n texts by tier reached, by gain, and of all."""
    columns = [np.bincount(text, tier >= k, n) for k in range(1, len(TIERS) + 1)] + [np.bincount(text, gain >= k, n) for k in GAINS]
    return np.log1p(np.column_stack([*columns, np.bincount(text, minlength=n)]))


def all_features(texts: list[str], model: ToxicModel, reader: CellReader) -> np.ndarray:
    w = windows(texts)
    raw, a, gain = reader(w)
    return counted(w.text, len(texts), model.tiers[cells(raw, a, gain)], gain)


def features(text: str, model: ToxicModel, reader: CellReader) -> np.ndarray:
    return all_features([text], model, reader)[0]


def _surprise(w: Windows, a: np.ndarray, ordinary: np.ndarray) -> tuple[np.ndarray, float]:
    """How much longer each window is than ordinary ones of its raw length, and where the worst of the ordinary ones begin."""
    raw = w.raw()
    many = np.bincount(raw[ordinary], minlength=_LONGEST + 1)
    mean = np.bincount(raw[ordinary], a[ordinary], _LONGEST + 1) / np.maximum(many, 1)
    mean[many == 0] = np.interp(np.flatnonzero(many == 0), np.flatnonzero(many), mean[many > 0])
    over = a - mean[raw]
    return over, float(np.quantile(over[ordinary], 1 - BAD))


def fit_toxic(toxic: list[str], ordinary: list[str], seed: int = 6) -> ToxicModel:
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    n1, n0 = len(toxic), len(ordinary)
    if not n1 or not n0:
        return ToxicModel()
    w = joined_windows([*toxic, *ordinary])
    y = np.r_[np.ones(n1), np.zeros(n0)]
    rng = np.random.default_rng(seed)
    drawn = lambda at: [w[i] for i in rng.permutation(at)[:FIT_WINDOWS]]
    no, yes = np.flatnonzero(y[w.text] == 0), np.flatnonzero(y[w.text] == 1)
    if not len(no) or not len(yes):
        return ToxicModel()
    common = trained([x + _PAD for x in drawn(no)], ORDINARY_BYTES)
    over, cut = _surprise(w, Compressor(common)(w), no)
    common = trained(drawn(no[over[no] >= cut]), ORDINARY_BYTES, SEGMENT) + common
    a = Compressor(common)(w)
    over, cut = _surprise(w, a, no)
    # Passages that ordinary texts share say nothing; a window counts once, or copies would confirm each other.
    names = np.fromiter((hash(w[i]) for i in range(len(w.size))), np.int64, len(w.size))
    yes = yes[~np.isin(names[yes], names[no])]
    yes = np.sort(yes[np.unique(names[yes], return_index=True)[1]])
    fold = rng.integers(0, FOLDS, n1 + n0)
    some = rng.permutation(no)[:200_000]
    kept = {f: yes[:0] for f in range(FOLDS)}
    content = dict.fromkeys(range(FOLDS), b"")  # trained on the other folds
    others = lambda f: np.concatenate([kept[g] for g in range(FOLDS) if g != f])
    for _ in range(ROUNDS):
        new = dict(kept)
        for f in range(FOLDS):
            held = yes[fold[w.text[yes]] != f]
            left = held[~np.isin(w.text[held], w.text[others(f)]) & (over[held] >= cut)]
            if len(left) < LEAST_WINDOWS:
                continue
            content[f] = trained(drawn(left), ROUND_BYTES, SEGMENT) + content[f]
            compressor, own = Compressor(content[f] + common), yes[fold[w.text[yes]] == f]
            gain, usual = a[own] - compressor(w, own), a[some] - compressor(w, some)
            for least in range(1, 16):
                found = int((gain >= least).sum())
                if found >= LEAST_WINDOWS and found >= SURPLUS * ((usual >= least).sum() + 0.5) / len(usual) * len(gain):
                    new[f] = own[gain >= least]
                    break
        kept = new
    every = np.concatenate(list(kept.values()))
    if not len(every):  # too few texts for rounds: the windows that ordinary text explains worst
        every = yes if len(yes) else np.flatnonzero(y[w.text] == 1)
        every = every[np.argsort(-over[every], kind="stable")[: max(1, len(every) // 10)]]
        kept = {f: every[fold[w.text[every]] == f] for f in range(FOLDS)}
    model = ToxicModel(common, trained(drawn(every), TOXIC_BYTES, SEGMENT) + common)
    gain = np.zeros(len(a), np.int32)
    for f in range(FOLDS):
        own, held = np.flatnonzero(fold[w.text] == f), others(f)
        content_f = trained(drawn(held), TOXIC_BYTES, SEGMENT) + common if len(held) else model.toxic
        gain[own] = a[own] - Compressor(content_f)(w, own)
    cell = cells(w.raw(), a, gain)
    pairs = np.unique(w.text.astype(np.int64) * _CELLS + cell)
    in1, in0 = (np.bincount(pairs[y[pairs // _CELLS] == k] % _CELLS, minlength=_CELLS) for k in (1, 0))
    ratio = np.log((in1 + 0.5) / (n1 + 1)) - np.log((in0 + 0.5) / (n0 + 1))
    model.tiers = np.where(in1 >= 3, sum((ratio >= t).astype(np.int8) for t in TIERS), 0).astype(np.int8)
    model.weights, model.bias = _logistic(counted(w.text, n1 + n0, model.tiers[cell], gain), y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 5.0) -> tuple[np.ndarray, float]:
    z = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(keep)
        w += np.linalg.solve(hessian, z.T @ (y - p) - keep * w)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, keep: Column, bound: int = FIT_ROWS, seed: int = 6) -> ToxicModel:
    sample, counts = sampled_labels(labels, "toxic", bound, seed, keep)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")  # bounded by the sample
    chars = rows.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0
    rows = rows.where(hash_share(seed + 1, F.col("doc_id")) < min(1.0, FIT_CHARS / max(1, chars))).collect()
    texts = {k: [r["text"] for r in rows if r["label"] == k] for k in (0, 1)}
    model = fit_toxic(texts[1], texts[0], seed)
    if model.weights is not None:  # the sample has other shares of the labels than the corpus
        model.bias += math.log(counts[1] / counts[0]) - math.log(len(set(texts[1])) / len(set(texts[0])))
    return model


def toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score and predicted of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = CellReader(model.ordinary, model.toxic) if model.weights is not None else None
        for batch in uncollected(batches):
            scores = np.zeros(batch.num_rows)
            if reader is not None:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for a, b in byte_slices([len(t) for t in texts], SLICE):
                    margin = (all_features(texts[a:b], model, reader) * model.weights).sum(axis=1) + model.bias
                    scores[a:b] = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
