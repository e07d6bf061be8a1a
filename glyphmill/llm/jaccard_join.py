"""N-gram Jaccard join with set-relation skipping: an exact similarity self-join of sets of word shingles.

A document's set is its distinct 5-word shingles as 64-bit hashes; documents of equal sets are one node. Sets are
told apart by two 64-bit signatures: nodes go by the first, and sets that share a first signature but not the
second (n^2 / 2^65 are expected among n) are found and go by the second, so sets merge only where 128 bits agree.
Shingles are ordered by frequency class (estimated on a sample of documents, which steers cost only: any order
gives the same links), then by hash. Two sets that reach the threshold share a shingle in their prefixes, so only
prefixes are indexed.

Index-level skipping: a list is cut by set size into blocks that can link at all. In a first round each block's
middle set (its head) is paired with the others, as are sets of neighbouring sizes, where positions leave enough
overlap, and each set is compared with a few of its pairs; links give components. In a second round each list is
ordered (its most common component, then the others, by size and position) and cut into blocks; a pair of blocks of one component, or whose sizes or
positions leave too small an overlap, is skipped as a whole before any of its pairs is formed.

Answer-level skipping: in the second round a set's answers follow from its head's where they can: of pairs with a
common head, those whose similarities to it differ by more than the threshold allows can't link (Jaccard distance
is a metric). Before a comparison of texts the parities of both sets by hash class bound their difference from
below. What is compared is derived incrementally: the overlap of a hub with a set is its overlap with a highly
similar set, changed by the shingles in which the two differ, which are computed once for all hubs. No link between
components is lost, so components are exact.

The number of parts follows the bytes of text. Lists of frequent shingles are salted by set, in number with their
estimated length; their heads are compared across salts, and in the second round only the rows outside a list's
most common component are copied to its salts. Lists of one component are dealt out beyond FAMILY_ROWS. Nothing is
dropped or capped.

Null and empty texts have empty sets and link with nothing, as do rows with a null id, whose component is
null. Repeated rows give repeated results. Rows of one id with different texts are separate sets of one id.
Sets of similarity exactly 0.8 link. Very long texts are single items of a batch. Empty tables give empty ones.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import byte_slices, written

SHINGLE = 5
#: The threshold as a fraction.
UP, DOWN = 4, 5
#: One document in so many is in the sample that tells frequent shingles; a shingle is one from HOT_COUNT documents of it.
SAMPLE, HOT_COUNT = 32, 3
#: Bound of the broadcast table of frequent shingles (16 bytes each); beyond it, rarer ones count as infrequent.
HOT_BOUND = 1_000_000
#: Estimated rows of one salt of a list.
LIST_ROWS = 20_000
#: Entries of lists of one common component that go to one bucket of the second round.
FAMILY_ROWS = 4_000
#: Rows of a block of the second round, and pairs of blocks whose pairs are formed at a time.
SKIP_ROWS, SKIP_PAIRS = 32, 512
#: Bytes of text for each task of the first round; each task has PARTS_EACH parts.
TASK_BYTES, PARTS_EACH = 16 << 20, 4
#: Sets next to each other by size that are paired in a list, and pairs of a set that are compared in the first round.
CHAIN, WAVE = 3, 4
#: Lists up to this length are compared pairwise at once.
SHORT_LIST = 4
#: Pairs of one hub that are verified in one bucket, and bytes of texts of a bucket (on average).
HUB_PAIRS, BUCKET_BYTES = 500, 8 << 20
#: Documents fetched for verification whose ids are broadcast; with more, they are joined by shuffle.
BROADCAST_IDS = 500_000

#: Characters of texts that are made into sets at a time (a longer text is by itself).
SLICE_BYTES = 1 << 20

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**63, 256, np.uint64) * _U(2) + _U(1)
_PLACE = _RNG.integers(0, 2**63, SHINGLE + 1, np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """document (its place) and hash of each distinct shingle, sorted by both."""
    raw = [t.encode().lower() for t in texts]  # bytes.lower changes A-Z only
    x = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    starts_of = np.cumsum([1] + [len(r) + 1 for r in raw])
    blank = _SPACE[x]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[x] * _powers(len(x), _BASE), dtype=np.uint64)])
    word = mixed((total[last] - total[first]) * _powers(len(x), _BASE_INVERSE)[first] + (last - first).astype(np.uint64))
    doc = np.searchsorted(starts_of, first, side="right") - 1
    n = len(word) - SHINGLE + 1
    docs, hashes = [], []
    if n > 0:
        whole = np.flatnonzero(doc[:n] == doc[SHINGLE - 1 :])
        value = sum((word[whole + j] * _PLACE[j] for j in range(SHINGLE)), np.zeros(len(whole), np.uint64))
        docs.append(doc[whole])
        hashes.append(mixed(value))
    words = np.bincount(doc, minlength=len(texts))
    for d in np.flatnonzero((words > 0) & (words < SHINGLE)):
        own = word[np.searchsorted(doc, d) :][: words[d]]
        docs.append(np.array([d]))
        hashes.append(mixed((own * _PLACE[: len(own)]).sum(dtype=np.uint64)[None] + _PLACE[SHINGLE:] * _U(len(own))))
    doc, value = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def signatures(doc: np.ndarray, value: np.ndarray, n: int, renamed: np.ndarray | None = None, mask: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and both signatures of each of n documents' sets; sets whose first is among `renamed` (sorted) go by the second.

    mask cuts the first signature, for tests.
    """
    sizes = np.bincount(doc, minlength=n)
    ends = np.cumsum(sizes)

    def summed(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        return total[ends] - total[ends - sizes]

    first = mixed(summed(mixed(value + _PLACE[0])) + sizes.astype(np.uint64) * _PLACE[1]).view(np.int64) & np.int64(mask)
    second = mixed(summed(mixed(value ^ _PLACE[2])) + sizes.astype(np.uint64) * _PLACE[3]).view(np.int64)
    if renamed is not None and len(renamed):
        at = np.minimum(np.searchsorted(renamed, first), len(renamed) - 1)
        first = np.where(renamed[at] == first, second, first)
    return sizes, first, second


def parities(doc: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Bits of each set: whether the number of its hashes in each class is odd; four to eight classes for each hash."""
    ends = np.cumsum(sizes)
    out = []
    for n, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        classes = _classes(n)
        out.append(np.packbits(np.bincount((value[end - n : end] & _U(classes - 1)).astype(np.int64), minlength=classes).astype(np.uint8) & 1).tobytes())
    return out


def _classes(n: int) -> int:
    return 1 << max(6, (4 * n - 1).bit_length())


def _matrix(bits: list[bytes], width: int) -> np.ndarray:
    """Rows of 64-bit words of parities folded to `width` classes (or half of a wider one's, never more)."""
    out = np.zeros((len(bits), width // 64), np.uint64)
    for i, b in enumerate(bits):
        x = np.unpackbits(np.frombuffer(b, np.uint8))
        while len(x) > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = np.packbits(x).view(np.uint64)
    return out


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str]]]:
    texts = [t or "" for t in batch.column(column).to_pylist()]
    for a, b in byte_slices([len(t) for t in texts], SLICE_BYTES):
        yield a, b, texts[a:b]


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many documents of the sample (sorted) and how many hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, b, texts in _texts(batch, 0):
                doc, value = shingle_sets(texts)
                _, sig, _ = signatures(doc, value, len(texts))
                once = np.zeros(len(texts), bool)
                once[np.unique(sig, return_index=True)[1]] = True
                got, n = np.unique(value[once[doc]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(n)], names=["t", "n"])

    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    counts = written(part.mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_COUNT), "frequent")
    least = HOT_COUNT
    while counts.where(F.col("n") >= least).count() > HOT_BOUND:
        least *= 2
    rows = counts.where(F.col("n") >= least).toPandas()
    t, n = rows["t"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(t)
    return t[order], n[order]


def prefixes(doc: np.ndarray, value: np.ndarray, hot: np.ndarray, hot_n: np.ndarray) -> tuple[np.ndarray, ...]:
    """document, shingle, position and number of salts of each prefix entry, in the global order."""
    count = np.zeros(len(value), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, value), len(hot) - 1)
        count = np.where(hot[at] == value, hot_n[at], 0)
    level = np.frexp(count.astype(float))[1]
    order = np.lexsort((value, level, doc))
    doc, value, count = doc[order], value[order], count[order]
    sizes = np.bincount(doc)
    start = np.concatenate([[0], np.cumsum(sizes)])[doc]
    position = np.arange(len(doc)) - start
    size = sizes[doc]
    keep = position < size - (UP * size + DOWN - 1) // DOWN + 1
    return doc[keep], value[keep], position[keep], np.maximum(1, -(-count[keep] * SAMPLE // LIST_ROWS))


_ENTRY = np.dtype([("t", "<u8"), ("sig", "<i8"), ("n", "<u4"), ("pos", "<u4"), ("salt", "<u2"), ("salts", "<u2")])
_DOC = np.dtype([("doc_id", "<i8"), ("sig", "<i8"), ("n", "<i8"), ("sig2", "<i8")])
_OUT = "kind int, a long, b long, n int, pos int, salt int, salts int, head long, bits binary"


def _index(docs: DataFrame, parts: int, hot: np.ndarray, hot_n: np.ndarray, renamed: np.ndarray, mask: int) -> DataFrame:
    """part, kind, blob: the documents' sizes and signatures (kind 0) and the prefix entries (kind 1), dealt by shingle."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, hot_n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_n = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, texts in _texts(batch, 1):
                doc, value = shingle_sets(texts)
                sizes, sig, sig2 = signatures(doc, value, len(texts), renamed, mask)
                rows = np.zeros(len(texts), _DOC)
                rows["doc_id"], rows["sig"], rows["n"], rows["sig2"] = ids[a:b], sig, sizes, sig2
                once = np.zeros(len(texts), bool)  # equal sets of a batch are indexed once
                once[np.unique(sig2, return_index=True)[1]] = True
                d, t, pos, salts = prefixes(doc, value, hot, hot_n)
                mine = once[d]
                d, t, pos, salts = d[mine], t[mine], pos[mine], np.minimum(salts[mine], 65535)
                entries = np.zeros(len(d), _ENTRY)
                entries["t"], entries["sig"], entries["n"], entries["pos"], entries["salts"] = t, sig[d], sizes[d], pos, salts
                entries["salt"] = mixed(sig[d].view(np.uint64)) % salts.astype(np.uint64)
                out = []
                own_part = (mixed(sig.view(np.uint64)) % _U(parts)).astype(np.int64)
                for i, bits in enumerate(parities(doc, value, sizes)):
                    out.append((int(own_part[i]), 0, rows[i : i + 1].tobytes() + bits))
                for kind, array, key in ((1, entries, mixed(t + entries["salt"].astype(np.uint64))),):
                    part = (key % _U(parts)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    array, part = array[order], part[order]
                    cuts = np.flatnonzero(np.diff(part)) + 1
                    for piece, at in zip(np.split(array, cuts), np.concatenate([[0], cuts]), strict=True):
                        if len(piece):
                            out.append((int(part[at]), kind, piece.tobytes()))
                if out:
                    p, k, blob = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(blob, pa.binary())], names=["part", "kind", "blob"])

    return docs.select("doc_id", "text").mapInArrow(run, "part int, kind int, blob binary")


def can_link(nx: np.ndarray, px: np.ndarray, ny: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Whether sizes, and positions of a shared shingle that is the first, leave enough overlap."""
    need = -(-(nx + ny) * UP // (UP + DOWN))
    return (DOWN * np.minimum(nx, ny) >= UP * np.maximum(nx, ny)) & (np.minimum(nx - px, ny - py) >= need)


def _lists(e: np.ndarray) -> Iterator[np.ndarray]:
    """The lists (of one shingle and salt, by size) that hold at least two sets, each set once."""
    e = e[np.lexsort((e["pos"], e["sig"], e["n"], e["salt"], e["t"]))]
    same = (e["t"][1:] == e["t"][:-1]) & (e["salt"][1:] == e["salt"][:-1])
    e = e[np.concatenate([[True], ~(same & (e["sig"][1:] == e["sig"][:-1]))])]
    cuts = np.flatnonzero((e["t"][1:] != e["t"][:-1]) | (e["salt"][1:] != e["salt"][:-1])) + 1
    bounds = np.concatenate([[0], cuts, [len(e)]])
    for i in np.flatnonzero((np.diff(bounds) > 1) | (e["salts"][bounds[:-1]] > 1)):
        yield e[bounds[i] : bounds[i + 1]]


def _first_round(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one part: documents (kind 0: doc_id, sig, n, sig2 as head), pairs (1: head, other), entries of longer lists (2: t, sig)."""
    out = []
    own = list(pdf.loc[pdf["kind"] == 0, "blob"])
    docs = np.frombuffer(b"".join(b[: _DOC.itemsize] for b in own), _DOC)
    out.append(pd.DataFrame({"kind": 0, "a": docs["doc_id"], "b": docs["sig"], "n": docs["n"].astype(np.int32), "pos": 0, "salt": 0, "salts": 1, "head": docs["sig2"], "bits": [b[_DOC.itemsize :] for b in own]}))
    blobs = [np.frombuffer(b, _ENTRY) for b in pdf.loc[pdf["kind"] == 1, "blob"]]
    pairs, entries = [], []
    if blobs:
        for e in _lists(np.concatenate(blobs)):
            n, pos = e["n"].astype(np.int64), e["pos"].astype(np.int64)
            if len(e) <= SHORT_LIST and e["salts"][0] == 1:
                i, j = np.triu_indices(len(e), 1)
                head = None
            else:
                # Blocks by size; the middle set of each is its head. Near sizes are paired too, so that a family of
                # near copies grows together before the second round.
                place = np.zeros(len(e), np.int64)
                start = 0
                while start < len(e):
                    end = int(np.searchsorted(n, n[start] * DOWN // UP, side="right"))
                    place[start:end] = (start + end) // 2
                    start = end
                every = np.arange(len(e))
                i = np.concatenate([place, *[every[:-d] for d in range(1, CHAIN + 1)]])
                j = np.concatenate([every, *[every[d:] for d in range(1, CHAIN + 1)]])
                i, j = i[i != j], j[i != j]
                head = e["sig"][place]
            ok = can_link(n[i], pos[i], n[j], pos[j])
            x, y = e["sig"][i[ok]], e["sig"][j[ok]]
            pairs.append(np.column_stack([x, y]))
            if head is not None:
                entries.append(pd.DataFrame({"kind": 2, "a": e["t"].view(np.int64), "b": e["sig"], "n": n.astype(np.int32), "pos": pos.astype(np.int32), "salt": e["salt"].astype(np.int32), "salts": e["salts"].astype(np.int32), "head": head, "bits": None}))
    if pairs:
        both = np.unique(np.concatenate(pairs), axis=0)
        out.append(pd.DataFrame({"kind": 1, "a": both[:, 0], "b": both[:, 1], "n": 0, "pos": 0, "salt": 0, "salts": 1, "head": 0, "bits": None}))
    return pd.concat([*out, *entries], ignore_index=True)


def room(nx: np.ndarray, ny: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many hashes may differ beyond the classes of unequal parity for sets to link; negative: they can't."""
    apart = np.bitwise_count(x ^ y).sum(axis=-1).astype(np.int64)
    return nx + ny - 2 * (-(-(nx + ny) * UP // (UP + DOWN))) - apart


def open_blocks(n: np.ndarray, pos: np.ndarray, comp: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of a list, each once, of those pairs of blocks that can hold a link between components.

    The list is put in order: its most common component, then the others, each by size and position. A pair of blocks
    is skipped as a whole if both are of one and the same component, if neither has a row that belongs here, or if the
    sizes, or what the positions leave, are too far apart for any two of their sets.
    """
    names, many = np.unique(comp, return_counts=True)
    order = np.lexsort((pos, n, comp != names[many.argmax()]))
    n, pos, comp, own = n[order], pos[order], comp[order], own[order]
    start = np.arange(0, len(n), SKIP_ROWS)
    low, high = np.minimum.reduceat(n, start), np.maximum.reduceat(n, start)
    left = np.maximum.reduceat(n - pos, start)
    first, last = np.minimum.reduceat(comp, start), np.maximum.reduceat(comp, start)
    here = np.maximum.reduceat(own.astype(np.int8), start) > 0
    place = np.arange(SKIP_ROWS)
    for p in range(len(start)):
        q = np.arange(p, len(start))
        ok = ~((first[p] == last[q]) & (last[p] == first[q])) & (here[p] | here[q])
        ok &= (DOWN * high[p] >= UP * low[q]) & (DOWN * high[q] >= UP * low[p])
        ok &= np.minimum(left[p], left[q]) >= -(-(low[p] + low[q]) * UP // (UP + DOWN))
        q = q[ok]
        for at in range(0, len(q), SKIP_PAIRS):
            j = (start[q[at : at + SKIP_PAIRS], None] + place).ravel()
            j = j[j < len(n)]
            i = np.arange(start[p], min(start[p] + SKIP_ROWS, len(n)))
            i, j = np.repeat(i, len(j)), np.tile(j, len(i))
            yield order[i[i < j]], order[j[i < j]]


def _second_round(entries: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """Of lists (a, to): pairs of different components that sizes, positions, common heads and parities don't rule out."""
    out = [np.zeros((0, 2), np.int64)]
    if len(entries):
        sets = sets.sort_values("sig", ignore_index=True)
        known, bits = sets["sig"].to_numpy(), list(sets["bits"])
        width = np.array([8 * len(b) for b in bits])
        folded = {w: _matrix([b if 8 * len(b) >= w else bytes(w // 8) for b in bits], w) for w in np.unique(width)}
        entries = entries.sort_values(["a", "to", "n", "b"], ignore_index=True)
        n, pos = entries["n"].to_numpy().astype(np.int64), entries["pos"].to_numpy().astype(np.int64)
        sig, comp, own, head = (entries[c].to_numpy() for c in ("b", "comp", "own", "head"))
        own = own.astype(bool)
        alike = entries["alike"].to_numpy(float)
        at = np.searchsorted(known, sig)
        lists = entries["a"].to_numpy(), entries["to"].to_numpy()
        cuts = np.flatnonzero((lists[0][1:] != lists[0][:-1]) | (lists[1][1:] != lists[1][:-1])) + 1
        for start, end in zip([0, *cuts], [*cuts, len(entries)], strict=True):
            for i, j in open_blocks(n[start:end], pos[start:end], comp[start:end], own[start:end]):
                i, j = i + start, j + start
                keep = (comp[i] != comp[j]) & (own[i] | own[j])
                i, j = i[keep], j[keep]
                keep = can_link(n[i], pos[i], n[j], pos[j])
                with np.errstate(invalid="ignore"):
                    keep &= ~((head[i] == head[j]) & (np.abs(alike[i] - alike[j]) > 1 - UP / DOWN + 1e-9))
                i, j = i[keep], j[keep]
                common = np.minimum(width[at[i]], width[at[j]])
                for w in np.unique(common):
                    here = common == w
                    x, y = i[here], j[here]
                    ok = room(n[x], n[y], folded[w][at[x]], folded[w][at[y]]) >= 0
                    out.append(np.column_stack([sig[x[ok]], sig[y[ok]]]))
                if len(out) > 200:
                    out = [np.unique(np.sort(np.concatenate(out), axis=1), axis=0)]
    both = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
    return pd.DataFrame({"a": both[:, 1], "b": both[:, 0]})


def _open_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose parities leave a link open, with the share of the room left; sets has sig, n and bits."""
    x, y = (sets.select(F.col("sig").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            ba, bb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            width = np.array([8 * min(len(p), len(q)) for p, q in zip(ba, bb, strict=True)])
            left = np.zeros(len(na), np.int64)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                left[at] = room(na[at], nb[at], _matrix([ba[i] for i in at], w), _matrix([bb[i] for i in at], w))
            keep = pa.array(left >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(left / (na + nb)).filter(keep)], names=["a", "b", "room"])

    rows = pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return rows.mapInArrow(run, "a long, b long, room double")


def bucket_count(pairs: int, bytes_each: int = 4000) -> int:
    """Buckets for which a bucket's texts take about BUCKET_BYTES."""
    return max(8, math.ceil(2 * pairs * bytes_each / BUCKET_BYTES))


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


class Answers:
    """Overlaps of sets, derived from those with a highly similar set.

    Sets that share their least hash are of one family, whose first set is its leader. For a set with several hubs
    the shingles in which it differs from the leader are computed once; its overlap with each hub is the leader's,
    plus the hub's share of what the set has more, less the hub's share of what it has less.
    """

    def __init__(self, known: dict[int, np.ndarray], hubs: dict[int, int]):
        self.known, self.hubs = known, hubs  # sets by name; how many hubs each set is compared with
        self.leaders: dict[int, int] = {}
        self.differences: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}
        self.told: dict[tuple[int, int], int] = {}
        self.derived = 0

    def difference(self, b: int, leader: int) -> tuple[np.ndarray, np.ndarray] | None:
        if b not in self.differences:
            x, y = self.known[b], self.known[leader]
            more, less = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
            self.differences[b] = (more, less) if 4 * (len(more) + len(less)) <= len(x) else None
        return self.differences[b]

    def of(self, a: int, b: int) -> int:
        """The size of the intersection of the sets a (a hub) and b."""
        y = self.known[b]
        leader = self.leaders.setdefault(int(y[0]), b)
        if leader != b and self.hubs.get(b, 0) > 1 and (change := self.difference(b, leader)) is not None:
            more, less = change
            self.derived += 1
            return self._plain(a, leader) + overlap(more, self.known[a]) - overlap(less, self.known[a])
        return self._plain(a, b)

    def _plain(self, a: int, b: int) -> int:
        if (a, b) not in self.told:
            self.told[a, b] = overlap(self.known[a], self.known[b])
        return self.told[a, b]


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, parts: int, renamed: np.ndarray, mask: int) -> DataFrame:
    """a, b, alike, linked of each pair of signatures; nodes (sig, doc_id, n) tells a document of each set."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("long").alias("salts"))
    parts = max(parts, bucket_count(pairs.count()))
    dealt = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("salts"))), F.lit(parts)).cast("int").alias("bucket"))
    dealt = written(dealt, "dealt")
    routes = dealt.select(F.col("a").alias("sig"), "bucket").union(dealt.select(F.col("b").alias("sig"), "bucket")).distinct()
    need = routes.groupBy("sig").agg(F.collect_list("bucket").alias("buckets")).join(nodes.select("sig", "doc_id"), "sig").select("doc_id", "sig", "buckets")
    need = written(need, "need")
    if need.count() <= BROADCAST_IDS:
        need = F.broadcast(need)
    routed = docs.join(need, "doc_id").select(F.explode("buckets").alias("bucket"), "sig", "text")

    def compare(sets: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        known = {}
        for a, b in byte_slices([len(t) for t in sets["text"]], SLICE_BYTES):
            doc, value = shingle_sets(list(sets["text"][a:b]))
            sizes, got, _ = signatures(doc, value, b - a, renamed, mask)
            ends = np.cumsum(sizes)
            known.update({int(got[i]): value[ends[i] - sizes[i] : ends[i]] for i in range(b - a)})
        answers = Answers(known, pairs["b"].value_counts().to_dict())
        alike, linked = [], []
        for a, b in zip(pairs["a"], pairs["b"], strict=True):
            inter = answers.of(a, b)
            union = len(known[a]) + len(known[b]) - inter
            alike.append(inter / union)
            linked.append(DOWN * inter >= UP * union)
        return pd.DataFrame({"a": pairs["a"], "b": pairs["b"], "alike": alike, "linked": linked})

    return written(routed.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInPandas(compare, "a long, b long, alike double, linked boolean"), "compared")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node reachable) of every node of edges (a, b), by alternating large and small stars."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct().checkpoint()
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.union(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def jaccard_components(docs: DataFrame, mask: int = -1) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text); mask cuts first signatures, for tests."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where(F.col("doc_id").isNotNull())
    tasks = max(8, math.ceil((known.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) / TASK_BYTES))
    parts = PARTS_EACH * tasks
    hot, hot_n = frequent(known)
    renamed = np.zeros(0, np.int64)
    while True:
        index = _index(known, parts, hot, hot_n, renamed, mask).repartition(tasks, "part")
        found = written(index.groupBy("part").applyInPandas(_first_round, _OUT), "first")
        rows = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("sig"), "n")
        sets = found.where("kind = 0 AND n > 0").select(F.col("a").alias("doc_id"), F.col("b").alias("sig"), "n", F.col("head").alias("sig2"), "bits")
        nodes = sets.groupBy("sig").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id"), F.max("bits").alias("bits"), ((F.min("sig2") != F.max("sig2")) | (F.min("n") != F.max("n"))).alias("clash"))
        nodes = written(nodes, "nodes")
        # Different sets of one first signature: n^2 / 2^65 of n are expected. They go by their second one.
        clash = nodes.where("clash").select("sig").toPandas()["sig"].to_numpy(np.int64)
        if not len(clash):
            break
        renamed = np.unique(np.concatenate([renamed, clash]))
    entries = found.where("kind = 2").drop("bits")
    # Heads of the salts of one list are compared with the least of them.
    heads = entries.where("salts > 1").select("a", "head").distinct()
    across = heads.join(heads.groupBy("a").agg(F.min("head").alias("least")), "a").where("head <> least").select(F.col("least").alias("a"), F.col("head").alias("b"))
    pairs = written(_open_pairs(found.where("kind = 1").select("a", "b").union(across).distinct(), nodes), "pairs")
    # Of each set's pairs the likeliest ones first: as many as WAVE.
    best = pairs.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("room", "a")), asc=False), 1, WAVE).alias("best"))
    first = verified(best.select(F.explode("best").alias("p"), "b").select("p.a", "b"), nodes, known, parts, renamed, mask)
    comps = components(first.where("linked").select("a", "b"))
    # Lists with more than one component; rows outside the most common one go to every salt.
    placed = entries.join(comps.withColumnRenamed("node", "b"), "b", "left").withColumn("comp", F.coalesce("comp", "b"))
    held = placed.groupBy("a", "comp").agg(F.count("*").alias("c")).groupBy("a").agg(F.max_by("comp", F.struct("c", "comp")).alias("common"), F.count("*").alias("kinds"))
    placed = placed.join(held.where("kinds > 1"), "a")
    alike = first.select(F.col("a").alias("head"), "b", "alike")
    placed = placed.join(alike, ["head", "b"], "left").withColumn("alike", F.when(F.col("head") == F.col("b"), F.lit(1.0)).otherwise(F.col("alike")))
    copies = F.when((F.col("comp") != F.col("common")) & (F.col("salts") > 1), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array("salt"))
    placed = placed.withColumn("to", F.explode(copies)).withColumn("own", F.col("to") == F.col("salt"))
    # Lists of one common component go together, so that a pair of many lists is told once; large families are dealt out.
    size = placed.groupBy("common").agg(F.ceil(F.count("*") / FAMILY_ROWS).cast("long").alias("shares"))
    share = F.pmod(F.xxhash64("a", "to"), F.col("shares"))
    listed = placed.join(size, "common").withColumn("bucket", F.pmod(F.xxhash64("common", share), F.lit(16 * parts)).cast("int"))
    listed = written(listed.select("bucket", "a", "b", "n", "pos", "head", "alike", "comp", "own", "to"), "listed")
    held = listed.select(F.col("bucket").alias("part"), F.col("b").alias("sig")).distinct().join(nodes.select("sig", "bits"), "sig")
    more = listed.groupBy("bucket").cogroup(held.groupBy("part")).applyInPandas(_second_round, "a long, b long")
    # Pairs of the first round that are not compared yet, between components.
    place = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    rest = pairs.join(place("a"), "a", "left").join(place("b"), "b", "left").where("coalesce(comp_a, a) <> coalesce(comp_b, b)").select("a", "b")
    more = written(more.union(rest).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "told")
    done = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = written(more.join(done, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        second = verified(more, nodes, known, parts, renamed, mask).where("linked").select("a", "b")
        if not second.isEmpty():
            comps = components(first.where("linked").select("a", "b").union(second))
    grouped = rows.join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.when(F.col("n") > 0, F.coalesce("comp", "sig")))
    grouped = written(grouped.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "comp"), "grouped")
    least = grouped.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = grouped.join(least, "comp", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.union(_sizes_of_unknown(docs.where(F.col("doc_id").isNull())))


def _sizes_of_unknown(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in _texts(batch, 0):
                sizes, _, _ = signatures(*shingle_sets(texts), len(texts))
                none = pa.nulls(len(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(sizes, pa.int64()), none], names=["doc_id", "n_shingles", "component_id"])

    return docs.select("text").mapInArrow(run, "doc_id long, n_shingles long, component_id long")

