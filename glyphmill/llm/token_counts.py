"""Token counts: batch encoding in an Arrow function that returns lengths only.

Texts go through the tokenizer in batches balanced by bytes. A text is split at safe boundaries
before encoding: before a single space, or a line end, whose neighbours are both no white space. Byte-level
pre-tokenizers begin a piece at such a space in any case, so the pieces, and with them the count,
are those of the whole text; a special string holds no such space. Equal pieces are encoded once
and their lengths kept in a bounded table of the worker.

The tokenizer file is checked first: unless its pre-tokenizer is byte-level, texts are encoded whole.

Null text counts as empty (0 bytes, 0 tokens). Repeated rows give repeated results, empty tables empty ones.
Extra columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import byte_slices, uncollected

#: Entries of a worker's table of piece lengths; the table starts anew beyond it.
CACHE_ENTRIES = 400_000
#: Longer pieces (long runs without a space) are encoded, never kept.
CACHE_CHARS = 64

#: White space other than single blanks and single line ends inside a text.
UNEASY = re.compile(r"\s\s|[^\S \n]|^\s|\s$")

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def cuts_are_safe(path: str) -> bool:
    """Whether the file's pre-tokenizer splits at blanks by the byte-level rule, without a prefix blank or a normalizer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", [before])
    plain = spec.get("normalizer") is None and all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and s.get("use_regex", True) for s in steps)
    return plain and not any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))


def safe_pieces(text: str) -> list[str]:
    """The text cut before each single space that has no white space on either side.

    A piece keeps its leading space; "".join(pieces) is the text.
    """
    if not text:
        return []
    parts = text.split(" ")
    out = [parts[0]]
    for part in parts[1:]:
        before = out[-1]
        if part and not part[0].isspace() and before and not before[-1].isspace():
            out.append(" " + part)
        else:
            out[-1] = before + " " + part
    return out


class PieceCounter:
    """Counts tokens of texts; encode gives the lengths of a list of pieces.

    Lengths are kept in two generations of at most `entries` pieces each: when the young one is
    full it becomes the old one, so that frequent pieces stay and rare ones go.
    """

    def __init__(self, encode: Callable[[list[str]], list[int]], entries: int = CACHE_ENTRIES):
        self.encode, self.entries, self.young, self.old = encode, entries, {}, {}
        self.mark = dict(zip(".,", encode([".", ","]), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        split = [pieces(t) for t in texts]
        new = set().union(*split).difference(self.young) if split else set()
        known = self.young
        if new:
            if len(known) + len(new) > self.entries:
                self.old, known = known, {}
                self.young = known
                new = set().union(*split)
            old, unknown = self.old, []
            for piece in new:
                n = old.get(piece)
                if n is None:
                    unknown.append(piece)
                else:
                    known[piece] = n
            # A letter before a final mark ends its piece, so "word," is "word" and ",".
            stems = [p[:-1] if p[-1:] in self.mark and p[-2:-1].isalpha() else p for p in unknown]
            todo = [p for p in dict.fromkeys(stems) if p not in known]
            known.update(zip(todo, self.encode(todo), strict=True))
            for piece, stem in zip(unknown, stems, strict=True):
                if piece is not stem:
                    known[piece] = known[stem] + self.mark[piece[-1]]
        out = [sum(map(known.__getitem__, parts)) for parts in split]
        for piece in [p for p in new if len(p) > CACHE_CHARS]:
            known.pop(piece, None)
        return out


def pieces(text: str) -> list[str]:
    """As safe_pieces; a text without adjacent white space is also cut before its line ends."""
    if not UNEASY.search(text):
        first, *rest = text.replace("\n", " \n").split(" ")
        return [first, *[p if p[:1] == "\n" else " " + p for p in rest]]
    return safe_pieces(text)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)
        encode = lambda new: [len(e) for e in tok.encode_batch_fast(new, add_special_tokens=False)]
        counts_of = PieceCounter(encode).counts if cuts_are_safe(tokenizer_path) else encode
        for batch in uncollected(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            counts: list[int] = []
            for a, b in byte_slices(sizes):
                counts += counts_of(texts[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
