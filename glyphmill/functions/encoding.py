"""Captions to token ids with an explicit limit: injectable tokenizers, overflow policies, padding and attention masks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OVERFLOW = ("error", "truncate")


@dataclass(frozen=True)
class Encoder:
    """ids of a batch of texts without special tokens, and the ids that stand before and after a text, and for padding."""

    ids: Callable[[list[str]], list[list[int]]]
    before: tuple[int, ...] = ()
    after: tuple[int, ...] = ()
    pad: int = 0

    def special(self) -> int:
        return len(self.before) + len(self.after)


#: Makes an Encoder on the worker; it travels instead of the tokenizer.
Loader = Callable[[], Encoder]


def byte_encoder() -> Encoder:
    """A token for each UTF-8 byte (its value plus 3) and an end mark 1; 0 pads, 2 is unused."""
    return Encoder(lambda texts: [[b + 3 for b in t.encode()] for t in texts], after=(1,))


def file_encoder(path: str, before: tuple[int, ...] = (), after: tuple[int, ...] = (), pad: int = 0) -> Loader:
    """Of a tokenizers .json or a sentencepiece .model file; workers load it once."""
    return lambda: _from_file(path, before, after, pad)


@lru_cache(maxsize=4)
def _from_file(path: str, before: tuple[int, ...], after: tuple[int, ...], pad: int) -> Encoder:
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return Encoder(lambda texts: model.encode(texts), before, after, pad)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return Encoder(lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)], before, after, pad)


def _batches(values: Iterator[pd.Series], load: Loader, rows: int = 256) -> Iterator[tuple[pd.Series, Encoder, list[list[int]]]]:
    encoder = load()
    for series in values:
        ids: list[list[int]] = []
        for start in range(0, len(series), rows):
            ids += encoder.ids([t or "" for t in series.iloc[start : start + rows]])
        yield series, encoder, ids


def token_count(text: Column, load: Loader = byte_encoder) -> Column:
    """Tokens of a text, special ones included; null counts as empty."""

    @F.pandas_udf("long")
    def counted(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series, encoder, ids in _batches(values, load):
            yield pd.Series([len(x) + encoder.special() for x in ids], index=series.index)

    return counted(text)


def encoded(text: Column, limit: int, load: Loader = byte_encoder, overflow: str = "error") -> Column:
    """struct<ids, mask, tokens>: ids padded to the limit, 1 where the mask has a token, and the tokens before any cut.

    A text beyond the limit fails the query, or is cut so that the closing special tokens stay.
    """
    if overflow not in OVERFLOW:
        raise ValueError(f"overflow must be one of {OVERFLOW}")
    if limit <= 0:
        raise ValueError("the limit must be positive")

    @F.pandas_udf("ids array<int>, mask array<int>, tokens long")
    def fitted(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series, encoder, ids in _batches(values, load):
            room = max(0, limit - encoder.special())
            rows = []
            for own in ids:
                n = len(own) + encoder.special()
                if n > limit and overflow == "error":
                    raise ValueError(f"a caption has {n} tokens, over the limit of {limit}")
                kept = [*encoder.before, *own[:room], *encoder.after][:limit]
                rows.append((kept + [encoder.pad] * (limit - len(kept)), [1] * len(kept) + [0] * (limit - len(kept)), n))
            yield pd.DataFrame(rows, columns=["ids", "mask", "tokens"], index=series.index)

    return fitted(text)
