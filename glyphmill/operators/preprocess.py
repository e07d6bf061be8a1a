"""A registry of preprocessing steps and a small language that chains them: "keep('a')|copy('a', 'b')".

Steps are functions from DataFrame to DataFrame, so a chain is only a rewritten plan.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


class Registry:
    def __init__(self) -> None:
        self._makers: dict[str, Callable[..., Step]] = {}

    def register(self, name: str) -> Callable[[Callable[..., Step]], Callable[..., Step]]:
        def add(maker: Callable[..., Step]) -> Callable[..., Step]:
            if name in self._makers:
                raise KeyError(f"{name} is registered already")
            self._makers[name] = maker
            return maker

        return add

    def step(self, call: str) -> Step:
        """The step of a call like "name" or "name(1, key='x')"; arguments are literals only."""
        tree = ast.parse(call.strip(), mode="eval").body
        if isinstance(tree, ast.Call):
            args = [ast.literal_eval(a) for a in tree.args]
            options = {k.arg: ast.literal_eval(k.value) for k in tree.keywords}
            tree = tree.func
        else:
            args, options = [], {}
        names = []
        while isinstance(tree, ast.Attribute):
            names.append(tree.attr)
            tree = tree.value
        if not isinstance(tree, ast.Name):
            raise ValueError(f"not a step: {call!r}")
        name = ".".join([tree.id, *reversed(names)])
        if name not in self._makers:
            raise KeyError(f"unknown step {name}")
        return self._makers[name](*args, **options)

    def chain(self, text: str) -> Step:
        """All steps of a text, separated by bars outside of strings and brackets."""
        steps = [self.step(part) for part in split_bars(text) if part.strip()]
        return lambda df: reduce(lambda d, s: s(d), steps, df)


def split_bars(text: str) -> list[str]:
    parts, depth, quote, start, skip = [], 0, "", 0, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quote:
            skip = c == "\\"
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "|" and not depth:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def column_step(default_in: str, default_out: str | None = None) -> Callable[[Callable[..., Callable[[Column], Column]]], Callable[..., Step]]:
    """Make a maker of Column functions a maker of steps with key=, inkey= and outkey=."""

    def decorate(maker: Callable[..., Callable[[Column], Column]]) -> Callable[..., Step]:
        @wraps(maker)
        def make(*args: object, key: str | None = None, inkey: str | None = None, outkey: str | None = None, **options: object) -> Step:
            f = maker(*args, **options)
            source, target = inkey or key or default_in, outkey or key or default_out or default_in
            return lambda df: df.withColumn(target, f(F.col(source)))

        return make

    return decorate


STEPS = Registry()


@STEPS.register("keep")
def keep(*columns: str) -> Step:
    return lambda df: df.select(*columns)


@STEPS.register("copy")
def copy(inkey: str, outkey: str) -> Step:
    return lambda df: df.withColumn(outkey, F.col(inkey))


@STEPS.register("value_range")
@column_step("image")
def value_range(vmin: float = -1, vmax: float = 1, in_min: float = 0, in_max: float = 255.0, clip_values: bool = False) -> Callable[[Column], Column]:
    def one(x: Column) -> Column:
        y = (x.cast("double") - in_min) / (in_max - in_min) * (vmax - vmin) + vmin
        return F.least(F.greatest(y, F.lit(float(vmin))), F.lit(float(vmax))) if clip_values else y

    return lambda values: F.transform(values, one)


@STEPS.register("first_caption")
@column_step("caption")
def first_caption() -> Callable[[Column], Column]:
    return lambda texts: F.coalesce(F.get(texts, 0), F.lit(""))


@STEPS.register("sample_caption")
@column_step("caption")
def sample_caption(seed: int = 0) -> Callable[[Column], Column]:
    return lambda texts: F.coalesce(F.get(texts, F.floor(F.rand(seed) * F.size(texts)).cast("int")), F.lit(""))


@STEPS.register("decode_png")
@column_step("image")
def decode_png(channels: int = 3) -> Callable[[Column], Column]:
    from glyphmill.functions.images import png_values

    return lambda data: png_values(channels)(data)
