"""String functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_path(url: Column, base: str = "") -> Column:
    """Path of a file by the md5 of its URL: bytes in hex without leading zeros, the first six digits as folders."""
    h = F.md5(url)
    name = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.lower(F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 16))), "")
    return F.concat(F.lit(base), F.substring(name, 1, 3), F.lit("/"), F.substring(name, 4, 3), F.lit("/"), name, F.lit(".jpg"))


def parse_size(value: Column) -> Column:
    """struct<width, height> of "WxH", or null; only positive whole numbers count."""
    parts = F.split(F.lower(value), "x", 2)
    w, h = F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int")
    return F.when((w > 0) & (h > 0), F.struct(w.alias("width"), h.alias("height")))


def target_aspect(declared: Column, reference: Column) -> Column:
    """Width over height by a declared ratio "W:H", else a reference "WxH", else 1."""
    declared, reference = F.trim(F.coalesce(declared, F.lit(""))), F.trim(F.coalesce(reference, F.lit("")))

    def ratio(text: Column, pattern: str) -> Column:
        w = F.regexp_extract(text, pattern, 1).try_cast("double")
        h = F.regexp_extract(text, pattern, 2).try_cast("double")
        return F.when((w > 0) & (h > 0), w / F.when(h > 0, h))

    return F.coalesce(ratio(declared, r"^(\d+(?:\.\d+)?):(\d+(?:\.\d+)?)$"), ratio(reference, r"^(\d+)[xX*×](\d+)$"), F.lit(1.0))


def first_name(*keys: Column, fallback: Column) -> Column:
    """Base name of the first key that is not blank, else the fallback."""
    tidy = [F.when(F.trim(k) != "", F.substring_index(F.trim(k), "/", -1)) for k in keys]
    return F.coalesce(*tidy, fallback)


def quoted_words(prompt: Column) -> Column:
    """Lower-case words inside single quotes."""
    inside = F.regexp_extract_all(prompt, F.lit("'(.*?)'"), F.lit(1))
    return F.flatten(F.transform(inside, lambda x: F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")))


def normalized(text: Column, mode: str = "en") -> Column:
    """Letters, digits and CJK ideographs only; en: single blanks, lower case; zh: no blanks."""
    kept = F.regexp_replace(text, r"(?U)[^一-龥a-zA-Z0-9\sàâäéèêëîïôöùûüçÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ]", "")
    if mode == "zh":
        return F.regexp_replace(kept, r"(?U)\s+", "")
    return F.lower(F.trim(F.regexp_replace(kept, r"(?U)\s+", " ")))


def slug(text: Column, length: int = 100) -> Column:
    """Runs of other characters as one underscore, the last `length` characters, "sample" if nothing is left."""
    name = F.right(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_"), F.lit(length))
    return F.coalesce(F.nullif(F.regexp_replace(name, r"^[._]+|[._]+$", ""), F.lit("")), F.lit("sample"))


def category(text: Column) -> Column:
    """What stands before the first parenthesis."""
    return F.trim(F.substring_index(text, "(", 1))


def ints(text: Column, sep: str = ",") -> Column:
    """Whole numbers of a separated list; other entries are null."""
    return F.transform(F.split(text, sep), lambda x: F.trim(x).try_cast("int"))


def word_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / (longer length + 1e-5)."""
    return 1 - F.levenshtein(a, b) / (F.greatest(F.char_length(a), F.char_length(b)) + 1e-5)


def prefix_has_word(text: Column, word: str, count: int = 10, ascii_words: bool = False) -> Column:
    """Whether `word` is among the first words, folded to lower case; with ascii_words only a-z, 0-9 and _ make words."""
    if ascii_words:
        # Of all capitals only the dotted one has an ASCII letter and a mark, which would end a word, as its lower case.
        folded, pattern = F.lower(F.replace(text, F.lit("İ"), F.lit("i"))), "[a-z0-9_]+"
    else:
        folded, pattern = F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"(?U)\b\w+\b"
    words = F.slice(F.regexp_extract_all(folded, F.lit(pattern), F.lit(0)), 1, count)
    return F.array_contains(words, word.lower())


def single_line(text: Column) -> Column:
    return F.array_join(F.split(text, r"\R"), " ")


def html_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def duration(seconds: Column) -> Column:
    """Seconds; beyond a minute minutes and seconds; beyond an hour hours and minutes. Rounded, halves to even; not padded."""
    whole = lambda x: F.bround(x.cast("double")).cast("long")
    m = F.floor(seconds / 60)
    long = F.format_string("%dh%dm", F.floor(m / 60), m % 60)
    return F.when(seconds < 60, F.format_string("%ds", whole(seconds))).when(m < 60, F.format_string("%dm%ds", m, whole(seconds - m * 60))).otherwise(long)


def truth(text: Column) -> Column:
    """true or false by the usual words, else null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("yes", "true", "t", "y", "1"), True).when(t.isin("no", "false", "f", "n", "0"), False)


def stem(path: Column, first_dot: bool = False) -> Column:
    """File name without its last suffix, or up to its first dot."""
    name = F.substring_index(path, "/", -1)
    return F.substring_index(name, ".", 1) if first_dot else F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def stable_seed(seed: Column, *parts: Column) -> Column:
    """First eight bytes of a sha256 of the parts as an unsigned number."""
    digest = F.sha2(F.concat_ws("|", seed.cast("string"), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def fenced_json(text: Column) -> Column:
    """JSON text without code fences and trailing commas."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    return F.regexp_replace(bare, r",\s*([}\]])", "$1")
