"""Markdown and token functions, as columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamline.functions.constants import ALIASES, SNIPPET_CHARS, STOPWORDS

#: Fixed value: white space as ECMAScript has it, for use inside a character class. Java's \s is ASCII only.
JS_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WS = f"[{JS_SPACE}]"
LINE_START = r"(?:\A|(?<=[\n\r\u2028\u2029]))"

#: The marks that are taken off, in this order, and what stays of each.
MARKS = [
    (r"(?s)```.*?```", " "),
    (r"`([^`]+)`", "$1"),
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|([^\]]+))?\]\]", "$2 $1"),
    (rf"{LINE_START}#{{1,6}}{WS}+", ""),
    (r"[*_~>|-]+", " "),
    (rf"{WS}+", " "),
]


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def strip_markdown(c: Column) -> Column:
    """The text without Markdown marks, white space as single spaces. One chain of built-in replacements, inside codegen."""
    for pattern, instead in MARKS:
        c = F.regexp_replace(c, pattern, instead)
    return F.regexp_replace(c, r"\A | \z", "")


def split_words(c: Column) -> Column:
    return F.filter(F.split(strip_markdown(c), " "), lambda w: w != "")


def word_count(body: Column) -> Column:
    """Words of a body, from which marks are taken off twice, as the count of an index has it."""
    return F.size(split_words(strip_markdown(body)))


def stem(t: Column) -> Column:
    n = F.length(t)
    return (
        F.when((n > 5) & t.endswith("ing"), t.substr(F.lit(1), n - 3))
        .when((n > 4) & t.endswith("ied"), F.concat(t.substr(F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & (t.endswith("ed") | t.endswith("es")), t.substr(F.lit(1), n - 2))
        .when((n > 3) & t.endswith("s"), t.substr(F.lit(1), n - 1))
        .otherwise(t)
    )


def stem_word(t: str) -> str:
    """``stem`` for a word on the driver, for the literals below."""
    for ending, least, cut, add in (("ing", 5, 3, ""), ("ied", 4, 3, "y"), ("ed", 4, 2, ""), ("es", 4, 2, ""), ("s", 3, 1, "")):
        if len(t) > least and t.endswith(ending):
            return t[:-cut] + add
    return t


def _alias_map() -> Column:
    known = {k: [stem_word(v) for v in vs] for k, vs in ALIASES.items()}
    return F.create_map(*chain.from_iterable((F.lit(k), F.array(*[F.lit(v) for v in vs])) for k, vs in known.items()))


def tokenize(c: Column, aliases: bool = True) -> Column:
    """Stemmed tokens in order; with ``aliases`` each is followed by the words that stand for it.

    Stopwords are looked for after stemming, so some inflected ones stay. No UDF: arrays and higher-order functions.
    """
    bare = F.regexp_replace(F.regexp_replace(F.lower(strip_markdown(c)), "['’]", ""), "[^a-z0-9]+", " ")
    base = F.filter(F.transform(F.split(bare, " "), stem), lambda t: (F.length(t) > 1) & ~t.isin(sorted(STOPWORDS)))
    return with_aliases(base) if aliases else base


def with_aliases(tokens: Column) -> Column:
    """Each token followed by the words that stand for it."""
    return F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.coalesce(F.element_at(_alias_map(), t), F.array().cast("array<string>")))))


def phrases_of(tokens: Column) -> Column:
    """All runs of two and three tokens of more than four characters, in order of size and place."""

    def runs(size: int) -> Column:
        at = F.when(F.size(tokens) >= size, F.sequence(F.lit(1), F.size(tokens) - (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, size), " "))

    return F.filter(F.concat(runs(2), runs(3)), lambda p: F.length(p) > 4)


def chunk_windows(c: Column, size: Column | int, overlap: Column | int) -> Column:
    """The text of each window of ``size`` words, the next beginning ``size - overlap`` words later; one, maybe empty, for a short text."""
    size, overlap = (x if isinstance(x, Column) else F.lit(x) for x in (size, overlap))
    words = split_words(c)
    step = F.greatest(F.lit(1), size - overlap)
    n = F.when(F.size(words) <= size, 1).otherwise(F.ceil((F.size(words) - size) / step) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, i * step + 1, size), " "))


def snippet(c: Column, most: int = SNIPPET_CHARS) -> Column:
    clean = strip_markdown(c)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(trim_ws(F.substring(clean, 1, most - 1)), F.lit("...")))
