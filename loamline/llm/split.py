"""Cutting of long notes into pieces under a limit of words, at natural places, with overlap."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.functions.constants import STOPWORDS
from loamline.functions.text import JS_SPACE
from loamline.session import spread

#: Sizes for vaults without settings of their own or of vault 0.
SIZE, OVERLAP = 260, 48
#: Words on each side of a gap whose vocabulary is compared.
BLOCK = 30
#: What a piece ends with: 0 in the middle of a sentence, 1 a line, 2 a sentence, 3 a list item or table row, 4 a paragraph, 5 a section, 6 the text.
HARD, LINE, SENTENCE, ITEM, PARAGRAPH, SECTION, END = range(7)

_S = JS_SPACE
_LINE_START = r"(?:\A|(?<=[\n\r\u2028\u2029]))"
_GAP_WORDS = re.compile(f"[^{_S}]+")
_LINK = re.compile(r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|([^\]]+))?\]\]")
#: The marks of Markdown in the order in which they go: the pattern, and which group stays (0: a space instead).
_MARKS: list[tuple[re.Pattern, int | None]] = [
    (re.compile(r"```[\s\S]*?```"), 0),
    (re.compile(r"`([^`]+)`"), 1),
    (re.compile(r"!\[[^\]]*\]\([^)]*\)"), 0),
    (re.compile(r"\[([^\]]+)\]\([^)]*\)"), 1),
    (_LINK, None),
    (re.compile(f"{_LINE_START}#{{1,6}}[{_S}]+"), -1),
    (re.compile(r"[*_~>|-]+"), 0),
]
_BLANK = re.compile(r"(?:\r\n|\n|\r)[ \t\u00A0\u200B]*(?:\r\n|\n|\r)|[\u2028\u2029]")
_BREAK = re.compile(r"[\n\r\u2028\u2029]")
_HEADING = re.compile(r"[\n\r\u2028\u2029][ \t]*#{1,6}[ \t]")
_MARKER = re.compile(r"[ \t>]*(?:[-*+|]|\d{1,9}[.)][ \t])")
_STOP = re.compile(r"[.!?…。！？।؟۔]+[\"'”’»)\]*_~]*\Z")
#: Short forms that end in a full stop without ending a sentence, in the languages of the notes.
_SHORT = set("dr. mr. mrs. ms. prof. st. vs. etc. e.g. i.e. cf. no. vol. fig. ca. z. b. d. h. u. a. bzw. usw. nr. str. p. ej. sr. sra. m. mme. approx. dept. co. inc. ltd. sys. univ. inst. hosp. lab. intl. mfg. assoc. fdn. org.".split())


def stripped(text: str) -> tuple[str, list[int]]:
    """The text without its marks, white space as it is, and for each character the place it has in the source."""
    origin = list(range(len(text)))
    for pattern, group in _MARKS:
        out, where, last = [], [], 0
        for m in pattern.finditer(text):
            a, z = m.span()
            out.append(text[last:a])
            where.append(origin[last:a])
            if group == 0:
                out.append(" ")
                where.append([origin[a]])
            elif group == 1:
                b, c = m.span(1)
                out.append(text[b:c])
                where.append(origin[b:c])
            elif group is None:
                # The label comes before the target; the whole link counts as one place.
                shown = f"{m.group(2) or ''} {m.group(1)}"
                out.append(shown)
                where.append([origin[a]] * (len(shown) - 1) + [origin[z - 1]])
            last = z
        if last:
            out.append(text[last:])
            where.append(origin[last:])
            text, origin = "".join(out), [x for part in where for x in part]
    return text, origin


def words_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """The words of a text, and the place in it of the first and last character of each."""
    bare, origin = stripped(text)
    words, first, last = [], [], []
    for m in _GAP_WORDS.finditer(bare):
        words.append(m.group())
        first.append(origin[m.start()])
        last.append(origin[m.end() - 1])
    return words, first, last


def ends(text: str, words: list[str], first: list[int], last: list[int]) -> list[int]:
    """What ends after each word but the last."""
    out = []
    item = bool(_MARKER.match(text))
    for i in range(len(words) - 1):
        gap = text[last[i] + 1 : first[i + 1] + 1]
        level = HARD
        if _BREAK.search(gap):
            below = max(gap.rfind(c) for c in "\n\r\u2028\u2029") + last[i] + 2
            was, item = item, bool(_MARKER.match(text, below))
            if _HEADING.search(gap):
                level = SECTION
            elif _BLANK.search(gap):
                level = PARAGRAPH
            elif item or was:
                level = ITEM
            else:
                level = LINE
        word = words[i]
        if level < SENTENCE and last[i] < first[i + 1] and _STOP.search(word):
            short = word.lower().lstrip("(\"'“«")
            single = len(short) == 2 and short[0].isalpha()
            if not (short in _SHORT or single) and not words[i + 1][0].islower():
                level = SENTENCE
        out.append(level)
    return out


def cohesion(words: list[str], block: int = BLOCK) -> list[float]:
    """For each gap between two words, the cosine of the vocabularies of the blocks of words before and after it."""
    n = len(words)
    terms = [w if w and w not in STOPWORDS else "" for w in ("".join(c for c in x.lower() if c.isalnum()) for x in words)]
    left: dict[str, int] = {}
    right: dict[str, int] = {}
    dot = a2 = b2 = 0

    def move(own: dict[str, int], other: dict[str, int], term: str, by: int) -> tuple[int, int]:
        was = own.get(term, 0)
        own[term] = was + by
        return by * (2 * was + by), by * other.get(term, 0)

    for t in terms[:block]:
        if t:
            b2 += move(right, left, t, 1)[0]
    out = []
    for g in range(1, n):
        for own, other, at, by in ((right, left, g - 1, -1), (left, right, g - 1, 1), (left, right, g - 1 - block, -1), (right, left, g - 1 + block, 1)):
            if 0 <= at < n and (t := terms[at]):
                square, product = move(own, other, t, by)
                dot += product
                if own is left:
                    a2 += square
                else:
                    b2 += square
        out.append(dot / (a2 * b2) ** 0.5 if a2 and b2 else 0.0)
    return out


def depths(values: list[float]) -> list[float]:
    """How deep the valley at each value is: the rise to the nearest peak on either side."""
    n = len(values)
    rise_left, rise_right = [0.0] * n, [0.0] * n
    peak = 0.0
    for i, v in enumerate(values):
        peak = v if i == 0 or v >= values[i - 1] and v >= peak else max(peak, values[i - 1]) if values[i - 1] > v else v
        rise_left[i] = max(0.0, peak - v)
    for i in range(n - 1, -1, -1):
        v = values[i]
        peak = v if i == n - 1 or v >= values[i + 1] and v >= peak else max(peak, values[i + 1]) if values[i + 1] > v else v
        rise_right[i] = max(0.0, peak - v)
    return [a + b for a, b in zip(rise_left, rise_right, strict=True)]


def cuts(n: int, size: int, overlap: int, levels: list[int], depth: Callable[[], dict[int, float]]) -> list[tuple[int, int]]:
    """(first word, word after the last) of each piece.

    Each piece ends at the deepest valley among the natural places in the later half of its window, else at the last
    natural place in the earlier half, else at the limit. ``levels[i]``: what ends before word i + 1.
    """
    size = max(1, size)
    overlap = min(max(0, overlap), size - 1)
    if n <= size:
        return [(0, n)]
    deep = depth()
    out, start, done = [], 0, overlap
    while n - start > size:
        far = start + size
        half = max(done + 1, start + (size + 1) // 2)
        late = [e for e in range(half, far + 1) if levels[e - 1] >= SENTENCE]
        if late:
            end = max(late, key=lambda e: (round(deep.get(e, 0.0), 6), levels[e - 1], e))
        else:
            early = [e for e in range(min(half, far) - 1, done, -1) if levels[e - 1] >= SENTENCE]
            lines = [e for e in range(far, done, -1) if levels[e - 1] == LINE]
            end = early[0] if early else lines[0] if lines else far
        out.append((start, end))
        start, done = end - overlap, end
    out.append((start, n))
    return out


def split(text: str, size: int, overlap: int, block: int = BLOCK) -> list[dict]:
    """The pieces of a text: start and end (words), words, text, start_char, end_char, ends_with.

    Words are what is left of the text without its Markdown marks, cut at white space. A text of at most ``size`` words is
    one piece. start_char to end_char of the source, without what a piece shares with the one before, follow each other
    from 0 to the length of the text, so that marks, code and white space are in them too.
    """
    words, first, last = words_of(text)
    n = len(words)
    levels = ends(text, words, first, last) if n > size else []

    def depth() -> dict[int, float]:
        natural = [g + 1 for g, level in enumerate(levels) if level >= SENTENCE]
        values = cohesion(words, block)
        return dict(zip(natural, depths([values[g - 1] for g in natural]), strict=True))

    out = []
    for a, z in cuts(n, size, overlap, levels, depth):
        shared = out[-1]["end"] - a if out else 0
        begin = out[-1]["end_char"] if out else 0
        stop = len(text) if z == n else max(begin, first[z])
        out.append({"start": a, "end": z, "shared": shared, "text": " ".join(words[a:z]), "start_char": begin, "end_char": stop, "ends_with": END if z == n else levels[z - 1]})
    return out


def settings(configs: DataFrame) -> tuple[DataFrame, int, int]:
    """vault_id, size and overlap of each vault, and those of vault 0, which stand in where others are null."""
    zero = configs.where(F.col("vault_id") == 0).agg(F.max("chunk_size_words"), F.max("chunk_overlap_words")).first()
    own = configs.where(F.col("vault_id").isNotNull()).groupBy("vault_id").agg(F.max("chunk_size_words").alias("size"), F.max("chunk_overlap_words").alias("overlap"))
    return own, SIZE if zero[0] is None else zero[0], OVERLAP if zero[1] is None else zero[1]


def pieces(docs: DataFrame, configs: DataFrame, key: str = "doc_no", text: str = "content", block: int = BLOCK) -> DataFrame:
    """The pieces of each note: key, piece_no (from 0), pieces, start_word, end_word, shared_words, text, start_char, end_char, ends_with.

    A piece has at most the words that the settings of its vault allow, shares the set number of words with the one
    before (at most one less than the limit) and ends where a section, paragraph, list item or sentence ends if the limit
    leaves such a place beyond what is shared. A limit below 1 counts as 1, a negative overlap as 0. A null, empty or
    blank text is one empty piece. Rows are handled one by one, so repeated rows give repeated pieces, a null key is
    kept, and nothing is shuffled but the settings.
    """
    own, size, overlap = settings(configs)
    rows = spread(docs.select(F.col(key).alias("key"), "vault_id", F.col(text).cast("string").alias("text"))).join(own, "vault_id", "left")
    rows = rows.select("key", F.coalesce("size", F.lit(size)).alias("size"), F.coalesce("overlap", F.lit(overlap)).alias("overlap"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("i", pa.int64()), ("piece_no", pa.int32()), ("pieces", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("shared", pa.int32()), ("text", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("ends_with", pa.int32())])

        def out(keys: pa.Array, held: list[dict]) -> pa.RecordBatch:
            t = pa.RecordBatch.from_pylist(held, schema=kinds)
            return pa.RecordBatch.from_arrays([keys.take(t.column(0)), *t.columns[1:]], names=["key", *kinds.names[1:]])

        for b in batches:
            sizes, overlaps, held, chars = b.column("size").to_pylist(), b.column("overlap").to_pylist(), [], 0
            for i, x in enumerate(b.column("text")):
                got = split(x.as_py(), max(1, sizes[i]), overlaps[i], block)
                for k, p in enumerate(got):
                    held.append(p | {"i": i, "piece_no": k, "pieces": len(got)})
                    chars += len(p["text"])
                    if chars > 8_000_000:
                        yield out(b.column("key"), held)
                        held, chars = [], 0
            if held:
                yield out(b.column("key"), held)

    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(run, f"key {kind}, piece_no int, pieces int, start int, end int, shared int, text string, start_char int, end_char int, ends_with int")
    return made.select(F.col("key").alias(key), "piece_no", "pieces", F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("shared").alias("shared_words"), "text", "start_char", "end_char", "ends_with")
