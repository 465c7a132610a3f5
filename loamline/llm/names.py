"""Spellings of the same person or organisation among names that people have typed."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.session import cut, drop, spread

#: Given names and their short forms in general use; the first is the full name.
GIVEN = """
abigail abby abbie gail|alexander alex alec sandy xander|alice ali|amanda mandy|andrew andy drew|anna annie anne ann|anthony tony|barbara barb babs
benjamin ben benny benji|catherine cathy cate|charles charlie chuck chas|chloe|christopher chris kit|daniel dan danny|david dave davy|deborah deb debbie debby
donald don donnie|dorothy dot dottie|edward ed eddie ned|eleanor ellie nell|elizabeth liz lizzie beth betty betsy eliza libby|emily em emmy|eric|frances fran
francis frank|frederick fred freddie freddy|george|gerald gerry|gregory greg|hanna hannah|helen|henry hank harry|jacob jake|james jim jimmy jamie|jennifer jen jenny jenn
jessica jess jessie|john johnny jack|jonathan jon|joseph joe joey|joshua josh|judith judy|julia|katherine kate kathy katie kat|kenneth ken kenny|laura|lawrence larry
leonard leo len lenny|linda|louis lou louie|lucia|maria|margaret maggie meg peggy marge|martin marty|mary molly polly|matthew matt matty|michael mike mick mickey
nancy|nathaniel nate nathan|nicholas nick nicky|olivia liv|pamela pam|patricia pat patty trish tricia|paul|peter pete|philip phil|quentin|raymond ray|rebecca becky becca
richard dick rick rich richie|robert bob rob bobby robbie|ronald ron ronnie|samantha|samuel sam sammy|sarah sally|stephen steve steven|susan sue susie suzy
theodore ted theo teddy|thomas tom tommy|timothy tim timmy|ulrike|victoria vicky vicki tori|vincent vince|walter walt wally|william bill will billy willy liam|yasmin|zachary zach zack zac|zoe
"""
NICK = {n: names.split()[0] for names in re.split(r"[|\n]", GIVEN.strip()) for n in names.split()}

#: Words that say what kind of organisation a name is of, with their short forms.
KINDS = """
academy acad|agency agcy|associates assoc assocs associated|association assn|bank|board|bureau|center centre ctr|church|clinic clin|college coll|commission comm|committee|company co comp
consulting|cooperative coop|corporation corp|council|department dept dep depts|enterprises ent|federation fed|foundation fdn found fdtn|group grp|holdings|hospital hosp|industries ind
institute inst institution|international intl int|laboratory lab labs laboratories|library lib|logistics|manufacturing mfg mfr manuf|ministry min|museum mus|office|partners|school sch|services svc
society soc|solutions|studio|systems sys syst|technologies tech technology|trust|union|university univ uni
"""
KIND = {n: names.split()[0] for names in re.split(r"[|\n]", KINDS.strip()) for n in names.split()}
LONG_KINDS = tuple(sorted({k for k in KIND.values() if len(k) >= 6}))

#: Words that belong to no name.
TITLES = set("dr mr mrs ms prof professor sir the".split())
LEGAL = set("ltd limited inc incorporated llc plc gmbh ag sa bv".split())
PREFIXES = ("people/", "person/", "contacts/", "org/", "orgs/", "company/", "companies/", "@")
_PLAIN = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i"})

#: Letters of a gram.
Q = 3
#: The part of the weight of the grams of the lighter of two names that the other must have, for them to be compared.
SHARED = 0.35
#: The least weighted similarity of two names that mean the same, and of two of which one has an initial for a word.
SIMILAR, INITIALS = 0.8, 0.7
#: The part of the weight of a name of which some word has a partner in every name that it is linked with: more than the 1 - ``SIMILAR`` that may be without, since parts of words weigh differently.
LEADING = 0.25
#: Letters of a text of which all shortened forms are keys; of longer ones the halves are.
SHORTENED = 40
#: How alike two words are: short form and full name, initial and word, first letters of two words and the first of them, abbreviation.
NICKNAME, INITIAL, INITIAL_TWO, ABBREVIATED = 0.95, 0.7, 0.6, 0.8
#: Words of two names that are compared with one another at most; beyond it only equal ones count (names of more than a hundred words).
COMPARED = 10_000
STRONG, PARTIAL, MIDDLE, BARE, BARE_SLIP = range(5)


def fold(text: str) -> str:
    low = unicodedata.normalize("NFKD", text.lower().translate(_PLAIN))
    return "".join(c for c in low if not unicodedata.combining(c))


def near(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or exchange of neighbours makes one word the other."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    if n == m:
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i + 1 :] == b[i:] if n > m else a[i:] == b[i + 1 :]


def shortened(word: str) -> set[str]:
    """The word, and what is left without one of its letters; words one slip apart have one of these in common."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def slips(text: str) -> set[str]:
    """Texts that are the same or one slip apart have one of these in common: shortened forms, or of long ones halves, one of which no slip reaches."""
    if len(text) <= SHORTENED:
        return shortened(text)
    # Of two lengths one apart the shorter one's half is among those of both. A text of just more letters than SHORTENED meets the shorter one by these, too.
    halves = {h for n in ((len(text) - 3) // 2, (len(text) - 2) // 2) for h in (f"<{text[:n]}", f">{text[-n:]}")}
    return halves | {text} | (shortened(text) if len(text) == SHORTENED + 1 else set())


class Lexicon:
    """Words with their canonical forms, found also with one slip of typing."""

    def __init__(self, words: dict[str, str]):
        self.words = words
        self.near: dict[str, set[str]] = {}
        for w in words:
            for d in shortened(w):
                self.near.setdefault(d, set()).add(w)

    def fuzzy(self, word: str, least: int) -> str | None:
        """The canonical form of the word of at least so many letters that this one is a slip of."""
        if not least - 1 <= len(word) <= 40:
            return None
        got = sorted(w for w in set().union(*(self.near.get(d, set()) for d in shortened(word))) if len(w) >= least and near(w, word))
        return self.words[got[0]] if got else None


@dataclass
class Words:
    """What is known of words: short forms of given names and of kinds of organisations."""

    nick: dict[str, str] = field(default_factory=lambda: NICK)
    kinds: dict[str, str] = field(default_factory=lambda: KIND)

    def __post_init__(self):
        nick, kinds = Lexicon(self.nick), Lexicon(self.kinds)
        self.given = lru_cache(100_000)(lambda w: (self.nick[w], 1.0) if w in self.nick else (nick.fuzzy(w, 4), 0.9) if len(w) > 3 else (None, 0.0))
        self.kind = lru_cache(100_000)(lambda w: self.kinds.get(w) or (kinds.fuzzy(w, 6) if len(w) > 4 else None))

    def __reduce__(self):
        return Words, (self.nick, self.kinds)

    def alike(self, a: str, b: str) -> float:
        """How alike two words are: 1 for the same, 0 for different ones."""
        if a == b:
            return 1.0
        if not (a.isalpha() and b.isalpha()):
            return 0.0
        if len(a) > len(b):
            a, b = b, a
        ka, kb = self.kind(a), self.kind(b)
        if ka and ka == kb:
            return NICKNAME
        if len(a) == 1 or len(a) == 2 and len(b) > 2:
            # The first letter of a given name that has a full form is that of the full form.
            return (INITIAL if len(a) == 1 else INITIAL_TWO) if a[0] == self.nick.get(b, b)[0] else 0.0
        (ga, sa), (gb, sb) = self.given(a), self.given(b)
        if ga and ga == gb:
            return NICKNAME * min(sa, sb)
        known = a in self.nick and b in self.nick or a in self.kinds and b in self.kinds
        if not known and (len(a) > 3 or len(a) == 3 and a[0] == b[0]) and near(a, b):
            return 1 - 1 / len(b)
        letters = iter(b)
        if (ka or kb) and 2 * len(a) <= len(b) + 2 and a[0] == b[0] and all(c in letters for c in a):
            return ABBREVIATED
        return 0.0

    def keys(self, word: str) -> set[str]:
        """What words that are alike, but for initials, have one of in common."""
        if not word.isalpha() or len(word) < 2:
            return {word}
        kind, given = self.kind(word), self.given(word)[0]
        keys = {word} if len(word) == 2 else slips(word)
        keys |= {f"given {given}"} if given else set()
        keys |= {f"kind {kind}"} if kind else set()
        if not kind and 3 <= len(word) <= 10:
            # Abbreviations of a kind of organisation, also of a slip of one: the slip may have added a letter.
            for d, k in self.kinds.items():
                if 2 * len(word) <= len(d) + 3 and len(set(word).difference(d)) <= 1 and any(all(c in letters for c in v) for v in shortened(word) if (letters := iter(d))):
                    keys.add(f"kind {k}")
        return keys

    def parted(self, a: list[str], b: list[str]) -> list[str]:
        """``a`` with each word in two that begins or ends with a word of ``b``, where it is like none of them."""
        out = []
        whole = set(b)
        for t in a:
            at = 0
            if len(t) >= 7 and t not in whole and not any(len(u) > 1 and self.alike(t, u) for u in b):
                at = next((len(u) if t.startswith(u) else len(t) - len(u) for u in sorted(b, key=len, reverse=True) if len(u) >= 4 and len(t) - len(u) >= 3 and (t.startswith(u) or t.endswith(u))), 0)
            out += [t[:at], t[at:]] if at else [t]
        return out

    def compare(self, a: list[str], b: list[str], weights: dict[str, float]) -> tuple[int, bool, bool] | None:
        """How two names of these words are linked, if they are, whether a slip of typing (no plural) parts them, and whether the second is the single word.

        The similarity is the weighted mean of how alike each word is to its best partner in the other name; words
        without a partner count 0. ``weights``: how rare a word is; a part of one that isn't there is as rare as they are on average.
        """
        ja, jb = "".join(a), "".join(b)
        if ja == jb:
            return STRONG, False, False
        if len(a) != len(b) and min(map(len, a + b)) > 1 and len(ja) > 8 and (ja + jb).isalpha() and near(ja, jb):
            return STRONG, True, False
        a, b = self.parted(a, b), self.parted(b, a)
        usual = sum(weights.values()) / max(1, len(weights))
        w = lambda x: weights.get(x, usual)
        if len(a) * len(b) <= COMPARED:
            pairs = sorted(((s, -abs(i - j), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (s := self.alike(x, y))), reverse=True)
        else:
            first = {y: j for j, y in enumerate(b)}
            pairs = [(1.0, 0, i, first[x]) for i, x in enumerate(a) if x in first]
        left_a, left_b = dict(enumerate(a)), dict(enumerate(b))
        got = whole = 0.0
        initial = slip = unlike = False
        ends = 0
        for s, _, i, j in pairs:
            if i not in left_a or j not in left_b:
                continue
            x, y = left_a.pop(i), left_b.pop(j)
            short, long_ = sorted((x, y), key=len)
            if s in (INITIAL, INITIAL_TWO):
                initial, weight = True, w(long_)
            else:
                weight = min(w(x), w(y))
                slip |= x != y and long_ != short + "s"
                unlike |= x != y
                ends += (i in (0, len(a) - 1)) and (j in (0, len(b) - 1))
            got += s * weight
            whole += weight
        if not whole:
            return None
        la, lb = list(left_a.values()), list(left_b.values())
        if any(not x.isalpha() for x in la + lb):
            return None
        # A single letter more, such as that of a second given name, says nothing against; other ones do.
        both = bool(la and lb)
        if not both:
            la, lb = [x for x in la if len(x) > 1], [x for x in lb if len(x) > 1]
        lost = sum(max(w(x), 2.0) for x in la + lb)
        similar = got / (whole + lost)
        one = min(len(a), len(b)) == 1
        if not initial and similar >= SIMILAR and not (one and len(a) != len(b)):
            return STRONG, slip, False
        if initial and not la and not lb and similar >= INITIALS and not one:
            return PARTIAL, False, False
        if one and not initial:
            t, own = (a[0], la) if len(a) == 1 else (b[0], lb)
            if not own and not self.given(t)[0] and not self.kind(t):
                return (BARE_SLIP if unlike else BARE), False, len(a) > 1
        if not one and not initial and not both and ends == 2 and not any(self.kind(x) for x in a + b):
            return MIDDLE, False, False
        return None


@dataclass
class Name:
    """The words of a name. ``sure``: the way it is typed says that it is of someone; ``given``: the word that it shows to be a given name.

    ``known``: it has a given name of the list (also as the beginning of a long word), a kind of organisation or an initial; ``short``: it has an initial.
    """

    words: list[str]
    sure: bool = False
    known: bool = False
    short: bool = False
    given: str | None = None


def read(name: str | None, about: Words) -> Name | None:
    """The words of a name, in small letters without marks, prefix, title and legal form; None where there are none."""
    text = fold(name or "").strip()
    prefix = next((p for p in PREFIXES if text.startswith(p)), "")
    text = text[len(prefix) :]
    comma = False
    if text.count(",") == 1:
        before, after = text.split(",")
        if (those := re.findall(r"[^\W_]+", after)) and those[-1] not in LEGAL:
            text, comma = f"{after} {before}", True
    words = re.findall(r"[^\W_]+", text)
    titled = words[:1] and words[0] in ("dr", "mr", "mrs", "ms", "prof")
    words = [w for w in words if w not in TITLES] or words
    legal = False
    while len(words) > 1 and words[-1] in LEGAL:
        words.pop()
        legal = True
    if not words:
        return None
    many = len(words) > 1
    kind = any(about.kind(w) or len(w) > 8 and w.endswith(LONG_KINDS) for w in words)
    short = many and any(w.isalpha() and (len(w) == 1 or len(w) == 2 and w not in about.kinds and w not in about.nick and w not in ("of", "de", "la", "le")) for w in words)
    person = many and not kind and (comma or titled or prefix in ("people/", "person/", "contacts/", "@") or len(words) == 3 and len(words[1]) == 1)
    glued = any(len(w) >= 9 and any(w[:n] in about.nick for n in range(4, len(w) - 4)) for w in words)
    known = glued or many and (kind or short or any(about.given(w)[0] for w in words))
    return Name(words, bool(prefix or comma or titled or legal), known, short, words[0] if person and len(words[0]) > 2 else None)


def grams_of(words: list[str]) -> list[str]:
    """The grams of each word; words shorter than a gram are grams themselves."""
    return sorted({w[i : i + Q] for w in words for i in range(max(1, len(w) - Q + 1))})


def typed(names: DataFrame, about: Words) -> DataFrame:
    """number, form (the words with blanks between), sure, known, short, given: of each name that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, n) for i, x in enumerate(b.column(1).to_pylist()) if (n := read(x, about))]
            cols = [pa.array([getattr(n, f) for _, n in got], t) for f, t in (("sure", pa.bool_()), ("known", pa.bool_()), ("short", pa.bool_()), ("given", pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in got], pa.int64())), pa.array([" ".join(n.words) for _, n in got], pa.string()), *cols], names=["number", "form", "sure", "known", "short", "given"])

    return names.select("number", "name").mapInArrow(run, "number bigint, form string, sure boolean, known boolean, short boolean, given string")


def weighed(forms: DataFrame, total: int) -> DataFrame:
    """id, words, weights (log(1 + forms / forms with the word)), codes and heads: the grams of the name, and the rarest of them.

    A code is a gram with its weight in the last 20 bits. The heads are the prefix of the filter: of the grams in order of
    rarity so many that the others weigh less than ``SHARED`` of all, so a name that has as much in common must have one.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, g) for i, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for g in grams_of(f.split(" "))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), pa.array([g for _, g in got], pa.string())], names=["id", "gram"])

    rare = lambda n: F.log(1 + F.lit(float(total)) / F.col(n))
    each = forms.select("id", "form").mapInArrow(grams, "id bigint, gram string")
    codes = each.groupBy("gram").agg(F.count("*").alias("n")).select("gram", ((F.shiftleft(F.xxhash64("gram"), 20)) + F.round(rare("n") * 1000).cast("bigint")).alias("code"), "n")
    own = each.join(codes, "gram").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "code"))).alias("g"))
    words = forms.select("id", F.posexplode(F.split("form", " ")).alias("at", "word"))
    counts = words.groupBy("word").agg(F.count_distinct("id").alias("n"))
    heavy = words.join(counts, "word").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "word", rare("n").cast("float").alias("w")))).alias("t"))
    heft = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x.bitwiseAND(F.lit((1 << 20) - 1)))
    rows = own.join(heavy, "id").select("id", F.col("t.word").alias("words"), F.col("t.w").alias("weights"), F.col("g.code").alias("codes")).withColumn("all", heft(F.col("codes")))
    # Weight of a gram and those after it.
    return rows.withColumn("heads", F.filter("codes", lambda c, i: heft(F.slice("codes", i + 1, F.size("codes"))) >= F.lit(SHARED) * F.col("all")))


def _mapped(df: DataFrame, of, schema: str) -> DataFrame:
    """The rows that ``of`` gives for each row (a tuple); both of plain values."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [out for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for out in of(*row)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], kinds[c.split()[1]]) for i, c in enumerate(schema.split(", "))], names=names)

    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    return df.mapInArrow(run, schema)


def alike_words(words: DataFrame, about: Words) -> DataFrame:
    """word, other: all words that are alike, but for initials, both ways, and each word with itself; ``words``: word, each once."""
    keys = cut(_mapped(words.select("word"), lambda w: [(w, k) for k in about.keys(w)], "word string, key string"), "keys")
    met = keys.join(keys.select(F.col("word").alias("other"), "key"), "key").where("word < other").select("word", "other").distinct()
    pairs = _mapped(met, lambda x, y: [(x, y), (y, x)] if about.alike(x, y) not in (0.0, INITIAL, INITIAL_TWO) else [], "word string, other string")
    alike = cut(pairs.unionByName(words.select("word", F.col("word").alias("other"))), "alike")
    drop(keys)
    return alike


def marked(rows: DataFrame, about: Words) -> DataFrame:
    """The rows of ``weighed`` with marks, and lead: marks of which one of two names that are linked has one of the other's.

    The grams that names are made of are few, so the pairs with a gram in common grow as the square of the names; words
    are many. What ``Words.compare`` links has at least one of these in common, unless all that
    leads is a word whose letters hold a short form of a kind of organisation by chance ("mus" in "musalowan"):
    - A word that leads. Of a name that is linked as a whole, the words without a partner weigh at most 1 - ``SIMILAR`` of
      all, and else one of the two names has partners for all its words. So of the words of a name, those with the fewest
      names first, so many lead that the others weigh less than 1 - ``LEADING``: one of them has a partner. The marks are
      the words of a name, also the parts of a word that begins or ends with another word; the leads are all words alike.
    - The letters of all its words together, or one slip of these.
    - Where the leading words of both have but initials for partners: a leading gram, with the letters of the initials.
    """
    each = rows.select("id", F.inline(F.arrays_zip("words", "weights"))).select("id", F.col("words").alias("word"), F.col("weights").alias("w"))
    real = cut(each.select("word").distinct(), "words")
    # Only pieces as long as some word are looked for.
    long_ = {r.n for r in real.select(F.length("word").alias("n")).distinct().collect() if r.n >= 4}

    def pieces(t: str) -> list[tuple[str, str, str]]:
        return [x for n in long_ if 7 <= n + 3 <= len(t) for x in ((t, t[:n], t[n:]), (t, t[-n:], t[:-n]))]

    parts = cut(_mapped(real, pieces, "whole string, word string, rest string").join(real, "word").select("whole", F.col("word").alias("part"), "rest"), "parts")
    inner = each.join(parts, each.word == parts.whole).select("id", F.explode(F.array("part", "rest")).alias("word"))
    own = cut(each.select("id", "word").unionByName(inner).distinct(), "own")
    known = cut(own.groupBy("word").agg(F.count("*").alias("n")), "known")
    alike = alike_words(known, about)
    names_ = cut(alike.join(known.select(F.col("word").alias("other"), "n"), "other").groupBy("word").agg(F.sum("n").alias("names")), "names")
    # Short words, which may be initials, lead only where the others don't weigh enough.
    whole = Window.partitionBy("id")
    before = whole.orderBy(F.length("word") < 3, "names", "word").rowsBetween(Window.unboundedPreceding, -1)
    of_all = each.join(names_, "word").withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0.0))).withColumn("total", F.sum("w").over(whole))
    leading = cut(of_all.where(F.col("before") <= LEADING * F.col("total")).select("id", "word").distinct(), "leading")
    # A word that leads may be parted; then the part that fewer names have leads.
    x, y = (names_.select(F.col("word").alias(c), F.col("names").alias(f"{c}_names")) for c in ("part", "rest"))
    lesser = parts.join(x, "part").join(y, "rest").select(F.col("whole").alias("word"), F.when(F.col("part_names") <= F.col("rest_names"), F.col("part")).otherwise(F.col("rest")).alias("to"))
    leads = leading.unionByName(leading.join(lesser, "word").select("id", F.col("to").alias("word"))).distinct()

    def texts(i: int, words: list[str], first: list[str]) -> list[tuple[int, list[str], list[str]]]:
        joint = "".join(words)
        initials = {w[0] for w in words if len(w) < 3 and w.isalpha()}
        letters = {"".join(sorted(s + about.nick.get(w, w)[0])) for s in initials for w in first if len(w) > 1} if initials else set()
        return [(i, sorted(slips(joint) if len(joint) > 7 and joint.isalpha() else {joint}), sorted(letters))]

    led = rows.select("id", "words").join(leading.groupBy("id").agg(F.collect_set("word").alias("first")), "id")
    more = _mapped(led, texts, "id bigint, texts array<string>, letters array<string>")
    mark = lambda kind, *c: F.xxhash64(F.lit(kind), *c)
    with_letters = lambda codes: F.flatten(F.transform("letters", lambda x: F.transform(codes, lambda c: mark("initials", c, x))))
    words = own.groupBy("id").agg(F.collect_set(mark("word", "word")).alias("own"))
    first = leads.join(alike, "word").groupBy("id").agg(F.collect_set(mark("word", "other")).alias("lead"))
    both = F.transform("texts", lambda t: mark("text", t))
    got = rows.join(words, "id").join(first, "id").join(more, "id").withColumn("marks", F.concat("own", both, with_letters("codes"))).withColumn("lead", F.concat("lead", both, with_letters("heads"))).drop("own", "texts", "letters")
    got = cut(got, "marks")
    drop(real, parts, own, known, alike, names_, leading)
    return got


def candidates(rows: DataFrame) -> DataFrame:
    """a, b: the ids of each two names of which the lighter has ``SHARED`` of its gram weight in common with the other; of rows of ``marked``, those of them that have a mark in common."""
    lead, marks = ("lead", "marks") if "marks" in rows.columns else ("heads", "codes")
    heads = rows.select(F.col("id").alias("a"), F.col("all").alias("a_all"), F.explode(lead).alias("code"))
    every = rows.select(F.col("id").alias("b"), F.col("all").alias("b_all"), F.explode(marks).alias("code"))
    lighter = (F.col("a_all") < F.col("b_all")) | (F.col("a_all") == F.col("b_all")) & (F.col("a") < F.col("b"))
    met = heads.join(every, "code").where("a <> b")
    # Grams lead from the lighter name only, words from either.
    met = (met.where(lighter) if lead == "heads" else met.select(F.when(lighter, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(lighter, F.col("b")).otherwise(F.col("a")).alias("b"))).select("a", "b").distinct()
    x, y = (rows.select(F.col("id").alias(k), F.col("codes").alias(f"{k}_codes"), F.col("all").alias(f"{k}_all")) for k in "ab")
    common = F.aggregate(F.array_intersect("a_codes", "b_codes"), F.lit(0).cast("bigint"), lambda s, c: s + c.bitwiseAND(F.lit((1 << 20) - 1)))
    return met.join(x, "a").join(y, "b").where(common >= F.lit(SHARED) * F.col("a_all")).select("a", "b")


def compared(pairs: DataFrame, rows: DataFrame, about: Words) -> DataFrame:
    """a, b, link, slip: the pairs of names that are linked, and how (``Words.compare``); of BARE ones ``a`` is the single word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for i, (x, xw, y, yw) in enumerate(zip(*(b.column(c).to_pylist() for c in range(2, 6)), strict=True)):
                if found := about.compare(x, y, dict(zip(x + y, xw + yw, strict=True))):
                    got.append((i, *found))
            left, right = b.column(0).to_pylist(), b.column(1).to_pylist()
            ends = [(right[i], left[i]) if turned else (left[i], right[i]) for i, _, _, turned in got]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in ends], pa.int64()), pa.array([y for _, y in ends], pa.int64()), pa.array([k for _, k, _, _ in got], pa.int32()), pa.array([s for _, _, s, _ in got], pa.bool_())], names=["a", "b", "link", "slip"])

    x, y = (rows.select(F.col("id").alias(k), F.col("words").alias(f"{k}_words"), F.col("weights").alias(f"{k}_weights")) for k in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "a_words", "a_weights", "b_words", "b_weights")
    return both.mapInArrow(run, "a bigint, b bigint, link int, slip boolean")


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """id, label: the smallest id of the connected component of each id of the edges (a, b), by labels that spread and jump.

    Goes on until no label changes; where that takes more than ``most`` rounds, it is an error.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    before = labels
    for done in count(1):
        near_ = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("seen"))
        spread_ = labels.join(near_, "id").select("id", F.least("label", "seen").alias("new"), F.col("label").alias("old"))
        # Each label is replaced by the label of that id: paths halve with every round.
        jump = spread_.select(F.col("id").alias("new"), F.col("new").alias("further"))
        now = cut(spread_.join(jump, "new", "left").select("id", F.coalesce("further", "new").alias("label"), "old"), "labels")
        drop(before)
        before, labels = now, now.select("id", "label")
        if now.where(F.col("label") != F.col("old")).isEmpty():
            drop(both)
            return labels
        if done == most:
            raise RuntimeError(f"components not settled after {most} rounds")


def _relabelled(forms: DataFrame, edges: DataFrame) -> DataFrame:
    """The forms with the labels that edges (a, b) between their labels give them."""
    sets = components(edges)
    joined = forms.join(sets.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left")
    return cut(joined.withColumn("label", F.coalesce("to", "label")).drop("to"), "labels")


def _between(links: DataFrame, forms: DataFrame, kinds: list[int], *more: str, ways: int = 2) -> DataFrame:
    """x, y, link: the labels of the forms that links of these kinds join, one way or both; and columns ``more`` of the forms of each."""
    both = links.where(F.col("link").isin(kinds)).select(F.col("a").alias("i"), F.col("b").alias("j"), "link")
    if ways == 2:
        both = both.unionByName(both.select(F.col("j").alias("i"), F.col("i").alias("j"), "link"))
    x, y = (forms.select(F.col("id").alias(i), F.col("label").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in more]) for i, k in (("i", "x"), ("j", "y")))
    return both.join(x, "i").join(y, "j").where("x <> y").drop("i", "j")


def entities(names: DataFrame, about: Words | None = None) -> DataFrame:
    """number, entity: which spellings mean the same person or organisation; those of topics are left out.

    ``names``: number, name. Every name takes part as the set of the q-grams of its words, weighted by rarity: a
    prefix-filtered join (``marked``) gives the pairs of which the lighter name has ``SHARED`` of its weight in common with
    the other, and the mean similarity of their words, weighted by rarity, decides (``Words.compare``). Equal words in equal order
    are one form. A list of short forms only adds to the similarity of two words. Then
    - names linked as a whole form sets;
    - a name with an initial for a word joins the one set of full names that it is linked with, and where there is none,
      the others with initials; a name without a middle name joins the one set that has it;
    - a single word joins the one set of names that have it, or, if none has, a slip of it.
    A set is of a person or organisation if something in it speaks for that: a given name (of the list, or standing as
    such in a name whose way of typing shows which it is), a kind of organisation, an initial, a title, a prefix, or a
    slip of typing (a plural is none). Others are topics. Null and empty names are no cases; of repeated rows of a number
    the smallest name counts. Grams that many names have weigh little and are seldom heads, so a surname that a third of
    the names have isn't compared with all of them.
    """
    about = about or Words()
    base = spread(names.where(F.col("number").isNotNull() & F.col("name").isNotNull()).groupBy("number").agg(F.min("name").alias("name")))
    rows = cut(typed(base, about), "typed")
    forms = cut(rows.groupBy("form").agg(F.bool_or("sure").alias("sure"), F.bool_or("known").alias("known"), F.bool_or("short").alias("short")).withColumn("id", F.monotonically_increasing_id()), "forms")
    total = forms.count()
    grams = cut(weighed(forms, total), "grams")
    heavy = marked(grams, about)
    met = cut(candidates(heavy), "candidates")
    links = cut(compared(met, heavy, about), "links")
    drop(met, heavy, grams)

    forms = forms.withColumn("label", F.col("id")).withColumn("single", ~F.col("form").contains(" "))
    forms = _relabelled(forms, links.where(F.col("link") == STRONG).select("a", "b"))
    # By initials and middle names: the one set of full names that fits.
    kind = cut(forms.groupBy("label").agg(F.bool_or(~F.col("short")).alias("full"), F.bool_and("single").alias("single")), "kinds")
    x, y = (kind.select(F.col("label").alias(k), F.col("full").alias(f"{k}_full")) for k in "xy")
    part = _between(links, forms, [PARTIAL]).join(x, "x").join(y, "y").where("not x_full")
    fits = part.groupBy("x").agg(F.min(F.when(F.col("y_full"), F.col("y"))).alias("one"), F.max(F.when(F.col("y_full"), F.col("y"))).alias("other"))
    part = part.join(fits, "x").where("(one = other and y = one) or one is null").select(F.col("x").alias("a"), F.col("y").alias("b"))
    size = F.size(F.split("form", " "))
    middle = _between(links, forms.withColumn("size", size), [MIDDLE], "size").where("x_size < y_size").groupBy("x").agg(F.min("y").alias("one"), F.max("y").alias("other")).where("one = other")
    forms = _relabelled(forms, part.unionByName(middle.select(F.col("x").alias("a"), F.col("one").alias("b"))))
    # Single words: the one set that has them.
    alone = forms.groupBy("label").agg(F.bool_and("single").alias("single")).where("single").select(F.col("label").alias("x"))
    bare = _between(links, forms, [BARE, BARE_SLIP], ways=1).join(alone, "x").groupBy("x").agg(*[f(F.when(F.col("link") == k, F.col("y"))).alias(n) for k, p in ((BARE, "same"), (BARE_SLIP, "slip")) for f, n in ((F.min, f"{p}_one"), (F.max, f"{p}_other"))])
    goes = bare.select(F.col("x").alias("a"), F.when(F.col("same_one").isNotNull(), F.when(F.col("same_one") == F.col("same_other"), F.col("same_one"))).when(F.col("slip_one") == F.col("slip_other"), F.col("slip_one")).alias("b"))
    forms = _relabelled(forms, goes.where("b is not null"))

    learnt = rows.where(F.col("given").isNotNull()).select(F.col("given").alias("word")).distinct()
    words = forms.where("not single").select("label", F.explode(F.split("form", " ")).alias("word"))
    shown = forms.where("sure or known").select("label").unionByName(words.join(learnt, "word", "left_semi").select("label"))
    slips = links.where("slip").select(F.col("a").alias("id")).join(forms, "id").select("label")
    real = forms.join(shown.unionByName(slips).distinct(), "label", "left_semi")
    named = real.join(real.groupBy("label").agg(F.min("form").alias("entity")), "label").select("form", "entity")
    return rows.select("number", "form").join(named, "form").select("number", "entity")


def spellings(summaries: DataFrame, about: Words | None = None) -> DataFrame:
    """entity_no, entity of the link and tag records of persons and organisations."""
    rows = summaries.where(F.col("entity_type").isin("link", "tag")).select(F.col("entity_no").cast("bigint").alias("number"), F.col("name").cast("string").alias("name"))
    return entities(rows, about).select(F.col("number").alias("entity_no"), "entity")


def spelling_pairs(summaries: DataFrame, about: Words | None = None) -> DataFrame:
    """entity_no_a, entity_no_b: each pair of records of the same one, the smaller number first."""
    one = cut(spellings(summaries, about), "spellings")
    a, b = one.select("entity", F.col("entity_no").alias("entity_no_a")), one.select("entity", F.col("entity_no").alias("entity_no_b"))
    return a.join(b, "entity").where(F.col("entity_no_a") < F.col("entity_no_b")).select("entity_no_a", "entity_no_b")
