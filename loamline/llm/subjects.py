"""Subject areas of notes: latent Dirichlet topics, mapped to subjects by their top terms, and counted by sentence."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.session import cut, drop, spread

#: Topics.
TOPICS = 128
#: A term stands in so many notes, and in such a part of all notes; so there are at most (distinct terms of a note / ``RATE``) terms.
NOTES, RATE = 5, 5e-5
#: A term that stands in more than this part of the notes of a language says nothing about their subject.
COMMON = 0.25
#: Judged notes by which topics are mapped to subjects, at most; chosen by hash where there are more.
JUDGED = 20_000
#: Parts of the notes that the topics are learnt from one after the other, and how often; the weight of a part is (LATE + parts before) to the power of -FORGET.
BATCHES, EPOCHS, LATE, FORGET = 16, 2, 2.0, 0.6
#: Priors of the topics of a note (in the mean) and of the terms of a topic, and rounds within a note.
ALPHA, ETA, ROUNDS = 0.05, 0.01, 6
#: Terms of a topic by which it is mapped, and how much more of the judged notes with them than of all must be of one subject (0: no more, 1: all).
TOP_TERMS, PURE = 12, 0.3
#: Passes over all notes in which the terms of the subjects are counted anew, sentence by sentence.
PASSES = 1
#: The part of the terms of a sentence about a subject that are its own; priors of a subject and of none in a note; the logarithm by which a sentence must speak for a subject.
OWN, SUBJECT, BACKGROUND, EVIDENCE = 0.3, 0.1, 2.0, 1.0
#: Taken off the count of a term in a subject, so that words met by chance don't stay in it.
DISCOUNT = 1.0
#: Terms of notes that are held at once, for the memory of a worker.
HELD = 100_000
#: Sentences about a subject that make it one of a note's.
SENTENCES = 3

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_LINKS = re.compile(r"!\[[^\]]*\]\([^)]*\)|\[\[[^\]]*\]\]|https?://\S+|`[^`\n]*`|<[^>\n]{1,80}>")
_LABEL = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_TAG = re.compile(r"(?:(?<=\s)|\A)[#@][^\s#@]+")
_MARKER = re.compile(r"\s*(?:>+\s*)*(?:[-*+•]\s+|\d{1,3}[.)]\s+|\[[ x]\]\s*|\d{1,2}:\d{2}(?::\d{2})?\s+|#{2,6}\s+)*")
_LAST = re.compile(r"[^\W\d_]+\Z")
_STOP = re.compile(r"([.!?…]+[\"'”’»)*_]*|[。！？])(?=\s|[。！？]|\Z)")
#: Short forms whose full stop doesn't end a sentence.
_SHORT = set("dr mr mrs ms prof st vs etc cf no vol fig ca bzw usw nr str sr sra mme approx dept co inc ltd sys univ inst hosp lab intl mfg assoc fdn ej mus org".split())


def segments(text: str) -> list[str]:
    """The lines, list items and table cells of a note, without front matter, title, code, links, tags and addresses."""
    t = text.replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n").replace("\u2029", "\n\n")
    if t.startswith("---\n") and (end := t.find("\n---\n", 4)) >= 0:
        t = t[end + 5 :]
    t = _TAG.sub(lambda m: f" {m.group()[0]} ", _LABEL.sub(r"\1", _LINKS.sub(" ", _FENCE.sub("\n\n", t))))
    out: list[str] = []
    open_ = False
    for line in t.split("\n"):
        bare = line.strip()
        if not bare or bare.startswith("# "):
            open_ = False
            continue
        if bare.startswith("|"):
            out += [c for c in bare.split("|") if c.strip()]
            open_ = False
            continue
        rest = _MARKER.sub("", line, count=1) if (marked := bool(_MARKER.match(line).group().strip())) else bare
        # A line goes on from the one before where that has no end and this one begins small.
        if open_ and not marked and rest[:1].islower():
            out[-1] += " " + rest
        else:
            out.append(rest)
        open_ = not bare.endswith((".", "!", "?", "…", "。", ":", "!", "*"))
    return out


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence of a note, in small letters."""
    if not text:
        return []
    small = text == text.lower()
    out = []
    for s in segments(text):
        last = 0
        parts = []
        for m in _STOP.finditer(s):
            at = m.start()
            if m.group(1)[0] == ".":
                before = _LAST.search(s, max(0, at - 20), at)
                if before and (len(before.group()) == 1 or before.group().lower() in _SHORT) or not small and s[m.end() :].lstrip()[:1].islower():
                    continue
            parts.append(s[last : m.end()])
            last = m.end()
        parts.append(s[last:])
        out += [w for p in parts if (w := _WORD.findall(p.lower()))]
    return out


def _flat(b: pa.RecordBatch, column: str) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and the lengths of the lists."""
    a = b.column(column)
    return a.flatten(), np.diff(a.offsets.to_numpy()).astype(np.int64)


def _numbers(b: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    values, lengths = _flat(b, column)
    return values.to_numpy(zero_copy_only=False), lengths


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


def split_notes(docs: DataFrame, key: str) -> DataFrame:
    """key, lang, words, lengths (of the sentences); the texts are taken apart once, and written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, lengths = [], []
            for text in b.column(2).to_pylist():
                own = sentences(text)
                words.append([w for s in own for w in s])
                lengths.append([len(s) for s in own])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.string())), pa.array(lengths, pa.list_(pa.int32()))], names=["key", "lang", "words", "lengths"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"), "text")
    return cut(rows.mapInArrow(run, f"key {rows.schema[0].dataType.simpleString()}, lang string, words array<string>, lengths array<int>"), "words")


def _begins(lengths: np.ndarray) -> np.ndarray:
    """The place of the first word of each sentence."""
    return np.cumsum(lengths) - lengths


def beginnings(notes: DataFrame, least: int) -> DataFrame:
    """a, b: pairs of words that begin at least ``least`` sentences, and of which at least every second one begins a sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = _flat(b, "words")[0].dictionary_encode()
            if len(words) < 2:
                continue
            lengths, _ = _numbers(b, "lengths")
            code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            pair = code[:-1] * len(words.dictionary) + code[1:]
            inside = np.ones(len(code), bool)
            ends = np.cumsum(lengths) - 1
            inside[ends] = False
            first = np.zeros(len(code), bool)
            first[_begins(lengths)[lengths > 2]] = True
            some = np.flatnonzero(inside[:-1])
            u, at, n = np.unique(pair[some], return_inverse=True, return_counts=True)
            begin = np.bincount(at, weights=first[some], minlength=len(u)).astype(np.int64)
            a, c = u // len(words.dictionary), u % len(words.dictionary)
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(a)), words.dictionary.take(pa.array(c)), pa.array(begin), pa.array(n)], names=["a", "b", "starts", "times"])

    rows = notes.select("words", "lengths").mapInArrow(run, "a string, b string, starts bigint, times bigint")
    sums = rows.groupBy("a", "b").agg(F.sum("starts").alias("starts"), F.sum("times").alias("times"))
    return sums.where((F.col("starts") >= least) & (2 * F.col("starts") >= F.col("times"))).select("a", "b")


def vocabulary(notes: DataFrame, least: int, common: float = COMMON) -> DataFrame:
    """term: words of at least two letters in at least ``least`` notes, but those that are common in a language: by more than chance in more than ``common`` of its notes."""
    spoken = notes.groupBy("lang").agg(F.count("*").alias("all"))
    each = notes.select("lang", F.explode(F.array_distinct("words")).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    usual = F.col("n") > common * F.col("all") + 3 * F.sqrt(common * F.col("all"))
    rows = each.join(spoken, "lang").groupBy("term").agg(F.sum("n").alias("n"), F.bool_or(usual & (F.col("lang") != "")).alias("usual"))
    return rows.where((F.col("n") >= least) & ~F.col("usual") & (F.length("term") > 1)).select("term")


def encode_notes(notes: DataFrame, terms: list[str], starts: list[tuple[str, str]], batches: int) -> DataFrame:
    """key, weight, sentences, ids and lengths (the terms of each sentence that has any), bag and times (the terms of the note), batch.

    A sentence is cut where a pair of words stands that begins sentences, three words after the last cut at the soonest, so
    that runs without stops come apart. Notes of rarer languages weigh more while the topics are learnt (the square root
    of how much rarer), so that these get topics of their own.
    """
    spoken = notes.where("lang <> ''").groupBy("lang").agg(F.count("*").alias("n"))
    most = spoken.agg(F.max("n")).first()[0] or 1
    spoken = spoken.select("lang", F.sqrt(1.01 * most / (F.col("n") + 0.01 * most)).cast("float").alias("weight"))
    rows = notes.join(spoken, "lang", "left").select("key", F.coalesce("weight", F.lit(1.0).cast("float")).alias("weight"), "words", "lengths")
    shared = notes.sparkSession.sparkContext.broadcast((terms, starts))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, begin = shared.value
        value_set = pa.array(known, pa.string())
        left, right = (sorted({p[i] for p in begin}) for i in (0, 1))
        place = [{w: i for i, w in enumerate(x)} for x in (left, right)]
        pairs = np.array(sorted(place[0][a] * len(right) + place[1][b] for a, b in begin), np.int64)
        for b in batches_:
            words, per_note = _flat(b, "words")
            lengths, per_sentence = _numbers(b, "lengths")
            index = lambda those: pa.compute.fill_null(pa.compute.index_in(words, value_set=those), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = index(value_set)
            begins = _begins(lengths.astype(np.int64))
            fresh = np.zeros(len(ids) + 1, bool)
            fresh[begins] = True
            if len(pairs) and len(ids) > 1:
                a, c = index(pa.array(left, pa.string())), index(pa.array(right, pa.string()))
                hit = (a[:-1] >= 0) & (c[1:] >= 0) & np.isin(a[:-1] * len(right) + c[1:], pairs) & ~fresh[:-2] & ~fresh[1:-1]
                last = -1
                of = np.searchsorted(begins, np.flatnonzero(hit), side="right") - 1
                for i, s in zip(np.flatnonzero(hit), of, strict=True):
                    if i - max(last, begins[s]) >= 3:
                        fresh[i] = True
                        last = i
            sentence = np.cumsum(fresh[:-1]) - 1
            note = np.repeat(np.arange(b.num_rows), per_note)
            count = np.bincount(note, weights=fresh[:-1], minlength=b.num_rows).astype(np.int64)
            some = ids >= 0
            ids, sentence, note = ids[some], sentence[some], note[some]
            which, sizes = np.unique(sentence, return_counts=True)
            owner = note[np.searchsorted(sentence, which)] if len(which) else which
            bag, times = np.unique(note * max(1, len(known)) + ids, return_counts=True)
            home = bag // max(1, len(known))
            tally = lambda x: np.bincount(x.astype(np.int64), minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("weight"), pa.array(count, pa.int32()), _lists(ids, tally(note), pa.int32()), _lists(sizes, tally(owner), pa.int32()), _lists(bag % max(1, len(known)), tally(home), pa.int32()), _lists(times, tally(home), pa.int32())],
                names=["key", "weight", "sentences", "ids", "lengths", "bag", "times"],
            )

    kind = notes.schema["key"].dataType.simpleString()
    done = rows.mapInArrow(run, f"key {kind}, weight float, sentences int, ids array<int>, lengths array<int>, bag array<int>, times array<int>")
    return cut(done.withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(batches)).cast("int")), "notes", by="batch")


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, so many each; 0 for none."""
    total = np.concatenate([np.zeros((1, values.shape[1]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def _exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp(digamma(x)) of positive numbers, to six figures."""
    out = np.zeros_like(x)
    for _ in range(4):
        out -= 1 / x
        x = x + 1
    r = 1 / (x * x)
    return np.exp(out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r / 252)))


def proportions(bag: np.ndarray, times: np.ndarray, per: np.ndarray, alpha: np.ndarray, words: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The Dirichlet of the topics of each note, and how much of each of its terms each topic has: the variational step of a block of notes, none of them empty."""
    n = len(per)
    of, begins = np.repeat(np.arange(n), per), _begins(per)
    weight = (1 + np.log(times)).astype(np.float32)
    own = words[bag]
    gamma = alpha + (np.add.reduceat(weight, begins) / len(alpha))[:, None].astype(np.float32) * np.ones((1, len(alpha)), np.float32)
    for i in range(rounds + 1):
        drawn = _exp_digamma(gamma)
        mine = drawn[of]
        share = own * (weight / (np.einsum("ij,ij->i", mine, own) + 1e-30))[:, None]
        if i == rounds:
            return gamma, share * mine
        gamma = alpha + drawn * np.add.reduceat(share, begins, axis=0)
    return gamma, share


def _blocks(batches: Iterator[pa.RecordBatch], column: str = "bag") -> Iterator[pa.RecordBatch]:
    """The batches in blocks of notes with so many terms together that a worker can hold what it makes of them."""
    for b in batches:
        per = np.diff(b.column(column).offsets.to_numpy())
        ends = np.cumsum(per)
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HELD, side="right")))
            yield b.slice(a, z - a)
            a = z


def _term_sums(rows: DataFrame, terms: int, width: int, run) -> np.ndarray:
    """[term, value]: sums over all rows. ``run`` gives for the batches of a task one such matrix.

    A task sends what it has summed up, a slice of terms at a time, and the slices are summed by tasks before the driver
    gets them: as many values as the model has.
    """
    chunk = max(1, min(terms, (1 << 22) // max(1, width)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = run(batches)
        at = [i for i in range(0, terms, chunk) if sums[i : i + chunk].any()]
        if at:
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([sums[i : i + chunk].astype(np.float32).tobytes() for i in at], pa.binary())], names=["at", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for at, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(v, np.float32)
                held[at] = held[at] + v if at in held else v.astype(np.float64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["at", "v"])

    parts = min(max(1, math.ceil(terms / chunk)), 64)
    got = rows.mapInArrow(emit, "at bigint, v binary").repartition(parts, "at").mapInArrow(add, "at bigint, v binary").toArrow()
    out = np.zeros((terms, width))
    for at, v in zip(got.column("at").to_pylist(), got.column("v").to_pylist(), strict=True):
        v = np.frombuffer(v, np.float64).reshape(-1, width)
        out[at : at + len(v)] += v
    return out


@dataclass
class Model:
    """topics[term, topic]: how often; share[topic, subject]: as ``mapped`` gives it; own[subject, term] and rest[subject, term]: parts of one."""

    terms: list[str]
    subjects: list[str]
    topics: np.ndarray
    share: np.ndarray
    own: np.ndarray
    rest: np.ndarray

    def gain(self) -> np.ndarray:
        """[term, subject]: the logarithm by which a term is likelier in a sentence about a subject than in another."""
        return np.log1p(OWN * (self.own.T / self.rest.T - 1)).astype(np.float32)

    def subject(self) -> np.ndarray:
        """The number of the subject of each topic, -1 for none."""
        if not self.share.size:
            return np.full(self.topics.shape[1], -1)
        return np.where(self.share.max(1) >= PURE, self.share.argmax(1), -1)

    def table(self, n: int = 20) -> list[tuple[int, str | None, float, list[str]]]:
        """Topic, the subject it is mapped to, how sure that is (``mapped``), and its top terms: the map, to be looked through."""
        top, to = top_terms(self.topics, n), self.subject()
        return [(k, self.subjects[to[k]] if to[k] >= 0 else None, float(self.share[k].max()) if self.share.size else 0.0, [self.terms[j] for j in top[k]]) for k in range(len(to))]


def top_terms(topics: np.ndarray, n: int) -> list[np.ndarray]:
    """The terms of each topic that are frequent in it and rare elsewhere, the first first."""
    if not topics.size:
        return [np.zeros(0, int)] * topics.shape[1]
    part = topics / np.maximum(topics.sum(0), 1e-9)
    all_ = topics.sum(1) / max(topics.sum(), 1e-9)
    lift = part * np.log(np.maximum(part, 1e-12) / np.maximum(all_, 1e-12)[:, None])
    return [np.array([j for j in np.argsort(-lift[:, k], kind="stable")[:n] if lift[j, k] > 1e-4], int) for k in range(topics.shape[1])]


def judgements(labels: DataFrame, subjects: DataFrame, key: str, most: int = JUDGED) -> DataFrame:
    """key, subject, vote: the part of its readers who give a note a subject, for at most ``most`` notes. Case doesn't count."""
    rows = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.lower(F.trim("subject")), F.lit("")).alias("s"), F.coalesce("reader", F.lit("")).alias("reader")).distinct()
    chosen = rows.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(most)
    rows = rows.join(chosen, "key", "left_semi")
    readers = rows.groupBy("key").agg(F.count_distinct("reader").alias("all"))
    named = subjects.select(F.col("subject"), F.lower(F.trim("subject")).alias("s")).where("subject is not null")
    return rows.join(named, "s").groupBy("key", "subject").agg(F.count_distinct("reader").alias("n")).join(readers, "key").select("key", "subject", (F.col("n") / F.col("all")).alias("vote"))


def learn_topics(notes: DataFrame, terms: int, topics: int = TOPICS, batches: int = BATCHES, epochs: int = EPOCHS) -> np.ndarray:
    """[term, topic]: how often each topic has each term, by online variational Bayes for latent Dirichlet allocation.

    The notes are taken part by part (a part is a folder of the table, dealt by hash); each part is a pass of all tasks,
    whose sums move the topics. Topics that have more of the terms get a larger prior. No judgement is used.
    """
    spark = notes.sparkSession
    whole = float(notes.select(F.sum(F.aggregate("times", F.lit(0.0), lambda s, x: s + 1 + F.log(x)))).first()[0] or 0.0)
    counts = np.random.default_rng(7).gamma(100.0, 0.01, (terms, topics)) * whole / max(1, terms * topics)
    for t in range(batches * epochs if terms and whole else 0):
        mass = counts.sum(0) / counts.sum()
        alpha = (np.full(topics, ALPHA) if t < batches // 2 else np.maximum(ALPHA / 5, mass * topics * ALPHA)).astype(np.float32)
        held = spark.sparkContext.broadcast((alpha, (_exp_digamma(counts + ETA) / _exp_digamma((counts + ETA).sum(0))).astype(np.float32)))

        def run(batches_: Iterator[pa.RecordBatch], held=held) -> np.ndarray:
            prior, words = held.value
            sums = np.zeros((terms, topics), np.float32)
            for b in _blocks(batches_):
                bag, per = _numbers(b, "bag")
                some = per > 0
                if not some.any():
                    continue
                _, share = proportions(bag, _numbers(b, "times")[0], per[some], prior, words)
                share *= np.repeat(b.column("weight").to_numpy(zero_copy_only=False)[some], per[some])[:, None]
                order = np.argsort(bag, kind="stable")
                u, first = np.unique(bag[order], return_index=True)
                sums[u] += np.add.reduceat(share[order], first, axis=0)
            return sums

        part = _term_sums(notes.where(F.col("batch") == t % batches).select("weight", "bag", "times"), terms, topics, run)
        rho = (LATE + t) ** -FORGET
        counts = (1 - rho) * counts + rho * batches * part
        held.unpersist()
    return counts


def mapped(notes: DataFrame, votes: DataFrame, names: list[str], topics: np.ndarray) -> np.ndarray:
    """[topic, subject]: how much more of the judged notes with the top terms of a topic are of a subject than of all judged notes; 0: no more, 1: all of them."""
    terms, k = topics.shape[0], len(names)
    if not (terms and k):
        return np.zeros((topics.shape[1], k))
    number = F.create_map(*[F.lit(x) for i, s in enumerate(names) for x in (s, i)])
    judged = votes.groupBy("key").agg(F.collect_list(F.struct(number[F.col("subject")].alias("s"), "vote")).alias("votes"))

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros((terms + 1, k + 1))
        for b in batches:
            bag, per = _numbers(b, "bag")
            y = np.zeros((b.num_rows, k + 1))
            y[:, k] = 1
            for i, those in enumerate(b.column("votes").to_pylist()):
                for one in those:
                    if one["s"] is not None:
                        y[i, one["s"]] = one["vote"]
            np.add.at(sums, bag, y[np.repeat(np.arange(b.num_rows), per)])
            sums[terms] += y.sum(0)
        return sums

    seen = _term_sums(notes.select("key", "bag").join(judged, "key").select("bag", "votes"), terms + 1, k + 1, run)
    usual = seen[terms, :k] / max(1.0, seen[terms, k])
    share = np.array([seen[t, :k].sum(0) / max(1.0, seen[t, k].sum()) for t in top_terms(topics, TOP_TERMS)])
    return (share - usual) / np.maximum(1 - usual, 1e-9)


def infer(gain: np.ndarray, ids: np.ndarray, per_sentence: np.ndarray, per_note: np.ndarray) -> np.ndarray:
    """[sentence, subject]: the part of each sentence that is about each subject, given the proportions of its note.

    A sentence is about one subject or none; the proportions of a note have a Dirichlet prior and are found together with
    what its sentences are about.
    """
    note_of = np.repeat(np.arange(len(per_note)), per_note)
    k = gain.shape[1]
    score = np.concatenate([_sums(gain[ids], per_sentence), np.zeros((len(per_sentence), 1))], 1)
    alpha = np.concatenate([np.full(k, SUBJECT), [BACKGROUND]])[None]
    share = alpha / alpha.sum() * np.ones((len(per_note), 1))
    part = score
    for _ in range(4):
        log = score + np.log(share)[note_of]
        log -= log.max(1, keepdims=True)
        part = np.exp(log)
        part /= part.sum(1, keepdims=True)
        share = alpha + _sums(part, per_note)
        share /= share.sum(1, keepdims=True)
    return np.where(score[:, :k] >= EVIDENCE, part[:, :k], 0.0)


def _model(terms: list[str], names: list[str], topics: np.ndarray, share: np.ndarray, subject: np.ndarray, every: np.ndarray) -> Model:
    """With the parts of each term: ``subject``[term, subject] of what there is of it (``every``) in subjects, the others in what isn't that subject."""
    some = subject + 1e-6
    others = np.maximum(every[:, None] - subject, 0) + 0.5
    return Model(terms, names, topics, share, (some / some.sum(0)).T, (others / others.sum(0)).T)


def _recounted(model: Model, notes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The terms of the subjects as all notes have them, sentence by sentence, and all terms. A note weighs as the root of its sentences."""
    v, k = len(model.terms), len(model.subjects)
    held = notes.sparkSession.sparkContext.broadcast((model.gain(), model.own.T.astype(np.float32), model.rest.T.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        gain, own, rest = held.value
        sums = np.zeros((v, k + 1))
        for b in _blocks(batches, "ids"):
            ids, per = _numbers(b, "ids")
            lengths, per_note = _numbers(b, "lengths")
            if not len(ids):
                continue
            part = infer(gain, ids, lengths.astype(np.int64), per_note)
            weight = np.repeat(b.column("weight").to_numpy(zero_copy_only=False) / np.sqrt(np.maximum(per_note, 1)), per)
            of = np.repeat(np.arange(len(lengths)), lengths)
            np.add.at(sums[:, k], ids, weight)
            for s in range(k):
                some = np.flatnonzero(part[of, s] > 1e-3)
                w = ids[some]
                mine = OWN * own[w, s]
                np.add.at(sums[:, s], w, weight[some] * part[of[some], s] * mine / (mine + (1 - OWN) * rest[w, s]))
        return sums

    sums = _term_sums(notes.select("weight", "ids", "lengths"), v, k + 1, run)
    return np.maximum(sums[:, :k] - DISCOUNT, 0.0), sums[:, k]


def fit(docs: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", topics: int = TOPICS, epochs: int = EPOCHS, passes: int = PASSES, least_notes: int = NOTES, common: float = COMMON) -> tuple[Model, DataFrame]:
    """The model of all notes, and the notes as terms.

    Latent Dirichlet topics are learnt from all notes without judgements (``learn_topics``). Each is mapped to the subject
    that most of the judged notes with its top terms are of, if these agree; ``Model.table`` shows the map. Topics of a
    subject are one topic then, all others are the background, and their terms are counted anew over all notes.
    """
    docs = spread(docs.select(key, "text", "lang"))
    words = split_notes(docs, key)
    n = words.count()
    least = max(least_notes, math.ceil(RATE * n))
    terms = sorted(r.term for r in vocabulary(words, least, common).toLocalIterator())
    starts = [(r.a, r.b) for r in beginnings(words, least).toLocalIterator()]
    notes = encode_notes(words, terms, starts, BATCHES)
    drop(words)
    names = sorted({r.subject for r in subjects.where("subject is not null").select("subject").distinct().collect()})
    found = learn_topics(notes, len(terms), topics, BATCHES, epochs)
    share = mapped(notes, judgements(labels, subjects, key), names, found)
    model = Model(terms, names, found, share, np.zeros((len(names), len(terms))), np.ones((len(names), len(terms))))
    if names and terms:
        to = model.subject()
        model = _model(terms, names, found, share, found @ (to[:, None] == np.arange(len(names))), found.sum(1))
        for _ in range(passes):
            model = _model(terms, names, found, share, *_recounted(model, notes))
    return model, notes


def counted_sentences(model: Model, notes: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, subject, sentences (about it), all_sentences; a row for each note and subject that has any."""
    held = notes.sparkSession.sparkContext.broadcast(model.gain() if model.subjects and model.terms else np.zeros((1, 0), np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for b in _blocks(batches, "ids"):
            ids, _ = _numbers(b, "ids")
            lengths, per_note = _numbers(b, "lengths")
            if not len(ids) or not gain.shape[1]:
                continue
            part = infer(gain, ids, lengths.astype(np.int64), per_note)
            n = _sums((part > 0.5).astype(np.float64), per_note)
            note, s = np.nonzero(n > 0.5)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(note)), pa.array(s, pa.int32()), pa.array(n[note, s].astype(np.int32), pa.int32()), b.column("sentences").take(pa.array(note))], names=["key", "s", "n", "m"])

    kind = notes.schema["key"].dataType.simpleString()
    rows = notes.select("key", "ids", "lengths", "sentences").mapInArrow(run, f"key {kind}, s int, n int, m int")
    names = F.array(*[F.lit(s) for s in model.subjects]) if model.subjects else F.array().cast("array<string>")
    return rows.select(F.col("key").alias(key), F.get(names, F.col("s")).alias("subject"), F.col("n").alias("sentences"), F.col("m").alias("all_sentences"))


def composition(counts: DataFrame, notes: DataFrame, least: int = SENTENCES) -> DataFrame:
    """subject, notes (with at least ``least`` sentences about it), sentences, note_share (of all notes), sentence_share (of all sentences)."""
    whole = notes.agg(F.count("*"), F.sum("sentences")).first()
    rows = counts.groupBy("subject").agg(F.sum(F.when(F.col("sentences") >= least, 1).otherwise(0)).alias("notes"), F.sum("sentences").alias("sentences"))
    return rows.select("subject", "notes", "sentences", (F.col("notes") / F.lit(max(1, whole[0]))).alias("note_share"), (F.col("sentences") / F.lit(max(1, whole[1] or 0))).alias("sentence_share"))


def subjects_of(docs: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", least: int = SENTENCES, **how) -> DataFrame:
    """key, subject, sentences: the subjects that at least ``least`` sentences of a note are about.

    Null, empty and blank texts, and texts in no known words, have none. Without judgements, subjects or notes there are
    no rows. Title, front matter, tags, links and code don't count. Repeated rows of a note give repeated rows.
    """
    model, notes = fit(docs, labels, subjects, key, **how)
    return counted_sentences(model, notes, key).where(F.col("sentences") >= least).select(key, "subject", "sentences")
