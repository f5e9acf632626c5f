"""Operator 7: toxicity behind disguise, by a noisy channel.

A writer means letters; the channel turns some into digits or signs, repeats
them, or puts separators between them. Spans that look so are decoded: a Viterbi
search over the lattice of what each character may stand for finds the letters
of highest probability under a character trigram model of the corpus and the
costs of the channel. The restored text is then scored: words and word
beginnings that labelled toxic documents have far more often make a lexicon,
and a logistic regression on a document's finds gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costgrain.llm.common import batch_of, in_training, small, table
from costgrain.llm.labelled import logistic, sample, sigmoid

CUT = 0.3
#: Letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
#: Signs that may stand between letters and mean nothing.
GAPS = " .-_*~'"
#: Natural logarithms of the channel: a sign for a letter, a letter repeated in a run
#: of three and more, one that is only double, a gap.
SIGN_COST, REPEAT_COST, DOUBLE_COST, GAP_COST = -1.5, -0.7, -3.0, -0.1
#: The same of a gap among letters that stand apart which parts two words.
BREAK_COST = -1.0
#: Word beginnings of these many letters are features beside whole words.
STARTS = (4, 5, 6, 7)
#: A lexicon entry has these many toxic documents, likelihood ratio and log odds at least.
LEAST_DOCS, LEAST_RATIO, LEAST_ODDS = 5, 18.0, 1.2
#: Likelihood ratio from which a find is strong; columns of the regression.
STRONG, WIDTH = 60.0, 7
#: Characters whose trigrams are worked out at a time.
PIECE = 1 << 20

_DISGUISED = re.compile(
    r"[^\W\d_][0-9@$!|+€£]+[^\W\d_]"  # signs inside a word
    r"|^[0-9@$€£]{1,2}[^\W\d_]{2}"  # or before it
    r"|[0-9@$€£][^\W\d_]{1,2}[0-9@$€£]"  # or around letters
    r"|([^\W\d_])\1\1"  # letters repeated
    r"|[^\W\d_](?:[.\-_*~][^\W\d_]){2}"  # gaps inside a word
)
_TRIPLE = re.compile(r"(.)\1\1")
#: Signs that stand for letters at a word's beginning or end: what else stands there belongs to no word.
_ENDS = re.compile(r"^(?:!(?=[^\W\d_]{2}))|(?<=[^\W\d_])[0-9@$€£]{1,3}$")
#: A letter twice running; one gap inside a word.
_TWICE = re.compile(r"([^\W\d_])\1")
_ONE_GAP = re.compile(r"(?<![^\W\d_])([^\W\d_]+)[.\-_*~'’]([^\W\d_]+)(?![^\W\d_])")
#: What may stand around a word and belongs to none; signs for letters only after it.
_AROUND = ".,;:!?\"'()[]{}<>#%&*-_~`|/\\=+^…«»„“”’"
_AFTER = _AROUND + "@$€£"
_BEFORE = _AROUND.replace("!", "")
#: Letters, or signs for letters, that each stand alone between gaps of any length: four and more.
_UNIT = r"[^\W_@$€£]|[@$!|+€£]"
_APART = re.compile(rf"(?<![^\W_])(?<![@$€£])(?:{_UNIT})(?:[\s.\-_*~']+(?:{_UNIT})(?![^\W_])(?![@$€£])){{3,}}")
_LONE, _WIDE = re.compile(_UNIT), re.compile(r"[\s.\-_*~']+")
_WORDS = re.compile(r"[^\W\d_]+")
_CODES = 28
_LETTER = np.full(256, 27, np.int64)  # by code point; all above are as the last
_LETTER[[9, 10, 11, 12, 13, 32]] = 0
_LETTER[97:123] = _LETTER[65:91] = np.arange(1, 27)


def code(letter: str) -> int:
    """0 for a word's edge, 1 to 26 for a to z, 27 for any other."""
    return ord(letter) - 96 if "a" <= letter <= "z" else 27


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all texts, as a cube of 28 codes a side.

    Each task adds up its own; at most 28**3 sums reach the driver."""
    schema = pa.schema([("tri", pa.int32()), ("n", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CODES**3, np.int64)
        for b in small(batches):
            joined = "  " + "  ".join(_strings(b.column(0))) + "  "
            for a in range(0, len(joined) - 2, PIECE):
                c = _LETTER[np.minimum(np.frombuffer(joined[a : a + PIECE + 2].encode("utf-32-le"), np.uint32), 255)]
                total += np.bincount((c[:-2] * _CODES + c[1:-1]) * _CODES + c[2:], minlength=_CODES**3)
        some = np.flatnonzero(total)
        yield batch_of(schema, pa.array(some, pa.int32()), pa.array(total[some]))

    rows = docs.select(F.col("text").cast("string")).mapInArrow(scan, "tri int, n long").groupBy("tri").agg(F.sum("n")).collect()
    cube = np.zeros(_CODES**3, np.int64)
    for tri, n in rows:
        cube[tri] = n
    return cube.reshape(_CODES, _CODES, _CODES)


def language_model(cube: np.ndarray) -> np.ndarray:
    """Log probability of each third character after two, backed by shorter contexts."""
    one = cube.sum(axis=(0, 1)) + 1.0
    two = cube.sum(axis=0) + 20.0 * one / one.sum()
    three = cube + 20.0 * (two / two.sum(axis=1, keepdims=True))[None]
    return np.log(three / three.sum(axis=2, keepdims=True))


@dataclass
class Decoder:
    """Viterbi search over the letters that a disguised span may stand for."""

    model: np.ndarray
    known: dict[str, str] = field(default_factory=dict)
    tokens: dict[str, tuple] = field(default_factory=dict)

    def __getstate__(self):
        return {"model": self.model, "known": {}, "tokens": {}}

    def decode(self, span: str) -> str:
        """The likeliest letters of a span, in lower case."""
        if (found := self.known.get(span)) is None:
            if len(self.known) > 50_000:
                self.known.clear()
            found = self.known[span] = self._search(span)
        return found

    @staticmethod
    def _repeats(span: str) -> list[float]:
        """What it costs each character to repeat the letter before it."""
        solid = [c for c in span if c not in GAPS]
        runs = [len(list(g)) for _, g in groupby(solid)]
        costs = iter([REPEAT_COST if n > 2 else DOUBLE_COST for n in runs for _ in range(n)])
        return [0.0 if c in GAPS else next(costs) for c in span]

    def _search(self, span: str, breaks: bool = False) -> str:
        """The likeliest letters; with ``breaks`` a gap may also end a word, which gives a blank."""
        # A state is the last two codes and the last letter read; it holds the best way there.
        states: dict[tuple[int, int, str], tuple[float, tuple]] = {(0, 0, ""): (0.0, ())}
        for read, repeat in zip(span, self._repeats(span), strict=True):
            means = [(read, 0.0)] if read.isalpha() else [(x, SIGN_COST) for x in SIGNS.get(read, "")]
            gap = read in GAPS or not means
            reached: dict[tuple[int, int, str], tuple[float, tuple]] = {}
            for (a, b, last), (value, way) in states.items():
                options = [((a, b, last), value + GAP_COST, way)] if gap else []
                if gap and breaks and b:
                    options.append(((b, 0, ""), value + BREAK_COST + self.model[a, b, 0], (way, " ")))
                for letter, cost in means:
                    c = code(letter)
                    options.append(((b, c, letter), value + cost + self.model[a, b, c], (way, letter)))
                    if letter == last:
                        options.append(((a, b, last), value + cost + repeat, way))
                for state, v, w in options:
                    if state not in reached or v > reached[state][0]:
                        reached[state] = (v, w)
            states = reached
        ends = [(v + self.model[a, b, 0], w) for (a, b, _), (v, w) in states.items()]
        way, out = max(ends, key=lambda x: x[0])[1] if ends else (), []
        while way:
            way, letter = way
            out.append(letter)
        return "".join(reversed(out))

    def token(self, shown: str) -> str:
        """A token in lower case, decoded where it looks disguised; signs at either end that may be letters are taken for such."""
        wide = shown.lstrip(_BEFORE).rstrip(_AROUND)
        if _ENDS.search(wide):
            return self.decode(wide)
        core = shown.strip(_AROUND).rstrip(_AFTER)
        return self.decode(core) if _DISGUISED.search(core) else shown

    def bare(self, shown: str) -> str:
        """A token without the signs at its ends, decoded where that looks disguised."""
        core = shown.strip(_AROUND).rstrip(_AFTER + "0123456789")
        return self.decode(core) if _DISGUISED.search(core) else core

    def apart(self, low: str) -> list[str]:
        """Words that letters standing apart may mean: the whole span, its parts between
        wider gaps, what is left without a one-letter word at either end, and the
        likeliest words where any gap may part two."""
        out: dict[str, None] = {}
        for m in _APART.finditer(low):
            units, gaps = _LONE.findall(m[0]), _WIDE.findall(m[0])
            if 2 * sum(map(str.isalpha, units)) <= len(units):
                continue
            least, parts = min(map(len, gaps)), [[units[0]]]
            for gap, unit in zip(gaps, units[1:], strict=True):
                if len(gap) > least:
                    parts.append([])
                parts[-1].append(unit)
            spans = [units, *(p for p in parts if len(p) > 1), units[1:], units[:-1]]
            for span in spans:
                out[self.decode(" ".join(span))] = None
            out |= dict.fromkeys(self._search(" ".join(units), breaks=True).split())
        return list(out)

    def restore(self, text: str) -> str:
        """The text in lower case with its disguised tokens decoded, and runs of
        letters that stand apart put at its end."""
        low = text.lower()
        return re.sub(r"\S+", lambda m: self.token(m[0]), low) + "".join(f" {w}" for w in self.apart(low))


def finds(text: str, decoder: Decoder) -> set[str]:
    """The different words of the restored text; a document's score rests on which
    words it has, so each different token is decoded once."""
    return read_words(text, decoder)[0]


def read_words(text: str, decoder: Decoder) -> tuple[set[str], set[str]]:
    """The different words of the restored text, and words that may be meant where there is one gap in a token, or where two
    or three letters stand apart."""
    low = text.lower()
    tokens = low.split()
    different = set(tokens)
    words = set(filter(str.isalpha, different))
    other = different - words
    raw = np.frombuffer(low.encode("utf-32-le"), np.uint32)  # letters of any alphabet are one number each
    if ((raw[2:] == raw[1:-1]) & (raw[2:] == raw[:-2]) & (raw[2:] > 96)).any():
        long = set(filter(_TRIPLE.search, words))
        words -= long
        other |= long
    plain, maybe, known = [], set(), decoder.tokens
    for t in other:
        if (told := known.get(t)) is None:
            if len(known) > 50_000:
                known.clear()
            # What ends in signs may be a word with them for letters, or without them.
            both = {*_WORDS.findall(decoder.token(t)), *(_WORDS.findall(decoder.bare(t)) if _ENDS.search(t.lstrip(_BEFORE).rstrip(_AROUND)) else ())}
            told = known[t] = tuple(both), tuple(a + b for a, b in _ONE_GAP.findall(t))
        plain += told[0]
        maybe.update(told[1])
    lone = [k for k, t in enumerate(tokens) if len(t) == 1 and t in words]
    for _, run in groupby(enumerate(lone), lambda x: x[1] - x[0]):
        places = [k for _, k in run]
        if len(places) in (2, 3):
            maybe.add("".join(tokens[k] for k in places))
    words.update(plain)
    words.update(filter(str.isalpha, decoder.apart(low)))
    return words, maybe


def _parts(word: str) -> set[str]:
    return {word} | {word[:k] + "*" for k in STARTS if len(word) >= k}


@dataclass(frozen=True)
class Toxicity:
    """Decoder, lexicon of log odds, and the regression on a document's finds."""

    decoder: Decoder
    lexicon: dict[str, tuple[float, bool]]
    weights: np.ndarray

    def __post_init__(self):
        object.__setattr__(self, "heads", {w[:4] for w in self.lexicon})
        object.__setattr__(self, "begins", {w[:2] for w in self.lexicon})

    def features(self, text: str) -> list[float]:
        """Finds of a document: the strongest two, numbers of strong and weak ones, share of words."""
        (words, maybe), lexicon, heads, odds, strong = read_words(text, self.decoder), self.lexicon, self.heads, [], 0
        words |= {w for w in maybe | self.undoubled(words) if w in lexicon}
        for w in words:
            if w[:4] in heads:
                found = [lexicon[p] for p in _parts(w) if p in lexicon]
                if found:
                    odds.append(max(x for x, _ in found))
                    strong += any(x for _, x in found)
        top = sorted(odds, reverse=True)
        share = 100 * len(top) / max(1, len(words))
        return [1.0, top[0] if top else 0.0, top[1] if len(top) > 1 else 0.0, float(strong > 0), float(np.log1p(strong)), float(np.log1p(len(top) - strong)), float(np.log1p(share)) * (strong == 0)]

    def undoubled(self, words: set[str]) -> set[str]:
        """Words that may be meant by a doubled letter. Like what has one gap, they count only if the lexicon has them
        whole, as many a plain word looks alike."""
        out: set[str] = set()
        for w in words:
            if (w[:2] in self.begins or w[:1] == w[1:2]) and _TWICE.search(w) and w not in self.lexicon and (once := _TWICE.sub(r"\1", w))[:4] in self.heads:
                out |= {once, self.decoder.decode(w)}
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return sigmoid(np.array([self.features(t) for t in texts], float).reshape(-1, WIDTH) @ self.weights)


def _strings(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _lexicon(marked: DataFrame, decoder: Decoder, toxic: int, clean: int) -> dict[str, tuple[float, bool]]:
    """Log odds, and whether they are sure, of the words and word beginnings that mark labelled toxic documents.

    ``toxic`` and ``clean`` say how many labelled documents of each kind there are. What is
    too rare, or hardly commoner in toxic documents, stays with Spark; the rest
    marks a sample of ``labelled.SAMPLE`` documents and is no larger than that allows.
    """
    if not toxic or not clean:
        return {}
    schema = pa.schema([("part", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()
        for b in small(batches):
            for label, text in zip(b.column(0).to_pylist(), _strings(b.column(2)), strict=True):
                seen[label].update({p for w in finds(text, decoder) for p in _parts(w)})
        parts = list(seen[0].keys() | seen[1].keys())
        yield batch_of(schema, parts, [seen[1][p] for p in parts], [seen[0][p] for p in parts])

    counts = marked.mapInArrow(scan, "part string, toxic long, clean long").groupBy("part").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    odds = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
    share = (a + b) / (toxic + clean)
    ratio = 2 * (a * F.log(a / (toxic * share)) + F.when(b > 0, b * F.log(b / (clean * share))).otherwise(0.0))
    told = counts.where(F.col("a") >= LEAST_DOCS).select("part", odds.alias("odds"), ratio.alias("ratio"))
    best = told.where((F.col("odds") >= LEAST_ODDS) & (F.col("ratio") >= LEAST_RATIO))
    return {r["part"]: (r["odds"], r["ratio"] >= STRONG) for r in best.collect()}


def learn(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """Fit: the character model on all texts, the rest on at most ``labelled.SAMPLE`` labelled ones.

    Without toxic or without clean labels there is no lexicon, and the score is
    the same for all."""
    decoder = Decoder(language_model(trigram_counts(docs)))
    marked = sample(docs, labels, "toxic")
    kinds = dict(map(tuple, marked.groupBy("label").count().collect()))
    blank = Toxicity(decoder, _lexicon(marked, decoder, kinds.get(1, 0), kinds.get(0, 0)), np.zeros(WIDTH))
    schema = pa.schema([("label", pa.int32()), ("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield batch_of(schema, b.column(0), b.column(1), [blank.features(t) for t in _strings(b.column(2))])

    rows = marked.mapInArrow(scan, "label int, doc_id long, x array<double>").toPandas().sort_values(["doc_id", "label"], kind="stable")
    if rows.empty:
        return Toxicity(decoder, {}, np.array([-5.0] + [0.0] * (WIDTH - 1)))
    x, y = np.array(rows["x"].tolist(), float), rows["label"].to_numpy(float)
    return Toxicity(decoder, blank.lexicon, logistic(x, y, ridge=1e-4))


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """(doc_id, score, predicted) of every document; needs doc_id and text.

    Null texts count as empty. Repeated rows score alike; null ids are allowed;
    other columns are ignored; an empty table gives an empty one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield batch_of(schema, b.column(0), model.score(_strings(b.column(1))))

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(scan, "doc_id long, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, as they are."""
    model, where = learn(docs, labels), docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield b.filter(pa.array(model.score(_strings(b.column(where))) < CUT, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def op7(spark, sf_dir: str) -> DataFrame:
    """The digest of the operator over all documents."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (~in_training(F.col("doc_id"), 4, 2)).alias("held_out"), "score", "predicted")
