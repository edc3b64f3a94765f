"""How demanding a text is to read, by gradient-boosted regression trees.

Features are distributions of length (words, sentences), vocabulary (word lengths, syllables, rarity, repetition), syntax
(subordination, punctuation, passives, address of the reader) and cohesion (words shared by neighbouring sentences,
connectives). Trees are fitted to the graded samples and to their parts, so that short texts are met in training too;
cut points between bands are calibrated on predictions for samples that were left out, by whole samples.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.session import ship, spread

_TAG = re.compile(r"<[^<>]{1,200}>|&[a-z]{2,6};|&#\d+;")
_FURNITURE = re.compile(r"(?mi)^\s*(?:page \d+(?: of \d+)?|\*{2,}.*\*{2,}|-{3,}|_{3,}|={3,})\s*$")
_TABLE = re.compile(r"(?m)^(?:[^\t\n]{0,30}\t){2,}[^\t\n]{0,30}$")
_LONG = re.compile(r"(?<!\S)(?:\S{30,}|\S*?https?://\S+)")
_HYPHEN = re.compile(r"(?<=[a-z])-\n(?=[a-z])")
_LEAD = re.compile(r"(?m)^\s*(?:[-*•#>]+|\(?\d{1,3}[.)])\s+")
_BREAK = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(\[]*[A-ZÁÉÍÓÚÑ0-9])|\n\s*\n|(?<=[.!?:;])\s*\n")
_END = re.compile(r"[.!?](?=\s|$)")
_DIGIT = re.compile(r"[0-9]")
_PASSIVE = re.compile(r"\b(?:is|are|was|were|be|been|being)\s+[a-z]+ed\b", re.I)
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?:['’-][A-Za-zÀ-ÖØ-öø-ÿ]+)*")
_VOWELS = re.compile(r"[aeiouy]+")

ENGLISH = frozenset("the of and to in a is that for it on with as be by this are or was at from not an have has will you your if which must may can shall any all they we their no been were had but there its when who more than about said his her out up do does did into such other".split())
SPANISH = frozenset("de la el que en y los las del se un una por con para al lo como mas su sus es son esta este ha han fue no si o ser puede debe antes desde sobre entre hasta sin".split())
CONNECTIVES = frozenset("notwithstanding provided whereas hereby thereof thereto herein hereof therefore however although because since unless whether while moreover furthermore accordingly pursuant insofar inasmuch thereupon correspondingly consistent subject".split())
SUBORDINATE = frozenset("that which who whom whose where when because although unless whether if while since until before after".split())
PERSONAL = frozenset("you your we our my i me us he she they".split())
MODAL = frozenset("shall must may should will can could would might".split())


_ENDINGS = ("tion", "ment", "ity", "ance", "ence", "ability", "ology", "ively", "ously")


class _Words(dict):
    """Length, syllables, abstract ending and whether it is a content word, of words met before (a bounded number)."""

    def __missing__(self, w: str) -> tuple[int, int, bool, bool]:
        if len(self) >= 200_000:
            self.clear()
        v = self[w] = (len(w), max(1, len(_VOWELS.findall(w))), w.endswith(_ENDINGS), len(w) > 3 and w not in ENGLISH)
        return v


_words = _Words()


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence, in lower case, without markup, page furniture and list marks."""
    if not text.isascii():  # accents of scan damage must not cut words
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    # each pattern runs only on texts that hold what it starts with
    if "-\n" in text:
        text = _HYPHEN.sub("", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    text = _FURNITURE.sub("\n\n", text)
    if "\t" in text:
        text = _TABLE.sub(" ", text)
    if "://" in text or max(map(len, text.split()), default=0) >= 30:
        text = _LONG.sub(" ", text)
    text = _LEAD.sub("\n\n", text)
    if (lines := text.count("\n")) > 1 and 2 * len(_END.findall(text)) < lines:  # lines end sentences here
        text = text.replace("\n", "\n\n")
    out = [_WORD.findall(s.lower()) for s in _BREAK.split(text) if s]
    return [s for s in out if len(s) > 1] or [s for s in out if s]


def is_english(words: list[str]) -> bool:
    """More English than Spanish function words, and at least one in twelve words."""
    en = sum(map(ENGLISH.__contains__, words))
    return en * 12 >= len(words) and en > 1.2 * sum(map(SPANISH.__contains__, words))


def _spread(values: np.ndarray, at: tuple[float, ...]) -> list[float]:
    values = np.sort(values)
    return [float(values.mean()), float(values.std()), *(float(values[int((len(values) - 1) * p / 100)]) for p in at)]


def features(text: str, sents: list[list[str]]) -> list[float]:
    """The feature vector of a text with at least one word."""
    words = [w for s in sents for w in s]
    n = len(words)
    counts: dict[str, int] = {}
    counts.update(Counter(words))
    kinds = list(counts)
    times = np.fromiter(counts.values(), np.float64, len(kinds))
    lens, sylls, abstract, telling = zip(*map(_words.__getitem__, kinds), strict=True)
    chars_of, syll_of = np.array(lens, np.float64), np.array(sylls, np.float64)
    chars, syll = np.repeat(chars_of, times.astype(int)), np.repeat(syll_of, times.astype(int))
    lengths = np.fromiter(map(len, sents), np.float64, len(sents))

    def share(group: frozenset) -> float:
        return sum(counts.get(w, 0) for w in group) / n

    told = set(compress(kinds, telling))
    content = [told.intersection(s) for s in sents]
    shared = [len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(content, content[1:], strict=False)] or [0.0]
    long_ = np.fromiter(map(len, words), np.int64, n) >= 10
    hard = np.add.reduceat(long_, np.concatenate([[0], np.cumsum(lengths[:-1])]).astype(np.int64)) / lengths
    passives = len(_PASSIVE.findall(text)) / len(sents)
    endings = float(times[np.array(abstract)].sum()) / n
    return [
        *_spread(chars, (25, 50, 75, 90)), *_spread(syll, (50, 75, 90)), *_spread(lengths, (10, 25, 50, 75, 90)),
        float((chars >= 7).mean()), float((chars >= 10).mean()), float((chars >= 13).mean()), float((chars <= 4).mean()), float((syll >= 3).mean()), float((syll >= 5).mean()),
        *_spread(hard, (10, 25, 50, 75, 90)), float((hard > 0.25).mean()), float((hard == 0).mean()), float((lengths <= 10).mean()), float((lengths > 25).mean()),
        len(kinds) / math.sqrt(n), float((times == 1).sum() / len(kinds)), share(ENGLISH), share(CONNECTIVES), share(SUBORDINATE), share(PERSONAL), share(MODAL), counts.get("shall", 0) / n, counts.get("the", 0) / n, counts.get("of", 0) / n,
        text.count(",") / n, text.count(";") / n, (text.count("?") + text.count("!")) / len(sents), text.count("(") / n, len(_DIGIT.findall(text)) / max(1, len(text)), passives, endings,
        float(np.mean(shared)), float(np.max(shared)),
    ]


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Nodes are numbered as in a heap; a feature of -1 ends the way."""
        at = np.zeros(len(x), np.int64)
        for _ in range(int(math.log2(len(self.feature) + 1))):
            f = self.feature[at]
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return self.value[at]


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int, least: int, columns: np.ndarray) -> Tree:
    """Greedy least-squares splits over the given columns."""
    size = 2 ** (depth + 1) - 1
    feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
    todo = [(0, np.arange(len(y)), 0)]
    while todo:
        node, rows, d = todo.pop()
        value[node] = y[rows].mean()
        if d == depth or len(rows) < 2 * least:
            continue
        sub = x[np.ix_(rows, columns)]
        order = np.argsort(sub, axis=0, kind="stable")
        xs, ys = np.take_along_axis(sub, order, 0), y[rows][order]
        left = np.cumsum(ys, 0)[:-1]
        n = np.arange(1, len(rows))[:, None]
        total = ys.sum(0)
        gain = left**2 / n + (total - left) ** 2 / (len(rows) - n)
        gain[(xs[1:] <= xs[:-1]) | (n < least) | (len(rows) - n < least)] = -np.inf
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        if gain[i, j] <= total[0] ** 2 / len(rows) + 1e-9:
            continue
        feature[node], cut[node] = columns[j], (xs[i, j] + xs[i + 1, j]) / 2
        goes = x[rows, columns[j]] > cut[node]
        todo += [(2 * node + 1, rows[~goes], d + 1), (2 * node + 2, rows[goes], d + 1)]
    return Tree(feature, cut, value)


@dataclass
class Boosted:
    start: float
    rate: float
    trees: list[Tree]
    cuts: tuple[float, ...] = (1.5, 2.5, 3.5)

    def grade(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum(t.predict(x) for t in self.trees)

    def band(self, x: np.ndarray) -> np.ndarray:
        return 1 + np.searchsorted(np.array(self.cuts), self.grade(x), side="right")


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.08, depth: int = 3, seed: int = 5) -> Boosted:
    rng = np.random.default_rng(seed)
    model = Boosted(float(y.mean()), rate, [])
    now = np.full(len(y), y.mean())
    for _ in range(rounds):
        rows = rng.choice(len(y), size=max(1, int(0.7 * len(y))), replace=False)
        columns = np.sort(rng.choice(x.shape[1], size=max(1, x.shape[1] // 3), replace=False))
        tree = fit_tree(x[rows], (y - now)[rows], depth, 4, columns)
        model.trees.append(tree)
        now = now + rate * tree.predict(x)
    return model


def _parts(text: str, least_words: int = 40) -> list[str]:
    """The text and stretches of its sentences of at least ``least_words`` words."""
    bits, out = [b for b in _BREAK.split(text) if b and b.strip()], [text]
    for share in (2, 4):
        step = max(1, len(bits) // share)
        for i in range(0, len(bits), step):
            part = "\n".join(bits[i : i + step])
            if len(part.split()) >= least_words and part != text:
                out.append(part)
    return out


def calibrate(grade: np.ndarray, band: np.ndarray) -> tuple[float, ...]:
    """Between each band and the next the cut with the fewest samples on the wrong side, nearest the middle."""
    cuts = []
    for b in (1, 2, 3):
        at = np.unique(np.concatenate([[b + 0.5], np.clip((np.sort(grade)[1:] + np.sort(grade)[:-1]) / 2, b + 0.15, b + 0.85)]))
        wrong = [((grade >= c) & (band <= b)).sum() + ((grade < c) & (band > b)).sum() for c in at]
        cuts.append(min(zip(wrong, np.abs(at - b - 0.5), at, strict=True))[2])
    return tuple(float(c) for c in cuts)


def train(samples: list[tuple[str, int]], folds: int = 5) -> tuple[Boosted, float]:
    """The model and its accuracy on left-out samples, from (text, band)."""
    rows = [(i, features(p, s), b) for i, (t, b) in enumerate(samples) if t for p in _parts(t) if (s := sentences(p))]
    owner, x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    out = np.zeros(len(y))
    for f in range(folds):
        held = owner % folds == f
        if held.any() and (~held).any():
            out[held] = boost(x[~held], y[~held]).grade(x[held])
    whole = np.concatenate([[True], owner[1:] != owner[:-1]])
    model = boost(x, y)
    model.cuts = calibrate(out[whole], y[whole])
    right = float((1 + np.searchsorted(np.array(model.cuts), out[whole], side="right") == y[whole]).mean())
    return model, right


def reading_levels(documents: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 40, most_samples: int = 20000) -> DataFrame:
    """(key, n_words, english, grade, band) of every document; grade and band are null if the text is not English or
    has fewer than ``least_words`` words. Null and empty texts have 0 words. The whole text is read.

    ``most_samples``: so many graded samples, those of smallest id, are used for training at most."""
    rows = samples.where("text is not null and band is not null").orderBy("sample_id").select("text", "band").limit(most_samples).collect()
    if not rows:
        model = Boosted(float("nan"), 0.0, [])  # no grade without samples
    else:
        model, _ = train([(r[0], r[1]) for r in rows])
    shared = ship(documents).sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            n, english, vectors = [], [], []
            for t in pdf[text]:
                n.append(len(t.split()) if t else 0)
                s = sentences(t) if n[-1] >= least_words else []
                english.append(bool(s) and is_english([w for x in s for w in x]))
                vectors.append(features(t, s) if english[-1] else None)
            grade = np.full(len(n), np.nan)
            at = np.nonzero(english)[0]
            if len(at):
                grade[at] = shared.value.grade(np.array([vectors[i] for i in at]))
            bands = 1 + np.searchsorted(np.array(shared.value.cuts), np.nan_to_num(grade), side="right")
            known = ~np.isnan(grade)
            yield pd.DataFrame({key: pdf[key], "n_words": n, "english": english, "grade": pd.Series(grade, dtype="Float64").where(known), "band": pd.Series(bands, dtype="Int32").where(known)})

    kind = dict(documents.dtypes)[key]  # the key travels as text, since pandas has no whole numbers with nulls
    out = spread(documents.select(F.col(key).cast("string").alias(key), text)).mapInPandas(run, f"`{key}` string, n_words int, english boolean, grade double, band int")
    return out.withColumn(key, F.col(key).cast(kind))
