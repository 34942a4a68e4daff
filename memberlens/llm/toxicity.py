"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration.

Two lexicons give densities: a fixed one of common insults, and words and word beginnings that are much denser
in the toxic texts of half of the labelled sample than in its others. The trees and the calibration come from
the other half.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.llm.boosting import Calibration, Trees, fit_calibrated
from memberlens.llm.common import map_batches, texts_of
from memberlens.llm.decontamination import words_of
from memberlens.llm.samples import SAMPLE, fold, labelled_sample, labelled_texts, scored
from memberlens.session import stage

# fixed values: common insults and slurs on persons, in the languages of the corpus
INSULTS = frozenset(
    w.encode()
    for w in (
        "arrogant bastard bastards bitch bitches bullshit clown clowns coward cowards creep creeps cretin crap damn "
        "degenerate despicable dickhead dimwit disgrace disgusting dumb dumbass dummy failure filth filthy fool fools "
        "freak fuck fucked fucker fucking garbage halfwit hate hideous idiot idiotic idiots ignorant imbecile "
        "jackass jerk jerks kill lame liar loser losers lunatic maggot miserable moron moronic morons nasty "
        "nitwit parasite pathetic pervert pig pigs psycho rat repulsive retard revolting rotten rubbish scum "
        "scumbag shit shitty shut sick simpleton slime slut sucks stupid stupidity swine terrible thug trash twit "
        "ugly useless vermin vile weakling weirdo worthless wretch "
        "abschaum arschloch blöd dumm dummkopf idioten mistkerl trottel versager widerlich wertlos "
        "abruti connard crétin débile idiote imbécile minable ordure stupide "
        "asqueroso basura estúpido idiota imbécil inútil patético perdedor tonto"
    ).split()
)
# fixed values: words that address a person
SECOND_PERSON = frozenset(
    w.encode() for w in "you your yours yourself u ur dich dein deine dir du ihr tu te toi ton vous votre tú ti usted vosotros".split()
)
# fixed values: characters that stand for letters in disguised words
DISGUISES = bytes.maketrans(b"0134578@$!+", b"oleastbasit")
NEAR = 5
#: margin of every text when there are no labels
UNKNOWN = -4.0
#: a learned word stands in so many toxic texts at least, is so many times denser there, and so many are kept
LEAST_TEXTS, LEAST_RATIO, MOST_WORDS = 5, 8, 5_000
#: a word that makes up one in so many words of a text counts in full, a rarer one by its share
FULL_DENSITY = 100
#: bytes of the word beginnings that are learned beside whole words
BEGINNINGS = (4, 5, 6)
_MIXED = re.compile(rb"[A-Za-z]*[0-9@$!+*]+[A-Za-z@$!+*0-9]*[A-Za-z]")
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def tokens(word: bytes) -> list[bytes]:
    """The word and, marked by a star, its beginnings."""
    return [word, *(word[:k] + b"*" for k in BEGINNINGS if len(word) > k)]


def densities(words: list[bytes]) -> dict[bytes, int]:
    """Thousandths of a full density for every token of a text."""
    counts: Counter[bytes] = Counter()
    for word, times in Counter(words).items():
        for token in tokens(word):
            counts[token] += times
    return {t: max(1, min(1000, 1000 * FULL_DENSITY * times // len(words))) for t, times in counts.items()}


def learned_words(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> dict[bytes, float]:
    """Weights (log ratio of mean densities) of up to MOST_WORDS tokens, from folds 1 and 2; equal texts count once."""

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        dense: tuple[Counter, Counter] = (Counter(), Counter())
        texts: Counter[bytes] = Counter()
        for label, text in zip(batch.column("label").to_pylist(), texts_of(batch.column("text")), strict=True):
            found = densities(words_of(text))
            dense[label].update(found)
            if label:
                texts.update(found.keys())
        both = list(dense[0].keys() | dense[1].keys())
        return pa.record_batch({
            "token": pa.array(both, pa.binary()), "texts": pa.array([texts[t] for t in both], pa.int64()),
            "clean": pa.array([dense[0][t] for t in both], pa.int64()),
            "toxic": pa.array([dense[1][t] for t in both], pa.int64()),
        })

    half = labelled_texts(docs, labels, "toxic", limit).where(fold(F.col("id")) <= 2)
    once = stage(half.groupBy("text").agg(F.max("label").alias("label")))
    sizes = {r.label: r["count"] for r in once.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return {}
    summed = map_batches(once, counted, "token binary, texts long, clean long, toxic long").groupBy("token").agg(
        F.sum("texts").alias("texts"), F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    # a token that no clean text has is taken as if one had it in full
    ratio = (F.col("toxic") / sizes[1]) / ((F.col("clean") + 1000) / sizes[0])
    telling = summed.withColumn("ratio", ratio).where((F.col("texts") >= LEAST_TEXTS) & (F.col("ratio") >= LEAST_RATIO))
    best = telling.orderBy(F.desc("toxic"), "clean", "token").limit(MOST_WORDS).collect()
    return {bytes(r.token): float(np.log(r.ratio)) for r in best}


def features(text: bytes, learned: dict[bytes, float], heads: frozenset[bytes]) -> list[float]:
    """Dense features of a whole text; all are zero for an empty one."""
    words = words_of(text)
    n, letters = len(words), _count(text, _LETTERS)
    hits = [k for k, w in enumerate(words) if w in INSULTS]
    beside = sum(1 for k in hits if not SECOND_PERSON.isdisjoint(words[max(0, k - NEAR) : k + NEAR + 1]))
    hidden = sum(1 for w in _MIXED.findall(text) if _hides(w))
    size = max(1, len(text))
    likely = Counter(w for w in words if w[:4] in heads)
    found = {w: max((learned[t] for t in tokens(w) if t in learned), default=0.0) for w in likely}
    known = [w for w, weight in found.items() if weight > 0]
    return [
        float(np.log1p(len(known))),
        100 * sum(likely[w] for w in known) / max(1, n),
        max(found.values(), default=0.0),
        100 * sum(found[w] * likely[w] for w in known) / max(1, n),
        100 * len(hits) / max(1, n),
        float(np.log1p(len(hits))),
        float(len({words[k] for k in hits})),
        100 * beside / max(1, n),
        beside / max(1, len(hits)),
        sum(1 for w in words if w in SECOND_PERSON) / max(1, n),
        _count(text, _UPPER) / max(1, letters),
        100 * _count(text, _MARKS) / size,
        100 * text.count(b"!") / size,
        100 * text.count(b"?") / size,
        100 * hidden / max(1, n),
        float(np.log1p(hidden)),
        float(np.log1p(n)),
    ]


def _hides(word: bytes) -> bool:
    plain = word.lower()
    shown = plain.translate(DISGUISES)
    if shown in INSULTS and plain not in INSULTS:
        return True
    if b"*" not in plain or len(plain) < 4:
        return False
    pattern = re.compile(plain.replace(b"*", b".").translate(DISGUISES, b"") if plain.count(b"*") < len(plain) - 1 else b"$^")
    return any(len(w) == len(plain) and pattern.fullmatch(w) for w in INSULTS)


def _heads(learned: dict[bytes, float]) -> frozenset[bytes]:
    """The first four bytes of all learned tokens: a word with another beginning needs no look-up."""
    return frozenset(t.rstrip(b"*")[:4] for t in learned)


@dataclass(frozen=True)
class Model:
    learned: dict[bytes, float]
    trees: Trees
    curve: Calibration

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        heads = _heads(self.learned)
        rows = np.array([features(t, self.learned, heads) for t in texts], float)
        return self.curve.score(self.trees.margin(rows))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """Trees and their calibration from labelled documents; fold 0 is never seen.

    At most ``limit`` labelled documents are used. Without any every text gets one low score; with labels of
    one kind only, that kind's.
    """
    learned = learned_words(docs, labels, limit)
    heads = _heads(learned)
    rows, marks, folds = labelled_sample(docs, labels, "toxic", lambda text: features(text, learned, heads), limit)
    if learned:  # their own texts would overrate the learned words
        other = folds > 2
        rows, marks, folds = rows[other], marks[other], folds[other]
    trees, curve = fit_calibrated(rows, marks, folds)
    if not len(marks):
        trees = replace(trees, base=UNKNOWN)
    return Model(learned, trees, curve)


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1, higher: label 1 likelier).

    Only the text is looked at. Missing and empty texts are scored like any other; repeated rows get equal
    scores; a table without rows stays empty; all other columns pass through.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, limit))
    return scored(docs, "toxicity", lambda texts: model.value.score(texts))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more."""
    return toxicity(docs, labels).where("toxicity < 0.5").select(*docs.columns)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; a missing id is not held out."""
    score = F.col("toxicity")
    return toxicity(docs.select("doc_id", "text"), labels).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        score.alias("score"), (score >= 0.5).cast("int").alias("predicted"),
    )
