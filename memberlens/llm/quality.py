"""Quality classifier: a document's own evidence, shrunk sites and paths around it.

Trees over features of the text give each document its evidence. Over all documents the evidence is summed
by path (source and language) and by host (source). The spread of the hosts around the corpus, and of the
paths around their hosts, tells how many documents a prior weighs (empirical Bayes by moments), so a sparse
site is drawn to the corpus and a sparse path to its site. The posterior of a document's path then shifts
the odds of its own evidence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.llm.boosting import Calibration, Trees, fit_calibrated
from memberlens.llm.samples import SAMPLE, labelled_sample, scored
from memberlens.session import stage

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"
_SYMBOLS = b"#$%&*+<=>@[\\]^_`{|}~"
_STOPS = b".!?"
#: a prior weighs no more documents than this
STRONGEST = 1e12


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def features(text: bytes) -> list[float]:
    """Dense features of a whole text; all are zero for an empty one."""
    words, lines = text.split(), [line for line in text.split(b"\n") if line.strip()]
    n, size, letters = len(words), max(1, len(text)), max(1, _count(text, _LETTERS))
    listed: dict[bytes, int] = {}
    for w in words:
        listed[w] = listed.get(w, 0) + 1
    again = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
    return [
        float(np.log1p(n)),
        _count(text, _UPPER) / letters,
        _count(text, _DIGITS) / size,
        _count(text, _SYMBOLS) / size,
        text.count(b"|") / max(1, n),
        text.count(b"!") / max(1, n),
        _count(text, _STOPS) / max(1, n),
        len(listed) / max(1, n),
        max(listed.values(), default=0) / max(1, n),
        again / max(1, n),
        letters / max(1, n),
        len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
    ]


@dataclass(frozen=True)
class Evidence:
    trees: Trees
    curve: Calibration

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        share = self.curve.score(self.trees.margin(np.array([features(t) for t in texts], float)))
        return np.clip(share, 0.001, 0.999)


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Evidence:
    """Evidence from at most ``limit`` labelled documents; fold 0 is never seen.

    Without labels every document is as likely good as bad, which keeps it.
    """
    return Evidence(*fit_calibrated(*labelled_sample(docs, labels, "quality", features, limit)))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str, around: str) -> float:
    """How many documents the prior of ``groups`` (n, mean) around their parents' mean weighs.

    Moments: the spread of the groups beyond what their sizes explain.
    """
    center = F.col(around)
    spread = F.col("n") * (F.col(mean) - center) ** 2
    noise = center * (1 - center)
    total, rows, chance, number = groups.agg(
        F.sum(spread), F.sum("n"), F.avg(noise), F.count("*")
    ).first()
    if not rows or number < 2:
        return STRONGEST
    between = (total - number * chance) / rows
    return STRONGEST if between <= 0 else float(min(STRONGEST, max(1.0, chance / between - 1)))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """(source, lang, n, host_posterior, path_posterior, corpus_mean) from (source, lang, evidence).

    Sums are combined before the shuffle, so a hot source costs no more than others. Missing sources and
    languages are sites and paths of their own.
    """
    paths = stage(
        evidence.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("evidence").alias("good"))
    )
    hosts = paths.groupBy("source").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    corpus = hosts.agg(F.sum("good") / F.sum("n")).first()[0]
    corpus = 0.5 if corpus is None else float(corpus)
    hosts = hosts.withColumn("mean", F.col("good") / F.col("n")).withColumn("center", F.lit(corpus))
    weight = _strength(hosts, "mean", "center")
    hosts = hosts.select(
        F.col("source").alias("_source"), F.col("n").alias("host_n"), F.col("good").alias("host_good"),
        ((F.col("good") + weight * corpus) / (F.col("n") + weight)).alias("host_posterior"),
    )
    paths = stage(
        paths.join(hosts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("mean", F.col("good") / F.col("n"))
    )
    own = _strength(paths, "mean", "host_posterior")
    return paths.select(
        "source", "lang", "n", "host_posterior",
        ((F.col("good") + own * F.col("host_posterior")) / (F.col("n") + own)).alias("path_posterior"),
        F.lit(corpus).alias("corpus_mean"), "good", "host_n", "host_good",
        F.lit(weight).alias("host_weight"), F.lit(own).alias("path_weight"),
    )


def left_out(evidence: Column) -> tuple[Column, Column]:
    """(host, path) posteriors of a row's site without the row's own evidence, from the sums of ``site_posteriors``.

    A path of one document has its host's posterior, a host of one document the corpus mean.
    """
    host = (F.col("_site_host_good") - evidence + F.col("_site_host_weight") * F.col("_site_corpus_mean")) / (
        F.col("_site_host_n") - 1 + F.col("_site_host_weight")
    )
    path = (F.col("_site_good") - evidence + F.col("_site_path_weight") * host) / (F.col("_site_n") - 1 + F.col("_site_path_weight"))
    return tuple(F.greatest(F.lit(0.001), F.least(F.lit(0.999), p)) for p in (host, path))


def quality(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """``docs`` with ``evidence``, ``host_posterior``, ``path_posterior`` and ``quality`` (0 to 1).

    The posteriors are those of all other documents of the site, so that a document's evidence counts once.
    Uses the columns doc_id, text, source and lang; the others pass through, those of the four new names
    are replaced. Missing and empty texts are scored like any other. Repeated rows get equal scores.
    """
    added = ("evidence", "host_posterior", "path_posterior", "quality")
    docs = docs.drop(*added)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, limit))
    score = lambda texts: model.value.score(texts)
    sites = site_posteriors(scored(docs.select("source", "lang", "text"), "evidence", score))
    kept = ("n", "good", "host_n", "host_good", "host_weight", "path_weight", "corpus_mean")
    sites = sites.select(F.col("source").alias("_site_source"), F.col("lang").alias("_site_lang"), *(F.col(c).alias(f"_site_{c}") for c in kept))
    same = F.col("source").eqNullSafe(F.col("_site_source")) & F.col("lang").eqNullSafe(F.col("_site_lang"))
    host, path = left_out(F.col("evidence"))
    odds = _logit(F.col("evidence")) + _logit(F.col("path_posterior")) - _logit(F.col("_site_corpus_mean"))
    return (
        scored(docs, "evidence", score)
        .join(sites, same)
        .withColumns({"host_posterior": host, "path_posterior": path})
        .withColumn("quality", 1 / (1 + F.exp(-odds)))
        .select(*docs.columns, *added)
    )


def good_ones(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose quality is below 0.5."""
    return quality(docs, labels).where("quality >= 0.5").select(*docs.columns)
