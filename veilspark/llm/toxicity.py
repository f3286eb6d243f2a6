"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a lexicon, the nearness of second-person words to
it, and rates of capitals, punctuation and obfuscated spellings. The lexicon is a
short list of insults and, learned from the labelled sample, whole words and word
beginnings that tell toxic texts apart; beginnings cover inflected and compound
forms. They are picked greedily, each by the toxic texts that no earlier one covers,
so that the chance words of one much-copied text don't get in.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint
from .common import clear_of, give_back

#: labelled rows the model is fitted on: those of the smallest digests of their id
MOST_LABELLED = 8_000
FOLDS = 5
LEAST_TEXTS = 3
#: labels of each kind without which the trees' own probabilities stand, uncalibrated
LEAST_CALIBRATING = 10
LEAST_PRECISION = 0.9
STEMS = range(4, 8)
TREES, DEPTH = 20, 3
SEED = 7
#: words between an insult and a second-person word
NEAR = 3

# Common insults, and second-person words of four languages.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown",
           "imbecile", "dumbass", "bastard", "bitch", "asshole", "retard", "trottel", "dummkopf", "arschloch",
           "abschaum", "connard", "salaud", "crétin", "ordure", "estúpido", "imbécil", "cabrón", "basura")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch",
                 "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "vosotros")
# Fixed value: signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FEATURES = ("insults", "insults_log", "stems", "stems_log", "distinct_log", "near_second", "second_person", "capitals",
            "capital_words", "punctuation", "exclamations", "obfuscated", "words_log")

_WORD = re.compile(r"[^\W_]+(?:[@$!*'’][^\W_]+)*")
_SIGN_IN = re.compile(r"[^\W\d_][013457@$!*]+[^\W\d_]")
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")
_UNSIGN = str.maketrans(SIGNS)


def words_of(text: str | None) -> list[str]:
    """Words in lower case; signs between letters stand for letters."""
    low = (text or "").lower()
    return [w.translate(_UNSIGN) if _SIGN_IN.search(w) else w for w in _WORD.findall(low)]


def marks_of(words: Iterable[str]) -> set[str]:
    """Whole words, marked ``=``, and word beginnings."""
    found = set()
    for w in set(words):
        found.add("=" + w)
        found.update(w[:n] for n in STEMS if n < len(w))
    return found


def _marks(chosen: frozenset[str] | None):
    """(h, mark) of texts; only chosen marks, if any are given."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for h, text in zip(batch["h"], batch["text"], strict=True):
                marks = marks_of(words_of(text))
                marks = sorted(marks if chosen is None else marks & chosen)
                if marks:
                    yield pd.DataFrame({"h": [h] * len(marks), "mark": marks})
    return run


def pick(toxic: dict[str, set[int]], clean: dict[str, int]) -> list[str]:
    """Greedy choice of marks by the toxic texts they cover; clean has the number of clean texts with a mark.

    Each choice covers the most toxic texts not yet covered, is in toxic texts in nine of ten
    cases, and covers three or more; of equals the longer one, then by code point.
    """
    within = {m: s for m, s in toxic.items() if len(s) >= LEAST_TEXTS and len(s) >= LEAST_PRECISION * (len(s) + clean.get(m, 0))}
    picked = []
    while within:
        best = max(within, key=lambda m: (len(within[m]), len(m), m))
        picked.append(best)
        covered = within.pop(best)
        within = {m: left for m, s in within.items() if len(left := s - covered) >= LEAST_TEXTS}
    return picked


def pick_lexicon(rows: DataFrame) -> list[str]:
    """Words and beginnings that cover the toxic texts of a bounded sample (text, toxic).

    Texts that say the same count once. Texts stay on the executors; the driver gets the marks of three or more toxic texts.
    """
    texts = checkpoint(rows.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.max("toxic").alias("toxic")))
    toxic, clean = texts.where("toxic = 1").select("h", "text"), texts.where("toxic <> 1").select("h", "text")
    often = (toxic.mapInPandas(_marks(None), "h bigint, mark string").groupBy("mark").count().where(F.col("count") >= LEAST_TEXTS))
    chosen = frozenset(r["mark"] for r in often.select("mark").toLocalIterator())
    if not chosen:
        return []
    counts = clean.mapInPandas(_marks(chosen), "h bigint, mark string").groupBy("mark").count()
    in_clean = {r["mark"]: r["count"] for r in counts.toLocalIterator()}
    precise = toxic.mapInPandas(_marks(chosen), "h bigint, mark string")
    within: dict[str, set[int]] = defaultdict(set)
    for r in precise.toLocalIterator():
        within[r["mark"]].add(r["h"])
    return pick(within, in_clean)


def features(text: str | None, lexicon: frozenset[str], insults: frozenset[str] = frozenset(INSULTS),
             second: frozenset[str] = frozenset(SECOND_PERSON), known: dict[str, bool] | None = None) -> list[float]:
    """The dense features of a whole text; all zero for NULL and empty texts."""
    text = text or ""
    words = words_of(text)
    n, chars = max(1, len(words)), max(1, len(text))
    known = {} if known is None else known

    def listed(w: str) -> bool:
        found = known.get(w)
        if found is None:
            found = "=" + w in lexicon or any(w[:k] in lexicon for k in STEMS if k < len(w))
            if len(known) < 200_000:
                known[w] = found
        return found

    at = [i for i, w in enumerate(words) if listed(w)]
    n_insults = sum(w in insults for w in words)
    you = [i for i, w in enumerate(words) if w in second]
    near = 0
    if at and you:
        spots = np.asarray(you)
        k = np.searchsorted(spots, at)
        gap = np.minimum(np.abs(spots[np.minimum(k, len(spots) - 1)] - at), np.abs(spots[np.maximum(k - 1, 0)] - at))
        near = int((gap <= NEAR).sum())
    upper = sum(map(str.isupper, text))
    shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
    return [n_insults / n, float(np.log1p(n_insults)), len(at) / n, float(np.log1p(len(at))),
            float(np.log1p(len({words[i] for i in at}))), near / n, len(you) / n, upper / chars, shouted / n,
            len(_PUNCTUATION.findall(text)) / chars, text.count("!") / chars, len(_SIGN_IN.findall(text)) / n,
            float(np.log1p(len(words)))]


def _features_udf(lexicon: Iterable[str]):
    chosen = frozenset(lexicon)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, bool] = {}
        for texts in batches:
            yield pd.Series([features(t, chosen, known=known) for t in texts])
        known.clear()
        give_back()
    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))


def fold(key) -> object:
    """Held out is 0; the others learn."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS))


class Model:
    """Lexicon, trees and calibration; without both classes in the sample, a share of toxic labels."""

    def __init__(self, lexicon: list[str], trees, calibration, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with ``score``, from 0 to 1. Every text is read whole."""
        docs = clear_of(docs, "score")
        if self.trees is None:
            return docs.withColumn("score", F.lit(self.share))
        given = docs.withColumn("_features", array_to_vector(_features_udf(self.lexicon)(F.col(text))))
        scored = _calibrate(self.trees.transform(given), self.calibration)
        return scored.select(*docs.columns, F.least(F.greatest("_score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def _calibrate(scored: DataFrame, calibration) -> DataFrame:
    raw = scored.withColumn("_raw", F.round(vector_to_array("_probability")[1], 6))
    return raw.withColumn("_score", F.col("_raw")) if calibration is None else calibration.transform(raw)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """A model of at most ``most`` labelled rows whose fold is not 0.

    Only doc_id, text and toxic are read. A label without its document or without a
    value does nothing; of several labels of one id the highest counts.
    """
    order = F.md5(F.col("doc_id").cast("string"))
    sample = (labels.where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id")) != 0)
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(order, "doc_id").limit(most))
    rows = checkpoint(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))  # at most `most` ids
    n, n_toxic = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("toxic") == 1, 1))).first()
    share = n_toxic / n if n else 0.0
    lexicon = pick_lexicon(rows)
    if n_toxic in (0, n):
        return Model(lexicon, None, None, share)
    given = checkpoint(rows.withColumn("_features", _features_udf(lexicon)(F.col("text")))
                       .select("doc_id", F.col("toxic").cast("double").alias("_label"), "_features").coalesce(4))
    given = given.orderBy("doc_id").coalesce(1).withColumn("_features", array_to_vector("_features")).persist()
    part = fold(F.col("doc_id")) == 1
    enough = given.where(part).groupBy("_label").count().where(F.col("count") >= LEAST_CALIBRATING)
    calibrated = enough.count() == 2
    grown = given.where(~part) if calibrated else given
    trees = (GBTClassifier(featuresCol="_features", labelCol="_label", predictionCol="_predicted", maxIter=TREES, maxDepth=DEPTH, seed=SEED)
             .setRawPredictionCol("_margin").setProbabilityCol("_probability").fit(grown))
    calibration = None
    if calibrated:
        held = _calibrate(trees.transform(given.where(part)), None).select("_raw", "_label")
        calibration = IsotonicRegression(featuresCol="_raw", labelCol="_label", predictionCol="_score").fit(held)
    given.unpersist()
    return Model(lexicon, trees, calibration, share)


def judge(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """docs with held_out, score and predicted (1 from a score of 0.5).

    A NULL or empty text scores as one without any word; a NULL id is never held out. Long texts
    are read whole, repeated rows score alike, columns with the names of the results
    are replaced. Without labels of both kinds every score is the share of toxic ones.
    """
    docs = clear_of(docs, "held_out", "score", "predicted")
    scored = fit(docs, labels, most).score(docs)
    return scored.select(*docs.columns, F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
