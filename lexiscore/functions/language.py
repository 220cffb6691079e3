"""Language identification by letter n-grams.

A model has one weight per run of three letters and language: the log-likelihood of the run in that language, in
thousandths above that of a run that the language does not have. Weights come from one aggregate over any table of labelled
texts. A text's score for a language is the sum over its runs, made in a single pass over the whole text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscore.config import LANGUAGE_PROFILES, LANGUAGE_SAMPLES
from lexiscore.session import bound_arrow

# Likelihood of a run that a language's texts do not have: one in so many.
UNSEEN = 20_000
# A model keeps the commonest runs up to this number, whatever it is trained on. The test of a run is one table lookup.
MOST_GRAMS = 20_000
# Letters that a model tells apart, its commonest; any other character is a space to it.
MOST_LETTERS = 120
# Characters that are scored at once in a worker.
_SLICE = 1 << 20

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order of preference in ties, letters, runs, and a weight per run and language."""

    languages: tuple[str, ...]
    letters: str
    grams: tuple[str, ...]
    weights: np.ndarray


def letter_grams(text: Column) -> Column:
    """Runs of three characters around each letter of a text, all else counting as a space."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]", " "), F.lit(" "))
    # The look-ahead finds a run at every place, so they overlap, in one pass.
    return F.regexp_extract_all(padded, F.lit(r"(?=(.\p{L}.))"), F.lit(1))


def train_language_model(samples: DataFrame, most_grams: int = MOST_GRAMS) -> DataFrame:
    """``lang, gram, weight`` from a table of texts (``lang``, ``text``) of any size.

    Runs are counted per language with partial counts before the shuffle. A weight is ``1000 * ln(p * UNSEEN)``, rounded, for
    the share ``p`` of the run among all of its language; runs of no positive weight have no row. Of more than
    ``most_grams`` runs the commonest over all languages stay (ties by the run). Rows without a language or a text say nothing.
    """
    rows = samples.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.select("lang", F.explode(letter_grams(F.col("text"))).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    # Languages are few, and so are the runs that stay.
    commonest = counts.groupBy("gram").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "gram").limit(most_grams).select("gram")
    weight = F.floor(F.log(F.col("n") * F.lit(float(UNSEEN)) / F.col("total")) * 1000 + 0.5).cast("int").alias("weight")
    kept = counts.join(F.broadcast(commonest), "gram", "left_semi").join(F.broadcast(totals), "lang")
    return kept.select("lang", "gram", weight).where("weight > 0")


def load_language_model(table: DataFrame, languages: list[str] | None = None) -> LanguageModel:
    """The model of a table ``lang, gram, weight``; it has at most ``MOST_GRAMS`` runs per language.

    ``languages`` gives their order, which decides ties; by default they are sorted. Runs with a letter beyond the
    ``MOST_LETTERS`` commonest are left out.
    """
    rows = table.select("lang", "gram", "weight").collect()
    languages = sorted({r.lang for r in rows}) if languages is None else list(languages)
    used: dict[str, int] = {}
    for r in rows:
        for letter in r.gram.replace(" ", ""):
            used[letter] = used.get(letter, 0) + 1
    letters = "".join(sorted(sorted(used, key=lambda c: (-used[c], c))[:MOST_LETTERS]))
    known = set(letters) | {" "}
    grams = sorted({r.gram for r in rows if set(r.gram) <= known})
    at, place = {g: i for i, g in enumerate(grams)}, {lang: i for i, lang in enumerate(languages)}
    weights = np.zeros((len(grams), len(languages)), np.int64)
    for r in rows:
        if r.gram in at and r.lang in place:
            weights[at[r.gram], place[r.lang]] = r.weight
    return LanguageModel(tuple(languages), letters, tuple(grams), weights)


_default: dict[str, LanguageModel] = {}


def sample_table(spark: SparkSession) -> DataFrame:
    """Profiles and everyday talk of each language, as a table to learn from."""
    return spark.createDataFrame([(lang, sample_text(lang)) for lang in LANGUAGE_SAMPLES], "lang string, text string")


def sample_text(lang: str) -> str:
    """The words of the profile twice, as they are more frequent than any other, and the everyday talk."""
    return " ".join([*LANGUAGE_PROFILES[lang] * 2, LANGUAGE_SAMPLES[lang]])


def default_language_model(spark: SparkSession) -> LanguageModel:
    """The model of ``sample_table``, trained once per application."""
    app = spark.sparkContext.applicationId
    if app not in _default:
        _default[app] = load_language_model(train_language_model(sample_table(spark)), list(LANGUAGE_SAMPLES))
    return _default[app]


class _Scorer:
    """Tables of a model for one worker."""

    def __init__(self, model: LanguageModel):
        n = len(model.letters) + 1
        self.n = n
        points = [ord(c) for c in model.letters]
        self.number = np.zeros(max(points, default=0) + 2, np.int32)
        self.number[points] = np.arange(1, n)
        place = {c: i for i, c in enumerate(model.letters, 1)} | {" ": 0}
        self.row = np.zeros(n**3, np.int32)
        for i, gram in enumerate(model.grams, 1):
            a, b, c = (place[letter] for letter in gram)
            self.row[(a * n + b) * n + c] = i
        # The row of an unknown run has no weight.
        self.weights = np.vstack([np.zeros((1, len(model.languages)), np.int64), model.weights])

    def slices(self, texts: list[str]):
        """Lists of whole texts of about ``_SLICE`` characters; a longer text is one of its own."""
        part, size = [], 0
        for text in texts:
            if part and size + len(text) > _SLICE:
                yield part
                part, size = [], 0
            part.append(text)
            size += len(text)
        if part:
            yield part

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([self._scores(part) for part in self.slices(texts)])

    def _scores(self, texts: list[str]) -> np.ndarray:
        n_grams, n_languages = self.weights.shape
        out = np.zeros((len(texts), n_languages), np.int64)
        # A space on each side of each text.
        points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.cumsum([1, *(len(t) + 1 for t in texts)])
        for low in range(1, len(points) - 1, _SLICE):
            high = min(low + _SLICE, len(points) - 1)
            near = self.number[np.minimum(points[low - 1 : high + 1], len(self.number) - 1)]
            row = self.row[(near[:-2] * self.n + near[1:-1]) * self.n + near[2:]]
            row[near[1:-1] == 0] = 0
            owner = np.repeat(np.arange(len(texts)), np.diff(np.clip(edges, low, high)))
            row, first = row[: len(owner)], owner[0] if len(owner) else 0
            n_texts = int(owner[-1] - first) + 1 if len(owner) else 0
            if n_texts * n_grams <= 2 * len(row):
                # Long texts: count each run, then one product with the weights, whole numbers below 2 ** 53 all along.
                counts = np.bincount((owner - first) * n_grams + row, minlength=n_texts * n_grams).reshape(n_texts, n_grams)
                out[first : first + n_texts] += (counts.astype(np.float64) @ self.weights).astype(np.int64)
                continue
            at = np.flatnonzero(row)
            if len(at):
                starts = np.flatnonzero(np.diff(owner[at], prepend=-1))
                out[owner[at[starts]]] += np.add.reduceat(self.weights[row[at]], starts, axis=0)
        return out


def score_languages(text: Column, model: LanguageModel | None = None) -> Column:
    """``struct(language, margin)``: the best language and its score less that of the second, in thousandths.

    Of equal scores the language that the model names first wins, at a margin of 0. Null for a text that has no run of the
    model, such as one without letters, and for null.
    """
    model = model or default_language_model(SparkSession.active())
    bound_arrow(SparkSession.active())
    languages = np.array([*model.languages, None], object)

    @F.pandas_udf("language string, margin long")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(model)
        for texts in batches:
            scores = scorer.scores(texts.fillna("").tolist()) if len(texts) else np.zeros((0, len(model.languages)), np.int64)
            best = np.argmax(scores, axis=1) if len(scores) else np.zeros(0, np.int64)
            top = scores[np.arange(len(scores)), best]
            rest = scores.copy()
            rest[np.arange(len(scores)), best] = 0
            second = rest.max(axis=1, initial=0)
            yield pd.DataFrame({"language": languages[np.where(top > 0, best, -1)], "margin": top - second})

    return judge(F.lower(text))


def detect_language(text: Column, model: LanguageModel | None = None, min_margin: int = 0) -> Column:
    """Code of the language of a whole text; null where ``score_languages`` has none or its margin is below ``min_margin``.

    The default takes every decision, however narrow, as a post of one word seldom has a wide one.
    """
    judged = score_languages(text, model)
    language = judged["language"]
    return F.when(judged["margin"] >= min_margin, language) if min_margin else language
