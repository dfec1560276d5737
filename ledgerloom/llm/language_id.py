"""Language identification by a string kernel.

The blended-spectrum presence kernel of two texts counts the distinct character n-grams (n = 1 to
``MAX_N``) that both hold, over the geometric mean of their own counts. Nystrom landmarks (labelled texts,
as many of each language) give every text the features K(text, landmarks) W^(-1/2), with W the kernel
among landmarks; a one-versus-rest kernel ridge regression is fitted on them in closed form. Scoring is
two matrix products a batch: gram presence x landmark grams, then the folded projection and weights.

Fitting uses a bounded sample of the labelled rows (``max_fit`` texts, read whole): those with the smallest hash
of id and text, kept by a bounded top-k aggregate for each language that is combined map-side, so a language that has
rows is never lost. Tasks turn the sampled texts into their sets of n-gram hashes; only these reach the driver.
Prediction reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, ship

MAX_N = 3
MAX_FIT = 2000  # labelled texts that a fit sees at most, but for one of each language
LANDMARKS = 160
RIDGE = 1e-3
BUCKETS = 1 << 16  # n-grams are told apart by a 16-bit hash, each length in its own range
UNDETERMINED = "und"
SPREAD = 8  # hash groups of a language for each row that the sample takes of it
TEXTS_AT_ONCE = 128
CHARS_AT_ONCE = 400_000

_LETTER = re.compile(r"[^\W\d_]")


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, gram hash) of every n-gram of the lower-cased texts, repeats included."""
    codes, lengths = [], []
    for t in texts:
        c = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes.append(c)
        lengths.append(len(c))
    flat = np.concatenate(codes).astype(np.uint64) if codes else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    who, grams = [], []
    key = np.zeros(len(flat), np.uint64)
    for n in range(1, MAX_N + 1):
        size = len(flat) - n + 1
        if size <= 0:
            break
        key = (key[:size] * np.uint64(0x9E3779B97F4A7C15)) ^ (flat[n - 1:] + np.uint64(1))
        mixed = key * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
        inside = owner[:size] == owner[n - 1:]
        who.append(owner[:size][inside])
        grams.append(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(48))[inside].astype(np.int64) + BUCKETS * (n - 1))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(who), np.concatenate(grams)


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # hashes of the landmarks' grams
    landmarks: np.ndarray  # grams x landmarks, 1 where present, scaled by 1 / sqrt(landmark's count)
    weights: np.ndarray  # landmarks x languages: W^(-1/2) and the ridge weights in one
    bias: np.ndarray

    def kernel(self, texts: list[str]) -> np.ndarray:
        return self._kernel(len(texts), *_grams(texts))

    def kernel_of_sets(self, sets: list[np.ndarray]) -> np.ndarray:
        return self._kernel(len(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets).astype(np.int64))

    def _kernel(self, n: int, who: np.ndarray, grams: np.ndarray) -> np.ndarray:
        seen = np.zeros((n, MAX_N * BUCKETS), bool)
        seen[who, grams] = True
        own = np.count_nonzero(seen, axis=1)
        present = seen[:, self.vocabulary].astype(np.float32)
        return (present @ self.landmarks) / np.sqrt(np.maximum(own, 1))[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        raw = self.kernel(texts) @ self.weights + self.bias
        best = raw.argmax(axis=1)
        share = np.exp(4 * (raw - raw.max(axis=1, keepdims=True)))  # margins of +-1 targets, as shares
        return [self.languages[i] for i in best], (share.max(axis=1) / share.sum(axis=1)).astype(float)


def gram_set(text: str) -> np.ndarray:
    """Sorted distinct n-gram hashes of a whole text."""
    return np.unique(_grams([text])[1]).astype(np.int32)


def fit(texts: list[str], languages: list[str]) -> Model | None:
    """Fit on the given labelled texts (already bounded); None when there is no label to learn."""
    return fit_sets([gram_set(t) for t in texts], languages)


def fit_sets(sets: list[np.ndarray], languages: list[str], landmarks: int = LANDMARKS) -> Model | None:
    """Fit on the texts' sets of n-gram hashes. Every language has ``landmarks`` / languages of the landmarks; where there are
    more languages than landmarks, languages at equal distances have one each."""
    names = sorted(set(languages))
    if not names:
        return None
    index = {x: k for k, x in enumerate(names)}
    label = np.array([index[x] for x in languages])
    each, step = max(1, landmarks // len(names)), -(-len(names) // landmarks)
    order = np.argsort(label, kind="stable")
    first = np.searchsorted(label[order], np.arange(0, len(names), step))
    until = np.searchsorted(label[order], np.arange(0, len(names), step), "right")
    chosen = np.concatenate([order[a:min(b, a + each)] for a, b in zip(first, until)])
    grams = np.concatenate([sets[i] for i in chosen])
    who = np.repeat(np.arange(len(chosen)), [len(sets[i]) for i in chosen])
    vocabulary = np.unique(grams)
    marks = np.zeros((len(vocabulary), len(chosen)), np.float32)
    marks[np.searchsorted(vocabulary, grams), who] = 1
    marks /= np.sqrt(np.maximum(marks.sum(axis=0), 1))
    model = Model(names, vocabulary, marks, np.zeros((len(chosen), len(names)), np.float32), np.zeros(len(names), np.float32))
    kernel = lambda some: np.concatenate([model.kernel_of_sets(some[i:i + TEXTS_AT_ONCE]) for i in range(0, len(some), TEXTS_AT_ONCE)])
    w = kernel([sets[i] for i in chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh((w + w.T) / 2)
    good = values > 1e-6 * values.max() if len(values) and values.max() > 0 else np.zeros(len(values), bool)
    root = vectors[:, good] / np.sqrt(values[good])
    k = kernel(sets) @ root
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    balance = (1 / np.bincount(label))[label]  # every language weighs the same
    middle = (k * balance[:, None]).sum(axis=0) / balance.sum()
    offset = (target * balance[:, None]).sum(axis=0) / balance.sum()
    centred = (k - middle) * balance[:, None]
    ridge = np.linalg.solve(centred.T @ (k - middle) + RIDGE * np.eye(k.shape[1]), centred.T @ (target - offset)) if k.shape[1] else np.zeros((0, len(names)))
    model.weights = (root @ ridge).astype(np.float32)
    model.bias = (offset - middle @ ridge).astype(np.float32)
    return model


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_fit: int = MAX_FIT) -> Model | None:
    """Fit on at most ``max_fit`` rows with a language and a letter, as many of each language as it allows, one at least.

    The sample is the rows of smallest hash: the same rows on any cluster and partitioning. Equal rows (id, text and
    language) count once. Texts are read whole, in tasks; their n-gram sets, which the hash range bounds, are collected.
    """
    lang, text = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    rows = (labelled.where(lang.isNotNull() & text.rlike(r"\p{L}"))
            .select(lang.alias("lang"), text.alias("text"), F.xxhash64(F.col(f"`{id_col}`").cast("string"), text).alias("h")))
    # of each language and hash group the smallest hash: a bounded state for each task, combined map-side
    n = max(1, rows.select("lang").distinct().count())
    per = max(1, max_fit // n)
    least = rows.select("lang", "h").groupBy("lang", F.pmod("h", F.lit(SPREAD * per)).alias("g")).agg(F.min("h").alias("h"))
    ranked = least.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per).select("lang", "h")
    chosen = rows.join(F.broadcast(ranked) if n <= max_fit else ranked, ["lang", "h"])  # at most max_fit rows
    sets = F.pandas_udf(lambda texts: texts.map(lambda t: gram_set(t).tobytes()), "binary")  # type: ignore[call-overload]
    ship(labelled.sparkSession)
    got = sorted(chosen.dropDuplicates(["lang", "h"]).select("lang", "h", sets("text").alias("grams")).collect())
    return fit_sets([np.frombuffer(r.grams, np.int32) for r in got], [r.lang for r in got])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (string) and ``score`` (double, 0 to 1: the winner's share of the margins).

    A text that is null, empty or without any letter, and every text when there was nothing to learn from,
    is ``und`` with score 0. Texts are read whole; equal texts get equal answers; ties go to the language
    first in order. Rows are independent (no shuffle); an empty table gives an empty one. Other columns pass
    through; those already named like an output are replaced.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    answer = free_names(docs.columns, "_answer")[0]
    return docs.select(*kept, _answer(docs, model, text_col).alias(answer)).select(*kept, f"{answer}.lang_pred", f"{answer}.score")


def _answer(docs: DataFrame, model: Model | None, text_col: str, once: bool = False) -> Column:
    """Struct (lang_pred, score). ``once``: Spark may not copy it from a column into the filters on that column."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # bounded by landmarks x n-gram hashes

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            good = [i for i, t in enumerate(texts) if m is not None and isinstance(t, str) and _LETTER.search(t)]
            values = texts.tolist()
            part, size = [], 0
            for j, i in enumerate(good):
                part.append(i)
                size += len(values[i])
                if len(part) == TEXTS_AT_ONCE or size >= CHARS_AT_ONCE or j == len(good) - 1:
                    names, share = m.predict([values[k] for k in part])
                    for k, name, s in zip(part, names, share):
                        lang[k], score[k] = name, s
                    part, size = [], 0
            yield pd.DataFrame({"lang_pred": lang, "score": np.clip(score, 0.0, 1.0)})

    predicted = F.pandas_udf(predict, "lang_pred string, score double")
    return (predicted.asNondeterministic() if once else predicted)(F.col(f"`{text_col}`").cast("string"))


def _has_letter(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: isinstance(t, str) and bool(_LETTER.search(t))).astype(bool)


def keep_identified(docs: DataFrame, model: Model | None, languages: list[str] | None = None, min_score: float = 0.0, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """The rows of ``docs``, same columns, that are not ``und``, score ``min_score`` or more and, if given, are in ``languages``.

    With ``lang_col`` that column holds the language found (it is replaced, or added). Without a model (there was no
    label to learn from) no text has a language or a score: the rows with a letter stay as they are, and asking for
    languages or a score is an error.
    """
    if model is None:
        if languages is not None or min_score > 0:
            raise ValueError("no model: no labelled text to learn languages from, so none can be asked for")
        lettered = F.pandas_udf(_has_letter, "boolean")(F.col(f"`{text_col}`").cast("string"))
        return docs.where(lettered)
    answer = free_names(docs.columns, "_answer")[0]
    found = docs.withColumn(answer, _answer(docs, model, text_col, once=lang_col is not None))
    lang, score = F.col(answer)["lang_pred"], F.col(answer)["score"]
    good = (lang != UNDETERMINED) & (score >= min_score)
    if languages is not None:
        good &= lang.isin(languages)
    kept = found.where(good)
    return (kept if lang_col is None else kept.withColumn(lang_col, lang)).drop(answer)
