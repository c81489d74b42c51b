"""External models as columns: a scorer or an embedder of texts, loaded once a worker and called with batches of bounded length."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from riskloom.functions import vectors as VX
from riskloom.operators.learn import TextModel, _accents, coefficients

#: Characters that a model gets at a time, one text at least.
BATCH_CHARS = 200_000
Model = Callable[[list[str]], Sequence]
_loaded: dict[str, Model] = {}


def _model(name: str, load: Callable[[], Model]) -> Model:
    """The model of this worker. It is made again in another worker, also after this one is lost."""
    if name not in _loaded:
        _loaded.clear()  # one model at a time in memory
        _loaded[name] = load()
    return _loaded[name]


def batched(texts: Sequence[str], model: Model, chars: int = BATCH_CHARS) -> list:
    """The model's answer for each text. Equal texts are asked about once, texts of about one length go together."""
    distinct = sorted(set(texts), key=lambda t: (len(t), t))
    answers, batch, size = {}, [], 0
    for k, text in enumerate(distinct):
        batch.append(text)
        size += len(text)
        if k + 1 == len(distinct) or size + len(distinct[k + 1]) > chars:
            found = model(batch)
            if len(found) != len(batch):
                raise ValueError(f"the model gave {len(found)} answers for {len(batch)} texts")
            answers.update(zip(batch, found))
            batch, size = [], 0
    return [answers[t] for t in texts]


def _column(load: Callable[[], Model], kind: str, chars: int, convert: Callable) -> Callable[[Column], Column]:
    name = uuid.uuid4().hex

    @F.pandas_udf(kind)
    def asked(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(name, load)
        for texts in series:
            usable = [isinstance(t, str) and bool(t.strip()) for t in texts]
            found = iter(batched([t for t, u in zip(texts, usable) if u], model, chars))
            yield pd.Series([convert(next(found)) if u else None for u in usable], dtype=object if kind != "double" else "float64")

    return asked


def text_scorer(load: Callable[[], Model], chars: int = BATCH_CHARS) -> Callable[[Column], Column]:
    """A column function from texts to probabilities; ``load`` makes the model: texts in, a number each out.

    Blank and null texts have no probability (null). Use it as ``triage(..., probability=scorer(F.col("report_text")))``.
    """
    return _column(load, "double", chars, float)


def text_embedder(load: Callable[[], Model], chars: int = BATCH_CHARS) -> Callable[[Column], Column]:
    """A column function from texts to vectors, for the ``embedding`` of similarity and patterns. Blank and null texts get null."""
    return _column(load, "array<double>", chars, lambda v: [float(x) for x in v])


# ------------------------------------------------------------------ models that come with the library


def exported(model: TextModel) -> dict:
    """A fitted classifier as plain values: inverse frequency and coefficient of each term of its vocabulary, and the intercept."""
    terms = {r["term"]: (r["idf"], r["coefficient"]) for r in model.vocab.join(coefficients(model), "term").collect()}
    return {"terms": terms, "intercept": float(model.regression.intercept)}


def linear(values: dict) -> Callable[[], Model]:
    """Loads an exported classifier: no Spark is needed to ask it."""
    def load() -> Model:
        plain = str.maketrans(*_accents())
        word = re.compile(r"\b\w\w+\b")

        def probability(text: str) -> float:
            words = word.findall(text.lower().translate(plain))
            counts: dict[str, int] = {}
            for term in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                if term in values["terms"]:
                    counts[term] = counts.get(term, 0) + 1
            weights = {t: (1 + math.log(n)) * values["terms"][t][0] for t, n in counts.items()}
            size = math.sqrt(sum(w * w for w in weights.values())) or 1.0
            return 1 / (1 + math.exp(-values["intercept"] - sum(w / size * values["terms"][t][1] for t, w in weights.items())))

        return lambda texts: [probability(t) for t in texts]

    return load


def word_odds(weights: dict[str, float]) -> Callable[[], Model]:
    """Loads a model that turns the mean weight of a text's known words into a probability; none known is one half."""
    def load() -> Model:
        def probability(text: str) -> float:
            known = [weights[w] for w in re.findall(r"\w\w+", text.lower()) if w in weights]
            return 1 / (1 + math.exp(-(sum(known) / len(known) if known else 0.0)))

        return lambda texts: [probability(t) for t in texts]

    return load


def hashed() -> Model:
    """The hashed embedding of :func:`riskloom.functions.vectors.hash_embedding` as an external model."""
    def vector(text: str) -> np.ndarray:
        out = np.zeros(VX.DIMENSIONS)
        for word in re.sub("[,.]", " ", text.lower()).split():
            h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
            for i in range(VX.BUCKETS):
                out[(h + i * VX.STRIDE) % VX.DIMENSIONS] += ((h >> (4 * i)) & 255) / 255.0 - 0.5
        size = np.linalg.norm(out)
        return out / size if size > VX.TINY_TEXT else np.eye(1, VX.DIMENSIONS)[0]

    return lambda texts: [vector(t) for t in texts]
