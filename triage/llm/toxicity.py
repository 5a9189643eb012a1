"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: its words, and how its longer words begin (the first three
to seven characters), which other endings share. Its score is

    sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j> / n)   over its n terms

so that two terms together (an insult and the mention of a group) can count more than their
own weights. Linear weights are held sparse, and terms of fewer than ``min_docs`` training
texts are left out, or chance words of long texts would decide. Only the text is an input.
The machine learns from at most ``max_train`` labelled rows, chosen by a hash of the id
(``MAX_TRAIN``, the one bound of this operator: what is collected for training has at most that
many rows of at most ``2**bits`` term numbers); every document is scored.

Defined cases: a null or empty text has no terms and gets the score of the bias; several labels
of one document count as toxic if one says so; null labels and labels without a document are not
used; a document that repeats an id is used once for training, with its smallest text; without
training rows of both kinds every score is the smoothed share of toxic rows, at most 0.25 without any rows.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.functions.scale import stage_path
from triage.llm import common

MAX_TRAIN = 20_000
# Words: runs of letters, digits and bytes outside ASCII, A-Z lower-cased.
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)
)


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    beginnings: tuple[int, ...] = (3, 4, 5, 6, 7)
    min_docs: int = 5
    factors: int = 4
    epochs: int = 10
    rate: float = 0.2
    sparsity: float = 1e-3  # of linear weights
    decay: float = 1e-2  # of factors
    batch: int = 256
    seed: int = 7


class Hasher:
    """Distinct term numbers of a text; the numbers of words already seen are kept."""

    def __init__(self, settings: Settings = Settings()):
        self.mask, self.beginnings = (1 << settings.bits) - 1, settings.beginnings
        self.kept: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = set((text or "").encode().translate(WORDS).split())
        if len(self.kept) > 500_000:
            self.kept.clear()
        kept, out = self.kept, set()
        for w in words:
            numbers = kept.get(w)
            if numbers is None:
                numbers = kept[w] = self._numbers(w)
            out.update(numbers)
        return np.fromiter(sorted(out), dtype=np.int32, count=len(out))

    def _numbers(self, word: bytes) -> tuple[int, ...]:
        letters = word.decode("utf-8", "ignore")
        starts = [(letters[:k] + "*").encode() for k in self.beginnings if len(letters) > k]
        return tuple(zlib.crc32(term) & self.mask for term in (word, *starts))


class Machine:
    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    @cached_property
    def known(self) -> np.ndarray:
        """Terms that the training texts held often enough."""
        return self.factors.any(axis=1) | (self.weights != 0)

    def score(self, terms: np.ndarray) -> float:
        z = self.bias
        terms = terms[self.known[terms]]
        if len(terms):
            v = self.factors[terms]
            s = v.sum(axis=0)
            z += float(self.weights[terms].sum()) + 0.5 * float((s * s).sum() - (v * v).sum()) / len(terms)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, bias=np.array(self.bias), weights=self.weights, factors=self.factors)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Machine:
        held = np.load(io.BytesIO(data))
        return cls(float(held["bias"]), held["weights"], held["factors"])


def fit(samples: list[tuple[np.ndarray, int]], settings: Settings = Settings()) -> Machine:
    """AdaGrad on the logistic loss, in small batches of a seeded order; after each step linear
    weights are drawn towards zero by ``sparsity``."""
    size = 1 << settings.bits
    rng = np.random.default_rng(settings.seed)
    n, positive = len(samples), sum(y for _, y in samples)
    share = (positive + 0.5) / (n + 2)
    weights = np.zeros(size, dtype=np.float32)
    factors = np.zeros((size, settings.factors), dtype=np.float32)
    machine = Machine(float(np.log(share / (1 - share))), weights, factors)
    if not 0 < positive < n:
        return machine
    # terms found often enough get dense numbers
    vocabulary = np.flatnonzero(
        np.bincount(np.concatenate([t for t, _ in samples]), minlength=size) >= settings.min_docs
    )
    dense = np.full(size, -1, dtype=np.int64)
    dense[vocabulary] = np.arange(len(vocabulary))
    found = [own[own >= 0] for own in (dense[t] for t, _ in samples)]
    lengths = np.array([len(t) for t in found])
    labels = np.array([y for _, y in samples], dtype=np.float32)
    m, k = len(vocabulary), settings.factors
    w, v = np.zeros(m), rng.normal(0, 0.05, (k, m))
    seen_w, seen_v, seen_0 = np.full(m, 1e-3), np.full((k, m), 1e-3), 1e-3
    for _ in range(settings.epochs):
        order = rng.permutation(n)
        for at in range(0, n, settings.batch):
            chosen = order[at : at + settings.batch]
            chosen = chosen[lengths[chosen] > 0]
            if not len(chosen):
                continue
            own = lengths[chosen]
            terms = np.concatenate([found[i] for i in chosen])
            starts = np.cumsum(own) - own
            row = np.repeat(np.arange(len(chosen)), own)
            sums, z = [], machine.bias + np.add.reduceat(w[terms], starts)
            for f in range(k):
                here = v[f][terms]
                sums.append(np.add.reduceat(here, starts))
                z += 0.5 * (sums[f] ** 2 - np.add.reduceat(here * here, starts)) / own
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]) / len(chosen)
            seen_0 += g.sum() ** 2
            machine.bias -= settings.rate * g.sum() / seen_0**0.5
            touched = np.bincount(terms, minlength=m) > 0
            gw = np.bincount(terms, g[row], m)
            seen_w += gw * gw
            step = settings.rate / np.sqrt(seen_w)
            moved = w - step * gw
            moved = np.sign(moved) * np.maximum(0, np.abs(moved) - step * settings.sparsity)
            w = np.where(touched, moved, w)
            share_of = np.bincount(terms, (g / own)[row], m)
            for f in range(k):
                gv = np.bincount(terms, (g / own * sums[f])[row], m) - share_of * v[f] + settings.decay * v[f] * touched
                seen_v[f] += gv * gv
                v[f] -= settings.rate * gv / np.sqrt(seen_v[f])
    weights[vocabulary], factors[vocabulary] = w, v.T
    return machine


# --- the Spark side ----------------------------------------------------------------


def training_rows(
    docs: DataFrame, labels: DataFrame, use: Column, max_train: int = MAX_TRAIN, settings: Settings = Settings()
) -> DataFrame:
    """(doc_id, toxic, terms) of the chosen labelled documents. ``labels``: (doc_id, toxic); ``use``
    is a condition on its doc_id."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(use)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    # at most max_train rows of two numbers: the broadcast is bounded
    found = common.texts(docs).join(F.broadcast(known), "doc_id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(settings)
        schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("terms", pa.binary())])
        yield from common.emit(
            ((d, y, hasher(t).tobytes()) for d, y, t in common.rows(batches, "doc_id", "toxic", "text")), schema, 512
        )

    terms = found.select("doc_id", "toxic", "text").mapInArrow(featurise, "doc_id long, toxic int, terms binary")
    return terms.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("terms").alias("terms"))


def train(rows: DataFrame, settings: Settings = Settings()) -> str:
    """Fit on the bounded rows in one task; returns the model's file in the shared folder."""
    folder = stage_path(rows.sparkSession, "toxicity")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(common.rows(batches, "doc_id", "toxic", "terms"))
        machine = fit([(np.frombuffer(t, dtype=np.int32), y) for _, y, t in held], settings)
        name = f"{folder}/{uuid.uuid4().hex}.npz"
        with common.open_out(name) as f:
            f.write(machine.dump())
        yield pa.RecordBatch.from_pydict({"file": [name]})

    return rows.repartition(1).mapInArrow(learn, "file string").first()["file"]


@common.worker_store
def _machine(file: str) -> Machine:
    with common.open_in(file) as f:
        return Machine.load(f.read())


def score(
    docs: DataFrame, model: str, text_col: str = "text", name: str = "score", settings: Settings = Settings()
) -> DataFrame:
    """``docs`` with the score of every whole text."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, hasher = _machine(model), Hasher(settings)
        for batch in batches:
            scores = [machine.score(hasher(t)) for t, in common.rows([batch], text_col)]
            yield batch.append_column(name, pa.array(scores, pa.float64()))

    return docs.mapInArrow(rate, schema)


def fit_and_score(
    docs: DataFrame, all_docs: DataFrame, labels: DataFrame, use: Column, max_train: int = MAX_TRAIN,
    name: str = "score", settings: Settings = Settings(),
) -> DataFrame:
    """Learn from the labelled rows of ``all_docs`` and score ``docs``."""
    model = train(training_rows(all_docs, labels, use, max_train, settings), settings)
    return score(docs, model, name=name, settings=settings)
