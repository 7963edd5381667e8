"""Language of texts by string kernels.

A text is the set of its n-grams of several lengths (a blended spectrum, presence
only), hashed to ``BINS`` places. The kernel of two texts is the number of shared
places over the root of the product of their set sizes. Nyström landmarks give
each text finite features, ``K(text, landmarks) K(landmarks, landmarks) ** -1/2``,
and kernel ridge regression fits one of them against the rest per language. As the
kernel is a product of presence vectors, landmarks and weights fold into one
matrix, and a batch of texts is scored by one matrix product.

The fit uses a bounded sample of labelled rows; every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import slices, sql_type

LENGTHS = (1, 2, 3, 4)
BINS = 1 << 14
SAMPLE_ROWS = 4000
LANDMARKS = 256
RIDGE = 1e-2
BATCH = 256

_LETTER = regex.compile(r"\p{L}")
_BLANKS = regex.compile(r"\s+")


def presence(text: str) -> np.ndarray:
    """Places of the text's n-grams as a 0/1 vector. Texts are lower-cased, and a run of white space is one blank."""
    chars = np.frombuffer(_BLANKS.sub(" ", f" {text.lower()} ").encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint32)
    out = np.zeros(BINS, dtype=np.uint8)
    code = np.zeros(len(chars), dtype=np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        if len(chars) < n:
            break
        code = code[:len(chars) - n + 1] * np.uint32(0x01000193) ^ chars[n - 1:] * np.uint32(0x9E3779B1)
        if n in LENGTHS:
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out[(mixed ^ (mixed >> np.uint32(16))) & np.uint32(BINS - 1)] = 1
    return out


def normed(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray  # BINS x languages
    bias: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return normed(rows) @ self.weights + self.bias


def fit(rows: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström kernel ridge regression; rows of all languages weigh the same in sum. The first rows of each language
    are the landmarks."""
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((BINS, 0), np.float32), np.zeros(0, np.float32))
    y = np.array([names.index(v) for v in labels])
    x = normed(rows)
    share = max(1, landmarks // len(names))
    marks = x[np.concatenate([np.flatnonzero(y == c)[:share] for c in range(len(names))])]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    z = (x @ marks.T) @ root
    weight = 1 / np.bincount(y)[y]
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    mean, level = (weight @ z) / weight.sum(), (weight @ target) / weight.sum()
    zc = z - mean
    inner = zc.T @ (weight[:, None] * zc) + ridge * np.eye(z.shape[1])
    w = np.linalg.solve(inner, zc.T @ (weight[:, None] * (target - level)))
    return Model(names, (marks.T @ (root @ w)).astype(np.float32), (level - mean @ w).astype(np.float32))


def _presence_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        bits = [np.packbits(presence(t or "")).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary()), batch.column(2)], ["lang", "bits", "turn"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
          sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about ``sample_rows`` rows with a label and a letter, as evenly over the languages as they allow.

    Rows are chosen by a hash of the id, at a rate per language, one of each id (that whose text has the least hash);
    only their bits come to the driver, at most a quarter more rows than asked for.
    """
    labelled = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(label_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, F.lit(7)).alias("turn"))
    sizes = {r.lang: r.n for r in docs.filter(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("lang")).agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample_rows).collect()}
    share = sample_rows / max(1, len(sizes))
    rate: Column = F.lit(0.0)
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, min(1.0, share / n)).otherwise(rate)
    chosen = (labelled.filter(F.pmod("turn", F.lit(1 << 20)) < rate * (1 << 20))
              .groupBy("turn").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "lang", "text")).alias("c"))
              .select("c.lang", "c.text", "turn").orderBy("turn").limit(sample_rows + sample_rows // 4))
    rows = chosen.mapInArrow(_presence_task, f"lang {sql_type(docs, label_col)}, bits binary, turn bigint").toPandas()
    rows = rows.sort_values(["turn", "lang"], kind="stable")
    bits = np.frombuffer(b"".join(rows["bits"]), dtype=np.uint8).reshape(-1, BINS // 8)
    return fit(np.unpackbits(bits, axis=1), rows["lang"].tolist())


def _score_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            found, score = ["und"] * len(texts), np.zeros(len(texts))
            asked = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)] if model.names else []
            for a in range(0, len(asked), BATCH):
                part = asked[a:a + BATCH]
                values = model.scores(np.stack([presence(texts[i]) for i in part]))
                for i, best, value in zip(part, values.argmax(axis=1), values.max(axis=1)):
                    found[i], score[i] = model.names[best], min(1.0, max(0.0, (1 + float(value)) / 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(score)], ["id", "lang", "score"])
    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``lang_pred`` and ``score`` from 0 to 1.

    Null texts and those without a letter are ``und`` with score 0, as is everything if the model saw no label. Equal
    scores go to the first name. Repeated rows each come back. Other columns are not looked at. An empty table gives
    an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        _score_task(shared), f"id {sql_type(docs, id_col)}, lang string, score double").select(
        F.col("id").alias(id_col), F.col("lang").alias("lang_pred"), "score")
