"""Quality classifier: gated-attention multiple-instance learning over the passages of a document."""

from __future__ import annotations

import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_kept, materialize, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of a passage, buckets of hashed words and of hashed word endings, width of the passage representation and of the attention.
PASSAGE, WORD_BUCKETS, BUCKETS, WIDTH, GATE = 64, 512, 64, 16, 8
SURFACE = 12
FEATURES = SURFACE + BUCKETS + WORD_BUCKETS
#: Bounds of training: labelled documents, and words of all of them together; documents are taken whole or not at all. Scoring has no bounds.
SAMPLE_DOCS, SAMPLE_WORDS = 4000, 3_000_000
_SYMBOL, _END = re.compile(rb"[#*$%&|<>]"), (b".", b"?", b"!")


def encode(text: str | None) -> np.ndarray:
    """One row of surface counts, hashed word endings and hashed words for each passage of the whole text; an empty text is one passage of zeros."""
    w = words(text)
    out = np.zeros((max(1, -(-len(w) // PASSAGE)), FEATURES), np.float32)
    crc = zlib.crc32
    for row, at in zip(out, range(0, len(w), PASSAGE)):
        own = w[at : at + PASSAGE]
        n, line = len(own), b" ".join(own)
        low = line.lower().split()
        row[:SURFACE] = (
            1.0, n / PASSAGE, len(line) / n / 10, len(_SYMBOL.findall(line)) / n, sum(x.isupper() for x in own) / n, line.count(b"!") / n, line.count(b"|") / n, sum(c.isdigit() for c in own) / n,
            sum(x.endswith(_END) for x in own) / n, len(set(own)) / n, sum(a == b for a, b in zip(own, own[1:])) / n, sum(a == b for a, b in zip(own, own[2:])) / n,
        )
        row[SURFACE:] = np.bincount([SURFACE + crc(x[-3:]) % BUCKETS for x in low] + [SURFACE + BUCKETS + crc(x) % WORD_BUCKETS for x in low], minlength=FEATURES)[SURFACE:] / n
    return out


class Model:
    """h = tanh(x W); a = softmax(u . (tanh(h V) * sigmoid(h G))); score = sigmoid((a . h) c + d)."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        mk = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        self.p = {"W": mk(FEATURES, WIDTH), "V": mk(WIDTH, GATE), "G": mk(WIDTH, GATE), "u": mk(GATE), "c": mk(WIDTH), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """x: passages of several documents one after another; starts: where each document begins."""
        p, size = self.p, np.diff(np.r_[starts, len(x)])
        h = np.tanh(x @ p["W"])
        v, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["G"]))
        e = (v * g) @ p["u"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), size))
        a = e / np.repeat(np.add.reduceat(e, starts), size)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return y, (x, size, h, v, g, a, z)

    def gradients(self, y: np.ndarray, label: np.ndarray, kept, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        p, (x, size, h, v, g, a, z) = self.p, kept
        dl = (y - label) / len(y)
        dz = np.repeat(dl[:, None] * p["c"], size, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), size))
        dv, dg = de[:, None] * p["u"] * g * (1 - v * v), de[:, None] * p["u"] * v * g * (1 - g)
        dh = a[:, None] * dz + dv @ p["V"].T + dg @ p["G"].T
        return {"W": x.T @ (dh * (1 - h * h)), "V": h.T @ dv, "G": h.T @ dg, "u": (v * g).T @ de, "c": z.T @ dl, "d": dl.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, steps: int = 600, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 6) -> Model:
        r, m, s = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for t in range(1, steps + 1):
            pick = r.integers(0, len(bags), min(batch, len(bags)))
            own = [bags[i] for i in pick]
            starts = np.r_[0, np.cumsum([len(b) for b in own])[:-1]]
            y, kept = self.forward(np.concatenate(own).astype(np.float64), starts)
            for k, g in self.gradients(y, labels[pick], kept, starts).items():
                g = g + decay * self.p[k]
                m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Model:
    """Fit on whole documents: the ``sample`` labelled, usable ones of least hashed id, as many of them as hold ``sample_words`` words together (the first always).

    Passages are encoded on the executors and sent to the driver packed. Of several labels of one id the highest counts, of several documents that of least hashed text, so the rows sent are bounded. Without two kinds of label the model stays untrained.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_i")).agg(F.max(F.col(label_col).cast("double")).alias("_y"))
    chosen = known.withColumnRenamed("_i", id_col).filter(usable).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    one = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.first("_y").alias("_y"), F.min_by(text_col, F.coalesce(F.xxhash64(text_col), F.lit(0))).alias("_text"))
    upto = F.sum("_n").over(Window.orderBy(F.xxhash64(id_col), id_col).rowsBetween(Window.unboundedPreceding, -1))  # over ``sample`` rows at most
    rows = materialize(one)
    fit = rows.select(id_col, F.coalesce(F.regexp_count(F.col("_text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("_n"))
    fit = fit.withColumn("_upto", F.coalesce(upto, F.lit(0)) + F.when(F.coalesce(upto, F.lit(0)) > 0, F.col("_n")).otherwise(0)).filter(F.col("_upto") <= sample_words).select(id_col)

    def run(batches):
        for b in batches:
            bags = [encode(t) for t in b.column(2).to_pylist()]
            packed = [zlib.compress(np.packbits(x != 0).tobytes() + x[x != 0].astype(np.float16).tobytes(), 1) for x in bags]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in bags], pa.int32()), pa.array(packed, pa.binary())], ["i", "y", "n", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = sorted(rows.join(F.broadcast(fit), id_col).select(id_col, "_y", "_text").mapInArrow(run, f"i {kind}, y double, n int, x binary").collect(), key=lambda r: r["i"])
    model, y = Model(), np.array([r["y"] for r in got])
    if len(set(y.tolist())) < 2:
        return model
    return model.fit([_unpacked(r["x"], r["n"]) for r in got], y)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    raw, cells = zlib.decompress(packed), n * FEATURES
    out, edge = np.zeros(cells, np.float16), -(-cells // 8)
    out[np.unpackbits(np.frombuffer(raw[:edge], np.uint8), count=cells).astype(bool)] = np.frombuffer(raw[edge:], np.float16)
    return out.reshape(n, FEATURES)


@columns_kept("_score", "_attention")
def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with ``_score`` (0 to 1) of the whole text and ``_attention`` (the weight of its weightiest passage). Null and empty texts score as one empty passage; other columns, repeats and an empty table pass through."""


    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            scores, tops = [], []
            for at in range(0, len(texts), 256):
                bags = [encode(t) for t in texts[at : at + 256]]
                starts = np.r_[0, np.cumsum([len(x) for x in bags])[:-1]]
                y, kept = model.forward(np.concatenate(bags).astype(np.float64), starts)
                scores.append(y)
                tops.append(np.maximum.reduceat(kept[5], starts))
            cols = [pa.array(np.concatenate(x) if x else [], pa.float64()) for x in (scores, tops)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "_score", "_attention"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType()), T.StructField("_attention", T.DoubleType())]))
