"""Quality rules: a linear-chain CRF marks lines as content or boilerplate; the share of content decides.

Potentials start from given ones and are fitted to documents whose quality is known, by forward-backward.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, replaced, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SYMBOLS = "#*$%&|<>"
_SYMBOL = re.compile(rb"[#*$%&|<>]")
FEATURES = ("bias", "symbols_per_word", "upper_case", "shouts_per_word", "stutter", "repeat", "ends_sentence", "length")


@dataclass(frozen=True)
class Potentials:
    """Log potentials of the chain: of content against boilerplate for each of FEATURES of a line, of staying in a state and of changing it. The defaults are what fitting starts from and is drawn to."""

    weights: tuple[float, ...] = (1.0, -5.0, -4.0, -3.0, -6.0, -0.5, 1.0, 0.5)
    stay: float = 0.4
    change: float = -0.4


#: Bounds of fitting: labelled documents and lines of all of them together; documents are taken whole or not at all. Strength of the pull to the given potentials.
SAMPLE_DOCS, SAMPLE_LINES, PULL = 1000, 20_000, 0.02
CONTENT_SHARE = 0.5
COLUMNS = T.StructType([T.StructField(n, T.LongType()) for n in ("_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words")] + [T.StructField("_base_failed", T.BooleanType()), T.StructField("_content_share", T.DoubleType()), T.StructField("_kept", T.BooleanType())])


def repeat_words(w: list[bytes], k: int = 8) -> int:
    """Words that lie in a k-word window (k a multiple of 4) found twice or more in the text, the first included."""
    if len(w) <= k:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(x, len(ids)) for x in w), np.int64, len(w))
    m = len(ids)
    if m < 50_000:
        four = ((a[:-3] * m + a[1:-2]) * m + a[2:-1]) * m + a[3:]
    else:
        two = np.unique(a[:-1] * m + a[1:], return_inverse=True)[1]
        four = two[:-2] * (int(two.max()) + 1) + two[2:]
    rank = np.unique(four, return_inverse=True)[1]
    if len(rank) == int(rank.max()) + 1:
        return 0
    for at in range(4, k, 4):  # windows of at + 4 words
        rank = np.unique(rank[:-4] * (len(w) + 1) + np.unique(four, return_inverse=True)[1][at:], return_inverse=True)[1]
    twice = np.bincount(rank)[rank] > 1
    ends = np.zeros(len(w) + 1, np.int64)
    np.add.at(ends, np.flatnonzero(twice), 1)
    np.add.at(ends, np.flatnonzero(twice) + k, -1)
    return int((np.cumsum(ends)[:-1] > 0).sum())


def viterbi(content: list[float], potentials: Potentials = Potentials()) -> list[bool]:
    """The likeliest states of a chain whose content potentials are given (boilerplate has 0); ties go to content."""
    if not content:
        return []
    stay, change = potentials.stay, potentials.change
    yes, no, back = content[0], 0.0, []
    for x in content[1:]:
        back.append((yes + stay >= no + change, no + stay <= yes + change))
        yes, no = max(yes + stay, no + change) + x, max(no + stay, yes + change)
    states = [yes >= no]
    for from_content, to_boilerplate in reversed(back):
        states.append(from_content if states[-1] else to_boilerplate)
    return states[::-1]


def line_features(line: bytes, w: list[bytes], repeated: bool) -> tuple[float, ...]:
    n = len(w)
    stutter = sum(w[i] == w[i - 1] or i > 1 and w[i] == w[i - 2] for i in range(1, n)) / n
    return (
        1.0, min(1.0, len(_SYMBOL.findall(line)) / n), float(n > 2 and line.decode("utf-8", "surrogatepass").isupper()), min(1.0, line.count(b"!!") / n),
        stutter, float(repeated), float(w[-1].endswith((b".", b"?", b"!", b":"))), min(1.0, n / 20),
    )


def _lines(text: str | None):
    """(line, its words, whether an equal line stands before it) for the lines that have words."""
    seen: set[bytes] = set()
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        if own := line.split():
            yield line, own, line in seen
            seen.add(line)


def chain_gradient(bags: list[np.ndarray], content: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean over documents of the log-likelihood of a line's state where all lines of a document are content or all are boilerplate, and its gradient by (weights, stay, change); by forward-backward over all chains at once."""
    count = np.array([len(b) for b in bags])
    x = np.zeros((len(bags), count.max(), bags[0].shape[1]))
    for i, b in enumerate(bags):
        x[i, : len(b)] = b
    live = np.arange(x.shape[1]) < count[:, None]
    node, (stay, change) = x @ p[:-2], p[-2:]
    ahead, behind = np.zeros((*live.shape, 2)), np.zeros((*live.shape, 2))
    ahead[:, 0, 0] = node[:, 0]
    step = lambda m: np.stack([np.logaddexp(m[:, 0] + stay, m[:, 1] + change), np.logaddexp(m[:, 0] + change, m[:, 1] + stay)], 1)
    for t in range(1, x.shape[1]):
        now = step(ahead[:, t - 1])
        now[:, 0] += node[:, t]
        ahead[:, t] = np.where(live[:, t, None], now, ahead[:, t - 1])
    for t in range(x.shape[1] - 2, -1, -1):
        after = behind[:, t + 1].copy()
        after[:, 0] += node[:, t + 1]
        behind[:, t] = np.where(live[:, t + 1, None], step(after), 0.0)
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    p_content = np.exp(ahead[..., 0] + behind[..., 0] - total[:, None]) * live
    both = live[:, 1:]
    pair = lambda a, b, w: np.exp(np.where(both, ahead[:, :-1, a] + w + (node[:, 1:] if b == 0 else 0) + behind[:, 1:, b] - total[:, None], -np.inf))
    same, moved = pair(0, 0, stay) + pair(1, 1, stay), pair(0, 1, change) + pair(1, 0, change)
    value = np.where(content, (node * live).sum(1), 0.0) + stay * (count - 1) - total
    wanted = content[:, None] * live
    share = 1 / count / len(bags)
    by_weight = np.einsum("dt,dtf,d->f", wanted - p_content, x, share)
    return float((value * share).sum()), np.r_[by_weight, (((count - 1) - same.sum(1)) * share).sum(), (-moved.sum(1) * share).sum()]


def fit_potentials(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", start: Potentials = Potentials(), sample: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES, steps: int = 200) -> Potentials:
    """``start`` moved towards the likelihood of labelled documents, whose lines all count as content (label 1) or boilerplate (0).

    The ``sample`` labelled, usable documents of least hashed id that pass the base rule, as many of them as have ``sample_lines`` lines together; of several labels of one id the highest counts, of several documents that of least hashed text. Transitions stay as they are. Without two kinds of label ``start`` comes back.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col)).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    chosen = known.filter(usable).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    one = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.first("_y").alias("_y"), F.min_by(text_col, F.coalesce(F.xxhash64(text_col), F.lit(0))).alias("_text"))

    def run(batches):
        for b in batches:
            bags = [[line_features(*x) for x in _lines(t)] for t in b.column(2).to_pylist()]
            some = [i for i, (t, x) in enumerate(zip(b.column(2).to_pylist(), bags)) if not assess(t)[5] and len(x) <= sample_lines]
            kept = [np.array(bags[i], np.float32).tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int64())), b.column(1).take(pa.array(some, pa.int64())), pa.array(kept, pa.binary())], ["i", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    sized = materialize(one.mapInArrow(run, f"i {kind}, y int, x binary").withColumn("n", (F.octet_length("x") / (4 * len(FEATURES))).cast("bigint")))
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("i"), "i"))  # over ``sample`` rows at most
    rows = sized.join(F.broadcast(sized.select("i", "n").withColumn("_upto", upto).filter(F.col("_upto") <= sample_lines).select("i")), "i").orderBy("i").collect()
    content = np.array([r["y"] for r in rows], bool)
    if len(set(content.tolist())) < 2:
        return start
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES)).astype(float) for r in rows]
    origin = np.array([*start.weights, start.stay, start.change])
    p, m, v = origin.copy(), np.zeros_like(origin), np.zeros_like(origin)
    for t in range(1, steps + 1):
        g = chain_gradient(bags, content, p)[1] - PULL * (p - origin)
        g[-2:] = 0.0  # labels of whole documents say nothing of changes between lines
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Potentials(tuple(map(float, p[:-2])), float(p[-2]), float(p[-1]))


def assess(text: str | None, potentials: Potentials = Potentials()) -> tuple:
    """The values of COLUMNS for one text; a null text counts as empty."""
    w = words(text)
    raw = (text or "").encode("utf-8", "surrogatepass")
    chars = sum(len(x) for x in w) if len(raw) == len(text or "") else len(b"".join(w).decode("utf-8", "surrogatepass"))
    dups, content, sizes = 0, [], []
    for line, own, again in _lines(text):
        dups += again
        content.append(sum(a * b for a, b in zip(potentials.weights, line_features(line, own, again))))
        sizes.append(sum(map(len, own)))
    repeats = repeat_words(w)
    failed = len(w) < 20 or 100 * repeats > 30 * len(w)
    share = sum(s for s, c in zip(sizes, viterbi(content, potentials)) if c) / sum(sizes) if sizes else 0.0
    return len(w), chars, sum(raw.count(c.encode()) for c in SYMBOLS), dups, repeats, failed, share, not failed and share >= CONTENT_SHARE


def quality_rules(docs: DataFrame, text_col: str = "text", potentials: Potentials = Potentials()) -> DataFrame:
    """docs with COLUMNS added. Rows, other columns and repeats stay as they are; null and empty texts have no words and fail the base rule; an empty table gives none."""

    docs = replaced(docs, *COLUMNS.names)

    def run(batches):
        for b in batches:
            rows = list(zip(*(assess(t, potentials) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()))) or [[] for _ in COLUMNS]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, k) for x, k in zip(rows, kinds))], [*b.schema.names, *COLUMNS.names])

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + COLUMNS.fields))
