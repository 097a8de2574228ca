"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of kinds of bytes and a few counts, its own and those of the lines
before and after it; two transition weights tie neighbours. Trained on lines that carry their document's label, by
gradient ascent on the likelihood that the forward-backward recursion gives. A document's quality is the mean of its
lines' marginals, weighted by length, put on a scale by a logistic fit on the same sample.

Training reads a bounded sample of labelled rows: of at most ``sample`` documents, the first by a hash of the id, all
lines, as windows of at most ``window`` lines in a row, of which the first ``sample`` * 4 by a hash are fitted. A window is
a chain of its own, so no two lines count as neighbours that aren't. Scoring reads every line of every document.

A null or empty text is one empty line and has a score as well. Null ids and repeated rows are scored each. Labels
without a quality, and labels of no document, don't count; of several labels of one document the least does. Without
any usable label all scores are 0.5. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import ids_and_text, slices, small_batches

#: Kinds of bytes, by their characters; bytes of longer characters are the last kind.
_KINDS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\f\v", ".,;:'\"-()?", "!", "|", "#$%&*+=", "<>@^_~\\/{}[]`"]
_OTHER = len(_KINDS)
_KIND_OF = np.full(256, _OTHER, dtype=np.uint8)
for _k, _chars in enumerate(_KINDS):
    _KIND_OF[[ord(c) for c in _chars]] = _k
_OWN = len(_KINDS) + 1 + 5
N_FEATURES = 3 * _OWN
#: Bytes of texts (one at least) whose lines are looked at together.
_SLICE_BYTES = 256 << 10
_WEIGHT = np.random.default_rng(5).integers(1, 1 << 62, size=(256,), dtype=np.uint64) | np.uint64(1)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (float32), their lengths in bytes, and the first line of each text (with the end)."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.r_[0, ends[:-1] + 1]
    sizes = ends - starts
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    first = np.r_[0, np.searchsorted(ends, text_ends - 1) + 1]
    kinds = _KIND_OF[data]
    size = np.maximum(sizes, 1).astype(np.float32)
    out = np.zeros((len(ends), _OWN), dtype=np.float32)
    kinds[ends] = 255
    for k in range(_OTHER + 1):
        out[:, k] = np.add.reduceat((kinds == k).view(np.uint8), starts, dtype=np.int32) / size
    # words: runs without white space; hashes by place in the word
    white = (kinds == 3) | (kinds == 255)
    begin = np.flatnonzero(~white & np.r_[True, white[:-1]])
    if len(begin):
        stop = np.flatnonzero(~white & np.r_[white[1:], True]) + 1
        length = stop - begin
        place = np.arange(len(data)) - np.repeat(begin, np.diff(np.r_[begin, len(data)]))[np.maximum(np.arange(len(data)) - begin[0], 0)] if begin[0] == 0 else None
        if place is None:
            place = np.arange(len(data)) - np.r_[np.zeros(begin[0], np.int64), np.repeat(begin, np.diff(np.r_[begin, len(data)]))]
        mixed = _WEIGHT[data] * (2 * (place.astype(np.uint64) & np.uint64(63)) + np.uint64(1))
        mixed[white] = 0
        hashes = np.add.reduceat(mixed, begin)
        line = np.searchsorted(starts, begin, side="right") - 1
        words = np.bincount(line, minlength=len(ends)).astype(np.float32)
        same = np.r_[False, (hashes[1:] == hashes[:-1]) & (np.searchsorted(text_ends, begin[1:], side="right") == np.searchsorted(text_ends, begin[:-1], side="right"))]
        some = np.maximum(words, 1)
        out[:, _OTHER + 1] = np.bincount(line, weights=same, minlength=len(ends)) / some
        out[:, _OTHER + 2] = np.bincount(line, weights=length, minlength=len(ends)) / some / 10
        upper = (kinds == 0).astype(np.int32)
        capitals = np.add.reduceat(upper, begin)
        out[:, _OTHER + 3] = np.bincount(line, weights=(capitals >= 2), minlength=len(ends)) / some
        last_kind = kinds[stop - 1]
        out[:, _OTHER + 4] = np.bincount(line, weights=(last_kind >= 5) & (last_kind <= 8), minlength=len(ends)) / some
        # words of a line that its text has met before within the last 64 words
        out[:, _OTHER + 5] = np.bincount(line, weights=_repeats(hashes, np.searchsorted(text_ends, begin, side="right")), minlength=len(ends)) / some
    before, after = np.zeros_like(out), np.zeros_like(out)
    before[1:] = out[:-1]
    after[:-1] = out[1:]
    before[first[:-1]] = out[first[:-1]]
    after[first[1:] - 1] = out[first[1:] - 1]
    return np.concatenate([out, before, after], axis=1), sizes, first


def _repeats(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether a word's two-word start (itself and the next) came up to 64 words before in the same text."""
    pair = hashes * np.uint64(3) + np.r_[hashes[1:], np.zeros(1, np.uint64)] * np.uint64(7)
    order = np.lexsort((np.arange(len(pair)), pair))
    near = np.zeros(len(pair), dtype=bool)
    a, b = order[:-1], order[1:]
    hit = (pair[a] == pair[b]) & (text[a] == text[b]) & (b - a <= 64)
    near[b[hit]] = True
    return near


@dataclass
class LineCRF:
    """``weights`` and ``bias`` give a line's log-odds of good; ``good`` and ``bad`` are the weights of two good and of
    two bad lines in a row, against a change; ``scale`` and ``shift`` put a document's mean on its scale."""

    weights: np.ndarray
    bias: float
    good: float
    bad: float
    scale: float = 1.0
    shift: float = 0.0

    def marginals(self, odds: list[float]) -> list[float]:
        """Probability of good for every line of one document, by forward and backward messages (as log-odds)."""
        good, bad, n = exp(self.good), exp(self.bad), len(odds)
        forward = [0.0] * n
        m = 0.0
        for t in range(1, n):
            m = self._message(odds[t - 1] + m, good, bad)
            forward[t] = m
        out, m = [0.0] * n, 0.0
        for t in range(n - 1, -1, -1):
            z = odds[t] + forward[t] + m
            out[t] = 1 / (1 + exp(-z)) if z > -700 else 0.0
            m = self._message(odds[t] + m, good, bad)
        return out

    @staticmethod
    def _message(z: float, good: float, bad: float) -> float:
        """Log-odds that a line with log-odds ``z`` sends to its neighbour."""
        if z > 0:
            e = exp(-z)
            return np_log((good + e) / (1 + bad * e))
        e = exp(z)
        return np_log((good * e + 1) / (e + bad))

    def score(self, texts: list[str]) -> list[float]:
        x, sizes, first = features(texts)
        odds = np.clip(x @ self.weights + self.bias, -30, 30).tolist()
        out = []
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            p = self.marginals(odds[a:z])
            w = (sizes[a:z] + 1).tolist()
            out.append(self.on_scale(sum(x * y for x, y in zip(p, w, strict=True)) / sum(w)))
        return out

    def on_scale(self, mean: float) -> float:
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        z = self.scale * float(np.log(mean / (1 - mean))) + self.shift
        return 1 / (1 + exp(-min(max(z, -50.0), 50.0)))


def np_log(x: float) -> float:
    return log1p(x - 1)


def train(sequences: list[np.ndarray], sizes: list[np.ndarray], labels: list[int], steps: int = 120, rate: float = 0.08, decay: float = 1e-4) -> LineCRF:
    """Fits to sequences of line features, all lines of one labelled as it is. Documents count alike: the gradient of
    one is divided by the root of its number of lines."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    n = np.array([len(sequences[i]) for i in order])
    y = np.array([labels[i] for i in order], dtype=float)
    longest = int(n[0])
    active = [(n > t).sum() for t in range(longest)]
    flat = np.concatenate([np.stack([sequences[i][t] for i in order[: active[t]]]) for t in range(longest)]).astype(np.float64)
    mean, spread = flat.mean(axis=0), flat.std(axis=0) + 1e-3
    flat = (flat - mean) / spread
    at = np.r_[0, np.cumsum(active)]
    share = 1 / np.sqrt(n)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)) if 0 < y.mean() < 1 else np.ones(len(y))
    weight = share * balance
    p = np.zeros(flat.shape[1] + 3)
    p[-2:] = 0.5
    m = v = np.zeros_like(p)
    for step in range(1, steps + 1):
        odds = np.clip(flat @ p[:-3] + p[-3], -30, 30)
        # potentials: transitions good-good p[-2], bad-bad p[-1], changes 0
        forward = [np.zeros(active[0])]
        for t in range(1, longest):
            z = (odds[at[t - 1] : at[t]] + forward[t - 1])[: active[t]]
            forward.append(np.logaddexp(z + p[-2], 0) - np.logaddexp(z, p[-1]))
        gradient = np.zeros_like(p)
        back = np.zeros(0)
        residual = np.zeros(len(odds))
        for t in range(longest - 1, -1, -1):
            back = np.r_[back, np.zeros(active[t] - len(back))]
            own = odds[at[t] : at[t + 1]]
            q = 1 / (1 + np.exp(-(own + forward[t] + back)))
            residual[at[t] : at[t + 1]] = (y[: active[t]] - q) * weight[: active[t]]
            if t:
                k = active[t]
                left, right = (odds[at[t - 1] : at[t]] + forward[t - 1])[:k], own + back
                gg, bb = left + right + p[-2], p[-1]
                total = np.logaddexp(np.logaddexp(gg, bb), np.logaddexp(left, right))
                gradient[-2] += ((y[:k] - np.exp(gg - total)) * weight[:k]).sum()
                gradient[-1] += ((1 - y[:k] - np.exp(bb - total)) * weight[:k]).sum()
                back = np.logaddexp(right + p[-2], 0) - np.logaddexp(right, p[-1])
        gradient[:-3] = flat.T @ residual
        gradient[-3] = residual.sum()
        gradient = gradient / weight.sum() - decay * p
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        p = p + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        p[-2:] = np.clip(p[-2:], -1.0, 3.0)
    w = p[:-3] / spread
    crf = LineCRF(w, float(p[-3] - mean @ w), float(p[-2]), float(p[-1]))
    means = []
    for i in order:
        q = np.array(crf.marginals(np.clip(sequences[i] @ w + crf.bias, -30, 30).tolist()))
        means.append(float(np.average(q, weights=sizes[i] + 1)))
    z = np.log(np.clip(means, 1e-6, 1 - 1e-6)) - np.log(1 - np.clip(means, 1e-6, 1 - 1e-6))
    a, b = 1.0, 0.0
    for _ in range(300):  # logistic fit, a few numbers
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        a = max(0.05, a + 0.05 * float(((y - q) * z).mean() - 0.01 * (a - 0.5)))
        b += 0.2 * float((y - q).mean())
    crf.scale, crf.shift = a, b
    return crf


def fit(docs: DataFrame, labels: DataFrame, kept: Column, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, window: int = 200) -> LineCRF | None:
    """Fits on labelled documents for which ``kept`` (a condition on the label's id) holds."""
    known = labels.filter(kept & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    some = known.orderBy(F.xxhash64(F.lit(11), F.col(id_col)), id_col).limit(sample)
    plain = ids_and_text(docs, id_col, text_col)
    picked = plain.join(F.broadcast(some), id_col).select(F.col(text_col).alias("text"), F.col("_label").cast("int").alias("label"), F.col(id_col).cast("long").alias("id"))
    arrow = pa.schema([("id", pa.int64()), ("at", pa.int32()), ("label", pa.int32()), ("x", pa.binary()), ("sizes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop in slices(b.column(0), _SLICE_BYTES):
                rows = b.slice(start, stop - start)
                x, sizes, first = features(rows.column(0).to_pylist())
                out = []
                for a, z, label, i in zip(first[:-1].tolist(), first[1:].tolist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                    for k in range(a, z, window):
                        end = min(z, k + window)
                        out.append({"id": i, "at": (k - a) // window, "label": label, "x": x[k:end].astype("<f4").tobytes(), "sizes": sizes[k:end].astype("<i8").tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    windows = picked.mapInArrow(run, "id long, at int, label int, x binary, sizes binary")
    rows = windows.orderBy(F.xxhash64(F.lit(11), "id", "at"), "id", "at", "x").limit(4 * sample).collect()
    rows.sort(key=lambda r: (r["id"], r["at"], r["x"]))
    if not rows:
        return None
    return train([np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES) for r in rows], [np.frombuffer(r["sizes"], "<i8") for r in rows], [r["label"] for r in rows])


def score(docs: DataFrame, crf: LineCRF | None, *, id_col: str = "doc_id", text_col: str = "text", into: str = "score") -> DataFrame:
    """All columns and each document's quality, 0 to 1. There is no shuffle, and only texts and scores go to Python and
    back."""
    others = [c for c in docs.columns if c != into]
    if crf is None:
        return docs.select(*others).withColumn(into, F.lit(0.5))

    def run(batches):
        for texts in batches:
            parts = [crf.score(texts.slice(start, stop - start).to_pylist()) for start, stop in slices(texts, _SLICE_BYTES)]
            yield pa.array([x for p in parts for x in p], pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}  # Spark reads types, not their names
    small_batches(docs.sparkSession)
    quality = F.arrow_udf(run, "double")(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(*others, quality.alias(into))
