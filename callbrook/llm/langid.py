"""Language identification by a byte convolutional network.

Filters of several widths slide over byte embeddings, their largest response in a window is kept, and a softmax layer turns these
into language probabilities.  The network is trained here, in numpy, on labelled texts.  A text is cut into windows of fixed
length; its probabilities are the mean over all its windows, weighted by their bytes.

Training reads at most ``per_class`` texts of each language (a documented bound), picked by hash over the whole table, and
``views`` windows at hashed places of each.  Everything else covers all rows and whole texts.

Defined results: a null text or one without a letter is ``und`` with score 0; a null id is not held out and not learned from;
repeated rows get equal results; an empty table gives an empty table, and without labelled rows every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, PER_CLASS, VIEWS, MOST_CLASSES = 256, 600, 3, 256
WIDTHS, FILTERS, SIZE = (2, 3, 4), 16, 8
RESULT = "lang_pred string, score double"


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Network:
    """Embedding, filters (all widths in one matrix, narrow ones padded with zeros) and softmax layer."""

    def __init__(self, classes: Sequence[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes, self.wide, n = list(classes), max(WIDTHS), len(WIDTHS) * FILTERS
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.p = {"emb": rng.normal(0, 0.3, (256, SIZE)), "filt": rng.normal(0, 0.3, (self.wide * SIZE, n)),
                  "out": rng.normal(0, 0.1, (n, len(self.classes))), "bias": np.zeros(len(self.classes))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.open = np.repeat(np.concatenate([np.arange(self.wide)[:, None] < w for w in WIDTHS], 1), FILTERS, 1).repeat(SIZE, 0).astype(np.float32)
        self._close()

    def _close(self):
        self.p["emb"][0] = 0  # padding answers nothing
        self.p["filt"] *= self.open

    def _pooled(self, x: np.ndarray):
        n, length = x.shape
        e = np.zeros((n, length + self.wide - 1, SIZE), np.float32)
        e[:, :length] = self.p["emb"][x]
        flat = sliding_window_view(e.reshape(n, -1), self.wide * SIZE, axis=1)[:, ::SIZE]
        cols = flat.reshape(n * length, self.wide * SIZE)
        return cols, (cols @ self.p["filt"]).reshape(n, length, -1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        top = np.maximum(self._pooled(x)[1].max(axis=1), 0)
        z = top @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 4e-3, seed: int = 6):
        """Adam on the cross-entropy, as many steps for few windows as for many; half the windows of a batch are shortened, so
        that short texts are learned too."""
        rng = np.random.default_rng(seed)
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        t = 0
        weight = (len(y) / (len(self.classes) * np.maximum(1, np.bincount(y, minlength=len(self.classes)))))[y].astype(np.float32)
        while t < steps:
            order = rng.permutation(len(x))
            for at in range(0, min(len(x), (steps - t) * batch), batch):
                rows = order[at:at + batch]
                b = x[rows].copy()
                for i in np.flatnonzero(rng.random(len(b)) < 0.5):
                    b[i, rng.integers(8, WINDOW):] = 0
                cols, act = self._pooled(b)
                n, length, f = act.shape
                where = act.argmax(axis=1)
                top = np.take_along_axis(act, where[:, None], 1)[:, 0]
                relu = np.maximum(top, 0)
                z = relu @ self.p["out"] + self.p["bias"]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                d = z / z.sum(axis=1, keepdims=True)
                d[np.arange(n), y[rows]] -= 1
                d *= (weight[rows] / n)[:, None]
                back = (d @ self.p["out"].T) * (top > 0)
                used = cols[(np.arange(n)[:, None] * length + where).ravel()].reshape(n, f, -1)
                into = back[:, :, None] * self.p["filt"].T[None]
                emb = np.zeros_like(self.p["emb"])
                padded = np.zeros((n, length + self.wide - 1), np.uint8)
                padded[:, :length] = b
                for k in range(self.wide):
                    byte = padded[np.arange(n)[:, None], where + k]
                    np.add.at(emb, byte.ravel(), into[:, :, k * SIZE:(k + 1) * SIZE].reshape(-1, SIZE))
                grad = {"out": relu.T @ d, "bias": d.sum(0), "filt": np.einsum("nf,nfk->kf", back, used), "emb": emb}
                t += 1
                lr = rate * (1 - (t - 1) / steps)
                for k, g in grad.items():
                    m, v = state[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
                self._close()
        return self

    def of_texts(self, data: np.ndarray, offsets: np.ndarray, step: int = 96) -> np.ndarray:
        """Mean probabilities of the texts that lie between the offsets."""
        lengths = np.diff(offsets)
        count = np.maximum(1, -(-lengths // WINDOW))
        text = np.repeat(np.arange(len(lengths)), count)
        k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start = offsets[:-1][text] + WINDOW * k
        valid = np.minimum(WINDOW, offsets[1:][text] - start)
        total = np.zeros((len(lengths), len(self.classes)))
        for at in range(0, len(text), step):
            part = slice(at, at + step)
            place = start[part][:, None] + np.arange(WINDOW)
            x = self.fold[data[np.minimum(place, max(0, len(data) - 1))]]
            x[np.arange(WINDOW) >= valid[part][:, None]] = 0
            np.add.at(total, text[part], self.probabilities(x) * np.maximum(1, valid[part])[:, None])
        return total / np.maximum(1e-30, total.sum(axis=1, keepdims=True))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_class: int = PER_CLASS, views: int = VIEWS,
        most_classes: int = MOST_CLASSES) -> Network | None:
    """Train on a bounded sample of the labelled rows that are not held out."""
    usable = docs.filter(F.col(lang).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.rlike(text, F.lit(r"\p{L}")))
    sizes = {r[0]: r[1] for r in usable.groupBy(lang).count().orderBy(lang).limit(most_classes + 1).collect()}
    if len(sizes) > most_classes:
        raise ValueError(f"more than {most_classes} languages")
    if not sizes:
        return None
    share = F.create_map(*(F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, per_class / n))))[F.col(lang)]
    raw = F.encode(F.col(text).cast("string"), "utf-8")
    room = F.greatest(F.octet_length(raw) - WINDOW, F.lit(0)) + 1
    view = F.array(*(F.substring(raw, (F.pmod(F.xxhash64(id_col, F.lit(k)), room) + 1).cast("int"), WINDOW) for k in range(views)))
    picked = usable.filter(F.shiftrightunsigned(F.xxhash64(id_col, F.lit("learn")), 11) * F.lit(2.0 ** -53) < share)
    rows = picked.select(F.col(id_col).alias("i"), F.col(lang).alias("lang"), view.alias("views")).limit(2 * per_class * len(sizes)).collect()
    net = Network(list(sizes))
    cases = sorted((r.i, r.lang, bytes(v)) for r in rows for v in r.views)
    x = np.zeros((len(cases), WINDOW), np.uint8)
    for k, (_, _, v) in enumerate(cases):
        x[k, :len(v)] = net.fold[np.frombuffer(v, np.uint8)]
    return net.train(x, np.array([net.classes.index(c) for _, c, _ in cases]))


def detect(text: Column, net: Network | None, spark) -> Column:
    """``struct<lang_pred, score>`` for whole texts."""
    none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if net is None:
        return none
    shared = spark.sparkContext.broadcast(net)  # some tens of kB

    @F.arrow_udf(RESULT)
    def apply(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            names, scores = [], []
            for at in range(0, len(part), 512):
                s = pa.concat_arrays([part.slice(at, 512)]).cast(pa.large_string())
                offsets = np.frombuffer(s.buffers()[1], np.int64)[s.offset:s.offset + len(s) + 1]
                data = np.frombuffer(s.buffers()[2] or b"\0", np.uint8)
                p = shared.value.of_texts(data, offsets)
                best = p.argmax(axis=1)
                names += [shared.value.classes[k] for k in best]
                scores.append(np.minimum(1.0, p[np.arange(len(p)), best]))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang_pred", "score"])

    lettered = F.coalesce(F.rlike(text.cast("string"), F.lit(r"\p{L}")), F.lit(False))
    return F.when(lettered, apply(F.when(lettered, text.cast("string")).otherwise(F.lit("")))).otherwise(none)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document."""
    net = fit(docs, text, lang, id_col, per_class)
    return docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), detect(F.col(text), net, docs.sparkSession).alias("d")) \
        .select("doc_id", "held_out", "d.lang_pred", "d.score")


def keep_identified(docs: DataFrame, least: float = 0.4, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The documents whose language is told with at least ``least``; columns as they were."""
    net = fit(docs, text, lang, id_col)
    tagged = docs.select(F.struct("*").alias("doc"), detect(F.col(text), net, docs.sparkSession).alias("d"))
    return tagged.filter((F.col("d.lang_pred") != "und") & (F.col("d.score") >= least)).select("doc.*")
