"""Toxicity scores from a convolutional text classifier trained in numpy.

Words are hashed to rows of an embedding table: the word as a whole and its
first four and five letters, whose rows are added, so unseen inflections of a
stem are known.  Filters of several widths run
over the whole text, each filter keeps its maximum, and a logistic layer turns
the maxima into a score.  Gradients reach a filter only at the position of its
maximum, so training costs little more than a forward pass.

Training reads every labelled row.  A hash of the id deals the rows into parts
of about ``max_rows``; each part trains a model of its own from the same start,
and the model is their mean, an embedding row that of the parts that learnt it.
Means are of whole numbers, so they do not depend on the order of parts.  Slope,
intercept and thresholds come from all rows that were kept aside, counted by
language and log-odds to a thousandth, of which there are few at any size.
Scoring covers every word of every text; a text is run in
stretches that overlap by the widest filter, so memory is bounded and no
window is missed.  The language sets only thresholds, never a score.

Edge cases: a null or empty text has no window and gets the score of zero
maxima; a text shorter than a filter is padded with the empty word; rows with a
null label are not learnt from; repeated rows get equal scores, but for the last
places of single precision; an empty table
gives no rows; with one class only in the labels the score is that class's
rate; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The word rule of this classifier: letters and digits, lower-cased.
WORDS = re.compile(r"[^\W_]+", re.UNICODE)
WIDTHS = (1, 2, 3)
#: Rows that make a word: itself, its first four and its first five letters.
PARTS = 3


@dataclass(frozen=True)
class Settings:
    """Size of the model and of its training."""

    buckets: int = 1 << 16
    dim: int = 12
    filters: int = 12
    epochs: int = 5
    rate: float = 0.05
    batch: int = 32
    l2: float = 1e-5
    max_rows: int = 4000  # of a part
    stretch: int = 1 << 16
    seed: int = 7


class TextCNN:
    """Hashed embeddings, filters of ``WIDTHS``, max pooling, one logistic unit."""

    def __init__(self, s: Settings) -> None:
        rng = np.random.default_rng(s.seed)
        self.s = s
        self.emb = rng.normal(0, 0.3, (s.buckets, s.dim)).astype(np.float32)
        self.emb[0] = 0  # the empty word
        self.conv = [rng.normal(0, (1 / (w * s.dim)) ** 0.5, (w, s.dim, s.filters)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(s.filters, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, len(WIDTHS) * s.filters).astype(np.float32)
        self.out0 = np.float32(0)
        self.scale, self.shift = 1.0, 0.0
        self._number: dict[str, int] = {}
        self._rows = np.zeros((1, PARTS), np.int32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_number": {}, "_rows": self._rows[:1]}

    def ids(self, text: str | None) -> np.ndarray:
        """Embedding rows of each word, padded to the widest filter; row 0 is of the empty word."""
        number, n = self._number, self.s.buckets - 1
        if len(number) > 400_000:
            number.clear()
        out = []
        for w in WORDS.findall((text or "").lower()):
            i = number.get(w)
            if i is None:
                i = number[w] = len(number) + 1
                if i >= len(self._rows):
                    self._rows = np.concatenate([self._rows, np.zeros((len(self._rows) + 1024, PARTS), np.int32)])
                self._rows[i] = [1 + zlib.crc32(x.encode("utf-8", "surrogatepass")) % n if x else 0 for x in (w, "4" + w[:4] if len(w) > 4 else "", "5" + w[:5] if len(w) > 5 else "")]
            out.append(i)
        out += [0] * (WIDTHS[-1] - len(out))
        return self._rows[np.array(out, dtype=np.int64)]

    def embedded(self, ids: np.ndarray) -> np.ndarray:
        """Vectors of words: the sum of their rows."""
        e = self.emb[ids[:, 0]]
        for k in range(1, PARTS):
            e += self.emb[ids[:, k]]
        return e

    def filtered(self, e: np.ndarray, k: int) -> np.ndarray:
        """Outputs of the filters of one width at every place."""
        w = WIDTHS[k]
        n = len(e) - w + 1
        h = e[:n] @ self.conv[k][0]
        for j in range(1, w):
            h += e[j : j + n] @ self.conv[k][j]
        return h

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter over a text, and where it is."""
        best = np.full(len(self.out), -np.inf, np.float32)
        where = np.zeros(len(self.out), np.int64)
        f, step = self.s.filters, self.s.stretch
        for lo in range(0, len(ids), step):
            e = self.embedded(ids[lo : lo + step + WIDTHS[-1] - 1])
            for k, w in enumerate(WIDTHS):
                if len(e) < w:
                    continue
                h = self.filtered(e, k)
                at = h.argmax(0)
                top, cols = h[at, np.arange(f)] + self.bias[k], slice(k * f, k * f + f)
                better = top > best[cols]
                where[cols] = np.where(better, at + lo, where[cols])
                best[cols] = np.where(better, top, best[cols])
        return best, where

    def maxima(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Pooled maxima of several texts laid end to end; ``first`` has where each begins."""
        e, out = self.embedded(ids), []
        last = np.append(first[1:], len(ids)) - 1
        for k, w in enumerate(WIDTHS):
            h = self.filtered(e, k)
            if w > 1:  # windows over the end of a text count for none
                cut = (last[:, None] - np.arange(w - 1)).ravel()
                h[cut[cut < len(h)]] = -np.inf
            out.append(np.maximum.reduceat(h, first, axis=0) + self.bias[k])
        return np.concatenate(out, axis=1)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated log-odds of each text; texts are run in groups of about a stretch of words."""
        out = np.zeros(len(texts))
        group: list[np.ndarray] = []
        members: list[int] = []

        def run() -> None:
            if group:
                first = np.concatenate([[0], np.cumsum([len(g) for g in group])[:-1]]).astype(np.int64)
                out[members] = np.maximum(self.maxima(np.concatenate(group), first), 0) @ self.out + self.out0
                group.clear()
                members.clear()

        total = 0
        for i, t in enumerate(texts):
            x = self.ids(t)
            if len(x) > self.s.stretch:
                out[i] = np.maximum(self.pooled(x)[0], 0) @ self.out + self.out0
                continue
            group.append(x)
            members.append(i)
            total += len(x)
            if total >= self.s.stretch:
                run()
                total = 0
        run()
        return out * self.scale + self.shift

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores between 0 and 1."""
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30)))

    def gradient(self, ids: np.ndarray, y: float) -> tuple:
        """Gradients of the log loss of one text: output weights, intercept, filters, their biases, and embedding rows with theirs.

        A filter has a gradient only at the place of its maximum.
        """
        m, where = self.pooled(ids)
        a, f = np.maximum(m, 0), self.s.filters
        d = np.float32(1 / (1 + np.exp(-np.clip(self.out @ a + self.out0, -30, 30))) - y)
        back = d * self.out * (m > 0)
        d_conv, d_bias, rows, grads = [], [], [], []
        for k, w in enumerate(WIDTHS):
            g, at = back[k * f : k * f + f], where[k * f : k * f + f]
            window = ids[at[:, None] + np.arange(w)]  # filters, places, parts
            d_conv.append(np.einsum("q,qwd->wdq", g, self.emb[window].sum(2)))
            d_bias.append(g)
            rows.append(window.reshape(-1, PARTS))
            grads.append(np.einsum("q,wdq->qwd", g, self.conv[k]).reshape(-1, self.s.dim))
        return d * a, d, d_conv, d_bias, rows, grads

    def fit(self, texts: list[str | None], labels: np.ndarray, aside: np.ndarray | None = None) -> TextCNN:
        """Adagrad on the log loss; then a slope and an intercept from the rows in ``aside``, every fifth unless given."""
        s, rng = self.s, np.random.default_rng(self.s.seed)
        y = np.asarray(labels, dtype=np.float32)
        rate = float(y.mean()) if len(y) else 0.0
        if not 0 < rate < 1:
            self.out[:] = 0
            self.out0 = np.float32(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
            return self
        docs = [self.ids(t) for t in texts]
        aside = kept_aside(len(y)) if aside is None else aside
        train = np.flatnonzero(~aside)
        self.out0 = np.float32(np.log(rate / (1 - rate)))
        g_emb = np.full(s.buckets, 1e-6, np.float32)
        g_conv = [np.full_like(c, 1e-6) for c in self.conv]
        g_bias = [np.full_like(b, 1e-6) for b in self.bias]
        g_out, g_out0 = np.full_like(self.out, 1e-6), 1e-6
        for epoch in range(s.epochs):
            rng.shuffle(train)
            lr = s.rate if epoch < s.epochs - 2 else s.rate / 4
            for b in range(0, len(train), s.batch):
                d_out, d_out0 = np.zeros_like(self.out), 0.0
                d_conv, d_bias = [np.zeros_like(c) for c in self.conv], [np.zeros_like(x) for x in self.bias]
                rows, grads = [], []
                for i in train[b : b + s.batch]:
                    one = self.gradient(docs[i], y[i])
                    d_out += one[0]
                    d_out0 += one[1]
                    for k in range(len(WIDTHS)):
                        d_conv[k] += one[2][k]
                        d_bias[k] += one[3][k]
                    rows += one[4]
                    grads += one[5]
                n = np.float32(1 / s.batch)
                g_out += (d_out * n) ** 2
                self.out -= lr * (d_out * n + s.l2 * self.out) / np.sqrt(g_out)
                g_out0 += (d_out0 * n) ** 2
                self.out0 -= np.float32(lr * d_out0 * n / g_out0**0.5)
                for k in range(len(WIDTHS)):
                    g_conv[k] += (d_conv[k] * n) ** 2
                    self.conv[k] -= lr * (d_conv[k] * n) / np.sqrt(g_conv[k])
                    g_bias[k] += (d_bias[k] * n) ** 2
                    self.bias[k] -= lr * (d_bias[k] * n) / np.sqrt(g_bias[k])
                every, back_to = np.unique(np.concatenate(rows).ravel(), return_inverse=True)
                v = np.zeros((len(every), s.dim), np.float32)
                np.add.at(v, back_to, np.repeat(np.concatenate(grads), PARTS, axis=0) * n)
                v, every = v[every > 0], every[every > 0]
                g_emb[every] += (v * v).mean(1)
                self.emb[every] -= lr * v / np.sqrt(g_emb[every])[:, None]
        self._calibrate(self.logits([texts[i] for i in np.flatnonzero(aside)]), y[aside])
        return self

    def params(self) -> list[np.ndarray]:
        """What is learnt besides the embedding rows, in a fixed order."""
        return [*self.conv, *self.bias, self.out]

    def table(self) -> np.ndarray:
        """All that is learnt, as rows of ``dim`` values: embedding rows, then the rest laid end to end and padded."""
        rest = np.concatenate([*[x.ravel() for x in self.params()], [self.out0]]).astype(np.float64)
        return np.concatenate([self.emb, np.pad(rest, (0, -len(rest) % self.s.dim)).reshape(-1, self.s.dim)]).astype(np.float64)

    def load(self, table: np.ndarray) -> None:
        """Take over what ``table`` gave."""
        self.emb = table[: self.s.buckets].astype(np.float32)
        rest, at = table[self.s.buckets :].ravel(), 0
        for x in self.params():
            x[:] = rest[at : at + x.size].reshape(x.shape)
            at += x.size
        self.out0 = np.float32(rest[at])

    def _calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> None:
        """Slope and intercept by Newton steps on the rows kept aside (Platt), with smoothed targets; each counts ``n`` times."""
        n = np.ones(len(y)) if n is None else n
        n1, n0 = (n * y).sum(), (n * (1 - y)).sum()
        if not (n1 and n0):
            return
        t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a, c = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
            w = n * (p * (1 - p) + 1e-9)
            grad = np.array([(n * (p - t) * z).sum() + 1e-3 * (a - 1), (n * (p - t)).sum()])
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]])
            step = np.linalg.solve(hess, grad)
            a, c = a - step[0], c - step[1]
            if np.abs(step).max() < 1e-8:
                break
        if a > 0:
            self.scale, self.shift = float(a), float(c)


def kept_aside(n: int) -> np.ndarray:
    """Which of ``n`` rows no weight is learnt from: every fifth, for calibration."""
    return np.arange(n) % 5 == 4


def language_thresholds(scores: np.ndarray, labels: np.ndarray, langs: list[str | None], default: float = 0.3, least: int = 5, counts: np.ndarray | None = None) -> dict[str, float]:
    """For each language ("" for none), the threshold with the best F1 on rows that were kept aside; none where toxic rows are few.

    With ``counts`` an entry stands for so many rows, of which ``labels`` are toxic.
    """
    out = {}
    names = np.array([x if x is not None else "" for x in langs], dtype=object)
    for lang in sorted(set(names)):
        own = names == lang
        s, y, n = scores[own], labels[own], np.ones(own.sum()) if counts is None else counts[own]
        if y.sum() < least or n.sum() == y.sum():
            continue
        order = np.argsort(-s, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.cumsum(n[order]) + y.sum())
        k = int(f1.argmax())
        low = s[order[k + 1]] if k + 1 < len(y) else 0.0
        out[lang] = float((s[order[k]] + low) / 2)
    return {k: v if 0 < v < 1 else default for k, v in out.items()}


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(text, label, lang) of all labelled documents; labels grow with the input, so they are merged, not broadcast."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"))
    return docs.join(rows.hint("merge"), F.col(id_col) == F.col("__id")).select(F.xxhash64("__id").alias("__h"), "__id", F.col(text_col).alias("text"), F.col("__label").cast("int").alias("label"), F.col(lang_col).alias("lang"))


def sample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """As ``labelled``, of at most ``max_rows`` labels, the first by a hash of the id; for trials only."""
    few = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(settings.max_rows)
    return labelled(docs, few, id_col, label_col, text_col, lang_col)


#: Fixed point of what parts have learnt, and of log-odds.
POINT, FINE = 1 << 24, 1000


def fit(rows: DataFrame, settings: Settings = Settings()) -> tuple[TextCNN, dict[str, float]]:
    """Train on all rows of ``labelled``, in parts; thresholds by language."""
    n, toxic = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    model = TextCNN(settings)
    if not 0 < (toxic or 0) < n:
        return model.fit([], np.repeat([0.0, 1.0], [n - (toxic or 0) > 0, (toxic or 0) > 0])), {}
    aside = F.pmod("__h", F.lit(5)) == 4
    parts = -(-n // settings.max_rows)
    dealt = rows.where(~aside).select(F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(parts)).alias("part"), "__h", "__id", "text", "label")

    def train(t: pa.Table) -> pa.Table:
        t = t.sort_by([("__h", "ascending"), ("__id", "ascending"), ("label", "ascending"), ("text", "ascending")])
        m, y = TextCNN(settings), t.column("label").to_numpy().astype(np.float32)
        start = m.table()
        changed, found = np.zeros(0, np.int64), np.zeros((0, settings.dim), np.int64)
        if 0 < y.sum() < len(y):  # a part of one class teaches nothing
            m.fit(t.column("text").to_pylist(), y, aside=np.zeros(len(y), bool))
            found = m.table()
            changed = np.flatnonzero((found != start).any(axis=1) | (np.arange(len(found)) >= settings.buckets))
            found = np.rint(found[changed] * POINT).astype(np.int64)
        cols = [pa.array(changed), *[pa.array(found[:, k]) for k in range(settings.dim)]]
        return pa.Table.from_arrays(cols, names=["row", *names])

    names = [f"v{k}" for k in range(settings.dim)]
    learnt = dealt.groupBy("part").applyInArrow(train, "row long, " + ", ".join(f"{v} long" for v in names))
    mean = learnt.groupBy("row").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(v) for v in names]).toPandas()
    table = model.table()
    if len(mean):
        table[mean["row"].to_numpy()] = mean[names].to_numpy() / mean[["n"]].to_numpy() / POINT
        model.load(table)
    else:
        model.out[:], model.out0 = 0, np.float32(np.log(toxic / (n - toxic)))
    kept = scored(rows.where(aside), model, ["label", "lang"], logits=True)
    seen = kept.groupBy("lang", F.rint(F.col("score") * FINE).cast("long").alias("z")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).orderBy("lang", "z").toPandas()
    z, count, hit = seen["z"].to_numpy(float) / FINE, seen["n"].to_numpy(float), seen["toxic"].to_numpy(float)
    model._calibrate(np.tile(z, 2), np.repeat([1.0, 0.0], len(z)), np.concatenate([hit, count - hit]))
    score = 1 / (1 + np.exp(-np.clip(z * model.scale + model.shift, -30, 30)))
    return model, language_thresholds(score, hit, list(seen["lang"]), counts=count)


def scored(df: DataFrame, model: TextCNN, keep: list[str], text_col: str = "text", logits: bool = False) -> DataFrame:
    """``keep`` columns and ``score`` of every row, or its log-odds; one Arrow pass, no shuffle.

    The model (a few MB, bounded by ``Settings``) is a broadcast variable.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = df.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            found = pa.array((m.logits if logits else m.scores)(b.column("__text").to_pylist()), type=pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], found], names=[*keep, "score"])

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)
