"""Toxicity: a gap-weighted subsequence-kernel support vector machine on Nyström landmarks."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, slices

#: Labelled texts that training may read, toxic and clean alike. Bounds the fit, not what is scored.
TRAIN_TEXTS = 6000
#: Bytes of text that training may read in all: beyond them the last texts in the order of their hash are left out.
TRAIN_BYTES = 64_000_000
LANDMARKS = 128
ORDER, SPAN, DECAY = 3, 6, 0.6
WIDTH = 24
KINDS = 48
#: Distinct words kept with their margins within a task, about 150 bytes each.
CACHE_TOKENS = 200_000
SENTENCE = re.compile(r"[.!?]+\s+|\n+")
INNER = re.compile(r"[\W_]+")
EDGE = ".,;:!?()[]{}\"'«»“”…"
#: Index gaps of the subsequences of ORDER characters within SPAN places, with the weight of each.
GAPS = [(a, b, DECAY ** (a + b - 2)) for a in range(1, SPAN) for b in range(1, SPAN - a)]
#: Margins below are all the same: no such word decides a score.
FLOOR = -0.5


def _kind(code: int) -> int:
    c = chr(code)
    if "a" <= c <= "z":
        return code - 96
    return 27 if c.isdigit() else 29 + code % 18 if c.isalpha() else 47


#: Character classes of the code points below 65,536; all others are 47. 0 is no character, 28 a word's start.
KIND = np.array([0, *map(_kind, range(1, 1 << 16)), 47], np.int32)
START = 28


def tokens(text: str) -> set[str]:
    """Words without their outer punctuation, lower-cased; words with punctuation inside also without it; runs of three or more single characters also as one."""
    words = text.lower().split()
    out = {w.strip(EDGE) for w in set(words)}
    out.update([INNER.sub("", w) for w in out if not w.isalnum()])
    single = [k for k, w in enumerate(words) if len(w) == 1]
    run: list[int] = []
    for k in [*single, -9]:
        if run and k != run[-1] + 1:
            if len(run) > 2:
                out.add("".join(words[i] for i in run))
            run = []
        run.append(k)
    out.discard("")
    return out


def pieces(token: str) -> list[str]:
    """Windows of WIDTH characters over a long token."""
    return [token] if len(token) <= WIDTH else [token[i : i + WIDTH] for i in range(0, len(token) - WIDTH // 2, WIDTH // 2)]


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence codes (words x places) and their weights; weight 0 beyond a word's end."""
    width = max(map(len, words)) + 1
    grid = np.zeros((len(words), width + SPAN), np.int32)
    grid[:, 0] = [START if len(w) > 3 else 0 for w in words]
    grid[:, 1:width] = KIND[np.minimum(np.array(words, f"U{width - 1}").view(np.uint32).reshape(len(words), width - 1), 1 << 16)]
    out, weight = [], []
    for a, b, decay in GAPS:
        x, y, z = grid[:, :width], grid[:, a : a + width], grid[:, a + b : a + b + width]
        out.append((x * KINDS + y) * KINDS + z)
        weight.append(np.where(z > 0, np.float32(decay), np.float32(0)))
    return np.hstack(out), np.hstack(weight)


def norms(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square root of the kernel of each word with itself: weights of equal codes are summed first."""
    order = np.argsort(code, axis=1, kind="stable")
    c, w = np.take_along_axis(code, order, 1), np.take_along_axis(weight, order, 1)
    first = np.ones(c.shape, bool)
    first[:, 1:] = c[:, 1:] != c[:, :-1]
    group = np.cumsum(first.ravel()) - 1
    total = np.bincount(group, w.ravel())
    row = np.repeat(np.arange(len(c)), first.sum(axis=1))
    return np.sqrt(np.maximum(np.bincount(row, total**2, len(c)), 1e-12))


class Model:
    """A linear function of the subsequence kernels with the landmarks, folded into one weight a subsequence."""

    def __init__(self, table: np.ndarray, bias: float, slope: float, offset: float):
        self.table, self.bias, self.slope, self.offset = table, bias, slope, offset
        self.known: dict[str, float] = {}

    def margins(self, words: list[str]) -> np.ndarray:
        """Of each word its best window's margin, FLOOR at least. Norms are exact where a bound leaves the margin above FLOOR."""
        flat = [p for w in words for p in pieces(w)]
        of = np.array([k for k, w in enumerate(words) for _ in pieces(w)], np.int64)
        best = np.full(len(words), FLOOR)
        size = np.array(list(map(len, flat)))
        for low, high in ((0, 6), (6, 9), (9, 12), (12, 16), (16, WIDTH)):
            bucket = np.flatnonzero((size > low) & (size <= high))
            for at in range(0, len(bucket), 2048):
                rows = bucket[at : at + 2048]
                code, weight = codes([flat[k] for k in rows])
                raw = np.einsum("wp,wp->w", self.table[code], weight)
                # The norm is at least that of a word without repeated subsequences.
                f = raw / np.sqrt(np.maximum(np.einsum("wp,wp->w", weight, weight), 1e-12)) + self.bias
                near = np.flatnonzero(f > FLOOR)
                if len(near):
                    np.maximum.at(best, of[rows[near]], raw[near] / norms(code[near], weight[near]) + self.bias)
        return best

    def score(self, texts: list[str]) -> list[float]:
        """Probability of a toxic label: Platt's sigmoid of the largest margin of any token."""
        own = [tokens(t) for t in texts]
        new = set().union(*own).difference(self.known)
        if len(self.known) + len(new) > CACHE_TOKENS:
            self.known.clear()
            new = set().union(*own)
        if new:
            words = list(new)
            self.known.update(zip(words, self.margins(words).tolist(), strict=True))
        m = np.array([max(map(self.known.__getitem__, t), default=FLOOR) for t in own])
        return (1 / (1 + np.exp(-(self.slope * m + self.offset)))).tolist()


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear support vector machine, squared hinge loss, by accelerated gradient steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    reg = np.append(np.full(x.shape[1], ridge), 0)
    rate = 1 / (2 * np.linalg.norm(x1 * np.sqrt(weight)[:, None], 2) ** 2 + ridge)
    w = v = np.zeros(x1.shape[1])
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        new = v - rate * (reg * v - 2 * x1.T @ (weight * y * slack))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], w[-1]


def train(texts: list[str], toxic: list[int]) -> Model:
    """Fit on labelled texts, sentence by sentence.

    A text's label is that of its worst sentence, a sentence's that of its worst word. Words that stand
    out in toxic texts are the first witnesses and half of the landmarks; the hardest clean words found by
    each fit join the negatives of the next. Nyström features are k(x, landmarks) K^-1/2.
    """
    y = np.array(toxic)
    empty = Model(np.zeros(KINDS**3, np.float32), -1.0, 1.0, -2.0)
    if not (y == 1).any() or not (y == 0).any():
        return empty
    # Text by text, so that the driver holds the vocabulary and not every text's words.
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for t, v in zip(texts, toxic, strict=True):
        seen[v].update({p for s in SENTENCE.split(t) for w in tokens(s) for p in pieces(w)})
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    odds = {w: c * np.log((c + 0.5) / n1 * n0 / (seen[0][w] + 0.5)) for w, c in seen[1].items() if c / n1 > seen[0][w] / n0}
    ranked = sorted(odds, key=lambda w: (-odds[w], w))
    if not ranked:
        return empty
    # Witnesses: greedily, words that explain toxic texts, as long as they are rare in clean ones.
    witness = {w for w in ranked[:600] if seen[0][w] / n0 <= 0.2 * seen[1][w] / n1 and seen[1][w] > 1}
    positive = sorted(witness, key=lambda w: (-odds[w], w)) or ranked[:20]
    # Tolerance for inserted characters: each witness also with one of its characters doubled.
    longer = {w: seen[1][w] / len(w) for w in positive}
    varied = {w[:k] + w[k - 1 :]: c for w, c in longer.items() for k in range(1, len(w)) if len(w) < WIDTH and not seen[0][w[:k] + w[k - 1 :]]}
    common = [w for w, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0]))]
    negative = common[:1500]
    landmarks = (positive[: LANDMARKS * 2 // 3] + common)[:LANDMARKS]
    code, weight = codes(landmarks)
    size = norms(code, weight)
    spread = np.zeros((len(landmarks), KINDS**3), np.float32)
    for k in range(len(landmarks)):
        np.add.at(spread[k], code[k], weight[k] / size[k])

    def kernel(words: list[str]) -> np.ndarray:
        out = []
        for at in range(0, len(words), 256):
            c, w = codes(words[at : at + 256])
            out.append(np.einsum("mwp,wp->wm", spread[:, c], w) / norms(c, w)[:, None])
        return np.vstack(out)

    values, vectors = np.linalg.eigh(kernel(landmarks).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    model = empty
    pool = sorted(seen[0])
    for _ in range(4):
        words = positive + list(varied) + negative
        label = np.append(np.ones(len(words) - len(negative)), -np.ones(len(negative)))
        share = np.concatenate([[seen[1][w] for w in positive], [0.15 * c for c in varied.values()], [1 + 1000 * seen[0][w] / n0 for w in negative]])
        share = np.where(label > 0, share / share[label > 0].sum(), share / share[label < 0].sum() * 6)
        w, bias = _hinge(kernel(words) @ root, label, share)
        model = Model(((root @ w) @ spread).astype(np.float32), float(bias), 1.0, 0.0)
        f = model.margins(pool)
        hard = [pool[k] for k in np.argsort(-f, kind="stable")[:1500] if f[k] > FLOOR]
        added = set(hard).difference(negative, positive)
        if not added:
            break
        negative = negative + sorted(added)
    vocabulary: set[str] = set()
    for t in texts:
        vocabulary |= tokens(t)
    words = sorted(vocabulary)
    known = dict(zip(words, model.margins(words).tolist(), strict=True))
    f = np.array([max(map(known.__getitem__, tokens(t)), default=FLOOR) for t in texts])
    # Platt's sigmoid with his smoothed targets, by damped Newton steps.
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        g = np.array([np.sum((p - target) * f), np.sum(p - target)])
        q = p * (1 - p)
        h = np.array([[np.sum(q * f * f), np.sum(q * f)], [np.sum(q * f), np.sum(q)]]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1, 2 / np.abs(step).max())
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    if a <= 0:
        a, b = 1.0, float(np.log(n1 / n0))
    model.slope, model.offset = float(a), float(b)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_TEXTS) -> list:
    """At most `limit` labelled texts outside the held-out fold, the same for the same rows: a quarter of them toxic as far as there are."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    lab = labels.where("toxic in (0, 1)").select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(fold != 2)
    part = [lab.where(F.col("toxic") == k).withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(limit // 4 if k else limit - limit // 4) for k in (0, 1)]
    ids = part[0].unionByName(part[1]).select("doc_id", "toxic").distinct()
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("at", F.xxhash64("doc_id", "toxic", "text")).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    # A window without a key over at most `limit` labels' rows: the sum of the sizes up to each.
    upto = F.sum("size").over(Window.orderBy("at", "doc_id", "toxic", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= TRAIN_BYTES).select("doc_id", "text", "toxic").collect()
    return sorted(rows, key=lambda r: (r.doc_id, r.toxic, r.text or ""))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, limit: int = TRAIN_TEXTS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    The fit reads at most `limit` labelled texts (a documented bound; scoring reads every whole text and is
    a map without shuffle). Null and empty texts score as a text without words, near 0. Repeated rows give
    repeated rows; a null doc_id stays null and is not held out. With no labels of both kinds every score is low.
    """
    rows = training_rows(bounded(docs), labels, limit)
    model = docs.sparkSession.sparkContext.broadcast(train([r.text or "" for r in rows], [r.toxic for r in rows]))

    def run(batches):
        m = model.value
        for b in slices(batches, 2):
            score = m.score([t.as_py() or "" for t in b.column(2)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])
        m.known.clear()

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    src = docs.select("doc_id", held.alias("held_out"), "text")
    return src.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, limit: int = TRAIN_TEXTS) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold. Null and empty texts stay."""
    rows = training_rows(bounded(docs), labels, limit)
    model = docs.sparkSession.sparkContext.broadcast(train([r.text or "" for r in rows], [r.toxic for r in rows]))
    at = docs.columns.index("text")

    def run(batches):
        m = model.value
        for b in slices(batches, at):
            keep = [s < threshold for s in m.score([t.as_py() or "" for t in b.column(at)])]
            yield b.filter(pa.array(keep, pa.bool_()))
        m.known.clear()

    return docs.mapInArrow(run, docs.schema)
