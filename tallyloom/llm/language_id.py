"""Language ID: each document as a mixture of languages, by expectation-maximisation over its words' character n-gram likelihoods."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices

#: Longest n-gram, and the weight that the next shorter one's estimate has for each order.
ORDER, WEIGHTS = 4, (50.0, 20.0, 8.0, 4.0)
#: Characters that an unseen one is one of.
ALPHABET = 500
#: n-gram counts are kept by hash: 2 MB of model a language, whatever the corpus.
BUCKETS = 1 << 19
#: Letters of a word's piece: unbroken text is cut, so that it can be of several languages too.
PIECE = 32
#: Log-likelihood that each further language of a document must gain, for each doubling of its words.
PENALTY = 2.0
ROUNDS = 20
#: Languages counted side by side in a task, 4 MB each.
HELD = 32
#: Letters whose n-grams are looked up at a time.
STRETCH = 1 << 19
EDGE = 1
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, word) of every word in order of rows, and the distinct words: lower-cased runs of letters and their marks, in pieces of PIECE at most."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}]+", " ")

    def cut(clean):
        lists = pc.split_pattern(clean, " ")
        coded = pc.list_flatten(lists).dictionary_encode()
        return np.asarray(pc.list_parent_indices(lists)).astype(np.int64), np.asarray(coded.indices).astype(np.int64), coded.dictionary.cast(pa.string())

    row, word, names = cut(clean)
    length = np.asarray(pc.utf8_length(names)) if len(names) else np.zeros(0, np.int64)
    if len(names) and length.max() > PIECE:
        row, word, names = cut(pc.replace_substring_regex(clean, r"([^ ]{%d})" % PIECE, r"\1 "))
        length = np.asarray(pc.utf8_length(names))
    real = length[word] > 0 if len(word) else np.zeros(0, bool)
    return row[real], word[real], names


def stretches(names: pa.Array):
    """Slices of the distinct words with at most STRETCH letters together, or one word."""
    end, at = np.cumsum(np.asarray(pc.utf8_length(names)).astype(np.int64) + 1), 0
    while at < len(names):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + STRETCH, "right")))
        yield at, to
        at = to


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For words set one behind the other between edges: the word of each place, whether it is a first edge, and for each order the bucket of the n-gram that ends there and whether it lies within the word."""
    s = np.frombuffer(("\x01" + "\x01\x01".join(words) + "\x01").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    offset = np.arange(len(s)) - start[word]
    code, bucket, valid = np.zeros(len(s), np.uint64), [], []
    for k in range(ORDER):
        code[k:] += s[: len(s) - k] * MIX[k]
        mixed = (code ^ (code >> np.uint64(29))) * MIX[(k + 1) % 4] + np.uint64(k)
        bucket.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
        valid.append(offset >= max(k, 1))
    return word, offset == 0, bucket, valid


def _counted(batches):
    """(lang, bucket, n): n-grams of all words of a task's texts; bucket -1: how many single letters and edges."""
    held: dict[str, np.ndarray] = {}  # the last place is that of bucket -1

    def flushed():
        for lang, n in held.items():
            at = np.flatnonzero(n)
            for k in range(0, len(at), 50_000):
                some = at[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(np.where(some == BUCKETS, -1, some).astype(np.int32)), pa.array(n[some])], names=["lang", "bucket", "n"])
        held.clear()

    for b in slices(batches, 1):
        for lang in pc.unique(b.column(0)).to_pylist():
            _, word, names = words_of(b.filter(pc.equal(b.column(0), lang)).column(1))
            if lang not in held and len(held) >= HELD:
                yield from flushed()
            n, times = held.setdefault(lang, np.zeros(BUCKETS + 1, np.int64)), np.bincount(word, minlength=len(names))
            for at, to in stretches(names):
                if times[at:to].any():
                    of, _, bucket, valid = grams(names[at:to].to_pylist())
                    for g, ok in zip(bucket, valid, strict=True):
                        n[:BUCKETS] += np.bincount(g[ok], times[at:to][of[ok]], BUCKETS).astype(np.int64)
                    n[BUCKETS] += int(times[at:to][of[valid[0]]].sum())
    yield from flushed()


@dataclass
class Model:
    """Languages in order, n-gram counts (buckets x languages) and each language's letters and edges in all."""

    langs: list[str]
    counts: np.ndarray
    total: np.ndarray

    def likelihoods(self, names: pa.Array) -> np.ndarray:
        """Log-probability of each distinct word in each language: every letter behind the up to ORDER - 1 before it, shorter contexts filling in for rare ones."""
        out = np.zeros((len(names), len(self.langs)), np.float32)
        for at, to in stretches(names):
            word, first, bucket, valid = grams(names[at:to].to_pylist())
            n = [self.counts[g] for g in bucket]
            p = (n[0] + np.float32(WEIGHTS[0] / ALPHABET)) / (self.total + np.float32(WEIGHTS[0]))
            for k in range(1, ORDER):
                context = np.roll(n[k - 1], 1, axis=0)
                higher = (n[k] + np.float32(WEIGHTS[k]) * p) / (np.maximum(context, n[k]) + np.float32(WEIGHTS[k]))
                p = np.where(valid[k][:, None], higher, p)
            p[first] = 1
            out[at:to] = np.add.reduceat(np.log(p), np.flatnonzero(first), axis=0)
        return out


def fit(docs: DataFrame, usable: Column) -> Model:
    """A model of the usable rows' lang and text, all of them. Counts are added up on the executors; at most BUCKETS + 1 rows a language reach the driver."""
    rows = bounded(docs).where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    summed = rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(pc.unique(summed["lang"]).to_pylist())
    counts = np.zeros((BUCKETS + 1, len(langs)), np.float32)
    if langs:
        at = np.asarray(pc.index_in(summed["lang"].combine_chunks(), pa.array(langs)))
        counts[np.asarray(summed["bucket"]), at] = np.asarray(summed["n"])
    return Model(langs, counts[:-1], counts[-1])


def proportions(row: np.ndarray, times: np.ndarray, like: np.ndarray, rows: int, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of each row's proportions of languages among the allowed ones, and the log-likelihood reached.

    row, times, like: of every word of a row, in order of rows: its row, how often it stands there, its log-likelihood
    in each language. Words of a row are drawn each from one language, by the proportions sought.
    """
    top = like.max(axis=1, keepdims=True)
    scaled = np.exp(like - top)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    present = row[first]
    words = np.bincount(row, times, rows)
    share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    for _ in range(rounds):
        each = scaled * share[row]
        each *= (times / np.maximum(each.sum(axis=1), 1e-300))[:, None]
        share[present] = np.add.reduceat(each, first, axis=0) / words[present, None]
    reached = np.bincount(row, times * (np.log(np.maximum((scaled * share[row]).sum(axis=1), 1e-300)) + top[:, 0]), rows)
    return share, reached


def choose(row: np.ndarray, times: np.ndarray, like: np.ndarray, rows: int) -> np.ndarray:
    """Each row's proportions over the set of languages of highest penalised likelihood.

    Sets grow by the language next in the proportions that all of them together reach; the first set is the
    likeliest language alone. Growth ends with the first language that does not gain PENALTY a doubling of words.
    """
    k = like.shape[1]
    full, _ = proportions(row, times, like, rows, np.ones((rows, k)))
    alone = np.zeros((rows, k))
    for m in range(k):
        alone[:, m] = np.bincount(row, times * like[:, m], rows)
    best = alone.argmax(axis=1)
    everyone = np.arange(rows)
    chosen = np.zeros((rows, k))
    chosen[everyone, best] = 1
    share, reached = chosen.copy(), alone[everyone, best]
    need = PENALTY * np.log2(1 + np.bincount(row, times, rows))
    order = np.argsort(-(full + 2 * chosen), axis=1, kind="stable")
    live = np.ones(rows, bool)
    for step in range(1, k):
        live &= full[everyone, order[:, step]] > 1e-6
        some = live[row]
        if not some.any():
            break
        wider = chosen.copy()
        wider[everyone, order[:, step]] = 1
        to, now = proportions(row[some], times[some], like[some], rows, wider)
        live &= now - reached > need
        chosen[live], share[live], reached[live] = wider[live], to[live], now[live]
    return share


def judge(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, list[str]]:
    """Language, score and chosen languages of each text."""
    rows, k = len(texts), len(model.langs)
    letters = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
    row, word, names = words_of(texts)
    pred, score, chosen = ["und"] * rows, np.zeros(rows), [""] * rows
    if not k or not len(row):
        return pred, score, chosen
    pair, times = np.unique(row * len(names) + word, return_counts=True)
    row, word = np.divmod(pair, len(names))
    like = model.likelihoods(names)[word].astype(np.float64)
    share = choose(row, times.astype(np.float64), like, rows)
    alone = np.stack([np.bincount(row, times * like[:, m], rows) for m in range(k)], axis=1)
    odds = np.exp(alone - alone.max(axis=1, keepdims=True))
    odds /= odds.sum(axis=1, keepdims=True)
    seen = np.bincount(row, minlength=rows) > 0
    for r in np.flatnonzero(letters & seen):
        m = int(share[r].argmax())
        several = np.flatnonzero(share[r] > 0)
        pred[r], score[r] = model.langs[m], share[r, m] if len(several) > 1 else odds[r, m]
        chosen[r] = " ".join(f"{model.langs[x]}:{share[r, x]:.3f}" for x in sorted(several, key=lambda x: (-share[r, x], x)))
    return pred, np.clip(score, 0, 1), chosen


def predict(docs: DataFrame, fold: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (`en:0.913 fr:0.087`) of every document.

    Rows whose crc32(doc_id as text) mod `fold` is `held` are held out: the model is counted from the others with
    a lang, all of them. score is the language's proportion if several are chosen, else its posterior against the
    other languages alone. A null text, a text without a letter and, if nothing is learnt, any text is `und` with
    score 0. Rows without an id are judged, not held out, and train nothing; repeated rows train and are judged
    each; texts are read whole, whatever their length. Ties go to the first language in order of its name.
    """
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold
    model = fit(docs, F.coalesce(part != held, F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches, 2):
            pred, score, chosen = judge(b.column(2), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred), pa.array(score), pa.array(chosen)], names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    rows = bounded(docs).select(F.col("doc_id"), F.coalesce(part == held, F.lit(False)).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages string")
