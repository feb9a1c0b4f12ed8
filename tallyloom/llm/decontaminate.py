"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, slices

K1, B = 1.2, 0.75
#: Items of a posting block, and postings of the index shards that are broadcast at a time (about 40 bytes each).
BLOCK, SHARD_POSTINGS = 4, 500_000
#: Words of the shortest length class of items.
LEAST = 32
WORD = re.compile(r"\w+")
#: A part of fewer words may lose over half of its 5-word shingles by one change, so its words in order count too;
#: a short answer is joined to the words before it, up to TAIL words or half of the item.
SHORT, TAIL = 14, 10
SENTENCE = re.compile(r"(?<=[.!?:])\s+|\n+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's last sentence is its answer; of a single sentence, the last quarter of its words."""
    parts = [w for w in map(words, SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    own = parts[0] if parts else []
    cut = len(own) - len(own) // 4
    return own[:cut], own[cut:]


def overlap(part: list[str], grams: set, n: int = 5) -> float:
    """Share of the part's n-word shingles (the whole part if shorter) that a passage holds."""
    size = min(n, len(part))
    own = [tuple(part[i : i + size]) for i in range(len(part) - size + 1)] if part else []
    return sum(g in grams for g in own) / len(own) if own else 1.0


def in_order(part: list[str], near: list[str]) -> float:
    """Largest share of the part's words that stand in order in a stretch of half its length more."""

    def common(v):
        row = [0] * (len(v) + 1)
        for x in part:
            last = 0
            for k, y in enumerate(v):
                last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k], row[k + 1])
        return row[-1]

    held, size, best = set(part), len(part) + len(part) // 2 + 1, 0
    for i, w in enumerate(near):
        if w in held and best < len(part):
            v = [x for x in near[i : i + size] if x in held]
            if len(v) > best:
                best = max(best, common(v))
    return best / len(part) if part else 1.0


def part_overlaps(text: str, parts: tuple[list[str], list[str]], near: list[str], grams: set, question: float, answer: float) -> tuple[float, float]:
    """Overlap of an item's question and answer with a passage: by shingles, and by words in order where a short part fails."""
    q, a = overlap(parts[0], grams), overlap(parts[1], grams)
    if q < question and len(parts[0]) < SHORT:
        q = max(q, in_order(parts[0], near))
    if q >= question and a < answer and len(parts[1]) < SHORT:
        own = words(text)
        a = max(a, in_order(own[-max(len(parts[1]), min(TAIL, len(own) // 2), 1) :], near))
    return q, a


class Shard:
    """Postings of items of one length class. Weights are BM25 contributions over the item's score against itself.

    terms, items, weights: the postings, terms as places in `index`, which the shards of a broadcast share.
    Passages are `width` words, twice the class's longest item, so what an item meets does not hang on the others.
    """

    def __init__(self, index: dict[str, int], terms: np.ndarray, items: np.ndarray, weights: np.ndarray, ids: list, texts: list[str], stride: int):
        self.index, self.items, self.texts, self.stride, self.width = index, ids, texts, stride, 2 * stride
        order = np.lexsort((items, terms))
        terms, items, weights = terms[order], items[order], weights[order].astype(np.float64)
        self.start = np.searchsorted(terms, np.arange(len(index) + 1))
        self.post_item, self.post_weight = items, weights
        # Block maxima, only of blocks that hold the term.
        block = items // BLOCK
        first = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (block[1:] != block[:-1]))) if len(terms) else np.empty(0, np.int64)
        self.max_block = block[first]
        self.max_weight = np.maximum.reduceat(weights, first) if len(first) else weights
        self.max_start = np.searchsorted(terms[first], np.arange(len(index) + 1))
        self.blocks = -(-len(ids) // BLOCK)
        self.top = np.zeros(len(index) + 1)
        np.maximum.at(self.top, terms, weights)

    def postings(self, term: int) -> list[tuple[int, float]]:
        s = slice(self.start[term], self.start[term + 1])
        return list(zip(self.post_item[s].tolist(), self.post_weight[s].tolist(), strict=True))

    def block_maxima(self, term: int) -> dict[int, float]:
        s = slice(self.max_start[term], self.max_start[term + 1])
        return dict(zip(self.max_block[s].tolist(), self.max_weight[s].tolist(), strict=True))

    def possible(self, ids: np.ndarray, passage: np.ndarray, threshold: float) -> np.ndarray:
        """Numbers of the passages with a block whose maxima reach the threshold; each term of a passage counts once.

        ids: index terms (-1: none) of many texts' words, passage: the number of each word's passage.
        """
        at = self.top[ids] > 0  # the last place, of -1, is zero
        key = np.sort(passage[at] * np.int64(len(self.top)) + ids[at])
        if not len(key):
            return key
        key = key[np.append(True, key[1:] != key[:-1])]
        c, o = np.divmod(key, len(self.top))
        start = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        # Cheaper bound first: each term's largest weight anywhere.
        ok = np.add.reduceat(self.top[o], start) >= threshold - 1e-5
        if not ok.any():
            return key[:0]
        keep = np.repeat(ok, np.diff(np.append(start, len(c))))
        c, o = c[keep], o[keep]
        # The blocks of each term, summed over the terms of a passage.
        size = self.max_start[o + 1] - self.max_start[o]
        held = np.repeat(self.max_start[o], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        cell, back = np.unique(np.repeat(c, size) * np.int64(self.blocks) + self.max_block[held], return_inverse=True)
        best = np.bincount(back, self.max_weight[held])
        return np.unique(cell[best >= threshold - 1e-5] // self.blocks)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Every item whose score reaches the threshold: block-max WAND, document at a time."""
        post = {t: p for t in terms if (p := self.postings(t))}
        block_max = {t: self.block_maxima(t) for t in post}
        lists = [[t, 0] for t in post]
        found = []
        last = len(self.items)
        while True:
            lists = [x for x in lists if x[1] < len(post[x[0]])]
            lists.sort(key=lambda x: post[x[0]][x[1]][0])
            # Pivot: the first item that the terms before it could lift to the threshold.
            total, pivot = 0.0, None
            for k, (t, _) in enumerate(lists):
                total += float(self.top[t])
                if total >= threshold - 1e-5:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = post[lists[pivot][0]][lists[pivot][1]][0]
            while pivot + 1 < len(lists) and post[lists[pivot + 1][0]][lists[pivot + 1][1]][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(block_max[t].get(block, 0.0) for t, _ in lists[: pivot + 1]) < threshold - 1e-5:
                # No item of this block, as far as the lists before the next one reach, can make it: skip.
                to = min((block + 1) * BLOCK, post[lists[pivot + 1][0]][lists[pivot + 1][1]][0] if pivot + 1 < len(lists) else last)
                move = lists[: pivot + 1]
            else:
                if post[lists[0][0]][lists[0][1]][0] == item:
                    score = sum(post[t][p][1] for t, p in lists[: pivot + 1])
                    if score >= threshold:
                        found.append((item, score))
                    to = item + 1
                else:
                    to = item
                move = lists[: pivot + 1]
            for x in move:
                p, own = x[1], post[x[0]]
                while p < len(own) and own[p][0] < to:
                    p += 1
                x[1] = p


def _term_rows(batches):
    """(item, term, tf, size) of each item, its words split as passages are."""
    for b in slices(batches, 1):
        rows = []
        for item, text in zip(b.column(0), b.column(1), strict=True):
            own = Counter(words(text.as_py()))
            rows += [(item.as_py(), w, n, own.total()) for w, n in own.items()]
        if rows:
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], b.schema.field(0).type), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64())], names=["item", "term", "tf", "size"])


def keyed(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, text): the items, each with a key of its id and text, as items may share an id."""
    rows = benchmark.where("item_id is not null and text is not null")
    return rows.select(F.sha2(F.concat_ws("\u0000", F.col("item_id").cast("string"), "text"), 256).alias("item"), "item_id", "text")


def index_rows(benchmark: DataFrame) -> DataFrame:
    """(item, term, size, weight): BM25 of each item's terms as a share of the item's score against itself, over all items."""
    tf = materialize(keyed(benchmark).select("item", "text").mapInArrow(_term_rows, "item string, term string, tf long, size long").groupBy("item", "term").agg(F.max("tf").alias("tf"), F.max("size").alias("size")))
    n, mean = tf.groupBy("item").agg(F.max("size").alias("size")).agg(F.count("*"), F.avg("size")).first()
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = tf.join(df, "term").withColumn("w", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(mean or 1.0))))
    return score.join(score.groupBy("item").agg(F.sum("w").alias("own")), "item").select("item", "term", "size", (F.col("w") / F.col("own")).alias("weight"))


def shards(benchmark: DataFrame):
    """Lists of index shards, one for each length class; all shards of a list have at most about SHARD_POSTINGS postings and are broadcast together."""
    rows = materialize(index_rows(benchmark))
    parts = max(1, -(-rows.count() // SHARD_POSTINGS))
    texts = keyed(benchmark).groupBy("item").agg(F.first("item_id").alias("item_id"), F.first("text").alias("text"))
    for k in range(parts):
        own = F.pmod(F.xxhash64("item"), F.lit(parts)) == k
        got, text = rows.where(own).toArrow().sort_by([("item", "ascending"), ("term", "ascending")]), texts.where(own).toArrow()
        if not got.num_rows:
            continue
        name, text = (dict(zip(text["item"].to_pylist(), text[c].to_pylist(), strict=True)) for c in ("item_id", "text"))
        term = got["term"].combine_chunks().dictionary_encode()
        index, codes = {t: k for k, t in enumerate(term.dictionary.to_pylist())}, np.asarray(term.indices).astype(np.int64)
        item = got["item"].combine_chunks().dictionary_encode()
        ids, item, weight = item.dictionary.to_pylist(), np.asarray(item.indices).astype(np.int64), np.asarray(got["weight"])
        size = np.maximum(np.asarray(got["size"]), LEAST)
        stride = 1 << np.ceil(np.log2(size)).astype(np.int64)
        group = []
        for width in np.unique(stride).tolist():
            at = stride == width
            some, place = np.unique(item[at], return_inverse=True)
            keys = [ids[i] for i in some.tolist()]
            group.append(Shard(index, codes[at], place, weight[at], [name[i] for i in keys], [text[i] for i in keys], width))
        yield group


def _runs(column):
    """(first row, words of each text) for runs of texts of about 1 MB."""
    run, size, first = [], 0, 0
    for row, text in enumerate(column):
        t = text.as_py() or ""
        run.append(words(t))
        size += len(t)
        if size > 1_000_000:
            yield first, run
            run, size, first = [], 0, row + 1
    if run:
        yield first, run


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question: float = 0.5, answer: float = 0.5) -> DataFrame:
    """(doc_id, item_id, word, score, question_overlap, answer_overlap): test items found in documents.

    Items fall into classes by length (powers of two, LEAST words at least). For a class, a document's
    passages are runs of twice its longest length, each half over the next, over the whole text: every
    stretch as long as an item lies in one, and no item's result hangs on which others there are but
    through the weights of BM25. All items that a passage scores at or above `threshold` (as a share of the
    item's own score) are retrieved and verified: the share of the question's and of the answer's 5-word
    shingles in the passage must reach both limits, for parts of under SHORT words of their words in order
    (a short answer with the words before it). One row a document and item, of its best passage (the first
    among equals; word: where it begins).

    Null or empty texts hold nothing; null items are left out; items that share an id are searched each, and
    a document has one row of the best of them; repeated rows give repeated rows; a null doc_id stays null. Only doc_id, text and item_id,
    text are read. The index is broadcast in lists of shards of at most about SHARD_POSTINGS postings; a
    larger benchmark takes one pass over the documents for each list.
    """
    spark, out = bounded(docs).sparkSession, None
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, word int, score double, question_overlap double, answer_overlap double"
    for group in shards(benchmark):
        shared = spark.sparkContext.broadcast(group)

        def run(batches, shared=shared):
            group = shared.value
            parts = [[question_answer(t) for t in s.texts] for s in group]
            get = group[0].index.get
            for b in slices(batches, 1):
                rows: dict = {}
                for first, own in _runs(b.column(1)):
                    size = np.array(list(map(len, own)))
                    ids = np.fromiter((get(w, -1) for t in own for w in t), np.int64, size.sum())
                    place = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
                    for s, split in zip(group, parts, strict=True):
                        stride, width = s.stride, s.width
                        # Passage 2k + 1 of a text begins `stride` words behind passage 2k; numbers of texts do not meet.
                        base = np.cumsum(2 * (size // width + 2)) - 2 * (size // width + 2)
                        for odd in (0, 1):
                            number = np.repeat(base, size) + 2 * ((place + (stride if odd else 0)) // width) + odd
                            for c in s.possible(ids, number, threshold).tolist():
                                k = int(np.searchsorted(base, c, "right")) - 1
                                lo = (c - int(base[k])) // 2 * width - odd * stride
                                near = own[k][max(0, lo) : lo + width]
                                hits = s.search(sorted({get(w) for w in near if w in s.index}), threshold)
                                grams = {tuple(near[i : i + n]) for n in range(1, 6) for i in range(len(near) - n + 1)} if hits else ()
                                for item, score in hits:
                                    q, a = part_overlaps(s.texts[item], split[item], near, grams, question, answer)
                                    if q >= question and a >= answer:
                                        found = (q + a, score, -max(0, lo))
                                        at = first + k, s.items[item]
                                        if found > rows.get(at, ((-1,),))[0]:
                                            rows[at] = found, (first + k, s.items[item], max(0, lo), score, q, a)
                if rows:
                    cols = list(zip(*(x for _, (_, x) in sorted(rows.items())), strict=True))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0])), pa.array(cols[1]), pa.array(cols[2], pa.int32()), *(pa.array(c, pa.float64()) for c in cols[3:])], names=["doc_id", "item_id", "word", "score", "question_overlap", "answer_overlap"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out
