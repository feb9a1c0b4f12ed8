"""BPE encoding and decoding: a segment tree over the ranks of adjacent pairs gives each next merge."""

from __future__ import annotations

import json
import re
import unicodedata
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded, slices

INF = 1 << 60
#: Distinct words, and characters of them, kept with their codes within a task; at either bound the store is emptied and refilled.
CACHE_WORDS, CACHE_CHARS = 150_000, 4_000_000


def byte_characters() -> list[str]:
    """Printable stand-ins of the 256 bytes, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """Merges of many words at once, one segment tree a word.

    Leaf i of a word's tree holds the rank of symbol i with its right neighbour, as rank * width + i:
    the root is the leftmost pair of the lowest rank. A merge updates three leaves and their
    O(log width) ancestors, in numpy over all words that still have a mergeable pair.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[x] * self.base + vocab[y] for x, y in merges], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.made = np.array([vocab[x + y] for x, y in merges], np.int32)

    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x.astype(np.int64) * self.base + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (x >= 0) & (y >= 0), self.order[at], INF)

    def run(self, symbols: np.ndarray) -> np.ndarray:
        """symbols: (words, width) of ids, width a power of two, -1 behind a word's end; merged-away places become -1."""
        n, width = symbols.shape
        if width == 1:
            return symbols
        tree = np.full((n, 2 * width), INF, np.int64)
        place = np.arange(width)
        ranks = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width - 1)
        tree[:, width:-1] = np.where(ranks < INF, ranks * width + place[:-1], INF)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        # One place more at either end, so that the neighbour of the last (width) and the first (-1) exist.
        right = np.tile(np.append(np.arange(1, width + 1), width), (n, 1))
        left = np.tile(np.append(np.arange(-1, width - 1), -1), (n, 1))
        ids = np.hstack([symbols, np.full((n, 1), -1, symbols.dtype)])
        live = np.flatnonzero(tree[:, 1] < INF)
        while len(live):
            root = tree[live, 1]
            i = root % width
            j = right[live, i]
            after, before = right[live, j], left[live, i]
            ids[live, i] = self.made[root // width]
            ids[live, j] = -1
            right[live, i] = after
            left[live, after] = i
            one = self.rank(ids[live, i], ids[live, after])
            two = self.rank(ids[live, before], ids[live, i])
            tree[live, width + j] = INF
            tree[live, width + i] = np.where(one < INF, one * width + i, INF)
            ok = before >= 0
            tree[live[ok], width + before[ok]] = np.where(two < INF, two * width + before, INF)[ok]
            for leaf, rows in ((j, live), (i, live), (before[ok], live[ok])):
                up = (leaf + width) >> 1
                while len(rows) and up[0]:
                    tree[rows, up] = np.minimum(tree[rows, 2 * up], tree[rows, 2 * up + 1])
                    up = up >> 1
            live = live[tree[live, 1] < INF]
        return ids[:, :width]


#: Code points whose letters, numbers and white space stand in a plain character class.
SIMPLE = 0x250


class Codec:
    """Encoder and decoder of a word-end BPE vocabulary file with a NFC, white space, lower-case normaliser."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.merges = Merges(self.vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        chars = "".join(map(chr, range(SIMPLE)))
        kinds = {k: "".join(map(re.escape, regex.findall(k, chars))) for k in (r"\p{L}", r"\p{N}", r"\s")}
        for kind, members in kinds.items():
            pattern = pattern.replace(kind, members)
        self.simple_words = re.compile(pattern.replace("[[", "[").replace("]]", "]")).findall
        self.beyond = re.compile(f"[^\\x00-{chr(SIMPLE - 1)}]").search
        stand_in = byte_characters()
        self.first = np.array([self.vocab.get(c, -1) for c in stand_in], np.int32)
        self.last = np.array([self.vocab.get(c + self.end, -1) for c in stand_in], np.int32)
        self.whole = min(self.first.min(), self.last.min()) >= 0
        self.digits = {i: str(i) for i in self.tokens}
        self.codes: dict[str, str] = {}
        self.shown: dict[str, str] = {}
        self.held = 0  # characters of the words kept

    def learn(self, words: list[str]) -> None:
        """Encode new words, those of like width together."""
        raw = [w.encode() for w in words]
        by_width: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            by_width.setdefault(1 << (len(b) - 1).bit_length(), []).append(k)
        for width, members in by_width.items():
            step = max(1, (1 << 19) // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                joined = np.frombuffer(b"".join(raw[k] for k in part), np.uint8)
                sizes = np.array([len(raw[k]) for k in part])
                symbols = np.full((len(part), width), -1, np.int32)
                inside = np.arange(width) < sizes[:, None]
                symbols[inside] = self.first[joined]
                symbols[np.arange(len(part)), sizes - 1] = self.last[joined[np.cumsum(sizes) - 1]]
                for k, row in zip(part, self.merges.run(symbols).tolist(), strict=True):
                    ids = [x for x in row if x >= 0]
                    self.codes[words[k]] = " ".join([self.digits[x] for x in ids])
                    self.shown[words[k]] = " ".join([self.tokens[x] for x in ids])

    def normalized_words(self, text: str) -> list[str]:
        """The pattern never spans white space, so runs of it need not be made one space first."""
        if text.isascii():
            return self.simple_words(text.lower())
        text = unicodedata.normalize("NFC", text)
        # Lower-casing is per character: no final sigma.
        text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        return (self.words if self.beyond(text) else self.simple_words)(text)

    def encode_batch(self, texts: list[str]):
        """For each text its decimal ids joined by a space, and the decoded text of those ids."""
        parts = []
        for text in texts:
            if self.split is None or "<|" not in text:
                parts.append(self.normalized_words(text))
            else:  # a tuple marks a special token
                parts.append([w for p in self.split.split(text) if p for w in ([(p,)] if p in self.special else self.normalized_words(p))])
        new = {w for p in parts for w in p}.difference(self.codes)
        size = sum(map(len, new))
        if len(self.codes) + len(new) > CACHE_WORDS or self.held + size > CACHE_CHARS:
            self.codes.clear()
            self.shown.clear()
            new = {w for p in parts for w in p}
            self.held, size = 0, sum(map(len, new))
        self.held += size
        self.learn([w for w in new if isinstance(w, str)])
        for w in new:
            if isinstance(w, tuple):
                self.codes[w], self.shown[w] = str(self.special[w[0]]), w[0]
        for p in parts:
            codes, shown = map(self.codes.__getitem__, p), map(self.shown.__getitem__, p)
            if not self.whole:  # a word may have no piece at all
                codes, shown = filter(None, codes), filter(None, shown)
            yield " ".join(codes), " ".join(shown)

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens are joined by a space."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def encode_documents(docs: DataFrame, vocabulary: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, and token_ids with the decoded text, or with digests=True their SHA-256.

    A null text counts as empty: no tokens. Repeated rows give repeated rows; a null doc_id stays
    null; other columns are not carried. The vocabulary file (bounded by its kind, a few MB) is read
    on the driver and broadcast. A map without shuffle: any split of the input works alike.
    """
    spark = bounded(docs).sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches):
        codec = Codec(json.loads(spec.value))
        for b in slices(batches, 1):
            n, ids, shown = [], [], []
            for i, s in codec.encode_batch([t.as_py() or "" for t in b.column(1)]):
                n.append(i.count(" ") + 1 if i else 0)
                ids.append(sha256(i.encode()).hexdigest() if digests else i)
                shown.append(sha256(s.encode()).hexdigest() if digests else s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()) if digests else pa.array([list(map(int, i.split())) for i in ids], pa.list_(pa.int32())), pa.array(shown, pa.string())], names=["doc_id", "n_tokens", "i", "d"])

    names = "ids_sha256 string, decoded_sha256 string" if digests else "token_ids array<int>, decoded string"
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, {names.replace('ids_sha256', 'i').replace('token_ids', 'i').replace('decoded_sha256', 'd').replace('decoded ', 'd ')}")
    return out.withColumnsRenamed({"i": "ids_sha256", "d": "decoded_sha256"} if digests else {"i": "token_ids", "d": "decoded"})
