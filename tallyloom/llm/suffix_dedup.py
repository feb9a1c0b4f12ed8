"""Exact substring dedup: a radix sort of suffixes that stops at the threshold depth.

Only groups of equal prefixes matter, not their order, so each most-significant-digit pass deals the
suffixes out by a digest of their next bytes, and drops those left alone in their group:

1. Of all suffixes, those that start at an anchor take part. Anchors are the leftmost minima of a hash of
   GRAM bytes over every run of threshold - GRAM + 1 places, so each string of threshold bytes holds one,
   and equal strings hold it at the same offset. First digit: the GRAM bytes. Anchors alone in their
   group lie in no repeated window.
2. Next digit: all bytes up to threshold - GRAM places on either side, the reach of every window that
   holds the anchor. In a group that stays together all those windows repeat.
3. Where a group of pass 1 falls apart in pass 2, one member of each part is read again and the last pass
   sorts its windows by content, offset by offset: windows equal to one of another part repeat.
"""

from __future__ import annotations

from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, key_filter, materialize, maybe_in, release, signed, slices

GRAM = 32
#: Parts of one group that a task compares in memory; groups of more go through a shuffle of window digests.
GROUP_PARTS = 8192
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every run of `width`, by doubling."""
    done = 1
    while done * 2 <= width:
        a = pick(a[:-done], a[done:])
        done *= 2
    rest = width - done
    return pick(a[: len(a) - rest], a[rest:]) if rest else a


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: int) -> np.ndarray:
    """Anchor positions in `data`, which holds texts back to back."""
    n, w = len(data), threshold - GRAM + 1
    if n < threshold:
        return np.empty(0, np.int64)
    word = np.ndarray((n - 7,), "<u8", data, strides=(1,)).astype(np.uint64)
    h = word[: n - 31] * MIX[0]
    for k in (1, 2, 3):
        h ^= h >> np.uint64(29)
        h += word[8 * k : n - 31 + 8 * k] * MIX[k]
    h ^= h >> np.uint64(32)
    h *= MIX[1]
    h |= np.uint64(1)
    low = _sliding(h, w, np.minimum)
    # A window counts if it lies in one text.
    inside = np.zeros(len(low) + 1, np.int32)
    long = ends - starts >= threshold
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - threshold + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    del word, inside
    # The leftmost minimum: where it first stands in its window. Candidates first, exact order second.
    high = _sliding(np.concatenate([np.zeros(w - 1, np.uint64), np.where(valid, low, 0), np.zeros(w - 1, np.uint64)]), w, np.maximum)[: len(h)]
    cand = np.flatnonzero(h == high)
    if len(cand) < 2:
        return cand
    # A place that stands at most w - 1 behind an equal one is the leftmost only of windows that start after that one.
    value = h[cand]
    order = np.lexsort((cand, value))
    c, v = cand[order], value[order]
    gap = np.full(len(c), w, np.int64)
    same = v[1:] == v[:-1]
    gap[1:][same] = np.minimum(c[1:] - c[:-1], w)[same]
    keep = gap >= w
    # Close repeats of one gram: some valid window that starts in (c - gap, c] must have this minimum.
    for k in np.flatnonzero(~keep):
        s = slice(max(0, c[k] - gap[k] + 1), c[k] + 1)
        keep[k] = bool(np.any((low[s] == v[k]) & valid[s]))
    return np.sort(c[keep])


#: Bytes that a task hashes at a time. A longer text is taken in parts that overlap by a window, so each window lies in one.
STRETCH = 1_000_000


def _raw(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column back to back, without a copy, and where each text begins and the last ends."""
    c = column.cast(pa.large_binary())
    _, offsets, data = c.buffers()
    at = np.frombuffer(offsets, np.int64)[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _anchors_of(data: np.ndarray, at: np.ndarray, threshold: int) -> np.ndarray:
    if len(data) <= 2 * STRETCH:
        return anchors(data, at[:-1], at[1:], threshold)
    parts = []  # one long text, or one with short ones
    for lo in range(0, len(data), STRETCH):
        hi = min(len(data), lo + STRETCH + threshold)
        inside = np.clip(at - lo, 0, hi - lo)
        parts.append(lo + anchors(data[lo:hi], inside[:-1], inside[1:], threshold))
    return np.unique(np.concatenate(parts))


KEY = ["rk", "rk2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """A row key of 96 bits from id and content: rows that share it are the same text, and have the same result."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64("doc_id", "text").alias("rk"), (F.crc32(text) - (1 << 31)).cast("int").alias("rk2"), F.col("doc_id"), text.alias("text"))


def _anchor_rows(threshold: int):
    reach = threshold - GRAM

    def run(batches):
        d = xxhash.xxh3_64_intdigest
        for b in slices(batches, 2, STRETCH):
            data, at = _raw(b.column(2))
            pos = _anchors_of(data, at, threshold)
            starts, ends, view = at[:-1], at[1:], memoryview(data)
            for k in range(0, len(pos), 20_000):
                p = pos[k : k + 20_000]
                row = np.searchsorted(ends, p, "right")
                lo, hi = np.maximum(starts[row], p - reach), np.minimum(ends[row], p + threshold)
                gram = np.array([d(view[x : x + GRAM]) for x in p.tolist()], np.uint64).view(np.int64)
                around = np.array([d(view[x:y], q - x) for x, y, q in zip(lo.tolist(), hi.tolist(), p.tolist(), strict=True)], np.uint64).view(np.int64)
                keys = b.select([0, 1]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(around), *keys.columns, pa.array((p - starts[row]).astype(np.int32)), pa.array((p - lo).astype(np.int16)), pa.array((hi - p).astype(np.int16))], names=["gram", "around", *KEY, "pos", "before", "after"])

    return run


def _context_rows(threshold: int):
    reach = threshold - GRAM

    def run(batches):
        for b in slices(batches, 1, STRETCH):
            for text, needs in zip(b.column(1), b.column(0), strict=True):
                raw, all_ = text.as_py().encode(), needs.as_py()
                for k in range(0, len(all_), 4096):
                    part = all_[k : k + 4096]
                    body = [raw[max(0, x["pos"] - reach) : x["pos"] + threshold] for x in part]
                    yield pa.RecordBatch.from_arrays([pa.array([x["gram"] for x in part], pa.int64()), pa.array([x["around"] for x in part], pa.int64()), pa.array([min(x["pos"], reach) for x in part], pa.int32()), pa.array(body, pa.binary())], names=["gram", "around", "lead", "body"])

    return run


def _common_prefix(a: bytes, b: bytes) -> int:
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


#: Groups of up to so many parts are compared part by part, which takes less than a pass for each offset.
FEW_PARTS = 24


def _pairwise_offsets(parts: list[tuple[int, bytes]], threshold: int) -> list[tuple[int, int] | None]:
    """shared_offsets() of a small group: how far each two parts agree to the left and to the right of the anchor."""
    reach = threshold - GRAM
    out: list[tuple[int, int] | None] = [None] * len(parts)
    left, right = [body[:lead][::-1] for lead, body in parts], [body[lead:] for lead, body in parts]
    for i in range(len(parts)):
        for j in range(i):
            least = max(0, threshold - _common_prefix(right[i], right[j]))
            if least > reach:
                continue
            most = min(reach, _common_prefix(left[i], left[j]))
            if most >= least:
                for k in (i, j):
                    out[k] = (max(most, out[k][0]), min(least, out[k][1])) if out[k] else (most, least)
    return out


def shared_offsets(parts: list[tuple[int, bytes]], threshold: int) -> list[tuple[int, int] | None]:
    """For each (lead, bytes around an anchor), the largest and smallest offset of the anchor in a window that another part has too."""
    if len(parts) <= FEW_PARTS:
        return _pairwise_offsets(parts, threshold)
    reach = threshold - GRAM
    out: list[tuple[int, int] | None] = [None] * len(parts)
    for o in range(reach + 1):
        windows = [(k, body[lead - o : lead - o + threshold]) for k, (lead, body) in enumerate(parts) if lead >= o and len(body) >= lead - o + threshold]
        if len(windows) < 2:
            continue
        times = Counter(w for _, w in windows)
        if len(times) == len(windows):
            continue
        for k, w in windows:
            if times[w] > 1:
                out[k] = (o, out[k][1] if out[k] else o)
    return out


def _compare_groups(threshold: int):
    """Over contexts sorted by gram: (gram, around, omax, omin) of the parts that share a window; contexts of large groups pass with omin null."""

    def run(batches):
        def flush(rows, many):
            if not rows:
                return
            if many:
                found = [(g, a, None, None, lead, body) for g, a, lead, body in rows]
            else:
                shared = shared_offsets([(lead, body) for _, _, lead, body in rows], threshold)
                found = [(g, a, *s, None, None) for (g, a, _, _), s in zip(rows, shared, strict=True) if s]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names=["gram", "around", "omax", "omin", "lead", "body"])

        rows, many, current = [], False, None
        for b in batches:
            for g, a, lead, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != current:
                    yield from flush(rows, many)
                    rows, many, current = [], False, g
                rows.append((g, a, lead, body))
                if len(rows) > GROUP_PARTS:
                    yield from flush(rows, True)
                    rows, many = [], True
        yield from flush(rows, many)

    return run


def _window_rows(threshold: int):
    reach = threshold - GRAM

    def run(batches):
        for b in batches:
            for g, a, lead, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                offs = [o for o in range(reach + 1) if lead >= o and len(body) >= lead - o + threshold]
                if offs:
                    win = [signed(xxhash.xxh3_64_intdigest(body[lead - o : lead - o + threshold], o)) for o in offs]
                    n = len(offs)
                    yield pa.RecordBatch.from_arrays([pa.array([g] * n), pa.array([a] * n), pa.array(offs, pa.int32()), pa.array(win, pa.int64())], names=["gram", "around", "o", "win"])

    return run


def repeated_ranges(docs: DataFrame, threshold: int = 200) -> DataFrame:
    """(rk, rk2, lo, hi): byte ranges of repeated windows, as rows of the keyed input, in any order and overlapping.

    Written tables cut the lineage between the passes; those that are no longer read are deleted.
    """
    reach = threshold - GRAM
    keyed = _keyed(bounded(docs))
    rows = materialize(keyed.select(*KEY, "text").mapInArrow(_anchor_rows(threshold), "gram long, around long, rk long, rk2 int, pos int, before short, after short"))
    # Pass 1: first digits that occur twice. Counts are summed on the map side, so hot strings cost no task its balance.
    often = materialize(rows.groupBy("gram").count().where("count > 1").select("gram"))
    alive = materialize(rows.join(often, "gram"))
    release(rows)
    release(often)
    # Pass 2.
    part = alive.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "pos")).alias("at"), F.first("before").alias("before"), F.first("after").alias("after"))
    part = materialize(part)
    whole = part.where("n > 1").where(f"before + after >= {threshold}").select("gram", "around", F.least(F.col("before").cast("int"), F.lit(reach)).alias("omax"), F.greatest(F.lit(0), F.lit(threshold) - F.col("after")).cast("int").alias("omin"))
    # Last pass: one member of each part of the groups that fell apart.
    split = materialize(part.groupBy("gram").agg(F.count("*").alias("parts")).where("parts > 1").select("gram"))
    need = materialize(part.join(split, "gram").where(f"before + after >= {threshold}").select("at.rk", "at.rk2", F.struct("gram", "around", "at.pos").alias("need")).groupBy(*KEY).agg(F.collect_list("need").alias("needs")))
    texts = maybe_in(keyed.select(*KEY, "text"), "rk", key_filter(need, "rk")).dropDuplicates(KEY)
    context = need.join(texts, KEY).select("needs", "text").mapInArrow(_context_rows(threshold), "gram long, around long, lead int, body binary")
    met = materialize(context.repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare_groups(threshold), "gram long, around long, omax int, omin int, lead int, body binary"))
    release(need)
    release(split)
    windows = materialize(met.where("omin is null").select("gram", "around", "lead", "body").mapInArrow(_window_rows(threshold), "gram long, around long, o int, win long"))
    twice = windows.groupBy("gram", "win").count().where("count > 1").select("gram", "win")
    large = windows.join(twice, ["gram", "win"]).groupBy("gram", "around").agg(F.max("o").alias("omax"), F.min("o").alias("omin"))
    shared = met.where("omin is not null").select("gram", "around", "omax", "omin").unionByName(large)
    # Written, so that the join below is of two plain exchanges, which Spark can split where one part holds many rows.
    best = materialize(whole.unionByName(shared).groupBy("gram", "around").agg(F.max("omax").alias("omax"), F.min("omin").alias("omin")))
    for t in (part, met, windows):
        release(t)
    return alive.join(best, ["gram", "around"]).select(*KEY, (F.col("pos") - F.col("omax")).alias("lo"), (F.col("pos") + threshold - F.col("omin")).alias("hi"))


def _cut(raw: bytes, ranges) -> tuple[bytes, int, list[tuple[int, int]]]:
    spans: list[tuple[int, int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
        if spans and lo <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
        else:
            spans.append((lo, hi))
    kept, at = [], 0
    for lo, hi in spans:
        kept.append(raw[at:lo])
        at = hi
    kept.append(raw[at:])
    out = b"".join(kept)
    return out, len(raw) - len(out), spans


def _ranges(docs: DataFrame, threshold: int) -> DataFrame:
    """Row keys with their list of ranges (one text's, so bounded by its length)."""
    return materialize(repeated_ranges(docs, threshold).groupBy(*KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")))


def remove_repeats(docs: DataFrame, threshold: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes left).

    Every byte covered by a string of `threshold` UTF-8 bytes that also starts anywhere else goes, in all
    its places. A null text counts as empty; texts shorter than the threshold stay whole; repeated rows
    are copies of each other; a null doc_id stays null. Only doc_id and text are read.
    """

    def run(batches):
        for b in slices(batches, 1):
            done = [((raw := t.as_py().encode()), _cut(raw, r.as_py())) for t, r in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r, _ in done], pa.int64()), pa.array([n for _, (_, n, _) in done], pa.int64()), pa.array([len(s) for _, (_, _, s) in done], pa.int64()), pa.array([k for _, (k, _, _) in done], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).join(_ranges(docs, threshold), KEY, "left").select("doc_id", "text", "ranges").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def brute(texts: list[bytes], threshold: int) -> list[tuple[int, int, str]]:
    """n_removed, n_spans, SHA-256 of what is kept, straight from the definition; for tests."""
    times = Counter(t[i : i + threshold] for t in texts for i in range(len(t) - threshold + 1))
    out = []
    for t in texts:
        ranges = [{"lo": i, "hi": i + threshold} for i in range(len(t) - threshold + 1) if times[t[i : i + threshold]] > 1]
        kept, n, spans = _cut(t, ranges)
        out.append((n, len(spans), sha256(kept).hexdigest()))
    return out


def rewrite_texts(docs: DataFrame, threshold: int = 200) -> DataFrame:
    """The rows of docs, all columns, with the repeated bytes cut from text (and from n_chars, where there is one).

    A cut inside a character drops that character's other bytes too. Null texts stay null, no row is dropped,
    repeated rows are cut alike, and columns of any name are carried (the row travels as one struct).
    """
    names = docs.columns
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for b in slices(batches, at):
            cols = list(b.columns[: len(names)])
            texts = [t.as_py() if not (r := ranges.as_py()) else _cut(t.as_py().encode(), r)[0].decode(errors="ignore") for t, ranges in zip(cols[at], b.column(len(names)), strict=True)]
            cols[at] = pa.array(texts, cols[at].type)
            if count is not None:
                cols[count] = pa.array([n.as_py() if t is None else len(t) for t, n in zip(texts, cols[count], strict=True)], cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    src = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.xxhash64("doc_id", "text").alias("rk"), (F.crc32(F.coalesce("text", F.lit(""))) - (1 << 31)).cast("int").alias("rk2"))
    return src.join(_ranges(docs, threshold), KEY, "left").select(*[F.col(f"row.`{n}`") for n in names], F.col("ranges").alias("__ranges")).mapInArrow(run, docs.schema)
