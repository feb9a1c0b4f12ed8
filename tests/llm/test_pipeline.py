"""run() of the pipeline against the same five decisions taken one by one in plain Python."""

import json
import random
from hashlib import sha256

import corpus_pipeline
import pytest

from tallyloom.llm import bpe, common, simhash, suffix_dedup, toxicity
from tallyloom.llm.queries import vocabulary


def words(rng, n, kind="w"):
    return " ".join(kind + "".join(rng.choice(x) for x in ("bdgklmnprstv", "aeiou") * 2) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, near copies, a passage that repeats, a test item, odd rows, and a column of a clashing name."""
    rng, at = random.Random(21), tmp_path_factory.mktemp("pipe")
    base = [words(rng, rng.randrange(60, 160)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, base[k] + " end") for k in range(8)]  # near copies
    rows += [(120 + k, base[k]) for k in range(20, 24)]  # exact copies
    shared = words(rng, 50, "shared")
    rows += [(140 + k, words(rng, 70) + " " + shared + " " + words(rng, 70)) for k in range(4)]
    item = words(rng, 30, "item") + "? " + words(rng, 8, "answer") + "."
    rows += [(160, words(rng, 80) + " " + item + " " + words(rng, 60)), (161, words(rng, 90))]
    rows += [(200 + k, words(rng, 30) + " you absolute blockhead " + words(rng, 30)) for k in range(30)]
    rows += [(None, words(rng, 80)), (170, None), (171, ""), (172, "x"), (172, "x")]
    spark.createDataFrame([(*r, "tag") for r in rows], "doc_id long, text string, rk string").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, int(200 <= k < 230)) for k in [*range(60), *range(200, 230)]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), item


def test_pipeline_equals_plain_steps(spark, folder):
    at, item = folder
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    # 1: score() of a model fitted on the same rows.
    train = toxicity.training_rows(docs, labels)
    model = toxicity.train([r.text or "" for r in train], [r.toxic for r in train])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r, s in zip(rows, model.score([t or "" for _, t in rows]), strict=True) if s < 0.3]
    assert not [i for i, _ in rows if i is not None and i >= 200] and len(rows) > 75
    # 2: all pairs of fingerprints.
    fp = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    root = common.union_find([(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    groups: dict = {}
    for k, r in enumerate(rows):
        groups.setdefault(root.get(k, k), []).append(r)
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    # 3: every string of 200 bytes counted.
    texts = [(t or "").encode() for _, t in rows]
    seen: dict = {}
    for t in texts:
        for p in range(len(t) - 199):
            seen[t[p : p + 200]] = seen.get(t[p : p + 200], 0) + 1
    cut = [suffix_dedup._cut(t, [{"lo": p, "hi": p + 200} for p in range(len(t) - 199) if seen[t[p : p + 200]] > 1])[0].decode(errors="ignore") for t in texts]
    assert sum(map(len, cut)) < sum(map(len, texts))
    rows = [(i, None if t is None else c) for (i, t), c in zip(rows, cut, strict=True)]
    # 4: the only item stands in one document, word for word.
    assert sum(item in (t or "") for _, t in rows) == 1
    rows = [r for r in rows if item not in (r[1] or "")]
    # 5: ids of the codec, whose own test holds it against the library.
    codec = bpe.Codec(json.load(open(vocabulary())))
    want = []
    for (i, _), (ids, shown) in zip(rows, codec.encode_batch([t or "" for _, t in rows]), strict=True):
        want.append((i, list(map(int, ids.split())), sha256(shown.encode()).hexdigest()))
    got = [(r.doc_id, list(r.token_ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, at).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    at, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    none = docs.where("doc_id = -1")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == ["doc_id", "text", "rk"] and {r.rk for r in docs.select("rk").distinct().collect()} == {"tag"}
        assert stage(spark, none, at).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, at).count() == 0
