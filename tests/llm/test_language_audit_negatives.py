"""Language ID on held-out rows and by brute force, the filter audit and hard negatives against SQL and plain loops."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import filter_audit, hard_negatives, language_id
from tallyloom.llm.queries import op12_filter_audit, op13_hard_negatives

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def same(df, want):
    got = df.toPandas()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    rows = lambda f: sorted(map(str, f[names].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


# Language ID


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r.doc_id: r for r in language_id.predict(docs).collect()}
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert got.keys() == want.keys() and all(r.held_out == held(i) and 0 <= r.score <= 1 for i, r in got.items())
    hits = [got[i].lang_pred == lang for i, lang in want.items() if held(i)]
    assert np.mean(hits) >= 0.998


def test_language_and_source_are_no_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {r.doc_id: tuple(r) for r in language_id.predict(docs).collect()}
    changed = docs.selectExpr("doc_id", "text", f"case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 'xx' else lang end as lang", "'y' as source")
    assert {r.doc_id: tuple(r) for r in language_id.predict(changed).collect()} == a


def test_language_of_awkward_rows(spark):
    texts = {"a": "the cat and the dog sat there with the other one ", "b": "le chat et le chien sont avec les autres dans la maison "}
    rows = [(k, texts[c] * 5, c, "x") for k in range(60) for c in ("a", "b") if not held(k)]
    odd = [(1000, None, "a"), (1001, "", "a"), (1002, "123 !? ́", "a"), (None, texts["b"], None), (1003, texts["a"] * 20_000, None), (1004, "x" * 300_000, None), (1005, texts["a"] * 6 + texts["b"] * 6, None), (1006, "zzz qqq kkk", ""), (1007, texts["b"].upper(), None), (1007, texts["b"].upper(), None)]
    got = defaultdict(list)
    for r in language_id.predict(spark.createDataFrame(rows + [(*o, "y") for o in odd], "doc_id long, text string, lang string, languages string")).collect():
        got[r.doc_id].append(r)
    assert [(got[i][0].lang_pred, got[i][0].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[None][0].lang_pred == "b" and got[None][0].held_out is False and got[1003][0].lang_pred == "a" and len(got[1007]) == 2 and got[1007][0].lang_pred == "b"
    both = dict(x.split(":") for x in got[1005][0].languages.split())
    assert both.keys() == {"a", "b"} and 0.35 < float(both["a"]) < 0.65
    assert got[1004][0].lang_pred in ("a", "b", "")
    kind = "doc_id long, text string, lang string"
    assert language_id.predict(spark.createDataFrame([], kind)).count() == 0
    assert [r.lang_pred for r in language_id.predict(spark.createDataFrame([(5, "some words", None)], kind)).collect()] == ["und"]


def test_words_and_likelihoods_by_brute_force():
    """Words as a regular expression finds them; likelihoods as dictionaries of n-grams give them; EM never loses likelihood."""
    texts = ["Ünïted l'état 12x, don't", "", None, "a" * 70, "naïvé 日本語"]
    row, word, names = language_id.words_of(pa.array(texts, pa.string()))
    names = names.to_pylist()
    found = defaultdict(list)
    for r, w in zip(row, word, strict=True):
        found[r].append(names[w])
    assert found == {0: ["ünïted", "l", "état", "x", "don", "t"], 3: ["a" * 32, "a" * 32, "a" * 6], 4: ["naïvé", "日本語"]}
    train = {"p": ["aba", "abb", "cab"], "q": ["ccc", "bca"]}
    batches = [pa.RecordBatch.from_arrays([pa.array([l] * len(w)), pa.array(w)], names=["lang", "text"]) for l, w in train.items()]
    counts = np.zeros((language_id.BUCKETS + 1, 2), np.float32)
    for b in language_id._counted(iter(batches)):
        np.add.at(counts, (np.asarray(b.column(1)), ["pq".index(x) for x in b.column(0).to_pylist()]), np.asarray(b.column(2)))
    model = language_id.Model(["p", "q"], counts[:-1], counts[-1])
    n = [defaultdict(Counter) for _ in range(language_id.ORDER)]
    for lang, words in train.items():
        for w in words:
            s = f"^{w}$"
            for i in range(1, len(s)):
                for k in range(language_id.ORDER):
                    if i - k >= 0:
                        n[k][lang][s[i - k : i + 1].replace("^", "$")] += 1
    total = {lang: n[0][lang].total() for lang in train}
    for w in ("aba", "ccab", "z"):
        like = model.likelihoods(pa.array([w]))[0]
        for m, lang in enumerate("pq"):
            want, s = 0.0, f"^{w}$".replace("^", "$")
            for i in range(1, len(s)):
                p = (n[0][lang][s[i]] + language_id.WEIGHTS[0] / language_id.ALPHABET) / (total[lang] + language_id.WEIGHTS[0])
                for k in range(1, language_id.ORDER):
                    if i - k >= 0:
                        have = n[k][lang][s[i - k : i + 1]]
                        p = (have + language_id.WEIGHTS[k] * p) / (max(n[k - 1][lang][s[i - k : i]], have) + language_id.WEIGHTS[k])
                want += np.log(p)
            assert abs(like[m] - want) < 1e-3
    rng = np.random.default_rng(3)
    rows, like = np.repeat(np.arange(5), 20), rng.normal(scale=3, size=(100, 3)) - 5
    reached = [language_id.proportions(rows, np.ones(100), like, 5, np.ones((5, 3)), k)[1] for k in range(8)]
    assert all((b >= a - 1e-9).all() for a, b in itertools.pairwise(reached))


# Filter audit


def test_audit_equals_sql(spark, duck):
    same(op12_filter_audit(spark, SF), duck.execute(filter_audit.ORACLE_SQL).df())


def audit_by_hand(docs, labels):
    """Every document walked through every order."""
    good, toxic = ({i for i, q, t in labels if i is not None and v(q, t)} for v in (lambda q, t: q == 1, lambda q, t: t == 1))
    fails = []
    for i, text, lang in docs:
        t = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        f = ("A" if len(words) < 100 else "") + ("B" if 100 * len(set(words)) < 80 * len(words) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else "") + ("D" if re.search("[#$%&*|]", t) else "")
        f += "E" if i is not None and any(j is not None and j < i and (x or "") == t for j, x, _ in docs) else ""
        fails.append((lang or "", f, i in good, i in toxic))
    out, shares = {}, Counter()
    for part in {p for p, *_ in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step in range(1, 6):
                x = Counter()
                for p, f, g, t in fails:
                    if p == part:
                        first = next((c for c in order if c in f), None)
                        at = order.index(first) + 1 if first else 9
                        own = order[step - 1]
                        x["kept"] += at > step
                        x["removed"] += at == step
                        x["redundant"] += own in f and at < step
                        x["unique_fails"] += f == own
                        x["good_lost"] += at == step and g
                        x["toxic_lost"] += at == step and t
                out[part, order, step] = x
                shares[part, order[step - 1]] += x["removed"]
    return {(*k, *(x[n] for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shares[k[0], k[1][k[2] - 1]]) for k, x in out.items()}


def test_audit_of_awkward_rows(spark):
    long = " ".join(f"w{k}" for k in range(120))
    docs = [(1, None, "en"), (2, "", None), (3, "", ""), (4, long, "en"), (5, long, "en"), (5, long, "en"), (5, "HELLO there", "en"), (None, long, "en"), (None, long, "en"), (6, "a\x0bb c d #", "de"), (7, "ÄÖÜ AB cdefghijklmnopq", None), (8, "same " * 300, "de"), (9, "x" * 50_000, "en")]
    labels = [(4, 1, 0), (5, None, 1), (5, 1, None), (6, 0, 1), (None, 1, 1), (99, 1, 1)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, lang string, words int").repartition(3)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {tuple(r[n] for n in names) for r in filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got == audit_by_hand(docs, labels)
    kind = "doc_id long, text string, lang string"
    assert filter_audit.audit(spark.createDataFrame([], kind), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# Hard negatives


def test_negatives_equal_sql(spark, duck):
    same(op13_hard_negatives(spark, SF), duck.execute(hard_negatives.ORACLE_SQL).df())


def mined_by_hand(rows, every):
    rows = sorted({(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v, label in rows if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v)})
    out = Counter()
    for a in rows:
        if a[0] % every == 0:
            score = {b: sum(x * y for x, y in zip(a[2], b[2], strict=False)) for b in rows}
            first = lambda bs: sorted(bs, key=lambda b: (-score[b], b[0]))
            for p in first(b for b in rows if b != a and b[1] == a[1])[:5]:
                for rank, n in enumerate(first(b for b in rows if b[1] != a[1] and 30 * score[p] <= 100 * score[b] <= 90 * score[p])[:10]):
                    out[a[0], p[0], rank + 1, n[0], score[p], score[n]] += 1
    return out


@pytest.mark.parametrize(("anchors", "rows", "dims", "chunks"), [(256, 2048, 32, 8), (2, 16, 3, 8), (3, 7, 1, 4)])
def test_negatives_in_blocks_equal_all_pairs(spark, monkeypatch, anchors, rows, dims, chunks):
    """Many small tiles and chunks, ties by the dozen, negative scores, rows that take no part, vectors of other lengths and values near the limit."""
    for n, v in (("ANCHORS", anchors), ("ROWS", rows), ("DIMS", dims), ("CHUNKS", chunks)):
        monkeypatch.setattr(hard_negatives, n, v)
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(150, 10)), 1)
    v[40:70] = v[40]
    data = [(k * 3, x.tolist(), int(rng.integers(4))) for k, x in enumerate(v)]
    data += [(900, None, 1), (903, v[0].tolist(), None), (906, [float("nan")] * 10, 1), (909, [1.0, None] + [0.0] * 8, 1), (None, v[0].tolist(), 1), (912, [], 2), (915, [3.0, 1.0], 1), (918, [30_000.0] * 10, 2), (921, [-30_000.5] * 10, 1), (0, v[1].tolist(), 3), data[4], data[4]]
    df = spark.createDataFrame([(*x, 0) for x in data], "vec_id long, embedding array<double>, label int, rank int").repartition(3)
    got = Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives.mine(df, every=15).collect())
    assert got == mined_by_hand(data, 15) and len(got) > 100
    assert hard_negatives.mine(df.where("false")).count() == 0
    assert hard_negatives.mine(df.where("vec_id = 3")).count() == 0


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for most in (100, 1 << 20, 1 << 28):
        a, b = (rng.integers(-most, most, (5, 60)) for _ in range(2))
        assert (hard_negatives.product(a, b) == np.array([[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a])).all()
