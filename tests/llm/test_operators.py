"""Each operator against brute force, the library it follows, or held-out labels, on small and awkward rows."""

import json
import random
import textwrap
import time
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from tallyloom.llm import bpe, decontaminate, embedding_dedup, html_text, license_scan, simhash, substring_dedup, suffix_dedup, toxicity, url_filter
from tallyloom.llm.common import union_find
from tallyloom.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
ODD = ["", None, " \n\t", "a", "ΟΔΥΣΣΕΥΣ Σ", "x<|endoftext|> B it's we'LL 12 日本語😀", "q" * 3000, "z y " * 400, "dup dup", "dup dup"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r.doc_id, r.text, "extra") for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    rows += [(10_000 + k, t, None) for k, t in enumerate(ODD)] + [(None, "no id here", "x"), (10_003, "a", "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3)


def empty(spark, kind):
    return spark.createDataFrame([], kind)


def test_bpe_equals_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    got = bpe.encode_documents(docs, vocabulary()).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        want = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.token_ids) == want and r.n_tokens == len(want)
        assert r.decoded == t.decode(want, skip_special_tokens=False)
    codec = bpe.Codec(json.load(open(vocabulary())))
    assert codec.decode(list(got[0].token_ids)) == got[0].decoded
    assert bpe.encode_documents(empty(spark, "doc_id long, text string"), vocabulary()).count() == 0


def test_suffix_dedup_equals_definition(spark, docs):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, "a" * 900), (-2, "ab" * 150), (-3, "c" * 200), (-4, "c" * 201)]
    base = [t for _, t in rows if t and len(t) > 600][:20]
    for k in range(20):
        t, n = rng.choice(base), rng.choice([199, 200, 201, 260])
        at = rng.randrange(len(t) - n)
        rows.append((-10 - k, "".join(rng.choice("qwertz ") for _ in range(150)) + t[at : at + n] + "".join(rng.choice("uiopas ") for _ in range(90))))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 200).collect()
    want = suffix_dedup.brute([(t or "").encode() for _, t in rows], 200)
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_removed, r.n_spans, sha256(r.kept).hexdigest()) for r in got), key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key)
    assert suffix_dedup.remove_repeats(empty(spark, "doc_id long, text string")).count() == 0


def test_large_groups_of_contexts(monkeypatch, spark):
    monkeypatch.setattr(suffix_dedup, "GROUP_PARTS", 3)
    rng = random.Random(9)
    core = "".join(rng.choice("abcdefgh") for _ in range(230))
    rows = [(k, "".join(rng.choice("ijklmnop") for _ in range(120)) + core[rng.randrange(12) : 230 - rng.randrange(12)] + "".join(rng.choice("qrstuvwx") for _ in range(120))) for k in range(12)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 200).collect()
    want = suffix_dedup.brute([t.encode() for _, t in rows], 200)
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in got) == [(i, w[0], w[1]) for (i, _), w in zip(rows, want, strict=True)]


def test_simhash_equals_all_pairs(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    rows = [(r.doc_id, simhash.fingerprint((r.text or "").encode())) for r in docs.collect()]
    pairs = [(a, b) for a, x in rows for b, y in rows if a is not None and b is not None and a < b and (x ^ y).bit_count() <= 4]
    root = union_find(pairs)
    want = sorted((i, f"{x:016x}", root.get(i, i)) for i, x in rows if i is not None)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == want
    assert simhash.near_duplicates(empty(spark, "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("radius", [2, 3, 4, 5, 6])
def test_ball_links_with_hot_buckets(monkeypatch, spark, radius):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", 4 if radius < 5 else 32)
    rng = random.Random(5)
    fps = {0}
    for _ in range(6):
        c = rng.getrandbits(64)
        fps |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(radius + 2))) for _ in range(25 if radius < 5 else 6)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = union_find([tuple(r) for r in simhash.ball_links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius).collect()])
    mask = (1 << 64) - 1
    want = union_find([(a, b) for a in signed for b in signed if a < b and ((a & mask) ^ (b & mask)).bit_count() <= radius])
    assert {x: r for x, r in got.items()} == want


@pytest.mark.parametrize(("kind", "block", "lengths"), [("float", 4096, 1000), ("double", 16, 1000), ("float", 16, 1)])
def test_embeddings_equal_all_pairs(spark, monkeypatch, kind, block, lengths):
    """One and several blocks, vectors of two lengths, exact copies, vectors that link with nothing, and doubles apart by less than a float tells."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "LENGTHS", lengths)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    v = np.vstack([base, base[:15] + 0.25 * rng.normal(size=(15, 16)), base[:5], base[:1], base[:3] * (1 + 1e-12)]).astype("f4" if kind == "float" else "f8")
    rows = [(k, x.tolist(), 0) for k, x in enumerate(v)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None] + [0.0] * 14, 0), (904, [], 0), (905, [1.0, 2.0], 0), (906, [1.0, 2.1], 0)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, component_id int")).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    close = u @ u.T >= 0.9
    root = union_find([(i, j) for i in range(len(v)) for j in range(i) if close[i, j]])
    for k in range(len(v)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (close[k].sum() - 1, root.get(k, k), root.get(k, k) == k)
    for k in (900, 901, 902, 903, 904):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert (got[905].n_links, got[906].component_id, got[906].kept) == (1, 905, False) and len(got) == len(rows)
    assert embedding_dedup.near_duplicates(empty(spark, f"vec_id long, embedding array<{kind}>")).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    # Measured 951 of 990 with 329 toxic training texts; a first guess of 0.98 was never met at this size.
    assert sum(p == t for p, t in held) / len(held) > 0.95


def test_toxicity_awkward_rows(spark, docs):
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


def test_leaks(spark, docs):
    items = spark.createDataFrame([(1, "How many ships lie in the old northern harbour today? Exactly seventeen wooden ships."), (2, None), (3, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    rows = [(70, "x y z " * 200 + "how many ships lie in the old northern harbour today exactly seventeen wooden ships" + " p q r" * 90), (71, "ships harbour today " * 30), (72, "one two three four five six seven eight nine ten eleven twelve"), (73, None)]
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text")), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(70, 1), (72, 3)]
    assert decontaminate.find_leaks(docs, empty(spark, "item_id long, text string")).count() == 0


def test_wand_equals_exhaustive_scores(spark):
    rng = random.Random(2)
    for shard in next(decontaminate.shards(spark.read.parquet(f"{SF}/benchmark.parquet"))):
        for _ in range(60):
            terms = sorted(rng.sample(range(len(shard.index)), 40))
            score: dict = {}
            for t in terms:
                for item, w in shard.postings(t):
                    score[item] = score.get(item, 0) + w
            for limit in (0.05, 0.15, 0.3):
                want = sorted(i for i, s in score.items() if s >= limit)
                assert [i for i, _ in shard.search(terms, limit)] == want
                assert bool(want) <= bool(len(shard.possible(np.array(terms), np.zeros(len(terms), np.int64), limit)))


def plain_leaks(docs, items):
    """Every passage of every document against every item, scored with BM25 straight from its formula."""
    bags = {i: decontaminate.Counter(decontaminate.words(t)) for i, t in items}
    df = decontaminate.Counter(w for b in bags.values() for w in b)
    mean = sum(b.total() for b in bags.values()) / len(bags)
    weight = {i: {w: np.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * b.total() / mean)) for w, n in b.items()} for i, b in bags.items()}
    out = set()
    for doc, text in docs:
        own = decontaminate.words(text or "")
        for i, t in items:
            stride = 32
            while stride < bags[i].total():
                stride *= 2
            for lo in range(-stride, len(own), stride):
                near = own[max(0, lo) : lo + 2 * stride]
                if sum(weight[i].get(w, 0) for w in set(near)) >= 0.6 * sum(weight[i].values()) - 1e-9:
                    grams = {tuple(near[p : p + n]) for n in range(1, 6) for p in range(len(near) - n + 1)}
                    q, a = decontaminate.part_overlaps(t, decontaminate.question_answer(t), near, grams, 0.5, 0.5)
                    if q >= 0.5 and a >= 0.5:
                        out.add((doc, i))
    return out


def test_leaks_equal_every_passage_against_every_item(spark, monkeypatch):
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, text(rng.choice([6, 14, 30, 60])) + ". " + text(rng.choice([1, 3, 9])) + ".") for k in range(40)]
    items += [(90, "भारत की राजधानी क्या है और वहाँ कौन सी नदी बहती है? राजधानी नई दिल्ली है, नदी यमुना है।"), (91, text(900)), (92, items[3][1])]
    docs = [(k, text(rng.randrange(20, 500))) for k in range(30)]
    for k in range(60):
        own = decontaminate.words(rng.choice(items)[1])
        own = [w for w in own if rng.random() > rng.choice([0, 0.05, 0.2])]
        docs.append((100 + k, " ".join([text(rng.randrange(120)), *own, text(rng.randrange(200))])))
    docs += [(200, "पहले " + items[40][1] + " बाद में " + text(40)), (201, ""), (202, None), (100, docs[30][1])]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([*items, (5, None), (None, "x y z")], "item_id long, text string")
    found = []
    for postings in (500_000, 120):
        monkeypatch.setattr(decontaminate, "SHARD_POSTINGS", postings)
        found.append(sorted(tuple(r) for r in decontaminate.find_leaks(frame, bench).collect()))
    assert found[0] == found[1]
    assert {(r[0], r[1]) for r in found[0]} == plain_leaks(docs, items) and (200, 90) in {(r[0], r[1]) for r in found[0]}
    again = [r for r in found[0] if r[0] == 100]
    assert len(again) == 2 * len(set(again))


def test_licenses(spark):
    rows = [(1, "Some words.\nReleased under the MIT License.\nMore."), (2, "This work is licensed under the GNU General Public License, version 2."), (3, "The license of taste is free."), (4, None), (5, "Licensed under CC BY-NC 4.0."), (6, "Licensed under the Apache License, Version 2.0.")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "MIT"), (2, "GPL-2.0"), (5, "CC-BY-NC-4.0"), (6, "Apache-2.0")]


def test_fuzzy_passages(spark, docs):
    rng = random.Random(4)
    words = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(n)]
    p = words(80)
    q = [*p[:20], "changed", *p[21:50], *p[51:]]
    rows = [(501, " ".join(words(60) + p + words(40))), (502, " ".join(words(20) + q + words(90))), (503, " ".join(words(200))), (504, " ".join(p)), (505, " ".join(p))]
    got = substring_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))).collect()
    ids = {r.doc_id for r in got}
    assert {501, 502, 504, 505} <= ids and 503 not in ids
    assert all(r.end_word - r.start_word >= 50 and r.similarity >= 0.8 for r in got)
    assert substring_dedup.fuzzy_passages(empty(spark, "doc_id long, text string")).count() == 0


def test_chains_equal_quadratic_search():
    rng = random.Random(6)
    for _ in range(50):
        m = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(15)})
        best = {}
        for x in m:
            best[x] = substring_dedup.K + max([0.0, *(best[y] - substring_dedup.GAP * (x[0] - y[0] + x[1] - y[1]) for y in m if y[0] < x[0] and y[1] < x[1])])
        c = substring_dedup.chains(m)[0]
        score = substring_dedup.K * len(c) - substring_dedup.GAP * (c[-1][0] - c[0][0] + c[-1][1] - c[0][1])
        assert abs(score - max(best.values())) < 1e-9


def test_html():
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies.</div><article><header><h1>Head &amp; line</h1></header><p>One  two<br>three <b>four</b><p>Five</article><div id="comments"><p>A reader says this is long enough to count as text.</p></div><footer>&copy; x</footer>'
    assert html_text.main_text(page) == "Head & line\nOne two\nthree four\nFive"
    plain = "<body><ul><li><a href=a>Home</a><li><a href=b>About</a></ul><p>" + "This paragraph is the long text of the page. " * 3 + "</p><p>Short end.</p><ul><li><a href=c>More</a></ul>"
    assert html_text.main_text(plain).endswith("Short end.") and "Home" not in html_text.main_text(plain)
    assert html_text.main_text("") == ""


def test_html_marks_only_noise():
    get = html_text.main_text
    para = ["This paragraph is a long text of the page, number %d." % k for k in range(6)]
    body = "".join(f"<p>{x}</p>" for x in para)
    assert get(f'<article>{body}<article class="comment"><p>A reader says something long enough to count.</p></article></article>') == "\n".join(para)
    assert get(f'<article class="post category-social tag-ads">{body}<div class="legal">Terms stay.</div><p class="notice-period">Four weeks.</p><div class="site-notice">Gone.</div></article>') == "\n".join([*para, "Terms stay.", "Four weeks."])
    assert get(f'<div class="legal">Gone entirely, a legal line outside of the article that is long.</div><article>{body}</article>') == "\n".join(para)
    long = "Outside of the marked article there is one more paragraph, and it is long enough to be taken for a text of its own."
    assert get(f"<p>Skip</p><article>{body}</article><p>{long}</p><p>Top</p>") == "\n".join([*para, long])
    # Without a marked article: adverts do not interrupt, a link of its own inside the text stays, menus of links go.
    menu = "<ul>" + "".join(f"<li><a href=x>Entry {k}</a></li>" for k in range(5)) + "</ul>"
    aside = '<div class="ad">Buy this now, it is a very good thing to have.</div>' * 4
    assert get(f"<body>{menu}<p>{para[0]}</p>{aside}<p><a href=y>See also this</a></p><p>{para[1]}</p>{menu}") == "\n".join([para[0], "See also this", para[1]])
    assert get(f"<body>{menu}<p>{para[0]}</p>{menu}<p>{para[1]}</p>{menu}") == "\n".join(para[:2])
    assert get("<body><p>Short one.</p></body>") == "Short one." and get(f"<body>{menu}</body>") == ""
    # The window decides: a gap of three lines of links ends a run of blocks of three lines, not one of six; short lines then surge no more.
    gap = f"<p>{para[0]}</p>" + "<p><a href=x>link</a></p>" * 3 + "<p>Few.</p>"
    assert get(gap, 3) == para[0] and get(gap, 6).endswith("link\nFew.")


def test_html_extract(spark):
    rng = random.Random(14)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(rng.randrange(12, 60)))
    noise = ["<nav><a href=a>Home</a> <a href=b>News</a></nav>", '<div class="ad-slot">{}</div>', "<!-- <p>{}</p> -->", "<script>var a = '<p>{}</p>';</script>", '<section id="comments"><p>{}</p><p>{}</p></section>', "<aside>{}</aside>", "<form><p>{}</p><input></form>", "<footer>&copy; {}</footer>", "<style>p {{ }}</style>", '<div style="display: none">{}</div>', '<div role="alert">{}</div>']
    rows, want = [], {}
    for k in range(80):
        parts, blocks = [], []
        for _ in range(rng.randrange(1, 12)):
            if rng.random() < 0.5:
                parts.append(rng.choice(noise).replace("{}", text()))
            t = text()
            blocks.append(t + " & more")
            parts.append(f"<{x}>" + t.replace(" ", rng.choice([" ", "\n ", "  "]), 1) + f" &amp; more</{x}>" if (x := rng.choice(["p", "h2", "blockquote", "li", "pre"])) else "")
        inner = "".join(parts)
        rows.append((k, f"http://x/{k}", f"<html><head><title>{text()}</title></head><body>" + (f"<article>{inner}</article>" if k % 2 else inner) + "</body></html>", "clash"))
        want[k] = "\n".join(blocks)
    rows += [(None, None, None, "x"), (500, "u", "", None), (501, "u", "<p>" * 3000 + "deep", None), rows[0]]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)).collect()
    assert len(got) == len(rows) and sum(r.page_id == 0 for r in got) == 2
    assert all(r.text == want.get(r.page_id, "deep" if r.page_id == 501 else "") and r.n_chars == len(r.text) for r in got)
    assert html_text.extract(empty(spark, "page_id long, url string, html string")).count() == 0


def test_url_rules(spark):
    urls = ["http://www.Example.com/en/1", "https://a.example.com/en/2?x", "http://b.net/es/3#y", "http://x.com/de/4", "http://x.com", None, "no scheme", "http://net/fr/5"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/2", "example.com/en/", "block")
    assert got[2] == ("b.net", "/es/3", "net/es/", "block")
    assert got[3][2:] == ("com/", "allow") and got[4] == ("x.com", "", None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7][2:] == ("net/fr/", "block")


def test_fuzzy_passages_near_the_bound(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(4000)}"
    rows, want = [], set()
    for k in range(150):
        n, rate = [(55, 0.1), (55, 0.15), (60, 0.15), (80, 0.15), (60, 0.2)][k % 5]
        p = [word() for _ in range(n)]
        q = [f"x{rng.randrange(4000)}" if rng.random() < rate else x for x in p]
        rows += [(2 * k, " ".join([word() for _ in range(40)] + p + [word() for _ in range(40)])), (2 * k + 1, " ".join([word() for _ in range(30)] + q + [word() for _ in range(50)]))]
        same = [x == y for x, y in zip(p, q, strict=True)]
        # Brute force: any stretch of 50 words or more of which 0.8 agree.
        if any(sum(same[i:j]) >= 0.8 * (j - i) for i in range(n) for j in range(i + 50, n + 1)):
            want |= {2 * k, 2 * k + 1}
    got = substring_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = {r.doc_id for r in got}
    assert len(want & found) >= 0.99 * len(want)
    assert all(r.end_word - r.start_word >= 50 and r.similarity >= 0.8 for r in got)


def test_fuzzy_passages_with_common_lines(spark):
    """Against all pairs of texts: common lines in new orders, passages that many texts hold, repeats within a text, ties and odd rows."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 7)))
    some = lambda n: [word() for _ in range(n)]
    line = [some(rng.choice([18, 20, 30])) for _ in range(8)]
    texts = [some(40) + line[k % 8] + some(40) for k in range(48)]  # each line is common
    texts += [some(30) + line[0] + line[1] + line[2] + some(30), some(50) + line[0] + line[1] + line[2] + some(10)]
    texts += [some(9) + line[5] + line[6] + line[7] + some(5) for _ in range(7)]
    shared = some(70)
    for _ in range(12):  # a passage that many hold, each with changes of its own
        texts.append(some(30) + [word() if rng.random() < 0.08 else w for w in shared] + some(30))
    twice = some(80)
    texts += [some(20) + twice + some(30) + twice + some(10), some(5) + some(60) * 2, ["z", "y"] * 150, some(400)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    more = [(500, rows[0][1]), (None, rows[3][1]), (501, None), (502, ""), (503, rows[-1][1]), rows[7]]
    got = substring_dedup.fuzzy_passages(spark.createDataFrame([(*r, 1.0) for r in rows + more], "doc_id long, text string, similarity double").repartition(3)).collect()
    spans: dict = {}
    for i, a in rows:
        for j, b in rows:
            if i <= j:
                for x0, x1, y0, y1, _ in substring_dedup.passages_of(a, b, i == j, 50, 0.8):
                    spans.setdefault(i, []).append((x0, x1))
                    spans.setdefault(j, []).append((y0, y1))
    copies = {0, 500, 3, 7, 503, rows[-1][0]}
    assert {r.doc_id for r in got} - copies == set(spans) - copies and {48, 49, len(rows) - 4, len(rows) - 3} <= set(spans)
    held: dict = {}
    for r in got:
        held.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    lost = [(i, s) for i, own in spans.items() for s in own if len(held[i] & set(range(*s))) < 0.9 * (s[1] - s[0])]
    assert len(lost) <= 0.02 * sum(map(len, spans.values())), lost


def test_half_a_passage_in_many_texts(spark):
    """Two texts share 60 words; twenty others hold the first half, twenty the second."""
    rng = random.Random(19)
    some = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    one, two = some(30), some(30)
    rows = [(0, f"{some(20)} {one} {two} {some(20)}"), (1, f"{some(9)} {one} {two} {some(40)}")]
    rows = [(10 + k, f"{some(20)} {one} {some(20)}") for k in range(20)] + [(40 + k, f"{some(20)} {two} {some(20)}") for k in range(20)] + [(k + 90, t) for k, t in rows]
    got = substring_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.other_doc_id) for r in got) == [(90, 20, 80, 91), (91, 9, 69, 90)]


def test_license_wordings_on_one_line_and_wrapped():
    scanner = license_scan.Scanner()
    names = lambda t: {x[0] for x in scanner.scan(t)}
    for name, wordings in license_scan.TEMPLATES.items():
        for w in wordings:
            assert names("Some words before. " + w + " Some words behind.") == {name}, w
            assert names("Some words.\n\n" + textwrap.fill(w, 72, initial_indent="# ", subsequent_indent="# ") + "\n\nMore.") == {name}, w
    assert names("Licensed under the Apache License, Version 2.0 or released under the MIT License.") == {"Apache-2.0", "MIT"}
    assert names("He released a bird under the bridge. The fee for the license of a boat is two coins.") == set()


def test_licenses_that_differ_by_a_name():
    scanner = license_scan.Scanner()
    names = lambda t: {x[0] for x in scanner.scan(t)}
    assert names("Pictures under CC BY-ND 4.0. Licensed under CC BY-ND 4.0.") == {"CC-BY-ND-4.0"}
    assert names("Licensed under CC BY-NC-SA 4.0.") == {"CC-BY-NC-SA-4.0"} and names("Licensed under CC BY-NC-SA 3.0.") == set()
    assert names("This work is not released under the MIT License.") == set()
    assert names("Released under the Eiffel License.") == set()
    gpl = license_scan.TEMPLATES["GPL-3.0"][1]
    assert names(gpl) == {"GPL-3.0"} and names(gpl.replace("GNU General", "GNU Affero General")) == {"AGPL-3.0"}
    assert names(gpl.replace("GNU General", "GNU Lesser General").replace("program", "library")) == {"LGPL-3.0"}
    assert names(gpl.replace("version 3", "version 2")) == {"GPL-2.0"} and names(gpl.replace("program", "collection")) == {"GPL-3.0"}
    two, three = license_scan.TEMPLATES["BSD-2-Clause"][1], license_scan.TEMPLATES["BSD-3-Clause"][1]
    assert names(two) == {"BSD-2-Clause"} and names(three) == {"BSD-3-Clause"}
    assert names("// SPDX-License-Identifier: MIT\n// SPDX-License-Identifier: LGPL-2.1\n") == {"MIT", "LGPL-2.1"}


def test_license_of_the_largest_reduction():
    """The wording with more differences is compressed better, as its words stand together: the reduction decides."""
    import zstandard

    known = {"A": ("released under the green garden license of the old botanical society",), "B": ("released under the garden license of the old botanical society today anyhow",)}
    text = "Some words before. Released under the garden license of the old botanical society. Some words behind."
    assert [x[0] for x in license_scan.Scanner(known).scan(text)] == ["B"]
    # Every block against every wording, each compressed on its own.
    scanner = license_scan.Scanner()
    words = [m[0].lower() for t in license_scan.TEMPLATES.values() for w in t for m in license_scan.WORDS.finditer(w + " and some other words " * 9)]
    found = scanner.blocks(words)
    assert len(found) > 40
    for start, size in found:
        block = " ".join(words[start : start + size]).encode()
        size_of = lambda **k: len(zstandard.ZstdCompressor(level=-1, **k).compress(block))  # noqa: B023, E731
        saved = [size_of() - size_of(dict_data=zstandard.ZstdCompressionDict(" ".join(want).encode().rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, _, want in scanner.known]
        got = scanner.reductions(words[start : start + size])
        assert [n for n, _, _ in got] == sorted((n for n, _, _ in got), reverse=True) and len(got) > 1
        top = max(saved)
        assert abs(got[0][0] - top) <= 8 and saved[got[0][1]] >= top - 8  # a prepared dictionary may find other matches


def test_license_scan_finds_what_was_planted(spark):
    rng = random.Random(27)
    word = lambda: "".join(rng.choices("abcdefghijk", k=rng.randrange(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    rows, want = [(900, None), (901, ""), (902, some(60_000)), (903, "the license of taste " * 3000)], []
    for k in range(120):
        text = [some(rng.randrange(1, 200))]
        for name in rng.sample(sorted(license_scan.TEMPLATES), rng.randrange(0, 3)):
            own = rng.choice(license_scan.TEMPLATES[name]).split()
            if len(own) > 25 and rng.random() < 0.5:  # one changed word that names nothing
                at = rng.choice([i for i, w in enumerate(own) if w.islower() and not license_scan.NAME.match(w) and w.isalpha()])
                own[at] = word()
            text += [" ".join(own) if rng.random() < 0.5 else textwrap.fill(" ".join(own), 60, initial_indent="# ", subsequent_indent="# "), some(rng.randrange(60, 200))]
            want.append((k, name))
        rows.append((k, rng.choice([" ", "\n\n"]).join(text)))
    rows.append(rows[-1])
    want += [w for w in want if w[0] == 119]
    got = license_scan.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string").repartition(3)).collect()
    assert sorted((r.doc_id, r.license) for r in got) == sorted(want)
    assert license_scan.scan(empty(spark, "doc_id long, text string")).count() == 0


def test_rows_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1]), (None, texts[0]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (3, texts[4]), (3, texts[0]), (None, None)]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (3, texts[4]), (None, None)], key=str)

    spark.createDataFrame([(1, texts[2])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, texts[2]), (None, texts[3]), (5, texts[2]), (5, texts[4]), (6, None)]
    got = corpus_pipeline.drop_benchmark_leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, texts[3]), (5, texts[4]), (6, None)], key=str)


def test_leaks_with_a_changed_or_missing_answer(spark):
    rng = random.Random(15)
    word = lambda: f"w{rng.randrange(5000)}"
    items, rows, want = [], [], []
    for k in range(24):
        question, answer = [word() for _ in range(20)], [word() for _ in range([1, 2, 5, 9][k % 4])]
        items.append((k, " ".join(question) + "? " + " ".join(answer) + "."))
        at = len(answer) // 2
        changed = [*answer[:at], "other", *answer[at + 1 :]]
        for n, end in enumerate((answer, changed, answer[:-1])):
            rows.append((3 * k + n, " ".join([word() for _ in range(50)] + question + end + [word() for _ in range(50)])))
            want.append((3 * k + n, k))
    rows.append((900, " ".join(word() for _ in range(300))))
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == want


def test_url_filter_awkward_tables(spark):
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = [(1, "http://a.test/en/1", "x"), (1, "http://a.test/en/1", "y"), (2, "HTTP://B.test/en/2", None), (None, None, None), (3, "x" * 50_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted((r.page_id or 0, r.host, r.verdict) for r in url_filter.judge(pages, labels).collect())
    assert len(got) == len(rows) and got[1] == got[2] and got[0] == (0, "", "allow") and got[3][1] == "b.test"
    none = empty(spark, "page_id long, url string")
    assert url_filter.judge(none, labels).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, labels.where("doc_id > 9")).collect()} == {"allow"}


def test_toxicity_empty_and_bounded(spark, docs, monkeypatch):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(docs.where("doc_id = -5"), labels).count() == 0
    whole = toxicity.training_rows(docs, labels)
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 5000)
    some = toxicity.training_rows(docs.repartition(5), labels)
    assert 0 < len(some) < len(whole) and sum(len((r.text or "").encode()) for r in some) <= 5000
    assert some == toxicity.training_rows(docs, labels) and set(some) <= set(whole)


def test_rewrite_texts(spark):
    """Null and repeated rows, cuts within characters, columns of clashing names."""
    shared = "é" * 150  # 300 bytes
    rows = [(1, "a " * 20 + shared, 9, "x"), (2, shared + "b", 9, "y"), (3, None, 9, "z"), (4, "", 9, None), (5, "日" * 80, 9, "w"), (None, "short", 9, "v")]
    d = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, n_chars long, rk string")
    got = sorted(((r.doc_id or 0, r.text, r.n_chars, r.rk) for r in suffix_dedup.rewrite_texts(d, 200).collect()), key=str)
    want = {i: b"" if t is None else t.encode() for i, t, _, _ in rows}
    brute = dict(zip([*want, 6], suffix_dedup.brute([*want.values(), want[1]], 200), strict=True))
    assert [g[0] for g in got] == [0, 1, 1, 2, 3, 4, 5] and got[4] == (3, None, 9, "z")
    for i, text, n, _ in got:
        if i not in (0, 3):
            assert len(text.encode()) == len(want[i]) - brute[i][0] and n == len(text)
    assert suffix_dedup.rewrite_texts(d.where("doc_id = 77"), 200).count() == 0


def test_long_texts_in_stretches(monkeypatch, spark):
    """Texts over several stretches: the anchors are those of the whole text."""
    rng = random.Random(41)
    text = bytes(rng.choice(b"abcd ") for _ in range(30_000))
    data, at = np.frombuffer(text, np.uint8), np.array([0, 12_000, 12_150, 30_000])
    whole = suffix_dedup.anchors(data, at[:-1], at[1:], 200)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 5_000)
    assert suffix_dedup._anchors_of(data, at, 200).tolist() == whole.tolist()


def test_items_and_vectors_that_share_an_id(spark):
    """Two benchmark items of one id are searched each; two vectors of one id are linked each by itself."""
    one, two = ("what is the name of the tall mountain that stands behind the old village church in the far north", "how many grey geese fly over the long river when the first cold wind of autumn comes down")
    pad = " ".join(f"filler{k}" for k in range(60))
    items = spark.createDataFrame([(1, one), (1, two), (2, "why does the quick red fox run from the slow brown hound every single morning of the week")], "item_id long, text string")
    docs = spark.createDataFrame([(10, f"{pad} {one} {pad}"), (11, f"{pad} {two} {pad}"), (12, f"{one} {pad} {two}"), (13, pad)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()) == [(10, 1), (11, 1), (12, 1)]
    x, y = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.1, 0.0]
    rows = [(1, x), (1, y), (2, [1.0, 0.02, 0.0, 0.1]), (3, [0.0, 1.0, 0.12, 0.0]), (-5, [0.0, 0.0, 1.0, 1.0]), (None, [0.0, 0.0, 1.0, 1.1])]
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == [(-5, 1, -5), (0, 1, -5), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


@pytest.mark.parametrize("piece", ['<a href="', "<a ", "<div>", "<![CDATA[", "<!x", "<a b='", '<p class="a'])
def test_malformed_pages_take_linear_time(piece):
    small, large = ("".join([piece] * (size // len(piece))) for size in (100_000, 1_000_000))
    took = []
    for page in (small, small, large):
        began = time.process_time()
        html_text.lines_of(page)
        took.append(time.process_time() - began)
    assert took[2] < 40 * took[1] + 0.2


@pytest.mark.parametrize("cells", [1 << 27, 20])
def test_matched_words_are_longest(monkeypatch, cells):
    """A longest common subsequence whether its table is held whole or halved, as long as the quadratic search says."""
    monkeypatch.setattr(substring_dedup, "CELLS", cells)
    rng = random.Random(8)
    for _ in range(400):
        u, v = ([rng.choice("abcd") for _ in range(rng.randrange(25))] for _ in range(2))
        m = substring_dedup._matched(u, v)
        best = [[0] * (len(v) + 1) for _ in range(len(u) + 1)]
        for i, x in enumerate(u):
            for j, y in enumerate(v):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(m) == best[-1][-1] and all(u[i] == v[j] for i, j in m) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(m, m[1:], strict=False))


def test_passages_of_lines_that_many_texts_hold(spark):
    """Two texts hold three lines, the second with every 11th word changed, and each line stands in twenty other texts: no 5-mer is rare."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(100_000)}"
    rows, pairs = [], []
    for k in range(12):
        lines = [[word() for _ in range(20)] for _ in range(3)]
        for line in lines:
            rows += [" ".join([word() for _ in range(30)] + line + [word() for _ in range(30)]) for _ in range(20)]
        own = sum(lines, [])
        changed = [word() if i % 11 == 5 else x for i, x in enumerate(own)]
        pairs.append((len(rows), len(rows) + 1))
        rows += [" ".join([word() for _ in range(20)] + x + [word() for _ in range(20)]) for x in (own, changed)]
    got = {(r.doc_id, r.other_doc_id) for r in substring_dedup.fuzzy_passages(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)).collect()}
    assert {p for p in pairs if p in got and p[::-1] in got} == set(pairs)


def test_texts_that_share_only_frequent_seeds(spark):
    """Two texts of the largest keys, whose every common seed stands in 100 other texts, each of which holds less than a passage."""
    rng = random.Random(41)
    some = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(n)]
    lines, stretch, tail = [some(10) for _ in range(6)], some(21), some(40)
    broken = lambda: [w for line in lines for w in (*line, *some(1))]  # noqa: E731  ten words, then one of its own
    # 21 words, then four of every five: two seeds far enough apart are in all texts, and there is no other seed.
    grown = lambda: stretch + [w if k % 5 else some(1)[0] for k, w in enumerate(tail)]
    held = [" ".join(some(30) + line + some(30)) for line in (*lines, stretch) for _ in range(100)]
    for first_id, passage in ((1000, broken), (2000, grown)):
        own = [" ".join(some(9) + passage() + some(9)) for _ in range(300)]
        keyed = spark.createDataFrame([(t,) for t in own], "text string").selectExpr("text", "xxhash64(text) as ck").orderBy("ck").collect()
        two = [r.text for r in keyed[-2:]]
        assert substring_dedup.passages_of(*two, False, 50, 0.8)
        rows = [(k, t) for k, t in enumerate(held)] + [(first_id, two[0]), (first_id + 1, two[1])]
        got = substring_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert {(r.doc_id, r.other_doc_id) for r in got} == {(first_id, first_id + 1), (first_id + 1, first_id)}


def test_keys_of_the_same_texts_pair_them_once():
    m = np.array([(key, ck, 10 * key, 10 * key + 20) for key in range(50) for ck in range(5)])
    got = [r for b in substring_dedup._key_rows([substring_dedup._batch(m, ("key", "ck", "pi", "pj"))]) for r in zip(*(b.column(k).to_pylist() for k in (1, 2)), strict=True)]
    assert sorted(got) == [(i, j) for i in range(5) for j in range(i + 1, 5)]


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_pairs_of_seeds_in_blocks(monkeypatch, block):
    """Blocks smaller than a seed's places change nothing: seeds of few and many texts, of one text, with copies and repeats."""
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    rng = random.Random(3)
    rows = sorted((seed, ck, pos) for seed, texts in ((1, 3), (2, 70), (3, 1), (4, 64), (5, 65), (6, 2), (7, 200)) for ck in range(texts) for pos in [rng.randrange(40) for _ in range(rng.choice([1, 1, 1, 2, 5]))] * rng.choice([1, 2]))
    want, held = [], {}
    for seed, ck, pos in sorted(set(rows)):
        held.setdefault(seed, {}).setdefault(ck, []).append(pos)
    for seed, texts in held.items():
        mark = substring_dedup.MANY if len(texts) > 64 or max(map(len, texts.values())) > 1 else substring_dedup.ALONE
        want += [(ck, ck, x, y) for ck, at in texts.items() for x, y in zip(at, at[1:], strict=False)]
        want += [(ck, seed, x, mark) for ck, at in texts.items() for x in at if len(texts) > 1]
        want += [(a, b, texts[a][0], texts[b][0]) for a in texts for b in texts if a < b and len(texts) <= 64]
    batches = [substring_dedup._batch(np.array(rows[k : k + 9]), ("seed", "ck", "pos")) for k in range(0, len(rows), 9)]
    assert sorted(tuple(r.values()) for b in substring_dedup._pair_rows(batches) for r in b.to_pylist()) == sorted(want)


def test_classes_of_texts_by_their_hubs():
    # Hubs 0 and 1 are joined by the text that has both; hub 2 stands alone; texts without a hub are classes of their own.
    got = substring_dedup.labels(np.array([0b0001, 0b0010, 0b0011, 0b0100, 0, 0])).tolist()
    assert got[0] == got[1] == got[2] and len({got[0], got[3], got[4], got[5]}) == 4


def test_runs_of_one_word_meet_by_the_words_beside_them(spark):
    """Texts that share a run of one word alone have no key in common; two of which the run and words without a common 5-mer make a passage are found among 150 such."""
    rng = random.Random(51)
    some = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(n)]
    tail = some(20)
    grown = lambda: ["aaa"] * 32 + [w if k % 5 else some(1)[0] for k, w in enumerate(tail)]
    texts = [some(20) + ["aaa"] * rng.randrange(20, 39) + some(40) for _ in range(150)] + [some(9) + grown() + some(9) for _ in range(2)]
    codes = [substring_dedup.word_codes([w.encode() for w in t]) for t in texts]
    keys = [set(substring_dedup.run_keys(c, 50, 0.8)[:, 0].tolist()) for c in codes]
    assert all(keys) and not any(keys[i] & keys[j] for i in range(150) for j in range(i)) and keys[150] & keys[151]
    h, at = substring_dedup.seeds(codes[0])
    places = np.stack([np.zeros(len(h), np.int64), at, h.view(np.int64), np.full(len(h), substring_dedup.MANY)], axis=1)
    inner = [(i, j) for b in substring_dedup._composites([places]) for i, j in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True) if h[i] == h[j]]
    assert inner == []
    got = substring_dedup.fuzzy_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.other_doc_id) for r in got} == {(150, 151), (151, 150)}


def test_texts_with_a_passage_are_promising():
    rng = random.Random(52)
    said = set()
    for k in range(300):
        word = lambda: f"w{rng.randrange(rng.choice([30, 3000]))}"  # noqa: B023, E731
        p = [word() for _ in range(rng.choice([50, 60, 83, 84, 120]))]
        q = [f"x{rng.randrange(3000)}" if rng.random() < rng.choice([0.1, 0.2, 0.3]) else x for x in p]
        a, b = (" ".join([word() for _ in range(rng.randrange(60))] + x + [word() for _ in range(rng.randrange(60))]) for x in (p, q if k % 4 else [word() for _ in p]))
        known: dict = {}
        good = substring_dedup.promising(substring_dedup.known_text(b, known), [substring_dedup.known_text(t, known) for t in (a, "z " * 60)], 50, 0.8)
        found = bool(substring_dedup.passages_of(a, b, False, 50, 0.8))
        said.add((found, good[0]))
        assert good[0] or not found
        assert not good[1]
    assert {(True, True), (False, False)} <= said


@pytest.mark.parametrize("held", [4_000_000, 150])
def test_seeds_dealt_in_blocks(monkeypatch, held):
    """Whatever a task may hold, blocks in any order give the rows of _pair_rows() over all seeds in order; keys pass through."""
    monkeypatch.setattr(substring_dedup, "HELD", held)
    rng = random.Random(5)
    rows = [(seed << 40, ck, pos, seed << 40) for seed, texts in ((1, 3), (2, 70), (3, 1), (4, 64), (5, 300), (6, 2), (7, 200)) for ck in range(texts) for pos in sorted(rng.sample(range(40), rng.choice([1, 1, 1, 2, 5])))]
    of = sorted({r[1] for r in rows}, key=lambda _: rng.random())
    parts = [np.array([r for r in rows if r[1] in of[k : k + 40]]) for k in range(0, len(of), 40)]
    keys = list(substring_dedup._dealt(substring_dedup.KEYS, [np.array([(9, 8, 7, 6, 9)])]))
    dealt = [b for m in parts for b in substring_dedup._dealt(substring_dedup.SEEDS, [m])]
    got = list(substring_dedup._found_rows([*dealt, *keys]))
    read = lambda kind: sorted(tuple(x) for b in got for b in [b.filter(pa.compute.equal(b.column(0), kind))] for m in substring_dedup._buckets([b], 4) for x in m.tolist())
    want = [tuple(r.values()) for b in substring_dedup._pair_rows([np.array(sorted(rows))[:, :3]]) for r in b.to_pylist()]
    assert read(substring_dedup.MATCHES) == sorted(r for r in want if r[3] >= 0)
    assert read(substring_dedup.PLACES) == sorted((ck, pos, seed, mark) for ck, seed, pos, mark in want if mark < 0)
    assert read(substring_dedup.KEYS) == [(9, 8, 7, 6)]


def test_seeds_of_many_texts_are_dealt_by_text_and_not_by_pair(monkeypatch):
    """A seed of 64 texts is 64 rows and not 2,016 matches more; the texts that near_diagonals() leaves of all matches meet by one group of seeds, by two, by far ones, and with themselves."""
    rng = random.Random(61)
    at = np.cumsum([rng.choice([1, 4, 13, 60, 200]) for _ in range(40)]).tolist()
    rows = []
    for ck in range(0, 64 << 16, 1 << 16):
        start = rng.randrange(500)
        rows += [(seed + 1 << 40, ck, start + at[seed], seed + 1 << 40) for seed in ([0] if ck else []) + rng.sample(range(1, 40), rng.choice([0, 2, 6]))]
    rows += [(50 + k << 40, 1 << 16, p + k, 50 + k << 40) for k in range(13) for p in (3000, 3400)]
    sort = lambda batches, *by: pa.Table.from_batches(list(batches)).sort_by([(x, "ascending") for x in by]).to_batches()
    seeds = sort(substring_dedup._dealt(substring_dedup.SEEDS, [np.array(rows)]), "kind", "bucket")
    found = list(substring_dedup._found_rows(seeds, grouped=True))
    places = [m for m in substring_dedup._buckets(found, 4)]
    assert sum(map(len, places)) <= len(rows) and {k for b in found for k in b.column(0).to_pylist()} == {substring_dedup.PLACES}
    matched = [m for b in substring_dedup._pair_rows([np.array(sorted(rows))[:, :3]]) for m in b.to_pylist() if m["pb"] >= 0]
    assert len(matched) > 2016
    m = np.array(sorted(tuple(r.values()) for r in matched))
    want = set(map(tuple, substring_dedup.near_diagonals(m, 50).tolist()))
    for most in (substring_dedup.MATCHED, 10):
        monkeypatch.setattr(substring_dedup, "MATCHED", most)
        dealt = sort(substring_dedup._text_rows(50)(sort(found, "bucket")), "kind", "bucket")
        got = {(r["a"], r["b"]) for b in substring_dedup._keyed_rows(50)(dealt) for r in b.to_pylist() if r["pi"] < 0}
        assert (1 << 16, 1 << 16) in want and len(want) > 50 and want <= got and len(got) < 64 * 63 // 2


def test_pairs_of_many_keys_are_told_once(monkeypatch):
    m = np.array([(key, ck, 0) for key in range(30) for ck in range(70)])
    got = [(a, b) for x in substring_dedup._rest_rows([substring_dedup._batch(m, ("key", "ck", "mask"))]) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)]
    want = [(i, j) for i in range(70) for j in range(i + 1, 70)]
    assert sorted(got) == want
    monkeypatch.setattr(substring_dedup, "MATCHED", 100)
    got = {(a, b) for x in substring_dedup._rest_rows([substring_dedup._batch(m, ("key", "ck", "mask"))]) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)}
    assert sorted(got) == want


def test_texts_whose_shorter_hashes_are_equal(spark, monkeypatch):
    """Where texts share the bits that are dealt, all bits are."""
    rng = random.Random(62)
    some = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passage = some(60)
    rows = [(k, some(30) + " " + passage if k % 10 == 0 else some(80)) for k in range(60)]
    want = {(a, b) for a in range(0, 60, 10) for b in range(0, 60, 10) if a != b}
    for spared in (16, 60):
        monkeypatch.setattr(substring_dedup, "SPARED", spared)
        got = {(r.doc_id, r.other_doc_id) for r in substring_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == want
