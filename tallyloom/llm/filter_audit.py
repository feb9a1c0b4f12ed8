"""Filter interaction audit: which of five filters removes what, in every order they can be applied in."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

FILTERS = "ABCDE"
MASKS = range(1 << len(FILTERS))
#: Orders of all filters together, shared out over the filters that a document fails: 120, 60, 40, 30 or 24 for each.
ORDERS = 120
SPACE = "[\\x20\\x09-\\x0D]+"


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 (128 bits of the text), part, c and d (its own flags), copies, words, distincts: one row a text of a document.

    Texts are dealt once by document; words are exploded behind that, so that both aggregates, by (document, word)
    and by document, find a document's rows together and shuffle nothing. A null before each text's words counts
    rows, those without words and those repeated.
    """
    text = F.coalesce("text", F.lit(""))
    flags = F.when(F.regexp_count("text", F.lit("[A-Z]")) * 100 > F.length("text") * 10, 4).otherwise(0) + F.when(F.col("text").rlike("[#$%&*|]"), 8).otherwise(0)
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text")).select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), flags.alias("flags"))
    dealt = rows.repartition("doc_id", "h1", "h2")  # also keeps generated code from working out the flags anew for every word
    words = dealt.select("doc_id", "h1", "h2", "part", "flags", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.split("text", SPACE))).alias("word")).where("word is null or word <> ''")
    key = ["doc_id", "h1", "h2", "part", "flags"]
    per_word = words.groupBy(*key, "word").agg(F.count("*").alias("n"))
    per = per_word.groupBy(*key).agg(F.max(F.when(F.col("word").isNull(), F.col("n"))).alias("copies"), F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0)).alias("total"), F.count("word").alias("distincts"))
    return per.withColumn("words", F.expr("total div copies"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, copies, mask, good, toxic of every text of a document; bit k of mask: it fails filter k of FILTERS."""
    per = materialize(word_counts(docs))
    first = per.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # By document, not by text: a text that many documents share is no hot key.
    joined = per.join(first, ["doc_id", "h1", "h2"], "left").join(marked, "doc_id", "left")
    mask = F.when(F.col("words") < 100, 1).otherwise(0) + F.when(F.col("distincts") * 100 < F.col("words") * 80, 2).otherwise(0) + F.col("flags") + F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 16).otherwise(0)
    return joined.select("part", "copies", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _sum_of(counts: str, chosen) -> Column:
    """Sum of the counts whose mask is chosen."""
    picked = F.filter(F.sequence(F.lit(0), F.lit(len(MASKS) - 1)), chosen)
    return F.aggregate(picked, F.lit(0).cast("long"), lambda acc, m: acc + F.element_at(counts, m + 1))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (language), order of the five filters and step: documents kept, removed, redundant, failing this filter only, good and toxic ones removed, and the filter's sum over all orders.

    A document's flags become one of 32 masks; counts of masks by part, one pass with map-side sums, tell all of
    it. Null and empty texts are the same text of no words; a null language is the empty part. A document that
    stands on several rows counts as often; rows without an id never repeat a smaller id, nor are repeated.
    Several labels of an id count together: good or toxic if one says so. No documents, no rows.
    """
    fails = failures(docs, labels)
    counted = fails.groupBy("part").agg(*(F.sum(F.when(c & (F.col("mask") == m), F.col("copies")).otherwise(0)).alias(f"{n}_{m}") for n, c in (("all", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic"))) for m in MASKS))
    packed = counted.select("part", *(F.array(*(f"{n}_{m}" for m in MASKS)).alias(f"of_{n}") for n in ("all", "good", "toxic")))
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS))))
    place = [F.instr("filter_order", letter) for letter in FILTERS]
    masks = lambda fits: sum((F.when(fits(at), 1 << k).otherwise(0) for k, at in enumerate(place)), F.lit(0))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("step"), masks(lambda at, k=k: at == k).alias("own"), masks(lambda at, k=k: at < k).alias("before")) for k in range(1, len(FILTERS) + 1))))
    steps = packed.withColumn("filter_order", orders).withColumn("at", each).select("*", "at.*")
    own, seen = (lambda m: m.bitwiseAND(F.col("own")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)
    removed = lambda m: own(m) & ~seen(m)
    picked = F.filter(F.sequence(F.lit(0), F.lit(len(MASKS) - 1)), own)
    share = F.aggregate(picked, F.lit(0).cast("long"), lambda acc, m: acc + F.element_at("of_all", m + 1) * (F.lit(ORDERS) / F.bit_count(m)).cast("long"))
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), _sum_of("of_all", lambda m: ~own(m) & ~seen(m)).alias("kept"), _sum_of("of_all", removed).alias("removed"), _sum_of("of_all", lambda m: own(m) & seen(m)).alias("redundant"),
        _sum_of("of_all", lambda m: m == F.col("own")).alias("unique_fails"), _sum_of("of_good", removed).alias("good_lost"), _sum_of("of_toxic", removed).alias("toxic_lost"), share.alias("shapley"),
    )


#: Follows every document through every order, step by step; nothing of masks.
ORACLE_SQL = r"""
with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
judged as (select doc_id, part, len(w) < 100 as a, 100 * len(list_distinct(w)) < 80 * len(w) as b,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d,
    coalesce(min(doc_id) over (partition by t) < doc_id, false) as e from texts),
marks as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
docs as (select part, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when d then 'D' else '' end || case when e then 'E' else '' end as failed, coalesce(good, false) as good, coalesce(toxic, false) as toxic
    from judged left join marks using (doc_id)),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select p.x || q.x || r.x || s.x || t.x as o from l p, l q, l r, l s, l t where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
places as (select o, step, o[step] as f, o[1:step - 1] as earlier from orders, (select unnest([1, 2, 3, 4, 5]) as step)),
kinds as (select part, failed, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as x from docs group by part, failed),
walked as (select part, o, step, f, n, g, x, contains(failed, f) as fails, len(list_intersect(string_split(failed, ''), string_split(earlier, ''))) > 0 and failed <> '' and earlier <> '' as gone, failed = f as alone from kinds, places),
summed as (select part, o, step, f, coalesce(sum(n) filter (not fails and not gone), 0) as kept, coalesce(sum(n) filter (fails and not gone), 0) as removed, coalesce(sum(n) filter (fails and gone), 0) as redundant,
    coalesce(sum(n) filter (alone), 0) as unique_fails, coalesce(sum(g) filter (fails and not gone), 0) as good_lost, coalesce(sum(x) filter (fails and not gone), 0) as toxic_lost from walked group by part, o, step, f)
select part, o as filter_order, step::integer as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
    (sum(removed) over (partition by part, f))::bigint as shapley from summed
"""
