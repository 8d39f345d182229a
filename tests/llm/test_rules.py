import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from sievemill.llm import rules
from sievemill.llm.common import let


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), len(w) < 20 or 100 * len(repeated) > 30 * len(w)


def test_base_counts(spark):
    rng = random.Random(9)
    texts = [None, "", " \n\x0b ", "a", "a " * 8, "a " * 9, "one two " * 4, "#*$%&|<> é😀\xa0b", "\n\nx\nx \nx\n"]
    for _ in range(200):
        w = [rng.choice("abcdefg") for _ in range(rng.choice([7, 8, 9, 30, 200]))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w))
            w[at:at] = w[: rng.choice([3, 8, 12])]
        texts.append("".join(x + rng.choice([" ", "\n", "\t ", "  "]) for x in w))
    texts += ["long " * 30_000, " ".join(str(i) for i in range(20_000)), texts[12], texts[12]]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)] + [(None, texts[-1], 0, "")], "doc_id long, text string, n_words int, kept string")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (20, 1, 0), (20, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = rules.judge(df, labels).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        assert tuple(r)[1:7] == base(texts[-1 if r.doc_id is None else r.doc_id]), r
        assert not (r.base_failed and r.kept)
    assert rules.judge(df, labels.limit(0)).where("ratio <> 0").count() == 0
    assert rules.judge(df.limit(0), labels).count() == 0


def test_ratio(spark):
    docs = [(i, f"the good words of text {i % 5} flow on") for i in range(30)] + [(100 + i, f"JUNK!! BUY!! {i} NOW!! |") for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(105, 1, 1)], "doc_id long, quality int, toxic int")
    buckets = 64
    grams = {r.doc_id: r.g for r in df.select("doc_id", F.transform(let(let(rules.words(F.col("text")), rules.hashed), rules.ngrams), lambda p: rules.bucket(p, buckets)).alias("g")).collect()}
    raw, trusted = Counter(b for g in grams.values() for b in g), Counter(b for i, g in grams.items() if i < 20 for b in g)
    n_raw, n_trusted, prior = sum(raw.values()), sum(trusted.values()), 3
    for r in rules.judge(df, labels, buckets=buckets, prior=prior).collect():
        g = grams[r.doc_id]
        assert len(g) == 2 * r.n_words - 1
        own, mine = Counter(g), int(r.doc_id < 20)
        share = (n_trusted - len(g) * mine) / (n_raw - len(g))
        want = sum(math.log((trusted[b] - own[b] * mine + prior * share) / (share * (raw[b] - own[b] + prior))) for b in g) / len(g)
        assert math.isclose(r.ratio, want, abs_tol=1e-9)


def test_label_of_a_document_does_not_decide_its_own_verdict(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = rules.judge(docs, labels).join(docs.select("doc_id", "lang"), "doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left").where("not base_failed and ratio > -0.5").collect()
    for lang in {r.lang for r in out}:
        rate = lambda rows: sum(r.kept for r in rows) / len(rows)
        known, others = [r for r in out if r.lang == lang and r.quality is not None], [r for r in out if r.lang == lang and r.quality is None]
        assert abs(rate(known) - rate(others)) < 0.05
        assert rate([r for r in known if r.quality == 1]) > 0.95
    assert sum(r.kept for r in out if r.quality == 0) < sum(r.quality == 0 for r in out)


def test_bound_is_the_quantile_of_trusted_ratios(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in rules.judge(docs, labels, lowest=0.02).collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    ratios = sorted(round(out[i].ratio, 4) for i in good if not out[i].base_failed)
    bound = next(iter(out.values())).least_ratio

    def quantile(q):
        place = q * (len(ratios) - 1)
        low, high = ratios[math.floor(place)], ratios[math.ceil(place)]
        return low + (high - low) * (place - math.floor(place))

    assert math.isclose(bound, quantile(0.5) - 1.25 * (quantile(0.5) - quantile(0.02)), abs_tol=1e-9)
    assert all(r.kept == (not r.base_failed and r.ratio >= bound) for r in out.values())
