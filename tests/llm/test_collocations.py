"""Collocations against plain Python: ties, exact products, containment, languages, odd texts."""

import re
from collections import Counter

from sievemill.llm import collocations as c

ROWS = [
    ("en", "New York, new york! The new york times. " * 12),
    ("en", "a a a a a a " * 6 + "\t lead\x0bthe  end \n the end;the end"),
    ("en", "New York City is. " * 5 + "New York City was. " * 6 + "É É é é. " * 11),
    (None, "no lang here, " * 10),
    ("fr", None),
    ("fr", ""),
    ("fr", " \t . \n"),
    ("de", "Wort " * 4000),
    ("es", "x y. " * 10 + "x z. " * 10 + "y z. " * 10),
]


def plain(rows, max_n=3, least=10, share=50, top=2000):
    f = Counter()
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und", tuple(w[i : i + n])) for n in range(1, max_n + 1) for i in range(len(w) - n + 1))
    out = []
    for lang in {k[0] for k in f}:
        n = sum(v for (g, p), v in f.items() if g == lang and len(p) == 1)
        candidates = {p: v for (g, p), v in f.items() if g == lang and len(p) > 1 and v >= least}
        rows = []
        for p, a in candidates.items():
            held = any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items())
            if not held:
                cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -score) for i, (score, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def test_rows(spark):
    docs = spark.createDataFrame([(i, g, t, "x", "y", "z") for i, (g, t) in enumerate(ROWS)], "doc_id long, lang string, text string, phrase string, f string, w string")
    for options in ({}, {"max_n": 4}, {"max_n": 2, "least": 3}, {"share": 101}, {"top": 2}):
        assert sorted(tuple(r) for r in c.collocations(docs, **options).collect()) == plain(ROWS, **options), options
    assert c.collocations(docs.limit(0)).collect() == []
    assert c.collocations(docs.where("lang = 'fr'")).collect() == []


def test_products_beyond_64_bits(spark):
    """Counts of a large corpus, given as a table: 10**6 * a * a passes 64 bits by far."""
    a, x, y = 3_000_000_007, 4_000_000_009, 5_000_000_021
    known = spark.createDataFrame([("en", 2, "p q", a), ("en", 1, "p", x), ("en", 1, "q", y)], "lang string, size int, phrase string, f long")
    (row,) = c.scored(known).collect()
    assert (row.l, row.r, row.score) == (x, y, 1_000_000 * a * a // (x * y))
