"""Every operator on nulls, empty tables, repeated rows, very long texts and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from sievemill.llm import chat_format, collocations, decontaminate, filter_audit, line_dedup, mixing, order_minhash, quality_crf, rules, secrets, simhash, suffix_dedup, xent

EXTRA = ["key", "h", "n", "doc", "t", "b", "count", "label", "score", "quality", "rep", "gram", "bands", "__id", "__drop", "words", "spans", "class_id", "item_id", "good", "diff"]
LONG = " ".join(f"word{i % 977} runs\n" for i in range(20_000))
ROWS = [(1, "a plain text of a few words, nothing else."), (1, "a plain text of a few words, nothing else."), (2, None), (None, "no id here"), (None, None), (3, ""), (4, LONG), (5, LONG), (6, "\n\n \t")]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame([(i, t, "web") for i, t in ROWS], "doc_id long, text string, source string")
    return base.select("*", *[F.lit("x").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 0, 1), (6, 1, None), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "words that are in no text of these"), (None, "x")], "item_id long, text string")


BY_DOC = {
    "crf": lambda d, l, i: quality_crf.quality_scores(d, quality_crf.fit(d, l)),
    "lines": lambda d, l, i: line_dedup.dedup_digest(d),
    "drop_lines": lambda d, l, i: line_dedup.drop_lines(d),
    "clean": lambda d, l, i: decontaminate.keep_clean(d, i),
    "near": lambda d, l, i: order_minhash.near_duplicates(d),
    "suffix": lambda d, l, i: suffix_dedup.remove_repeats(d),
    "secrets": lambda d, l, i: secrets.scan(d),
    "rules": lambda d, l, i: rules.judge(d, l),
    "xent": lambda d, l, i: xent.scores(d, l),
    "mix": lambda d, l, i: mixing.mix_sources(d),
    "simhash": lambda d, l, i: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", BY_DOC)
def test_one_row_a_row(name, docs, labels, items):
    out = BY_DOC[name](docs, labels, items).select("doc_id").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((i is None, i or 0) for i, _ in ROWS)


@pytest.mark.parametrize("name", BY_DOC)
def test_empty_tables(name, docs, labels, items):
    assert BY_DOC[name](docs.limit(0), labels.limit(0), items.limit(0)).collect() == []


def test_near_keeps_columns(docs):
    out = order_minhash.keep_one(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.select("doc_id").collect()} == {1, 2, 4, None}


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (None, None, None, None), (2, 1, "assistant", LONG)], "conv_id long, turn long, role string, text string")
    turns = turns.select("*", *[F.lit("x").alias(c) for c in ["n", "segment", "loss", "start", "size", "files"]]).withColumn("parts", chat_format.text_part(F.col("text")))
    out = {r.conv_id: r for r in chat_format.digest(chat_format.format_conversations(turns)).collect()}
    assert {k: r.n_turns for k, r in out.items()} == {1: 2, None: 1, 2: 1}
    assert out[2].loss_chars == len(LONG)
    assert chat_format.digest(chat_format.format_conversations(turns.limit(0))).collect() == []


def test_reports(docs, labels):
    """Operators that report on the whole table: every row counts once, as often as it stands there."""
    clashing = docs.select("*", *[F.lit("x").alias(c) for c in ("lang", "part", "digest", "phrase", "times", "copies")])
    out = filter_audit.audit(clashing, labels).where("filter_order = 'ABCDE' and step = 1").collect()
    assert [(r.part, r.kept + r.removed) for r in out] == [("web", len(ROWS))]
    words = sum(len((t or "").split()) for _, t in ROWS)
    assert {(r.lang, r.n) for r in collocations.collocations(clashing).collect()} == {("x", words)}
    assert filter_audit.audit(clashing.limit(0), labels).collect() == collocations.collocations(clashing.limit(0)).collect() == []
