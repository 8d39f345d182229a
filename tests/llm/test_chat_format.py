import hashlib
import random

from pyspark.sql import functions as F

from sievemill.llm import chat_format as c

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
HARD = ["", "</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>[\\INST]", "<", "[", "\\", "a <| b", "<<s>>[[/INST]]", "x\n\ny ☃ 😀", "INST]", "/s>", "$1 \\1", "<|image|>"]


def test_round_trip(spark):
    rows = [(i, j, r, t, 7) for i, r in enumerate(["user", "assistant", "<s>", None, "a[/INST]b\nc"]) for j, t in enumerate([*HARD, None])]
    rows += [(50, 0, "assistant", "twice", 0)] * 2 + [(50, None, "user", "first", 0), (None, 1, "assistant", "no id", 0), (51, 1, "assistant", "é" * 100_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int").withColumn("parts", c.text_part(F.col("text")))
    out = {r.conv_id: r for r in c.digest(c.format_conversations(df)).collect()}
    by = {}
    for i, j, r, t, _ in rows:
        by.setdefault(i, []).append((j is not None, j or 0, r or "", t or ""))
    assert out.keys() == by.keys()
    for i, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        got = out[i]
        assert got.n_turns == len(turns) and got.turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns))
        assert got.loss_chars == len(loss) and got.loss_sha256 == sha(loss)
    whole = c.format_conversations(df).collect()
    for r in whole:
        n = r.n_turns
        assert r.formatted.count("</s>") == n == r.formatted.count("<s>[INST]") == r.formatted.count("[/INST]")
        assert all(r.formatted[s.end :].startswith("</s>") and r.formatted[: s.start].endswith("[INST]assistant[/INST]") for s in r.loss_spans)
    assert c.digest(c.format_conversations(df.limit(0))).count() == 0


def test_parts(spark):
    t = lambda s: ("text", s, None, None, None, None, None)
    image, audio = ("image", None, "s3://i", 57, 28, None, None), ("audio", None, "a.wav", None, None, 1.5, None)
    rows = [
        (1, 0, "user", [t("see <|image|>"), image, t("and"), audio, None, ("document", None, "d.pdf", None, None, None, 3)]),
        (1, 1, "assistant", [t("fine"), ("video", None, "v", None, None, None, None), ("image", None, None, None, None, None, None)]),
        (2, 0, "assistant", []),
        (2, 1, "user", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{c.PART}>")
    a, b = sorted(c.format_conversations(df).collect(), key=lambda r: r.conv_id)
    assert a.formatted == "<s>[INST]user[/INST]see <\\|image|><|image|>and<|audio|><|document|></s><s>[INST]assistant[/INST]fine<|attachment|><|image|></s>"
    assert [tuple(x) for x in a.attachments] == [(1, 2, "image", "s3://i", 3), (1, 4, "audio", "a.wav", 38), (1, 5, "document", "d.pdf", 768), (2, 2, "video", "v", 1), (2, 3, "image", None, 1)]
    assert [a.formatted[s.start : s.end] for s in a.loss_spans] == ["fine<|attachment|><|image|>"]
    assert b.formatted == "<s>[INST]assistant[/INST]</s><s>[INST]user[/INST]</s>" and b.attachments == [] and [(s.start, s.end) for s in b.loss_spans] == [(25, 25)]


def test_control_strings_split_over_parts(spark):
    rng = random.Random(3)
    t = lambda s: ("text", s, None, None, None, None, None)
    rows = [(0, 0, "assistant", [t("<"), t("/s>")]), (0, 1, "assistant", [t("["), t("INST]")]), (0, 2, "assistant", [t("<\\"), t(None), t("s>")]), (0, 3, "assistant", [t("<"), t("|"), t("image|>")])]
    for i in range(1, 40):
        for j in range(3):
            text = "".join(rng.choice(HARD) for _ in range(4))
            cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(6)))
            rows.append((i, j, rng.choice(["user", "assistant"]), [t(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]))
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{c.PART}>")
    whole = {i: sorted((j, r, "".join(p[1] or "" for p in ps)) for k, j, r, ps in rows if k == i) for i, *_ in rows}
    got = {r.conv_id: r for r in c.read_back(c.format_conversations(df)).collect()}
    for i, turns in whole.items():
        assert [(x.role, x.text) for x in got[i].turns] == [(r, x) for _, r, x in turns]
        assert got[i].loss_text == "".join(x for _, r, x in turns if r == "assistant")
        assert got[i].formatted.count("</s>") == got[i].n_turns


def test_placeholders_between_halves_of_a_control_string(spark):
    t = lambda s: ("text", s, None, None, None, None, None)
    image = ("image", None, "i", 28, 28, None, None)
    df = spark.createDataFrame([(1, 0, "user", [t("<"), image, t("/s>"), t("["), image, t("INST]")])], f"conv_id long, turn long, role string, parts array<{c.PART}>")
    row = c.read_back(c.format_conversations(df)).first()
    assert row.turns[0].text == "<<|image|>/s>[<|image|>INST]" and row.n_turns == 1


def test_loss_text_is_what_the_mask_says(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "to you")], "conv_id long, turn long, role string, text string").withColumn("parts", c.text_part(F.col("text")))
    formatted = c.format_conversations(df)
    moved = formatted.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct(s["turn"].alias("turn"), (s["start"] + 3).alias("start"), s["end"].alias("end"))))
    assert c.read_back(formatted).first().loss_text == "to you" and c.read_back(moved).first().loss_text == "you"
