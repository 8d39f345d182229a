import math
from collections import Counter

import pytest

from sievemill.llm import mixing as m


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 1}, {"a": 1}, {"a": 0.9, "b": 0.1, "c": 1e-7}, {f"s{i}": 1 + i % 7 for i in range(40)}])
def test_period_deviates_by_less_than_a_block(weights):
    shares = m.whole_shares(weights)
    order, total = m.period(shares), sum(shares.values())
    done = Counter()
    for t, k in enumerate(order, 1):
        done[k] += 1
        assert all(abs(done[s] - t * shares[s] / total) < 1 for s in shares)
    assert done == Counter(shares)


def test_phases_place_every_block_once():
    blocks = {"a": 1000, "b": 17, "c": 260, None: 3}
    shares = m.whole_shares({"a": 1, "b": 2, "c": 3, None: 1}, 64)
    done, slots = Counter(), 0
    for p in m.phases(blocks, shares):
        assert p["start"] == slots
        slots += sum(p["used"].values())
        assert all(p["before"][k] == done[k] for k in p["used"])
        done.update(p["used"])
    assert dict(done) == blocks


def test_mix(spark):
    rows = [(i, "a" if i % 3 else ("b" if i % 2 else None), "x", i) for i in range(997)] + [(5, "a", "x", 5)] * 3 + [(None, "z", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, slot_x long")
    weights = {"a": 0.2, "b": 0.5, None: 0.3}
    out = m.mix_sources(df, weights, block_docs=4, shares=20, bucket_docs=50).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((r[0], r[1]) for r in rows)
    by_source = {}
    for r in out:
        by_source.setdefault(r.source, []).append(r)
    slots = {}
    for k, own in by_source.items():
        assert sorted(r.source_rank for r in own) == list(range(len(own)))
        for r in own:
            assert r.block == r.source_rank // 4 and r.slot_rank == r.source_rank % 4
            assert slots.setdefault(r.slot, (k, r.block)) == (k, r.block)
    n_blocks = {k: math.ceil(len(v) / 4) for k, v in by_source.items()}
    assert sorted(slots) == list(range(sum(n_blocks.values())))
    # as long as no source has run out, each is within one block of its weight
    shares = m.whole_shares(weights | {"z": 1e-9 * 0.2}, 20)
    total, done = sum(shares.values()), Counter()
    for t in range(len(slots)):
        done[slots[t][0]] += 1
        if any(done[k] == n_blocks[k] for k in n_blocks):
            break
        assert all(abs(done[k] - (t + 1) * shares[k] / total) < 1 for k in n_blocks)
    assert m.mix_sources(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    names = ["start", "offsets", "n", "n_buckets", "phase", "period", "row", "p_source", "slot", "a.b"]
    df = spark.createDataFrame([(i, "a", *range(len(names))) for i in range(40)], ["doc_id", "source", *names])
    out = m.mix_sources(df)
    assert out.columns == [c for c in df.columns if c != "slot"] + m.ADDED
    assert sorted(r.slot * 16 + r.slot_rank for r in out.collect()) == list(range(40))


def test_more_sources_than_lanes(spark):
    rows = [(i, f"h{i % 150}" if i % 3 else "big", "x") for i in range(1500)] + [(5000 + i, None, "x") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = m.mix_sources(df, block_docs=4, bucket_docs=50, max_sources=5).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter(r[:2] for r in rows)
    assert sorted(r.slot_rank for r in out if r.slot == 0) == [0, 1, 2, 3]
    assert len({(r.slot, r.slot_rank) for r in out}) == len(rows) and max(r.slot for r in out) < len(rows) / 4 + 10
    # the two large sources keep lanes of their own: ranks without a gap
    for k in ("big", None):
        assert sorted(r.source_rank for r in out if r.source == k) == list(range(sum(r[1] == k for r in rows)))
    given = m.mix_sources(df, {"h7": 1.0, "big": 1.0}, block_docs=4, max_sources=3).collect()
    assert sorted(r.source_rank for r in given if r.source == "h7") == list(range(sum(r[1] == "h7" for r in rows)))
    with pytest.raises(ValueError):
        m.mix_sources(df, {f"h{i}": 1 for i in range(9)}, max_sources=5)


def test_order_does_not_depend_on_partitioning(spark):
    rows = [(i % 7 if i % 3 else None, "a", f"text {i}", {"k": str(i)}) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, extra map<string,string>")
    place = lambda d: {r.text: (r.slot, r.slot_rank) for r in m.mix_sources(d, bucket_docs=20).collect()}
    assert place(df.repartition(1)) == place(df.repartition(7))


@pytest.mark.parametrize("weights", [None, {"big": 3.0, "next": 2.0}])
def test_thousands_of_sources_deviate_by_less_than_a_block(spark, weights):
    size = {f"h{i}": 16 + (7 * i) % 16 for i in range(5000)} | {"big": 30_000, "next": 20_000}
    rows = [(k, n) for k, n in size.items()]
    df = spark.createDataFrame(rows, "source string, n int").selectExpr("source", "explode(sequence(1, n)) as i").selectExpr("xxhash64(source, i) as doc_id", "source").repartition(8)
    out = m.mix_sources(df, weights, max_sources=2).select("source", "slot", "slot_rank").toPandas()
    assert len(out) == sum(size.values())
    out = out.sort_values(["slot", "slot_rank"]).reset_index(drop=True)
    pooled = out[out.source.str.startswith("h")].reset_index(drop=True)
    # within their lane: proportional to the roots of the sizes (or equal), until the first source has run out
    weight = {k: math.sqrt(n) if weights is None else 1.0 for k, n in size.items() if k.startswith("h")}
    total = sum(weight.values())
    ends = pooled.groupby("source").apply(lambda g: g.index[-1], include_groups=False)
    first_end, worst = ends.min(), 0.0
    for k, own in pooled.groupby("source").indices.items():
        for i, at in enumerate(own):
            if at < first_end:
                worst = max(worst, abs(i + 1 - (at + 1) * weight[k] / total), abs(i - at * weight[k] / total))
    assert worst < 1.5  # documents, of 16 a block
    # lanes: within one block of their shares as long as none has run out
    lanes = out.source.where(~out.source.str.startswith("h"), "pool")
    share = m.whole_shares({"big": math.sqrt(30_000), "next": math.sqrt(20_000), "pool": total} if weights is None else {"big": 3.0, "next": 2.0, "pool": 2e-9 * 5000})
    done, n_blocks = Counter(), {k: math.ceil(sum(lanes == k) / 16) for k in share}
    for slot, k in enumerate(out.assign(lane=lanes).groupby("slot").lane.first(), 1):
        done[k] += 1
        if done[k] == n_blocks[k]:
            break
        assert all(abs(done[x] - slot * share[x] / sum(share.values())) < 1 for x in share)


def plain_schedule(rows, weights, block_docs, shares):
    """Order of sources' blocks by earliest deadline, slot by slot, over the whole table."""
    n = Counter(r[1] for r in rows)
    left = {k: math.ceil(c / block_docs) for k, c in n.items()}
    share, done, out = m.whole_shares(weights, shares), Counter(), []
    while left:
        part = {k: share[k] for k in left}
        g = math.gcd(*part.values())
        part, total, own, t, over = {k: v // g for k, v in part.items()}, sum(part.values()) // g, Counter(), 0, False
        while not over:
            ready = [k for k in part if own[k] * total // part[k] <= t]
            k = min(ready, key=lambda k: (-(-(own[k] + 1) * total // part[k]), k is None, str(k)))
            out.append((k, done[k]))
            own[k] += 1
            done[k] += 1
            t += 1
            left[k] -= 1
            if not left[k]:
                over = True
                del left[k]
    return out


def test_whole_schedule(spark):
    rows = [(i, "abc"[i % 3 if i % 5 else 0], "x") for i in range(700)] + [(900, None, "x")] * 9
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for weights in ({"a": 1, "b": 2, "c": 4, None: 1}, {"a": 5, "b": 1, "c": 1, None: 1}):
        out = m.mix_sources(df, weights, block_docs=4, shares=16).collect()
        slots = {r.slot: (r.source, r.block) for r in out}
        assert [slots[t] for t in range(len(slots))] == plain_schedule(rows, weights, 4, 16)
