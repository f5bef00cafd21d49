"""Mixing: shares to within the schedule's discrepancy, caps, repeated ids, the schedule and the blocks against plain Python."""

import math
from collections import Counter, defaultdict

import pytest

from quarry.llm import mixture

DOCS = "doc_id long, text string, source string, tokens int, slot string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for k in range(3000):
        source = ("A", " b", "c ")[0 if k % 10 < 6 else 1 if k % 10 < 9 else 2]
        rows.append((k, "x" * (40 + (k * 37) % 900), source, 1, "clash"))
    rows += [(7, "x", "a", 1, None), (7, "x" * 2000, "c", 1, None), (9001, "", "a", 1, None), (9002, None, "a", 1, None), (None, "xx", "a", 1, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("a", 4.0, 1), ("b", 4.0, 3), ("c", 2.0, 4), ("none", 0.1, 5)], "source string, weight double, max_repeats int")


def test_shares_and_caps(docs, targets):
    rows = {r["source"]: r for r in mixture.report(docs, targets).collect()}
    total = mixture.shares(docs, targets).head()["total"]
    for name in "abc":
        r = rows[name]
        assert r["feasible"] and abs(r["tokens"] - r["target_share"] * total) <= 30 * mixture.SLOT
    assert rows["b"]["most_uses"] <= 3 and rows["c"]["most_uses"] <= 4 and rows["a"]["most_uses"] == 1
    assert rows["none"]["tokens"] == 0 and not rows["none"]["feasible"]
    assert {r["source"] for r in mixture.unreachable(docs, targets).collect()} == {"none"}


def test_repeated_ids_count_alike(docs, targets):
    """The size that the shares count is the one that the mix places."""
    used = {(r["doc_id"], r["source"], r["tokens"]) for r in mixture.mix(docs, targets).collect() if r["doc_id"] == 7}
    sized = {(r["doc_id"], r["source"], r["tokens"]) for r in mixture.sized(docs).where("doc_id = 7").collect()}
    assert sized == {(7, "c", 500)} and used <= sized


def test_schedule_and_blocks(spark, docs, targets):
    sized = {r["doc_id"]: (r["source"], r["tokens"]) for r in mixture.sized(docs).collect()}
    plan = mixture.planned(mixture.sized(docs), targets)
    got = {r["slot"]: r["source"] for r in mixture.schedule(spark, plan).collect()}
    weights, want, high = {"a": 4.0, "b": 4.0, "c": 2.0, "none": 0.1}, {}, []
    for name in sorted(weights):
        high.append((name, (high[-1][1] if high else 0) + weights[name] / 10.1))
    for i in range(plan.slots):
        p = i * mixture.PHI - math.floor(i * mixture.PHI)
        want[i] = next((n for n, e in high[:-1] if p < e), high[-1][0])
    assert got == want and plan.slots == math.ceil(sum(t for _, t in sized.values()) / mixture.SLOT)
    placed = defaultdict(list)
    for r in mixture.mix(docs, targets).collect():
        assert got[r["slot"]] == r["source"] == sized[r["doc_id"]][0] and r["tokens"] == sized[r["doc_id"]][1] and 0 <= r["position"] < mixture.SLOT
        placed[r["source"], r["pass"]].append((r["slot"], r["position"], r["doc_id"]))
    for (source, _), docs_ in placed.items():  # within a pass each document once, in one order for all passes
        assert max(Counter(d for _, _, d in docs_).values()) == 1
        if source == "b":
            order = [d for _, _, d in sorted(docs_)]
            assert order == [d for _, _, d in sorted(placed[source, 0])][: len(order)]


def test_public_tokenizer(spark, docs, targets):
    size = mixture.tokenizer_size(spark, "/opt/tokenizers/byte_bpe_50k.json")
    text = spark.createDataFrame([(1, "def f(x): return <|endoftext|>", "a", 1, None), (2, "", "a", 1, None)], DOCS)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    assert {r["doc_id"]: r["tokens"] for r in mixture.sized(text, size).collect()} == {1: len(t.encode("def f(x): return <|endoftext|>", add_special_tokens=False).ids), 2: 0}


def test_large_sources_have_many_buckets(spark, docs, targets, monkeypatch):
    monkeypatch.setattr(mixture, "BUCKET_TOKENS", 1000)
    many = {(r["doc_id"], r["pass"], r["slot"]) for r in mixture.mix(docs, targets).collect()}
    monkeypatch.setattr(mixture, "BUCKET_TOKENS", 1 << 40)
    assert many == {(r["doc_id"], r["pass"], r["slot"]) for r in mixture.mix(docs, targets).collect()}
