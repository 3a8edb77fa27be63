import random
from collections import Counter, defaultdict

import pytest

from termforge.llm import packing


def one_by_one(histogram, capacities, worth):
    """Best fit decreasing, an item at a time: the cost, and the sorted contents of the bins."""
    bins = []  # [room, order, items]
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [b for b in bins if b[0] >= length]
            if fits:
                b = min(fits, key=lambda b: (b[0], b[1]))
            else:
                size = min((c for c in capacities if c >= length), key=lambda c: (packing.price(c) - worth * (c - length), c))
                b = [size, len(bins), []]
                bins.append(b)
            b[0] -= length
            b[2].append(length)
    contents = [sum(b[2]) for b in bins]
    return sum(packing.price(packing.fitted(u, capacities)) for u in contents), sorted(contents)


@pytest.mark.parametrize("seed", range(6))
def test_the_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = (16, 32, 64)
    histogram = Counter(rng.choice([rng.randint(1, 63), rng.randint(1, 8)]) for _ in range(rng.randint(1, 400)))
    costs = []
    for worth in packing.WORTHS:
        plan = packing.plan_for(histogram, sizes, worth)
        cost, contents = one_by_one(histogram, sizes, worth)
        costs.append(cost)
        assert plan.cost == pytest.approx(cost)
        assert sorted(u for _, n, u in plan.bins for _ in range(n)) == contents
    assert packing.best_plan(histogram, sizes).cost == pytest.approx(min(costs))


def checked(rows, expected, capacities=packing.CAPACITIES):
    """All tokens placed once, bins without overlap, downsized; returns the cost of the bins."""
    bins, spans = defaultdict(list), Counter()
    for r in rows:
        bins[r["bin_id"]].append(r)
        spans[r["doc_id"]] += r["length"]
    assert spans == Counter(expected)
    cost = 0.0
    for inside in bins.values():
        at = 0
        for r in sorted(inside, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["length"]
        assert {(r["bin_used"], r["capacity"]) for r in inside} == {(at, packing.fitted(at, capacities))}
        cost += packing.price(inside[0]["capacity"])
    return cost


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lengths = {r["doc_id"]: r["n"] for r in docs.select("doc_id", packing.token_length(docs["text"]).alias("n")).collect() if r["n"]}
    rows = packing.op2_best_fit_packing(spark, sf_dir).collect()
    cost = checked(rows, lengths)
    most = max(packing.CAPACITIES)
    rest = Counter(n % most for n in lengths.values() if n % most)
    best = min(one_by_one(rest, packing.CAPACITIES, w)[0] for w in packing.WORTHS)
    assert cost == pytest.approx(best + sum(n // most for n in lengths.values()) * packing.price(most))


def test_ranks_in_ranges_are_ranks_in_one(spark, monkeypatch):
    """The commonest length by one task and by many: the same place for every document, null and repeated ones once each."""
    docs = spark.createDataFrame([(k if k % 5 else None, "w " * (3 if k % 3 else 7)) for k in range(400)] + [(1, "w w w")] * 3, "doc_id bigint, text string").coalesce(1)
    whole = sorted((r["doc_id"] or 0, r["bin_id"], r["bin_offset"]) for r in packing.pack(docs).collect())
    monkeypatch.setattr(packing, "RANKED", 8)
    assert sorted((r["doc_id"] or 0, r["bin_id"], r["bin_offset"]) for r in packing.pack(docs).collect()) == whole and len(set(whole)) >= 320
    assert checked(packing.pack(docs.where("doc_id IS NOT NULL").distinct()).collect(), {k: 3 if k % 3 else 7 for k in range(400) if k % 5} | {1: 6}) > 0


def test_hard_rows(hard, nothing):
    rows = packing.pack(hard).collect()
    by = Counter(r["doc_id"] for r in rows)
    assert not {1, 2, 3} & set(by) and by[5] == 2 and by[None] == 1 and by[9] > 10
    assert packing.pack(nothing).count() == 0
    pieces = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 9)
    assert [p for p, _, _ in pieces] == list(range(len(pieces))) and all(s == p * max(packing.CAPACITIES) for p, s, _ in pieces)


def test_exact_sizes_and_only_empty_texts(spark):
    docs = spark.createDataFrame([(k, " ".join(["w"] * n)) for k, n in enumerate((512, 512, 8192, 8193, 1, 0))], "doc_id bigint, text string")
    assert checked(packing.pack(docs).collect(), {0: 512, 1: 512, 2: 8192, 3: 8193, 4: 1}) > 0
    assert packing.pack(docs.where("doc_id = 5")).count() == 0
