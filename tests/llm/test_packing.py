import random

from loomgraph.llm.packing import LENGTHS, cost, fill_bins, pack, plan


def check(sizes, segments, bins, lengths):
    used, ranks = {}, {}
    for size, lo, hi, first, per in segments:
        ranks.setdefault(size, []).append((lo, hi))
        for r in range(hi - lo):
            used[first + r // per] = used.get(first + r // per, 0) + size
    for size, n in sizes.items():
        spans = sorted(ranks[size])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    capacity = {b: c for first, count, c, _ in bins for b in range(first, first + count)}
    assert capacity.keys() == used.keys()
    assert all(used[b] <= capacity[b] and capacity[b] in lengths for b in used)
    assert all(not any(used[b] <= x < capacity[b] for x in lengths) for b in used)
    return sum(used.values()) / sum(capacity.values())


def test_plan_is_complete_and_tight():
    rnd = random.Random(3)
    for n in (1, 5, 60, 4000):
        sizes = {}
        for _ in range(n):
            s = min(2048, max(1, int(rnd.lognormvariate(5.5, 1.2))))
            sizes[s] = sizes.get(s, 0) + rnd.choice([1, 1, 7])
        fill = check(sizes, *plan(sizes), LENGTHS)
        assert n < 4000 or fill > 0.995


def test_whole_items_and_long_ones(spark):
    rnd = random.Random(8)
    tokens = [(i, rnd.choice([0, 1, 300, 300, 300, 700, 1500, 2048, 2049, 9000, None])) for i in range(400)]
    got = pack(spark.createDataFrame(tokens, "doc_id long, tokens long"), salts=3).collect()
    filled, pieces = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.token_start, r["size"]))
        if r.container_id is None:
            assert r["size"] == 0 and r.capacity is None
        else:
            filled.setdefault((r.container_id, r.capacity), []).append(r["size"])
    assert all(sum(v) <= c <= 2048 for (_, c), v in filled.items()) and len({k for k, _ in filled}) == len(filled)
    for i, n in tokens:
        ps = sorted(pieces[i])
        assert sum(p[2] for p in ps) == (n or 0) and len(ps) == max(1, -(-(n or 0) // 2048))
        assert [p[1] for p in ps] == [2048 * k for k in range(len(ps))]


def test_one_size_for_all_and_none(spark):
    same = spark.range(1000).selectExpr("id as doc_id", "512L as tokens")
    assert pack(same).select("container_id").distinct().count() == 250
    assert pack(same.limit(0)).count() == 0


def test_lengths_are_chosen_together():
    sizes = {700: 40_000, 800: 35_000, 900: 25_000}
    segments, bins = plan(sizes)
    assert check(sizes, segments, bins, LENGTHS) > 0.9
    only = fill_bins(sizes, only=2048)[1]
    assert cost(bins) <= min(cost(fill_bins(sizes, only=x)[1]) for x in LENGTHS if x >= 900) <= cost(only)
    assert sum(n * c for _, n, c, _ in fill_bins(sizes, lengths=(2048,))[1]) > 1.2 * sum(n * c for _, n, c, _ in bins)


def test_the_joint_plan_is_never_dearer():
    rnd = random.Random(5)
    for _ in range(30):
        sizes = {rnd.randint(1, 2048): rnd.randint(1, 500) for _ in range(rnd.randint(1, 40))}
        segments, bins = plan(sizes)
        check(sizes, segments, bins, LENGTHS)
        assert all(cost(bins) <= cost(fill_bins(sizes, only=x)[1]) for x in LENGTHS if x >= max(sizes))
