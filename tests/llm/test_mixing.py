import pytest

from brindle.llm.mixing import SCHEDULES, mixed, mixture

SCHEMA = "doc_id long, source string, text string, taken string"


def rows():
    out = [(i, f"s{i % 7}", "w " * (i * 37 % 211), "x") for i in range(700)]
    out += [(1000 + i, None, "w\tv " * 40, None) for i in range(9)] + [(2000, "big", "w " * 90000, None), (2001, "void", None, None), (2002, "void", " \n", None)]
    return out + [(None, "s1", "a b c", "x")] * 3 + out[:3]


def expected_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > cap * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            free.remove(s)


def test_targets_and_takes(spark):
    given = rows()
    df = spark.createDataFrame(given, SCHEMA).repartition(4)
    got = mixture(df).collect()
    assert len(got) == len(given)
    sizes, source = {}, {}
    for doc, s, text, _ in given:
        sizes[s] = sizes.get(s, 0) + len((text or "").split())
        source[doc] = s
    want = expected_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size and (r.taken > 0) == bool(r.positions)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5
    again = mixture(spark.createDataFrame(given[::-1], SCHEMA)).collect()
    key = lambda r: str((r.doc_id, r.size, r.taken, r.positions))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_positions_follow_the_schedule(spark):
    given = [(i, "abc"[i % 3], "w w", None) for i in range(3000)]
    got = mixture(spark.createDataFrame(given, SCHEMA), share=1.0).collect()
    for k in range(3):
        mine = sorted(p for r in got if r.doc_id % 3 == k for p in r.positions)
        for t in (0.25, 0.5, 0.75):
            knots = SCHEDULES[k]
            level = lambda u: next(a[1] + (b[1] - a[1]) * (u - a[0]) / (b[0] - a[0]) for a, b in zip(knots, knots[1:]) if u <= b[0])  # noqa: E731, B023
            area = sum(level((i + 0.5) / 1000) for i in range(int(1000 * t))) / sum(level((i + 0.5) / 1000) for i in range(1000))
            assert sum(p < t for p in mine) / len(mine) == pytest.approx(area, abs=0.01)


def test_rows_in_training_order(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = mixed(df)
    assert out.columns == df.columns
    assert out.count() == sum(len(r.positions) for r in mixture(df).collect())
    assert mixed(df.limit(0)).count() == 0
