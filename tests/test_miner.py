"""The miner by levels against the miner in memory, and tolerance of rare behaviour."""

import random
from collections import Counter

import pytest

from optrail.operators import levels, miner, model

TRACE = "array<struct<a:string,en:array<string>>>"


def as_log(rows):
    out = Counter()
    for trace, n in rows:
        out[tuple((e["a"], frozenset(e["en"])) for e in trace)] += n
    return out


def plain(words):
    return {tuple((a, frozenset(a)) for a in w): n for w, n in words.items()}


@pytest.fixture(scope="module")
def groups():
    rng, out = random.Random(3), {}
    for g in range(25):
        rows = []
        for _ in range(rng.randint(1, 10)):
            acts = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.choice([0, 1, 2, 3, 4, 6]))]
            rows.append(([{"a": a, "en": sorted({a, *rng.sample("abcdz", rng.randint(0, 2))})} for a in acts], rng.randint(1, 9)))
        out[f"g{g}"] = rows
    return out


@pytest.mark.parametrize("variant, noise", [("im", 0.0), ("im", 0.3), ("imto", 0.0), ("imts", 0.3), ("imtf", 0.0), ("imf", 0.0), ("imf", 0.3)])
def test_levels_give_the_trees_of_the_miner_in_memory(spark, groups, variant, noise):
    df = spark.createDataFrame([(g, t, n) for g, rows in groups.items() for t, n in rows], f"group_id string, trace {TRACE}, n_cases long")
    got = levels.group_trees(df, variant, noise, small=0)
    assert got == {g: model.fold(miner.mine_tree(as_log(rows), variant, noise)) for g, rows in groups.items()}


def test_rows_that_are_left_are_mined_where_they_are_collected(spark, groups):
    df = spark.createDataFrame([(t, n) for rows in groups.values() for t, n in rows], f"trace {TRACE}, n_cases long")
    assert len({str(levels.discover_tree(df, "imf", 0.2, small)) for small in (0, 20, 10**6)}) == 1
    assert str(levels.discover_tree(df.where("false"))) == "tau" and levels.group_trees(df.where("false").selectExpr("'x' AS group_id", "*")) == {}
    with pytest.raises(ValueError):
        levels.discover_tree(df, "imx")


@pytest.mark.parametrize("words, noise, tree", [
    # a sequence in which every neighbouring pair was once seen the other way round
    ({"klmn": 60, "kmln": 2, "klnm": 1, "lkmn": 1}, 0.2, "seq(k, l, m, n)"),
    # rarely skipped altogether, and often
    ({"kl": 60, "": 3}, 0.2, "seq(k, l)"),
    ({"kl": 60, "": 30}, 0.2, "xor(seq(k, l), tau)"),
    # a loop, once left where it is not
    ({"kl": 40, "klmkl": 30, "klm": 1}, 0.1, "loop(seq(k, l), m)"),
])
def test_rare_behaviour_is_left_out(words, noise, tree):
    assert str(model.fold(miner.mine_tree(plain(words), "imf", noise))) == tree
    assert str(model.fold(miner.mine_tree(plain(words), "im"))) != tree or noise * sum(words.values()) < min(words.values())


def test_segments_lose_the_fewest_events():
    rng = random.Random(9)
    for _ in range(300):
        trace = tuple((rng.choice("abcx"), frozenset()) for _ in range(rng.randint(0, 7)))
        sets = [{"a"}, {"b", "x"}, {"c"}]
        path = miner.segments(trace, sets)
        assert path == sorted(path) and len(path) == len(trace)

        def best(i, j):
            if i == len(trace):
                return 0
            return max((trace[i][0] in sets[k]) + best(i + 1, k) for k in range(j, 3))

        assert sum(a in sets[k] for (a, _), k in zip(trace, path, strict=True)) == best(0, 0)
