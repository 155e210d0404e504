"""Configurable costs of whole words and their corrections, against a plain edit distance."""
import random

from conftest import SF
from quarry.functions import phonetic as P
from quarry.plans import queries  # noqa: F401  (registers queries)
from quarry.plans.registry import REGISTRY


def plain(a, b):
    row = [100 * j for j in range(len(b) + 1)]
    for x in a:
        new = [row[0] + 100]
        for j, y in enumerate(b):
            swap = 0 if x == y else 20 if x in "aeiou" and y in "aeiou" else 150
            new.append(min(new[-1] + 100, row[j + 1] + 100, row[j] + swap))
        row = new
    return row[-1]


def test_every_word_meets_its_correction(spark):
    got = REGISTRY["edit_cost_words"].build(spark, SF).collect()
    assert got and all(r.cost == plain(r.a, r.b) for r in got)
    assert any(r.a[:2] != r.b[:2] for r in got) or any(not r.a.isascii() for r in got)


def with_rules(a, b, costs):
    """(cost, match length) of one pair, cell by cell."""
    ins, dele, sub, rules = costs
    star, a = a.endswith("*"), a.removesuffix("*") if a.endswith("*") else a
    d = [[1 << 60] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [0] if i == j == 0 else []
            ways += [d[i - 1][j] + dele] if i else []
            ways += [d[i][j - 1] + ins] if j else []
            ways += [d[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else sub)] if i and j else []
            ways += [d[i - len(f)][j - len(t)] + c for f, t, c in rules
                     if (f or t) and a[:i].endswith(f) and b[:j].endswith(t) and len(f) <= i and len(t) <= j]
            d[i][j] = min(ways)
    best, length = d[-1][-1], len(b)
    if star:
        for j in range(len(b)):
            if d[-1][j] <= best:
                best, length = d[-1][j], j
    return best, length


def test_a_batch_with_rules_is_its_pairs():
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcñóé") for _ in range(rng.randrange(n)))
    for _ in range(12):
        rules = [(0, word(4), word(4), rng.randrange(200)) for _ in range(rng.randrange(30))]
        costs = P.cost_rules(rules + [(0, "ñ", "", 5), (0, "", "ó", 7), (0, "?", "?", rng.randrange(200)), (0, "abc", "ñ", 1)], 0)
        pairs = [(word(9) + ("*" if rng.random() < 0.4 else ""), word(10)) for _ in range(150)] + [("", ""), ("*", ""), ("*", "ab")]
        cost, length = P.edit_costs_lang([a for a, _ in pairs], [b for _, b in pairs], costs, chunk=64)
        assert list(zip(cost.tolist(), length.tolist())) == [with_rules(a, b, costs) for a, b in pairs]
    assert P.edit_costs_lang([], [], costs)[0].shape == (0,)


def test_many_rules_are_joined_and_few_are_broadcast_alike(spark, monkeypatch):
    from quarry.operators import spelling as sp
    rows = [(0, "a", "e", 20), (0, "ph", "f", 5), (0, "?", "", 90), (0, "", "h", 10), (1, "x", "y", 1)]
    table = spark.createDataFrame(rows, "lang int, `from` string, `to` string, cost int")
    pairs = spark.createDataFrame([("phase", "feseh"), ("pha*", "fetch"), ("ñu", "nu"), ("", "h"), ("x", "y")], "a string, b string")
    few = sorted(map(tuple, sp.edit_costs_lang(pairs, table).collect()))
    monkeypatch.setattr(sp, "RULES_BROADCAST", 1)
    assert sorted(map(tuple, sp.edit_costs_lang(pairs, table).collect())) == few
    costs = P.cost_rules(rows, 0)
    assert [r[2:] for r in few] == [with_rules(a, b, costs) for a, b, *_ in few]


def test_match_lengths(spark):
    costs = P.cost_rules([(0, "?", "", 100), (0, "", "?", 100), (0, "?", "?", 150)] + [(0, x, y, 20) for x in "aeiou" for y in "aeiou" if x != y], 0)
    rows = REGISTRY["match_lengths"].build(spark, SF).collect()
    assert rows and all((r.cost, r.matched) == with_rules(r.a, r.b, costs) for r in rows)
