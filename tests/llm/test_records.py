"""Problems 3 and 4: near duplicates and similar sets, against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from srclens.llm import near_duplicates, set_joins
from tests.conftest import rows

RECORD = "candidate_id bigint, fragment string, code string, similarity double, shape string, size int, bucket string"
LIMIT = [("function", 0.85), ("block", 0.8), ("odd", None), (None, 0.5)]


def components(data):
    seen = {}
    for i, f, c in data:
        seen.setdefault(i, (f, Counter(re.findall("[a-z0-9_]+", (c or "").lower()))))
    limit = dict(LIMIT[:2])
    parent = {i: i for i in seen}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, (fa, ta)), (b, (fb, tb)) in combinations(seen.items(), 2):
        if fa == fb and fa in limit and ta and tb and 2 * sum((ta & tb).values()) >= limit[fa] * (sum(ta.values()) + sum(tb.values())) - 1e-9:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    size = Counter(find(i) for i in seen)
    return sorted(((i, find(i)) for i in seen if size[find(i)] > 1), key=repr)


def test_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)  # so that hot buckets go through the blocks
    random.seed(5)
    words = [f"w{n}" for n in range(60)]
    base = [[random.choice(words) for _ in range(random.randrange(8, 40))] for _ in range(12)] + [["hot", "token", *(random.choice(words[:6]) for _ in range(10))] for _ in range(4)]
    data = []
    for i in range(220):
        text = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 1, 2, 4])):
            at = random.randrange(len(text))
            text[at : at + random.choice([0, 1])] = [random.choice(words)] * random.choice([0, 1])
        if random.random() < 0.3:
            random.shuffle(text)
        data.append((i, random.choice(["function", "function", "block", "odd", None]), " ".join(text).upper() if i % 5 else "; ".join(text)))
    data += [(300, "function", None), (301, "function", ""), (302, "block", "+-"), (303, "block", "--"), (304, "function", "x " * 20_000), (305, "function", "X " * 20_000)] + data[:10]
    df = spark.createDataFrame([(*x, 1.0, "s", 1, "b") for x in data] + [(None, "block", "a", None, None, None, None)], RECORD)
    limits = spark.createDataFrame(LIMIT, "fragment string, similarity double")
    got = near_duplicates.groups(df, limits)
    assert rows(got, "candidate_id", "group_id") == components(data)
    assert near_duplicates.groups(df.limit(0), limits).count() == 0 and near_duplicates.groups(df, limits.limit(0)).count() == 0


def test_tables_that_grow_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Long records in small files: the estimates of their exploded tokens stay far below the default threshold of broadcasts."""
    code = [" ".join(f"w{(7 * i + 3 * n) % 997}" for n in range(300)) for i in range(40)] + [" ".join(f"w{n}" for n in range(300 - i)) for i in range(4)]
    spark.createDataFrame(list(enumerate(code)), "candidate_id bigint, code string").selectExpr("*", "'function' as fragment").write.parquet(f"{tmp_path}/records")
    plans = []
    keep = near_duplicates.durable

    def durable(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(near_duplicates, "durable", durable)
    monkeypatch.setattr(near_duplicates, "small", lambda df: df.hint("merge"))  # the limits are the one table that may be broadcast
    got = near_duplicates.groups(spark.read.parquet(f"{tmp_path}/records"), spark.createDataFrame([("function", 0.85)], "fragment string, similarity double"))
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert {40, 41, 42, 43} <= {i for i, _ in rows(got, "candidate_id", "group_id")}
    assert len(plans) == 6 and not [p for p in plans if "Broadcast" in p]


def test_fewest_matches_grows():
    needed = near_duplicates.fewest_matches(0.74)
    assert needed[0] == 0 and list(needed) == sorted(needed) and needed[128] < 128 * 0.74


def similar(data):
    sets = {}
    for i, own, *arrays in data:
        if i is not None:
            sets.setdefault(i, (own, {x.strip(" \t") for a in arrays for x in a or [] if x and x.strip(" \t")}))
    out = []
    for a, b in combinations(sorted(sets), 2):
        (oa, x), (ob, y) = sets[a], sets[b]
        if (oa or ob) and len(x) >= 5 and len(y) >= 5 and len(x & y) >= 0.75 * len(x | y) - 1e-9:
            out.append((a, b))
    return sorted(out, key=repr)


SYMBOL = "symbol_id bigint, types array<string>, identifiers array<string>, parameters array<string>, els string, own int, size int"


def _pairs(spark, data):
    make = lambda own: spark.createDataFrame([(i, *arrays, "c", 1, 2) for i, o, *arrays in data if o is own], SYMBOL)
    return rows(set_joins.similar_pairs(make(True), make(False)), "id_a", "id_b")


def test_pairs_against_brute_force(spark):
    random.seed(9)
    values = [f"v{n}" for n in range(40)]
    base = [random.sample(values, n) for n in (4, 5, 5, 6, 7, 8, 8, 9, 10, 12, 20) for _ in range(2)]
    data = []
    for i in range(260):
        s = set(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 1, 2])):
            s ^= {random.choice(values)}
        s = sorted(s)
        k = len(s) // 2
        data.append((i, i % 4 != 0, [f" {x}\t" for x in s[:k]] + [None, "", " "], s[k:] or None, s[:1] if i % 3 else None))
    data += [(900, True, None, None, None), (None, True, values, None, None), *data[:8]]
    assert _pairs(spark, data) == similar(data)
    assert _pairs(spark, []) == []


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 60), st.integers(5, 60))
def test_overlap_needed_is_the_threshold(s, t):
    c = set_joins.overlap_needed(s, t)
    assert c >= 0.75 * (s + t - c) - 1e-9 and c - 1 < 0.75 * (s + t - (c - 1))
