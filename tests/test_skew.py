"""One key holding a third of all rows: results stay whole and agree with plain Python."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keepsake.operators import contacts, jobs, meals, retrieval, state

N = 3000


@pytest.fixture(scope="module")
def rng():
    return random.Random(11)


def hot(rng, keys):
    """A key: the first one for a third of all draws."""
    return keys[0] if rng.random() < 1 / 3 else rng.choice(keys)


def test_ranks_inside_a_hot_currency(spark, rng):
    rows = [(i, hot(rng, ["USD", "EUR", "CHF"]), rng.choice([100_000, rng.randrange(10_000, 200_000)])) for i in range(N)]
    df = spark.createDataFrame([(i, c, s, s) for i, c, s in rows], "id int, salary_currency string, salary_min int, salary_max int")
    found = {r.id: r.rank_in_currency for r in jobs.compensation(df).collect()}
    by_currency = defaultdict(list)
    for _, c, s in rows:
        by_currency[c].append(s)
    assert found == {i: 1 + sum(x > s for x in by_currency[c]) for i, c, s in rows}


def test_shopping_list_of_a_hot_ingredient(spark, rng):
    days, kinds = ("monday", "wednesday", "sunday"), ("breakfast", "dinner")
    plans = [(i, hot(rng, ["u1", "u2", "u3"]), date(2024, 1, 1), rng.choice(days), rng.choice(kinds), f"r{i}") for i in range(N)]
    lines = [(f"r{p[0]}", p[1], pos, hot(rng, ["rice", "egg", "oil"]), "g", str(rng.randrange(99))) for p in plans for pos in range(2)]
    made = meals.shopping_list(
        spark.createDataFrame(plans, "id int, user_id string, week_start date, day_of_week string, meal_type string, recipe_id string"),
        spark.createDataFrame(lines, "recipe_id string, user_id string, pos int, name string, unit string, quantity string"))
    found = {(r.user_id, r.name): r.quantity for r in made.collect()}
    place = {p[5]: (days.index(p[3]), kinds.index(p[4]), p[0]) for p in plans}
    expected = defaultdict(list)
    for recipe, user, pos, name, _, quantity in lines:
        expected[(user, name)].append((*place[recipe], pos, quantity))
    assert found == {k: " + ".join(x[-1] for x in sorted(v)) for k, v in expected.items()}


def test_newest_thoughts_of_a_hot_person(spark, rng):
    names = [f"p{i}" for i in range(20)]
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(N)), [hot(rng, names)]) for i in range(N)]
    people = spark.createDataFrame([(i, "u", n.upper()) for i, n in enumerate(names)], "id int, user_id string, name string")
    found = defaultdict(list)
    for r in contacts.thoughts_about(people, spark.createDataFrame(rows, "id int, created_at timestamp, people array<string>"), 4).orderBy("rank").collect():
        found[r.name.lower()].append(r.thought_id)
    expected = {n: [r[0] for r in sorted((r for r in rows if r[2] == [n]), key=lambda r: (-r[1].timestamp(), r[0]))[:4]] for n in names}
    assert dict(found) == expected


def test_latest_rows_and_history_of_a_hot_contact(spark, rng):
    keys = list(range(30))
    calls = [(i, hot(rng, keys), "u", "call", datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(500)), "s",
              datetime(2024, 2, 1) + timedelta(minutes=rng.randrange(500))) for i in range(N)]
    df = spark.createDataFrame(calls, "id int, contact_id int, user_id string, interaction_type string, occurred_at timestamp, summary string, created_at timestamp")
    people = spark.createDataFrame([(k, "u", f"n{k}", None) for k in keys], "id int, user_id string, name string, last_contacted timestamp")
    found = {r.id: r.last_contacted for r in state.last_contacted(people, df).collect()}
    assert found == {k: max((c[6], c[0], c[4]) for c in calls if c[1] == k)[2] for k in keys}
    deals = df.limit(0).select("id", "contact_id", "user_id", F.lit("won").alias("stage"), "created_at", F.lit("t").alias("title"))
    rows = contacts.contact_history(people, df, deals).collect()
    assert len(rows) == N and all(r.interaction_count == sum(c[1] == r.id for c in calls) for r in rows[:200])
    assert [r.id for r in rows] == sorted(r.id for r in rows)


def test_copies_of_one_vector(spark, rng, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 50)
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(40)]
    rows = [(i, hot(rng, vectors), datetime(2024, 1, 1 + i % 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>, created_at timestamp")
    pairs = retrieval.similar_pairs(df, 0.9).collect()
    assert len(pairs) <= 40 * 41 // 2                    # distinct vectors, not 200 * 199 / 2 pairs of copies
    listed = {r.id: r.representative for r in retrieval.vector_copies(df).collect()}
    first = {}
    for i, v, _ in rows:
        first.setdefault(tuple(v), i)
    assert listed == {i: first[tuple(v)] for i, v, _ in rows}
    hot_pair = [p for p in pairs if p.id_a == p.id_b == first[tuple(vectors[0])]]
    assert hot_pair and hot_pair[0].copies_a == sum(v == vectors[0] for _, v, _ in rows)
    assert all(r.novelty == pytest.approx(0.0, abs=1e-9) for r in retrieval.novelty(df.where("id < 300"), n=None).collect()
               if sum(v == rows[r.id][1] for _, v, _ in rows[:300]) > 1)
