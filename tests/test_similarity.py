"""The bounded name search against comparing every pair."""

import difflib
import random

from pyspark.sql import functions as F

from brokerlake.operators import matching, similarity

WORDS = "blue ridge transport llc acme haul northern freight express lines go x straße river logistics".split()


def ratio(name, company):
    found = difflib.SequenceMatcher(None, name, company).ratio()
    return max(found, 0.75) if name in company or company in name else found


def some_names(seed, count):
    rng = random.Random(seed)
    found = set()
    while len(found) < count:
        name = " ".join(rng.choices(WORDS, k=rng.randint(1, 4)))
        if rng.random() < 0.3:
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice("abcxyz ") + name[at + 1:]
        found.add(name.strip() or "go")
    return sorted(found)


def test_best_companies_are_found_and_few_pairs_scored(spark):
    names, companies = some_names(1, 60), some_names(2, 900)
    a = spark.createDataFrame([("s", n) for n in names], "scope string, id string")
    b = spark.createDataFrame([("s", n, f"{i:04d}") for i, n in enumerate(companies)],
                              "scope string, id string, first string")
    rows = similarity.top_similar(a, b, 0.6, 3).collect()
    got = {}
    for r in rows:
        if r.ratio >= 0.6:
            got.setdefault(r["name"], []).append((-round(r.ratio, 9), f"{companies.index(r.company):04d}"))
    for name in names:
        want = sorted((-round(ratio(name, c), 9), f"{i:04d}") for i, c in enumerate(companies)
                      if ratio(name, c) >= 0.6)[:3]
        assert sorted(got.get(name, []))[:3] == want, name
    scored = sum(r.scored for r in rows)
    assert scored < len(names) * len(companies) / 10
    pairs = similarity.candidate_pairs(a, b, 0.6, 3).agg(F.count("*"), F.min(F.col("bound") - F.col("floor")))
    count, slack = pairs.first()
    assert scored <= count < len(names) * len(companies) / 3 and slack >= -1e-6


def test_many_searches_for_one_name(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_SEARCH", 5)
    companies = [f"acme haul {i}" for i in range(100)]
    a = spark.createDataFrame([("s", "acme haul")], "scope string, id string")
    b = spark.createDataFrame([("s", n, f"{i:04d}") for i, n in enumerate(companies)],
                              "scope string, id string, first string")
    rows = similarity.top_similar(a, b, 0.6, 3).collect()
    best = sorted((-r.ratio, r.company) for r in rows)
    assert {company for _, company in best[:10]} == {f"acme haul {i}" for i in range(10)}


def test_snapshots_and_decided_inquiries(spark):
    carriers = spark.createDataFrame(
        [("k1", "s1", "Blue Ridge Transport"), ("k2", "s2", "Blue Ridge Transport"), ("k3", "s1", None),
         ("k0", "s1", "BLUE RIDGE TRANSPORT")],
        "carrier_id string, snapshot_id string, company_name string")
    requests = spark.createDataFrame(
        [("i1", "s1", "blue ridge", None), ("i2", "s2", " Blue Ridge ", "blue ridge transport"),
         ("i3", "s3", "blue ridge", None), ("i4", "s1", "blue ridge", None), ("i5", "s1", None, " "),
         ("i6", "s1", None, "blue ridge transport"), ("i7", None, "blue ridge", None)],
        "inquiry_id string, snapshot_id string, carrier_name string, manual_hint string")
    exact = requests.select("inquiry_id", F.when(F.col("inquiry_id") == "i4", "verified").otherwise("none")
                            .alias("identity"))
    rows = matching.match_carrier_weak(requests, carriers, exact=exact).collect()
    got = sorted((r.inquiry_id, r["rank"], r.carrier_id, ",".join(r.signal_codes)) for r in rows)
    assert got == [
        ("i1", 1, "k0", "name_similarity"), ("i1", 2, "k1", "name_similarity"),
        ("i2", 1, "k2", "manual_hint,name_similarity"),
        ("i6", 1, "k0", "manual_hint"), ("i6", 2, "k1", "manual_hint"),
    ]
    assert matching.match_carrier_weak(requests.limit(0), carriers).count() == 0
    assert matching.match_carrier_weak(requests, carriers.limit(0)).count() == 0
