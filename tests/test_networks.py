"""Rings, near-duplicates, runs and turning points on odd and skewed rows, against plain loops."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

from rows import claims, values

from claimhound.operators import networks
from claimhound.operators.networks import churning_runs, connected, fraud_rings, near_duplicates, turning_points

DAY = dt.date(2022, 1, 1)


def later(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def skewed(n, seed):
    """Claims of which one service has a third."""
    rng, out = random.Random(seed), []
    for i in range(n):
        hot = i % 3 == 0
        out.append(
            {
                "Claim_ID": rng.randrange(n) if rng.random() < 0.9 else None,
                "Patient_ID": 1 if hot else rng.choice([1, 2, 3, None]),
                "Provider_ID": 1 if hot else rng.choice([1, 2, None]),
                "CPT_Code": "A" if hot else rng.choice(["A", "B", None]),
                "Claim_Date": later(rng.choice([None, *range(400)]) if rng.random() < 0.5 else rng.randrange(40)),
            }
        )
    return out


def test_near_duplicates_equal_a_comparison_of_all_pairs(spark):
    for n, days, seed in ((300, 3, 1), (200, 30, 2), (60, 0, 3)):
        rows = skewed(n, seed)
        known = [r for r in rows if None not in (r["Claim_ID"], r["Patient_ID"], r["Provider_ID"], r["CPT_Code"], r["Claim_Date"])]
        want = Counter()
        for a in known:
            service = [b for b in known if all(a[k] == b[k] for k in networks.SERVICE)]
            gaps = [
                (a["Claim_Date"] - b["Claim_Date"]).days
                for b in service
                if 0 <= (a["Claim_Date"] - b["Claim_Date"]).days <= days
                and (b["Claim_Date"], b["Claim_ID"]) < (a["Claim_Date"], a["Claim_ID"])
            ]
            if gaps:
                want[a["Claim_ID"], a["Claim_Date"], len(gaps), min(gaps)] += 1
        df = near_duplicates(claims(spark, *rows), days)
        assert Counter(values(df, "Claim_ID", "Claim_Date", "Earlier_Claims", "Days_Since")) == want and want
    assert near_duplicates(claims(spark, {}).limit(0)).count() == 0


def test_near_duplicates_spread_a_hot_service_over_its_days(spark):
    text = near_duplicates(claims(spark, {}))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(Patient_ID" in text and "bin" in text.split("hashpartitioning(Patient_ID")[1][:80]
    assert "Join" not in text


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(900, 901), (901, 902), (902, 900), (7, 7), (900, 901)]
    links += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent}
    rng.shuffle(links)
    found = connected(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len(want) and {r.node: r.ring for r in found} == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rings(spark):
    def fraud(provider, patient, n, **more):
        return [{"Provider_ID": provider, "Patient_ID": patient, "Fraud_Label": 1, **more}] * n

    rows = [
        *fraud(1, 10, 3), *fraud(2, 10, 3), *fraud(2, 11, 4), *fraud(3, 11, 3, Paid_Amount=None),
        *fraud(4, 12, 5), *fraud(5, 12, 2), *fraud(None, 10, 9), *fraud(6, None, 9),
        *[{"Provider_ID": 7, "Patient_ID": 10}] * 9, *fraud(8, 1, 3), *fraud(9, 1, 3),
    ]
    found = values(fraud_rings(claims(spark, *rows)), "Ring_ID", "Providers", "Patients", "Fraud_Claims", "Fraud_Paid")
    assert [(*r[:4], float(r[4])) for r in found] == [(1, 3, 2, 13, 800.0), (8, 2, 1, 6, 480.0)]
    assert fraud_rings(claims(spark, *rows), min_claims=1).count() == 3
    assert fraud_rings(claims(spark, {})).count() == 0


def test_churning_runs_equal_a_plain_pass(spark):
    rows = skewed(300, 5)
    days = defaultdict(list)
    for r in rows:
        if None not in (r["Provider_ID"], r["Patient_ID"], r["Claim_Date"]):
            days[r["Provider_ID"], r["Patient_ID"]].append(r["Claim_Date"])
    want = []
    for (provider, patient), dates in days.items():
        run = []
        for d in sorted(dates):
            if run and (d - run[-1]).days > 5:
                want.append((provider, patient, run[0], run[-1], len(run)))
                run = []
            run.append(d)
        want.append((provider, patient, run[0], run[-1], len(run)))
    df = churning_runs(claims(spark, *rows), gap_days=5, min_claims=1)
    assert sorted(values(df, "Provider_ID", "Patient_ID", "First_Day", "Last_Day", "Claims")) == sorted(want)


def test_turning_points(spark):
    def history(provider, counts):
        out = []
        for i, n in enumerate(counts):
            quarter = {"Provider_ID": provider, "Claim_Year": 2020 + i // 4, "Claim_Quarter": f"Q{1 + i % 4}"}
            out += [{**quarter, "Fraud_Label": 0}] + [{**quarter, "Fraud_Label": 1}] * n
        return out

    rows = history(1, [0, 0, 0, 0, 3, 3, 3, 3]) + history(2, [4, 4, 0, 0, 0, 0, 0, 0]) + history(3, [1] * 8) + history(4, [9, 0])
    rows += history(5, [0, 2, 0, 2, 0, 2, 0, 2]) + history(None, [0, 9] * 5)
    found = {r.Provider_ID: r for r in turning_points(claims(spark, *rows)).collect()}
    assert set(found) == {1, 2, 5}
    assert (found[1].Last_Quarter_Before, found[1].Direction, float(found[1].Strength)) == ("2020-Q4", "Rise", 6.0)
    assert (found[2].Last_Quarter_Before, found[2].Direction, float(found[2].Strength)) == ("2020-Q2", "Fall", 6.0)
    assert (found[5].Last_Quarter_Before, found[5].Quarters) == ("2020-Q1", 8)  # the first of equals
