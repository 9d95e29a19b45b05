"""Statements of the streams with state, the refreshed report and the network analyses."""

from __future__ import annotations

from claimhound.plans.oracle.base import FRAUD, RATE, cents, hu, money
from claimhound.plans.oracle.core import STATEMENTS as CORE
from claimhound.plans.oracle.more import STATEMENTS as MORE

SERVICE = "Patient_ID, Provider_ID, CPT_Code"

STATEMENTS = {
    "x02_deduplicated_arrivals": "SELECT DISTINCT Claim_ID, Claim_Date FROM fa",
    "x03_replayed_scores": MORE["x01_streamed_scores"],
    "x04_streamed_crowded_days": MORE["q08a_crowded_days"],
    "x05_refreshed_quarters": f"""
SELECT Claim_Year, Claim_Quarter, COUNT(*) AS Claims, COUNT(DISTINCT Provider_ID) AS Providers,
       {FRAUD} AS Fraud_Claims, {RATE} AS Fraud_Rate_Pct, {money(f"SUM({cents('Billed_Amount')})")} AS Billed,
       {money(f"SUM({cents('Paid_Amount')})")} AS Paid,
       {money(f"COALESCE(SUM(CASE WHEN Fraud_Label = 1 THEN {cents('Paid_Amount')} END), 0)")} AS Fraud_Paid
FROM fa GROUP BY Claim_Year, Claim_Quarter""",
    "x07_bucketed_priority": {**CORE, **MORE}["q13a_priority_claims"],
    "x06_sketched_counts": """
SELECT Claim_Year, Insurer, COUNT(DISTINCT Patient_ID) AS Patients, COUNT(DISTINCT Provider_ID) AS Providers,
       1 AS Patients_In_Bound, 1 AS Providers_In_Bound
FROM fa GROUP BY Claim_Year, Insurer""",
    "q01d_near_duplicates": f"""
SELECT a.Claim_ID, a.Patient_ID, a.Provider_ID, a.CPT_Code, a.Claim_Date, COUNT(*) AS Earlier_Claims,
       CAST(MIN(a.Claim_Date - b.Claim_Date) AS INTEGER) AS Days_Since
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY Claim_ID, Billed_Amount, Units_Billed) AS place FROM fa) a
JOIN fa b USING ({SERVICE})
WHERE a.Claim_Date - b.Claim_Date <= 30
  AND (b.Claim_Date < a.Claim_Date OR b.Claim_Date = a.Claim_Date AND b.Claim_ID < a.Claim_ID)
GROUP BY a.place, a.Claim_ID, a.Patient_ID, a.Provider_ID, a.CPT_Code, a.Claim_Date""",
    "q08b_fraud_rings": f""", e AS MATERIALIZED (
SELECT Provider_ID AS p, Patient_ID AS q, COUNT(*) AS n, SUM({cents('Paid_Amount')}) AS paid
FROM fa WHERE Fraud_Label = 1 GROUP BY ALL HAVING COUNT(*) >= 3), rings AS (
WITH RECURSIVE reach(p, r) AS (
  SELECT p, p FROM e
  UNION
  SELECT b.p, reach.r FROM reach JOIN e a ON a.p = reach.p JOIN e b ON b.q = a.q)
SELECT p, MIN(r) AS ring FROM reach GROUP BY p)
SELECT CAST(ring AS BIGINT) AS Ring_ID, COUNT(DISTINCT p) AS Providers, COUNT(DISTINCT q) AS Patients,
       CAST(SUM(n) AS BIGINT) AS Fraud_Claims, {money("COALESCE(SUM(paid), 0)")} AS Fraud_Paid
FROM e JOIN rings USING (p) GROUP BY ring HAVING COUNT(DISTINCT p) >= 2""",
    "r07_churning_runs": f""", marked AS (
SELECT *, CASE WHEN Claim_Date - LAG(Claim_Date) OVER w <= 60 THEN 0 ELSE 1 END AS begins
FROM fa WINDOW w AS (PARTITION BY Provider_ID, Patient_ID ORDER BY Claim_Date)), numbered AS (
SELECT *, SUM(begins) OVER (PARTITION BY Provider_ID, Patient_ID ORDER BY Claim_Date) AS run FROM marked)
SELECT Provider_ID, Patient_ID, MIN(Claim_Date) AS First_Day, MAX(Claim_Date) AS Last_Day,
       COUNT(*) AS Claims, {money(f"COALESCE(SUM({cents('Paid_Amount')}), 0)")} AS Paid
FROM numbered GROUP BY Provider_ID, Patient_ID, run HAVING COUNT(*) >= 4""",
    "q06e_turning_points": f""", h AS (
SELECT Provider_ID, CONCAT(Claim_Year, '-', Claim_Quarter) AS quarter, SUM(Fraud_Label) AS fraud
FROM fa GROUP BY ALL), s AS (
SELECT Provider_ID, quarter, COUNT(*) OVER p AS n, SUM(fraud) OVER p AS total,
       ROW_NUMBER() OVER (PARTITION BY Provider_ID ORDER BY quarter) AS k,
       SUM(fraud) OVER (PARTITION BY Provider_ID ORDER BY quarter) AS so_far
FROM h WINDOW p AS (PARTITION BY Provider_ID)), d AS (
SELECT *, n * so_far - k * total AS away FROM s WHERE n >= 8)
SELECT Provider_ID, n AS Quarters, CAST(total AS BIGINT) AS Fraud_Claims, quarter AS Last_Quarter_Before,
       CASE WHEN away < 0 THEN 'Rise' ELSE 'Fall' END AS Direction, {hu("ABS(away)", "n", 2)} AS Strength
FROM d WHERE away <> 0
QUALIFY ROW_NUMBER() OVER (PARTITION BY Provider_ID ORDER BY ABS(away) DESC, k) = 1""",
}
