"""Money, behaviour, payers, patients, specialties, scoring, queues and report analyses."""

from __future__ import annotations

from claimhound.plans.oracle.base import (
    CENTS_ALLOWED,
    CENTS_BILLED,
    CENTS_FRAUD_PAID,
    CENTS_PAID,
    FRAUD,
    RATE,
    big,
    cents,
    hu,
    mean_of,
    millions,
    money,
    score,
    signed_hu,
    thousands,
)
from claimhound.plans.oracle.core import FLAG_SUM, PROVIDER, PROVIDER_SCORES, RISKIEST

PAY_RATE = hu(f"{CENTS_PAID} * 100", f"NULLIF({CENTS_BILLED}, 0)", 1)
GAP = f"({CENTS_BILLED} - {CENTS_PAID})"
# Billed over allowed and unit overcharge, in millionths, per claim.
RATIO = f"CAST({hu(cents('Billed_Amount'), 'NULLIF(' + cents('Allowed_Amount') + ', 0)', 6, 18)} * 1000000 AS BIGINT)"
OVERCHARGE = (
    "CAST("
    + hu(
        f"(Units_Billed - Units_Rendered) * {cents('Billed_Amount')}",
        "NULLIF(Units_Billed, 0) * 100",
        6,
        18,
    )
    + " * 1000000 AS BIGINT)"
)

FINANCIAL = {
    "q07a_exposure": f"""
SELECT CASE Fraud_Label WHEN 1 THEN 'Fraudulent' ELSE 'Legitimate' END AS Category,
       COUNT(*) AS Claims, {millions(CENTS_BILLED)} AS Billed_M,
       {millions(CENTS_ALLOWED)} AS Allowed_M, {millions(CENTS_PAID)} AS Paid_M,
       {signed_hu(GAP, "100000000", 3, 24)} AS Denied_Gap_M, {PAY_RATE} AS Pay_Rate_Pct
FROM fa GROUP BY Fraud_Label""",
    "q07b_specialty_gap": f"""
SELECT Specialty, COUNT(*) AS Claims, {millions(CENTS_BILLED)} AS Billed_M,
       {millions(CENTS_PAID)} AS Paid_M, {signed_hu(GAP, "100000000", 3, 24)} AS Gap_M,
       {signed_hu(GAP + " * 100", f"NULLIF({CENTS_BILLED}, 0)", 1)} AS Gap_Pct,
       {hu(f"SUM({RATIO})", f"COUNT({RATIO}) * 1000000", 2)} AS Bill_to_Allow_Ratio
FROM fa GROUP BY Specialty""",
    "q07c_largest_fraud_claims": """
SELECT Claim_ID, Claim_Date, fa.Provider_Name, fa.Specialty, Provider_State, Patient_ID, Insurer,
       CPT_Description, Fraud_Type, Units_Billed, Units_Rendered, Billed_Amount AS Billed,
       Paid_Amount AS Paid, Fraud_Risk_Score, Claim_Status, Is_Fraudulent, License_Valid
FROM fa JOIN pr ON fa.Provider_ID = pr.Provider_ID
WHERE Fraud_Label = 1 AND Billed_Amount > 5000
ORDER BY Billed DESC, Claim_ID, Claim_Date, fa.Provider_Name, fa.Specialty, Provider_State,
         Patient_ID, Insurer, CPT_Description, Fraud_Type NULLS FIRST, Units_Billed,
         Units_Rendered, Paid NULLS FIRST
LIMIT 50""",
    "q07d_overbilled_units": f"""
SELECT Provider_ID, Provider_Name, Specialty, COUNT(*) AS Mismatch_Claims,
       {big("SUM(Units_Billed - Units_Rendered)")} AS Total_Extra_Units,
       {hu("SUM(Units_Billed - Units_Rendered)", "COUNT(*)", 2)} AS Avg_Extra_Units,
       {hu(f"SUM({OVERCHARGE})", "1000000", 2, 24)} AS Est_Overbilled
FROM fa WHERE Units_Billed > Units_Rendered GROUP BY Provider_ID, Provider_Name, Specialty""",
    "q07e_insurer_pay_rate": f"""
SELECT Insurer, COUNT(*) AS Claims, {millions(CENTS_BILLED)} AS Billed_M,
       {millions(CENTS_PAID)} AS Paid_M, {PAY_RATE} AS Pay_Rate_Pct, {FRAUD} AS Fraud_Claims,
       {millions(CENTS_FRAUD_PAID)} AS Fraud_Leakage_M
FROM fa GROUP BY Insurer""",
}

PATIENT = "Patient_ID, Patient_Age, Patient_Gender, Patient_State"

BEHAVIOUR = {
    "q08a_crowded_days": f"""
SELECT Provider_ID, Provider_Name, Specialty, Claim_Date, COUNT(*) AS Claims_That_Day,
       COUNT(DISTINCT Patient_ID) AS Patients_That_Day, {money(CENTS_BILLED)} AS Daily_Billed,
       {FRAUD} AS Fraud_That_Day,
       {hu("COUNT(*)", "COUNT(DISTINCT Patient_ID)", 2)} AS Claims_Per_Patient
FROM fa GROUP BY Provider_ID, Provider_Name, Specialty, Claim_Date HAVING COUNT(*) >= 10
ORDER BY Claims_That_Day DESC, Provider_ID, Provider_Name, Specialty, Claim_Date LIMIT 30""",
    "q08b_patient_rings": f"""
SELECT {PATIENT}, COUNT(*) AS Total_Claims, COUNT(DISTINCT Provider_ID) AS Unique_Providers,
       COUNT(DISTINCT Insurer) AS Insurers_Used, {FRAUD} AS Fraud_Claims,
       {hu("SUM(Fraud_Label) * 100", "COUNT(*)", 1)} AS Fraud_Rate_Pct,
       {thousands(CENTS_BILLED)} AS Total_Billed_K,
       STRING_AGG(Fraud_Type, ' | ' ORDER BY Fraud_Type) AS Fraud_Types
FROM fa GROUP BY {PATIENT} HAVING COUNT(DISTINCT Provider_ID) >= 5
ORDER BY Unique_Providers DESC, Total_Billed_K DESC, {PATIENT} LIMIT 30""",
    "q08b_ring_types": f""", top AS (
SELECT {PATIENT} FROM fa GROUP BY {PATIENT} HAVING COUNT(DISTINCT Provider_ID) >= 5
ORDER BY COUNT(DISTINCT Provider_ID) DESC, {thousands(CENTS_BILLED)} DESC, {PATIENT} LIMIT 30)
SELECT {PATIENT}, Fraud_Type, COUNT(*) AS Times FROM fa SEMI JOIN top USING ({PATIENT})
WHERE Fraud_Type IS NOT NULL GROUP BY ALL""",
    "q08c_billing_outliers": f""", st AS (
SELECT CPT_Code, CPT_Description, Specialty, COUNT(Billed_Amount) AS n, {CENTS_BILLED} AS total,
       AVG(CAST(Billed_Amount AS DOUBLE)) + 2 * STDDEV_SAMP(CAST(Billed_Amount AS DOUBLE)) AS ucl
FROM fa GROUP BY CPT_Code, CPT_Description, Specialty), o AS (
SELECT CPT_Code, CPT_Description, Specialty, n, total, Billed_Amount, Fraud_Label
FROM fa JOIN st USING (CPT_Code, CPT_Description, Specialty)
WHERE CAST(Billed_Amount AS DOUBLE) > ucl), g AS (
SELECT CPT_Code, CPT_Description, Specialty, COUNT(*) AS k, {FRAUD} AS fraud,
       {CENTS_BILLED} AS s, MAX(n) AS n, MAX(total) AS total
FROM o GROUP BY CPT_Code, CPT_Description, Specialty), f AS (
SELECT *, {hu("CAST(s AS HUGEINT) * n", "CAST(total AS HUGEINT) * k", 6, 18)} AS ratio FROM g)
SELECT CPT_Code, CPT_Description, Specialty, k AS Outlier_Claims, fraud AS Fraud_Among_Outliers,
       {hu("s", "k * 100", 2)} AS Avg_Outlier_Billed, {hu("total", "n * 100", 2)} AS Expected_Avg,
       {hu("CAST(ratio * 1000000 AS BIGINT)", "1000000", 2)} AS Overage_Ratio
FROM f""",
    "q08d_weekend_providers": f"""
SELECT {PROVIDER}, COUNT(*) AS Weekend_Claims, {FRAUD} AS Weekend_Fraud,
       {RATE} AS Weekend_Fraud_Rate_Pct, {money(CENTS_BILLED)} AS Weekend_Billed
FROM fa WHERE Flag_Weekend = 1 GROUP BY {PROVIDER}
HAVING COUNT(*) >= 5 AND AVG(Fraud_Label) > 0.40""",
}

PAYERS = {
    "q09a_insurer_exposure": f"""
SELECT Insurer, COUNT(*) AS Total_Claims, COUNT(DISTINCT Provider_ID) AS Providers_Billing,
       COUNT(DISTINCT Patient_ID) AS Patients_Covered, {millions(CENTS_BILLED)} AS Billed_M,
       {millions(CENTS_PAID)} AS Paid_M, {PAY_RATE} AS Pay_Rate_Pct, {FRAUD} AS Fraud_Claims,
       {RATE} AS Fraud_Rate_Pct, {millions(CENTS_FRAUD_PAID)} AS Fraud_Leakage_M,
       {score()} AS Avg_Risk_Score
FROM fa GROUP BY Insurer""",
    "q09b_detection": f"""
SELECT Insurer, {FRAUD} AS Total_Fraud_Claims,
       COUNT(*) FILTER (Claim_Status = 'Denied' AND Fraud_Label = 1) AS Caught_Denied,
       COUNT(*) FILTER (Claim_Status = 'Approved' AND Fraud_Label = 1) AS Slipped_Approved,
       {hu("COUNT(*) FILTER (Claim_Status = 'Denied' AND Fraud_Label = 1) * 100",
           "NULLIF(SUM(Fraud_Label), 0)", 1)} AS Detection_Rate_Pct,
       {thousands("SUM(CASE WHEN Claim_Status = 'Approved' AND Fraud_Label = 1 THEN "
                  + cents("Paid_Amount") + " ELSE 0 END)")} AS Undetected_Paid_K
FROM fa GROUP BY Insurer""",
    "q09c_insurer_specialty": f"""
SELECT Insurer, Specialty, COUNT(*) AS Claims, {FRAUD} AS Fraud_Claims, {RATE} AS Fraud_Rate_Pct,
       {thousands(CENTS_FRAUD_PAID)} AS Fraud_Paid_K
FROM fa GROUP BY Insurer, Specialty HAVING COUNT(*) > 50""",
}

PATIENTS = {
    "q10a_age_groups": f"""
SELECT CASE WHEN Patient_Age < 18 THEN '0-17  Minor' WHEN Patient_Age < 35 THEN '18-34 Young Adult'
            WHEN Patient_Age < 50 THEN '35-49 Middle Age'
            WHEN Patient_Age < 65 THEN '50-64 Pre-Senior' ELSE '65+ Elderly' END AS Age_Group,
       COUNT(*) AS Claims, COUNT(DISTINCT Patient_ID) AS Unique_Patients, {FRAUD} AS Fraud_Claims,
       {RATE} AS Fraud_Rate_Pct, {mean_of("Billed_Amount")} AS Avg_Billed,
       {thousands(CENTS_FRAUD_PAID)} AS Fraud_Paid_K
FROM fa GROUP BY 1""",
    "q10b_gender": f"""
SELECT Patient_Gender, COUNT(*) AS Claims, COUNT(DISTINCT Patient_ID) AS Unique_Patients,
       {FRAUD} AS Fraud_Claims, {RATE} AS Fraud_Rate_Pct, {mean_of("Billed_Amount")} AS Avg_Billed
FROM fa GROUP BY Patient_Gender""",
    "q10c_repeat_fraud_patients": f""", af AS (
SELECT Patient_ID, STRING_AGG(DISTINCT Fraud_Type, ' | ' ORDER BY Fraud_Type) AS Fraud_Types
FROM fa GROUP BY Patient_ID)
SELECT {PATIENT.replace("Patient_ID", "fa.Patient_ID")}, COUNT(*) AS Total_Claims,
       {FRAUD} AS Fraud_Claims, COUNT(DISTINCT Provider_ID) AS Providers_Seen,
       COUNT(DISTINCT Insurer) AS Insurers_Used, {thousands(CENTS_BILLED)} AS Total_Billed_K,
       {thousands(CENTS_FRAUD_PAID)} AS Fraud_Paid_K, Fraud_Types
FROM fa LEFT JOIN af ON fa.Patient_ID = af.Patient_ID
GROUP BY {PATIENT.replace("Patient_ID", "fa.Patient_ID")}, Fraud_Types
HAVING SUM(Fraud_Label) >= 3
ORDER BY Fraud_Claims DESC, {PATIENT.replace("Patient_ID", "fa.Patient_ID")} LIMIT 20""",
}

SPECIALTY = {
    "q11a_specialty_scorecard": f"""
SELECT Specialty, COUNT(*) AS Total_Claims, COUNT(DISTINCT Provider_ID) AS Providers,
       {FRAUD} AS Fraud_Claims, {RATE} AS Fraud_Rate_Pct, {millions(CENTS_BILLED)} AS Billed_M,
       {mean_of("Billed_Amount")} AS Avg_Billed, {score()} AS Avg_Risk_Score,
       CAST(RANK() OVER (ORDER BY AVG(Fraud_Label) DESC) AS INTEGER) AS Fraud_Rate_Rank,
       CAST(RANK() OVER (ORDER BY SUM(Billed_Amount) DESC) AS INTEGER) AS Revenue_Rank,
       CASE WHEN AVG(Fraud_Label) > 0.40 AND SUM(Billed_Amount) > 1000000 THEN 'HIGH PRIORITY'
            WHEN AVG(Fraud_Label) > 0.20 THEN 'MONITOR' ELSE 'LOW RISK' END
         AS Investigation_Priority
FROM fa GROUP BY Specialty""",
    "q11b_experience": f"""
SELECT CASE WHEN Years_Practice <= 5 THEN '0-5 yrs' WHEN Years_Practice <= 10 THEN '6-10 yrs'
            WHEN Years_Practice <= 20 THEN '11-20 yrs' ELSE '20+ yrs' END AS Experience_Band,
       COUNT(DISTINCT pr.Provider_ID) AS Providers, COUNT(Claim_ID) AS Claims,
       {FRAUD} AS Fraud_Claims, {RATE} AS Fraud_Rate_Pct, {score()} AS Avg_Risk_Score
FROM pr JOIN fa ON pr.Provider_ID = fa.Provider_ID GROUP BY 1""",
}


def _both(alias: str, *flags: str) -> str:
    condition = " AND ".join(f"Flag_{f} = 1" for f in flags)
    return f"COUNT(*) FILTER ({condition}) AS {alias}"


SCORING = {
    "q12a_flag_co_occurrence": f"""
SELECT {_both("F1_HighValue", "HighValue")}, {_both("F2_Weekend", "Weekend")},
       {_both("F3_SameDay", "SameDay_Volume")}, {_both("F4_UnitMismatch", "UnitMismatch")},
       {_both("F5_Duplicate", "Duplicate")}, {_both("F1xF4", "HighValue", "UnitMismatch")},
       {_both("F1xF5", "HighValue", "Duplicate")}, {_both("F2xF3", "Weekend", "SameDay_Volume")},
       {_both("F4xF5", "UnitMismatch", "Duplicate")},
       {_both("F1xF2xF5", "HighValue", "Weekend", "Duplicate")},
       COUNT(*) FILTER ({FLAG_SUM} = 5) AS All_5_Flags
FROM fa""",
    "q12b_score_bands": f"""
SELECT CASE WHEN Fraud_Risk_Score = 0 THEN '0 Clean' WHEN Fraud_Risk_Score <= 20 THEN '1-20 Low'
            WHEN Fraud_Risk_Score <= 50 THEN '21-50 Moderate'
            WHEN Fraud_Risk_Score <= 70 THEN '51-70 High' ELSE '71-99 Critical' END AS Risk_Band,
       COUNT(*) AS Claims, {hu("COUNT(*) * 100", "(SELECT COUNT(*) FROM fa)", 2)} AS Pct_Total,
       {FRAUD} AS Fraud_Claims, {RATE} AS Fraud_Rate_Pct, {millions(CENTS_BILLED)} AS Billed_M
FROM fa GROUP BY 1""",
    "q12c_flag_count_validation": f"""
SELECT TotalFlags, COUNT(*) AS Claims, {FRAUD} AS Fraud_Claims, {RATE} AS Fraud_Rate_Pct,
       {score()} AS Avg_Risk_Score, {mean_of("Billed_Amount")} AS Avg_Billed
FROM (SELECT *, {FLAG_SUM} AS TotalFlags FROM fa) t GROUP BY TotalFlags""",
}

SCORED = f""", sc AS (
SELECT CAST(Fraud_Risk_Score + 10 * Flag_HighValue + 15 * Flag_Duplicate + 8 * Flag_UnitMismatch
         + 12 * Flag_SameDay_Volume + 5 * Flag_Weekend
         + 20 * CAST(Billed_Amount > 10000 AS INTEGER) + 25 * Is_Fraudulent
         + 15 * CAST(License_Valid = 0 AS INTEGER) + 30 * Fraud_Label AS INTEGER) AS Priority_Score,
       Claim_ID, Claim_Date, fa.Provider_ID, fa.Provider_Name, fa.Specialty, Provider_State,
       Patient_ID, Insurer, Fraud_Type, Billed_Amount AS Billed, Paid_Amount AS Paid, Claim_Status,
       Fraud_Risk_Score, {FLAG_SUM} AS Total_Flags, Is_Fraudulent, License_Valid, Years_Practice
FROM fa JOIN pr ON fa.Provider_ID = pr.Provider_ID), act AS (
SELECT *, CASE WHEN Priority_Score > 120 THEN 'IMMEDIATE ACTION — Refer to SIU'
               WHEN Priority_Score > 80 THEN 'URGENT — Full Audit Required'
               WHEN Priority_Score > 50 THEN 'SCHEDULE — Desk Review'
               ELSE 'MONITOR — Low Priority' END AS Action_Required
FROM sc)"""

QUEUES = {
    "q13a_priority_claims": f"""{SCORED}
SELECT * FROM act
ORDER BY Priority_Score DESC, Claim_ID, Claim_Date, Provider_ID, Provider_Name, Specialty,
         Provider_State, Patient_ID, Insurer, Fraud_Type NULLS FIRST, Billed, Paid NULLS FIRST
LIMIT 50""",
    "q13b_intervention_queue": f"""{PROVIDER_SCORES}
SELECT CAST(ROW_NUMBER() OVER (ORDER BY {RISKIEST}) AS INTEGER) AS Queue_Position,
       ps.* EXCLUDE (Weekend_Claims), Is_Fraudulent, License_Valid, Network_Status,
       CASE WHEN Is_Fraudulent = 1 AND License_Valid = 1
              THEN 'LICENSE REVOCATION + CRIMINAL REFERRAL'
            WHEN Fraud_Rate_Pct >= 80 THEN 'IMMEDIATE SIU INVESTIGATION'
            WHEN Fraud_Rate_Pct >= 50 THEN 'FULL AUDIT — Billing Review'
            ELSE 'ENHANCED MONITORING' END AS Intervention
FROM ps JOIN pr ON ps.Provider_ID = pr.Provider_ID
QUALIFY Queue_Position <= 25""",
    "x01_streamed_scores": f"{SCORED}\nSELECT * FROM act",
}

STATE_LOSS = f""", st AS (
SELECT Provider_State, COUNT(*) AS Claims, {CENTS_FRAUD_PAID} AS f, {CENTS_PAID} AS p
FROM fa GROUP BY Provider_State), loss AS (
SELECT Provider_State, Claims, {money("f")} AS Fraud_Paid, {money("p")} AS Total_Paid,
       {hu("f * 100", "NULLIF(p, 0)", 2)} AS Loss_Ratio_Pct,
       {hu("(SELECT SUM(f) FROM st) * 100", "(SELECT SUM(p) FROM st)", 2)} AS National_Ratio_Pct,
       CAST(f * 100 > p * 15 AS INTEGER) AS Escalate
FROM st)"""

NAMED = "Provider_ID, Provider_Name, Specialty"
FRAUD_PROVIDERS = f""", fp AS (
SELECT {NAMED}, COUNT(*) AS Fraud_Claims, {money(CENTS_PAID)} AS Fraud_Paid
FROM fa WHERE Fraud_Label = 1 GROUP BY {NAMED})"""
BY_COUNT = f"SELECT * FROM fp ORDER BY Fraud_Claims DESC, {NAMED} LIMIT 10"
BY_PAID = f"SELECT * FROM fp ORDER BY Fraud_Paid DESC, {NAMED} LIMIT 10"
CLAIM = f"Claim_ID, Claim_Date, {NAMED}, Patient_ID, Fraud_Risk_Score, Claim_Status"


def _kpi(name: str, value: str, first: str, second: str, sign: str) -> str:
    target = "CAST({} AS DECIMAL(24,2))"
    return f"""
SELECT '{name}' AS KPI, {value} AS Current_Value, {target.format(first)} AS Target_2026,
       {target.format(second)} AS Target_2027, CAST({value} {sign} {first} AS INTEGER) AS Meets_2026,
       CAST({value} {sign} {second} AS INTEGER) AS Meets_2027
FROM fa"""


SPAN = "CAST(MAX(Claim_Date) - MIN(Claim_Date) AS INTEGER)"
DIFFER = "Units_Billed <> Units_Rendered"

REPORT = {
    "r01_state_loss_ratio": f"{STATE_LOSS}\nSELECT * FROM loss",
    "r01_escalated_states": f"{STATE_LOSS}\nSELECT * EXCLUDE (Escalate) FROM loss WHERE Escalate = 1",
    "r02_type_impact": f""", t AS (
SELECT Fraud_Type, COUNT(*) AS Claims, {money(CENTS_PAID)} AS Fraud_Paid,
       CAST(RANK() OVER (ORDER BY COUNT(*) DESC) AS INTEGER) AS Volume_Rank,
       CAST(RANK() OVER (ORDER BY {CENTS_PAID} DESC) AS INTEGER) AS Severity_Rank
FROM fa WHERE Fraud_Type IS NOT NULL GROUP BY Fraud_Type)
SELECT *, Volume_Rank - Severity_Rank AS Rank_Gap FROM t""",
    "r03_top_by_count": f"{FRAUD_PROVIDERS}\n{BY_COUNT}",
    "r04_top_by_paid": f"{FRAUD_PROVIDERS}\n{BY_PAID}",
    "r05_level_one": f"""{FRAUD_PROVIDERS}
SELECT c.* FROM ({BY_COUNT}) c WHERE Provider_ID IN (SELECT Provider_ID FROM ({BY_PAID}) p)""",
    "r06_peer_benchmark": f""", p AS (
SELECT {NAMED}, COUNT(*) AS Claims, {mean_of("Billed_Amount")} AS Avg_Billed,
       {RATE} AS Fraud_Rate_Pct
FROM fa GROUP BY {NAMED}), s AS (
SELECT Specialty, {mean_of("Billed_Amount")} AS Peer_Avg_Billed FROM fa GROUP BY Specialty)
SELECT p.*, Peer_Avg_Billed,
       {signed_hu("CAST((Avg_Billed - Peer_Avg_Billed) * 100 AS BIGINT) * 100",
                  "CAST(Peer_Avg_Billed * 100 AS BIGINT)", 2)} AS Deviation_Pct
FROM p JOIN s ON p.Specialty = s.Specialty""",
    "r07_patient_mills": f""", p AS (
SELECT {NAMED}, COUNT(*) AS Total_Claims, COUNT(DISTINCT Patient_ID) AS Unique_Patients,
       {RATE} AS Fraud_Rate_Pct,
       {hu("COUNT(*)", "COUNT(DISTINCT Patient_ID)", 2)} AS Claims_Per_Patient
FROM fa GROUP BY {NAMED})
SELECT * FROM p WHERE Total_Claims >= 100 AND Claims_Per_Patient >= 1.20""",
    "r08_weekday": f"""
SELECT CAST(isodow(Claim_Date) AS INTEGER) AS Day_Number, dayname(Claim_Date) AS Day_Name,
       COUNT(*) AS Claims, {FRAUD} AS Fraud_Claims, {RATE} AS Fraud_Rate_Pct,
       {mean_of("Billed_Amount")} AS Avg_Billed
FROM fa GROUP BY 1, 2""",
    "r09_fourth_quarter": f"""
SELECT CASE WHEN month(Claim_Date) >= 10 THEN 'Q4' WHEN Claim_Date IS NULL THEN 'No date'
       ELSE 'Q1-Q3' END AS Period, COUNT(*) AS Claims,
       {FRAUD} AS Fraud_Claims, {RATE} AS Fraud_Rate_Pct, {money(CENTS_FRAUD_PAID)} AS Fraud_Paid
FROM fa GROUP BY 1""",
    "r10_recoverable_loss": f"""
SELECT {money(CENTS_FRAUD_PAID)} AS Recoverable_Loss, {SPAN} AS Span_Days,
       {hu(CENTS_FRAUD_PAID, f"{SPAN} * 100", 2, 24)} AS Daily_Burn,
       {hu(f"{CENTS_FRAUD_PAID} * 365", f"{SPAN} * 100", 2, 24)} AS Annualised_Leakage
FROM fa""",
    "r11_leakage_ratio": f"""
SELECT {money(CENTS_FRAUD_PAID)} AS Fraud_Paid, {money(CENTS_PAID)} AS Total_Paid,
       {hu(f"{CENTS_FRAUD_PAID} * 100", CENTS_PAID, 2)} AS Leakage_Ratio_Pct, 5 AS Target_Pct,
       {hu(f"{CENTS_FRAUD_PAID} * 100", f"{CENTS_PAID} * 5", 2)} AS Multiple_Of_Target
FROM fa""",
    "r12_top_provider_share": f""", p AS (
SELECT Provider_ID, {CENTS_FRAUD_PAID} AS paid FROM fa GROUP BY Provider_ID), t AS (
SELECT * FROM p ORDER BY paid DESC, Provider_ID LIMIT 10), a AS (
SELECT COUNT(*) AS n, SUM(paid) AS s FROM p), b AS (SELECT COUNT(*) AS k, SUM(paid) AS w FROM t)
SELECT k AS Top_Providers, n AS All_Providers, {hu("k * 100", "n", 2)} AS Provider_Share_Pct,
       {money("w")} AS Top_Fraud_Paid, {money("s")} AS Total_Fraud_Paid,
       {hu("w * 100", "NULLIF(s, 0)", 2)} AS Fraud_Share_Pct
FROM a, b""",
    "r13_cost_profile": f"""
SELECT CASE Fraud_Label WHEN 1 THEN 'Fraudulent' ELSE 'Legitimate' END AS Claim_Type,
       COUNT(*) AS Claims, {mean_of("Paid_Amount")} AS Avg_Paid
FROM fa GROUP BY 1""",
    "r14_weekend_review": f"""
SELECT {CLAIM}, Billed_Amount AS Billed,
       Flag_HighValue + Flag_SameDay_Volume + Flag_UnitMismatch + Flag_Duplicate AS Other_Flags
FROM fa WHERE Flag_Weekend = 1
  AND (Flag_HighValue = 1 OR Flag_SameDay_Volume = 1 OR Flag_UnitMismatch = 1
       OR Flag_Duplicate = 1)""",
    "r14_weekend_known_providers": f"""
SELECT {CLAIM}, Billed_Amount AS Billed FROM fa
WHERE Flag_Weekend = 1 AND Provider_ID IN (SELECT Provider_ID FROM pr WHERE Is_Fraudulent = 1)""",
    "r15_unit_mismatch_holds": f"""
SELECT {CLAIM}, Billed_Amount AS Billed, Units_Billed, Units_Rendered, Flag_UnitMismatch
FROM fa WHERE {DIFFER}""",
    "r17_quarterly_peers": f""", sums AS (
SELECT {NAMED}, Claim_Year, Claim_Quarter, COUNT(*) AS Claims, {CENTS_BILLED} AS c,
       COUNT(Billed_Amount) AS k, {RATE} AS Fraud_Rate_Pct
FROM fa GROUP BY ALL), means AS (
SELECT *, {hu("c", "k * 100", 2)} AS Avg_Billed,
       {hu("SUM(c) OVER peers", "SUM(k) OVER peers * 100", 2)} AS Peer_Avg_Billed
FROM sums WINDOW peers AS (PARTITION BY Specialty, Claim_Year, Claim_Quarter))
SELECT * EXCLUDE (c, k),
       {signed_hu("CAST((Avg_Billed - Peer_Avg_Billed) * 100 AS BIGINT) * 100",
                  "CAST(Peer_Avg_Billed * 100 AS BIGINT)", 2)} AS Deviation_Pct
FROM means""",
    "r18_portfolio_savings": f"""
SELECT {money(CENTS_BILLED)} AS Total_Billed, {money(CENTS_PAID)} AS Total_Paid,
       {signed_hu(GAP, "100", 2, 24)} AS Savings,
       {signed_hu(GAP + " * 100", CENTS_BILLED, 2)} AS Savings_Rate_Pct
FROM fa""",
    "r19_audit_coverage": f"""{FRAUD_PROVIDERS}
SELECT t.*, 0 AS Reviewed, CAST(0 AS DECIMAL(12,2)) AS Coverage_Pct FROM ({BY_PAID}) t""",
    "r16_kpi_scorecard": " UNION ALL ".join(
        [
            _kpi("Portfolio Fraud Rate", hu("SUM(Fraud_Label) * 100", "COUNT(*)", 2, 24), "8.00", "5.00", "<="),
            _kpi("Revenue Leakage Ratio", hu(f"{CENTS_FRAUD_PAID} * 100", CENTS_PAID, 2, 24), "7.00", "5.00", "<="),
            _kpi("Daily Burn Rate", hu(CENTS_FRAUD_PAID, f"{SPAN} * 100", 2, 24), "7500.00", "5000.00", "<="),
            _kpi(
                "Unit Mismatch Recall",
                hu(
                    f"COUNT(*) FILTER ({DIFFER} AND Flag_UnitMismatch = 1) * 100",
                    f"NULLIF(COUNT(*) FILTER ({DIFFER}), 0)",
                    2,
                    24,
                ),
                "100.00",
                "100.00",
                ">=",
            ),
            _kpi(
                "Data Completeness",
                hu(
                    "(COUNT(Claim_ID) + COUNT(Provider_ID) + COUNT(Billed_Amount) + COUNT(Claim_Date)) * 100",
                    "(4 * COUNT(*))",
                    2,
                    24,
                ),
                "100.00",
                "100.00",
                ">=",
            ),
        ]
    ),
}

STATEMENTS = {
    **FINANCIAL,
    **BEHAVIOUR,
    **PAYERS,
    **PATIENTS,
    **SPECIALTY,
    **SCORING,
    **QUEUES,
    **REPORT,
}
