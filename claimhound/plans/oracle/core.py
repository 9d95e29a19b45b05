"""Audit, dashboard, patterns, providers, geography and time."""

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

FLAG_SUM = "Flag_HighValue + Flag_Weekend + Flag_SameDay_Volume + Flag_UnitMismatch + Flag_Duplicate"


def _nulls(alias: str, column: str) -> str:
    return f"COUNT(*) - COUNT({column}) AS {alias}"


def _share(name: str) -> str:
    return f"{hu('COUNT(*) * 100', '(SELECT COUNT(*) FROM fa)', 2)} AS {name}"


AUDIT = {
    "q00_claims": "SELECT * FROM fa",
    "q00_registry": "SELECT * FROM pr",
    "q01a_row_counts": """
SELECT 'Fraud_Analysis' AS "Table", COUNT(*) AS "Rows" FROM fa
UNION ALL SELECT 'Provider_Registry', COUNT(*) FROM pr""",
    "q01b_claims_nulls": f"""
SELECT {_nulls("Null_ClaimID", "Claim_ID")}, {_nulls("Null_ProviderID", "Provider_ID")},
       {_nulls("Null_PatientID", "Patient_ID")}, {_nulls("Null_FraudType", "Fraud_Type")},
       {_nulls("Null_BilledAmt", "Billed_Amount")}, {_nulls("Null_PaidAmt", "Paid_Amount")},
       {_nulls("Null_ClaimDate", "Claim_Date")}, COUNT(*) AS Total_Rows
FROM fa""",
    "q01c_registry_nulls": f"""
SELECT {_nulls("Null_ProviderID", "Provider_ID")}, {_nulls("Null_Specialty", "Specialty")},
       {_nulls("Null_State", "State")}, COUNT(*) AS Total_Rows
FROM pr""",
    "q01d_duplicate_claims": """
SELECT Claim_ID, COUNT(*) AS Occurrences FROM fa GROUP BY Claim_ID HAVING COUNT(*) > 1""",
    "q01e_orphan_providers": """
SELECT Provider_ID FROM fa EXCEPT SELECT Provider_ID FROM pr""",
    "q01f_overpayments": f"""
SELECT COUNT(*) AS Overpayment_Count,
       {money("SUM(" + cents("(Paid_Amount - Billed_Amount)") + ")")} AS Total_Excess_Paid
FROM fa WHERE Paid_Amount > Billed_Amount""",
    "q01g_unit_mismatches": """
SELECT COUNT(*) FILTER (Units_Billed <> Units_Rendered) AS Raw_Mismatch,
       COUNT(*) FILTER (Flag_UnitMismatch = 1) AS Flagged_Mismatch,
       COUNT(*) FILTER (Units_Billed <> Units_Rendered AND Flag_UnitMismatch = 0) AS Missed_By_Flag
FROM fa""",
    "q01h1_date_span": """
SELECT MIN(Claim_Date) AS Earliest, MAX(Claim_Date) AS Latest,
       CAST(MAX(Claim_Date) - MIN(Claim_Date) AS INTEGER) AS Span_Days
FROM fa""",
    "q01h2_claims_per_year": f"""
SELECT Claim_Year, COUNT(*) AS Claims, {_share("Pct")} FROM fa GROUP BY Claim_Year""",
    "q01i_fraud_type_nulls": """
SELECT Fraud_Label, COUNT(*) AS Claims, COUNT(*) - COUNT(Fraud_Type) AS Null_FraudType,
       COUNT(Fraud_Type) AS Has_FraudType
FROM fa GROUP BY Fraud_Label""",
}

DASHBOARD = {
    "q02a_dashboard": f"""
SELECT COUNT(*) AS Total_Claims,
       COUNT(DISTINCT fa.Provider_ID) AS Unique_Providers,
       COUNT(DISTINCT Patient_ID) AS Unique_Patients,
       COUNT(DISTINCT Provider_State) AS States_Covered,
       {millions(CENTS_BILLED)} AS Total_Billed_M,
       {millions(CENTS_ALLOWED)} AS Total_Allowed_M,
       {millions(CENTS_PAID)} AS Total_Paid_M,
       {signed_hu(f"({CENTS_BILLED} - {CENTS_PAID})", "100000000", 3, 24)} AS Billed_vs_Paid_Gap_M,
       {FRAUD} AS Confirmed_Fraud_Claims,
       {RATE} AS Overall_Fraud_Rate_Pct,
       {millions("SUM(CASE WHEN Fraud_Label = 1 THEN " + cents("Billed_Amount") + " ELSE 0 END)")}
         AS Fraud_Billed_M,
       {millions(CENTS_FRAUD_PAID)} AS Fraud_Paid_M,
       {score(2)} AS Avg_Risk_Score,
       COUNT(*) FILTER (Fraud_Risk_Score >= 70) AS Critical_Risk_Claims,
       {big("SUM(Flag_HighValue)")} AS Flag_HighValue,
       {big("SUM(Flag_Weekend)")} AS Flag_Weekend,
       {big("SUM(Flag_SameDay_Volume)")} AS Flag_SameDay,
       {big("SUM(Flag_UnitMismatch)")} AS Flag_UnitMismatch,
       {big("SUM(Flag_Duplicate)")} AS Flag_Duplicate,
       {big("SUM(Is_Fraudulent)")} AS Known_Fraudulent_Providers,
       COUNT(*) FILTER (Is_Fraudulent = 1 AND License_Valid = 1) AS Fraudulent_Still_Licensed,
       COUNT(DISTINCT fa.Provider_ID) FILTER (Is_Fraudulent = 1) AS Known_Fraudulent_Provider_Count,
       COUNT(DISTINCT fa.Provider_ID) FILTER (Is_Fraudulent = 1 AND License_Valid = 1)
         AS Fraudulent_Still_Licensed_Count
FROM fa JOIN pr ON fa.Provider_ID = pr.Provider_ID""",
    "q02b_claim_status": f"""
SELECT Claim_Status, COUNT(*) AS Claims, {_share("Pct_Total")}, {FRAUD} AS Fraud_Claims,
       {RATE} AS Fraud_Rate_Pct, {thousands(CENTS_BILLED)} AS Billed_K,
       {thousands(CENTS_PAID)} AS Paid_K, {score()} AS Avg_Risk_Score
FROM fa GROUP BY Claim_Status""",
    "q02c_network_status": f"""
SELECT Network_Status, COUNT(*) AS Claims, {FRAUD} AS Fraud_Claims, {RATE} AS Fraud_Rate_Pct,
       {millions(CENTS_BILLED)} AS Billed_M, {mean_of("Billed_Amount")} AS Avg_Billed,
       {score()} AS Avg_Risk_Score
FROM fa GROUP BY Network_Status""",
}


def _type_count(alias: str, value: str) -> str:
    return f"COUNT(*) FILTER (Fraud_Type = '{value}') AS {alias}"


PATTERNS = {
    "q03a_fraud_types": f"""
SELECT COALESCE(Fraud_Type, 'No Fraud — Legitimate') AS Fraud_Type, COUNT(*) AS Claims,
       {_share("Pct_Total")}, COUNT(DISTINCT Provider_ID) AS Providers_Involved,
       COUNT(DISTINCT Patient_ID) AS Patients_Affected,
       {money(CENTS_BILLED)} AS Total_Billed, {money(CENTS_PAID)} AS Total_Paid,
       {mean_of("Billed_Amount")} AS Avg_Billed, {score()} AS Avg_Risk_Score
FROM fa GROUP BY fa.Fraud_Type""",
    "q03b_type_by_specialty": f"""
SELECT Specialty, COUNT(*) AS Total_Claims, {FRAUD} AS Total_Fraud,
       {_type_count("Upcoding", "Upcoding")}, {_type_count("Unbundling", "Unbundling")},
       {_type_count("Phantom_Billing", "Phantom Billing")},
       {_type_count("Duplicate_Claim", "Duplicate Claim")},
       {_type_count("Identity_Theft", "Medical Identity Theft")},
       {_type_count("Kickback_Referral", "Kickback - Referral")}
FROM fa GROUP BY Specialty""",
    "q03c_fraud_by_insurer": f"""
SELECT Insurer, COUNT(*) AS Total_Claims, {FRAUD} AS Fraud_Claims, {RATE} AS Fraud_Rate_Pct,
       {thousands(CENTS_FRAUD_PAID)} AS Fraud_Paid_K,
       {hu("SUM(Fraud_Risk_Score) FILTER (Fraud_Label = 1)",
           "COUNT(Fraud_Risk_Score) FILTER (Fraud_Label = 1)", 1)} AS Avg_Fraud_Risk
FROM fa GROUP BY Insurer""",
    "q03d_weekend_split": f"""
SELECT Flag_Weekend, CASE Flag_Weekend WHEN 1 THEN 'Weekend' ELSE 'Weekday' END AS Day_Type,
       COUNT(*) AS Claims, {FRAUD} AS Fraud_Claims, {RATE} AS Fraud_Rate_Pct,
       {mean_of("Billed_Amount")} AS Avg_Billed, {score()} AS Avg_Risk_Score
FROM fa GROUP BY Flag_Weekend""",
    "q03e_all_flag_claims": f"""
SELECT Claim_ID, fa.Provider_ID, fa.Provider_Name, fa.Specialty, Patient_ID, Claim_Date,
       Fraud_Type, Billed_Amount AS Billed, Paid_Amount AS Paid, Fraud_Risk_Score, Claim_Status,
       Is_Fraudulent, License_Valid
FROM fa JOIN pr ON fa.Provider_ID = pr.Provider_ID
WHERE {FLAG_SUM} = 5""",
    "q03f_active_flags": f"""
SELECT {FLAG_SUM} AS Active_Flags, COUNT(*) AS Claims, {FRAUD} AS Fraud_Claims,
       {RATE} AS Fraud_Rate_Pct, {score()} AS Avg_Risk_Score,
       {mean_of("Billed_Amount")} AS Avg_Billed
FROM fa GROUP BY 1""",
}

PROVIDER = "fa.Provider_ID, fa.Provider_Name, fa.Specialty, fa.Provider_State"
RISKIEST = (
    "Fraud_Rate_Pct DESC, Avg_Risk_Score DESC, ps.Provider_ID, ps.Provider_Name,"
    " ps.Specialty, Provider_State"
)

PROVIDER_SCORES = f""", ps AS (
SELECT {PROVIDER}, COUNT(*) AS Total_Claims, {FRAUD} AS Fraud_Claims, {RATE} AS Fraud_Rate_Pct,
       {score()} AS Avg_Risk_Score, {thousands(CENTS_BILLED)} AS Billed_K,
       {big("SUM(Flag_UnitMismatch)")} AS Unit_Mismatches, {big("SUM(Flag_Duplicate)")} AS Dup_Flags,
       {big("SUM(Flag_Weekend)")} AS Weekend_Claims
FROM fa GROUP BY {PROVIDER})"""

PROVIDERS = {
    "q04a_provider_scorecard": f""", ps AS (
SELECT {PROVIDER}, COUNT(*) AS Total_Claims, COUNT(DISTINCT Patient_ID) AS Unique_Patients,
       {FRAUD} AS Fraud_Claims, {RATE} AS Fraud_Rate_Pct,
       {thousands(CENTS_BILLED)} AS Total_Billed_K, {thousands(CENTS_PAID)} AS Total_Paid_K,
       {mean_of("Billed_Amount")} AS Avg_Claim_Value, {score()} AS Avg_Risk_Score,
       {big("SUM(Flag_HighValue)")} AS HighValue_Flags, {big("SUM(Flag_Weekend)")} AS Weekend_Claims,
       {big("SUM(Flag_UnitMismatch)")} AS Unit_Mismatches,
       {big("SUM(Flag_Duplicate)")} AS Duplicate_Flags,
       {big("SUM(Flag_SameDay_Volume)")} AS SameDay_Flags,
       {hu("COUNT(*)", "COUNT(DISTINCT Patient_ID)", 2)} AS Claims_Per_Patient,
       {hu("COUNT(*) FILTER (Claim_Status = 'Denied')", "COUNT(*)", 12, 18)} AS Denial_Rate
FROM fa GROUP BY {PROVIDER})
SELECT ps.*, Is_Fraudulent, License_Valid, Years_Practice, Network_Status,
       CASE WHEN Fraud_Rate_Pct >= 80 THEN 'CRITICAL' WHEN Fraud_Rate_Pct >= 50 THEN 'HIGH'
            WHEN Fraud_Rate_Pct >= 25 THEN 'MODERATE' WHEN Fraud_Rate_Pct >= 10 THEN 'LOW'
            ELSE 'CLEAN' END AS Risk_Band,
       RANK() OVER (ORDER BY Fraud_Rate_Pct DESC, Avg_Risk_Score DESC) AS Risk_Rank
FROM ps JOIN pr ON ps.Provider_ID = pr.Provider_ID""",
    "q04b_hit_list": f"""{PROVIDER_SCORES}
SELECT CAST(ROW_NUMBER() OVER (ORDER BY {RISKIEST}) AS INTEGER) AS Rank,
       ps.*, Is_Fraudulent, License_Valid, Years_Practice,
       CASE WHEN Is_Fraudulent = 1 AND License_Valid = 1 THEN 'REVOKE LICENSE + AUDIT'
            WHEN Fraud_Rate_Pct >= 80 THEN 'IMMEDIATE INVESTIGATION'
            ELSE 'PRIORITY AUDIT' END AS Recommended_Action
FROM ps JOIN pr ON ps.Provider_ID = pr.Provider_ID
QUALIFY Rank <= 20""",
    "q04c_licensed_fraudulent": f"""
SELECT pr.*  EXCLUDE (Is_Fraudulent, License_Valid), COUNT(Claim_ID) AS Total_Claims,
       {FRAUD} AS Fraud_Claims, {RATE} AS Fraud_Rate_Pct, {thousands(CENTS_BILLED)} AS Billed_K
FROM pr JOIN fa ON pr.Provider_ID = fa.Provider_ID
WHERE Is_Fraudulent = 1 AND License_Valid = 1
GROUP BY ALL""",
    "q04d_out_of_network": f"""
SELECT pr.Provider_ID, pr.Provider_Name, pr.Specialty, pr.State, COUNT(Claim_ID) AS Total_Claims,
       {RATE} AS Fraud_Rate_Pct, {thousands(CENTS_BILLED)} AS Billed_K, Is_Fraudulent, License_Valid
FROM pr JOIN fa ON pr.Provider_ID = fa.Provider_ID
WHERE pr.Network_Status = 'Out-of-Network'
GROUP BY pr.Provider_ID, pr.Provider_Name, pr.Specialty, pr.State, Is_Fraudulent, License_Valid
HAVING AVG(Fraud_Label) > 0.30""",
    "q04e_provider_trend": f""", y AS (
SELECT Provider_ID, Provider_Name, Specialty, Claim_Year, COUNT(*) AS Claims, {RATE} AS Fraud_Rate_Pct
FROM fa WHERE Claim_Year >= 2021 GROUP BY Provider_ID, Provider_Name, Specialty, Claim_Year
HAVING SUM(Fraud_Label) * 20000 >= COUNT(*)),
t AS (SELECT *, LAG(Fraud_Rate_Pct) OVER (PARTITION BY Provider_ID ORDER BY Claim_Year)
        AS Prev_Year_Rate FROM y)
SELECT *, CAST(CASE WHEN Prev_Year_Rate IS NULL THEN 0 ELSE Fraud_Rate_Pct - Prev_Year_Rate END
               AS DECIMAL(12,2)) AS YoY_Change_PP
FROM t ORDER BY YoY_Change_PP DESC, Provider_ID, Claim_Year, Provider_Name, Specialty LIMIT 30""",
    "q04f_claims_per_patient": f"""
SELECT {PROVIDER}, COUNT(DISTINCT Patient_ID) AS Unique_Patients, COUNT(*) AS Total_Claims,
       {hu("COUNT(*)", "COUNT(DISTINCT Patient_ID)", 2)} AS Claims_Per_Patient,
       {RATE} AS Fraud_Rate_Pct
FROM fa GROUP BY {PROVIDER}
ORDER BY Claims_Per_Patient DESC, {PROVIDER} LIMIT 30""",
}

GEOGRAPHY = {
    "q05a_state_leaderboard": f"""
SELECT Provider_State AS State, COUNT(*) AS Total_Claims, {FRAUD} AS Fraud_Claims,
       {RATE} AS Fraud_Rate_Pct, {millions(CENTS_BILLED)} AS Billed_M,
       {millions(CENTS_PAID)} AS Paid_M, {score()} AS Avg_Risk_Score,
       CAST(RANK() OVER (ORDER BY AVG(Fraud_Label) DESC) AS INTEGER) AS Fraud_Rate_Rank,
       CAST(RANK() OVER (ORDER BY SUM(Fraud_Label) DESC) AS INTEGER) AS Volume_Rank
FROM fa GROUP BY Provider_State""",
    "q05b_above_average_states": f""", nat AS (
SELECT CAST(SUM(Fraud_Label) AS HUGEINT) AS k, CAST(COUNT(*) AS HUGEINT) AS n FROM fa), st AS (
SELECT Provider_State, CAST(SUM(Fraud_Label) AS HUGEINT) AS ks, CAST(COUNT(*) AS HUGEINT) AS ns
FROM fa GROUP BY Provider_State)
SELECT Provider_State, {hu("ks * 100", "ns", 2)} AS State_Fraud_Pct,
       {hu("k * 100", "n", 2)} AS National_Avg_Pct,
       {hu("(ks * n - k * ns) * 100", "(ns * n)", 2)} AS Above_National_PP,
       {big("ns")} AS Claims, {big("ks")} AS Fraud_Claims
FROM st, nat WHERE ks * n > k * ns""",
    "q05c_cross_state": f"""
SELECT Provider_State, Patient_State, COUNT(*) AS Claims, {FRAUD} AS Fraud_Claims,
       {RATE} AS Fraud_Rate_Pct, {thousands(CENTS_BILLED)} AS Billed_K
FROM fa WHERE Provider_State <> Patient_State
GROUP BY Provider_State, Patient_State HAVING COUNT(*) > 30""",
    "q05d_high_volume_states": f"""
SELECT Provider_State, COUNT(*) AS Total_Claims, {FRAUD} AS Fraud_Claims, {RATE} AS Fraud_Rate_Pct,
       {millions(CENTS_BILLED)} AS Billed_M
FROM fa GROUP BY Provider_State HAVING COUNT(*) > 400 AND AVG(Fraud_Label) > 0.35""",
}

TIME = {
    "q06a_yearly_trend": f""", y AS (
SELECT Claim_Year, COUNT(*) AS Claims, {FRAUD} AS Fraud_Claims, {RATE} AS Fraud_Rate_Pct,
       {millions(CENTS_BILLED)} AS Billed_M, {millions(CENTS_FRAUD_PAID)} AS Fraud_Paid_M,
       {mean_of("Billed_Amount")} AS Avg_Claim_Value
FROM fa WHERE Claim_Year >= 2021 GROUP BY Claim_Year), t AS (
SELECT *, LAG(Fraud_Rate_Pct) OVER (ORDER BY Claim_Year) AS Prev_Fraud_Rate_Pct,
       CAST(Fraud_Paid_M * 1000 AS BIGINT) AS m,
       CAST(LAG(Fraud_Paid_M) OVER (ORDER BY Claim_Year) * 1000 AS BIGINT) AS p
FROM y)
SELECT * EXCLUDE (m, p),
       CAST(COALESCE(Fraud_Rate_Pct - Prev_Fraud_Rate_Pct, 0) AS DECIMAL(12,2))
         AS YoY_Fraud_Change_PP,
       {signed_hu("(m - p) * 100", "NULLIF(p, 0)", 1, 18)} AS Fraud_Paid_Growth_Pct
FROM t""",
    "q06b_quarterly_trend": f"""
SELECT Claim_Year, Claim_Quarter, COUNT(*) AS Claims, {FRAUD} AS Fraud_Claims,
       {RATE} AS Fraud_Rate_Pct, {millions(CENTS_BILLED)} AS Billed_M, {score()} AS Avg_Risk
FROM fa WHERE Claim_Year >= 2021 GROUP BY Claim_Year, Claim_Quarter""",
    "q06c_monthly_pattern": f"""
SELECT Claim_Month, COUNT(*) AS Claims, {FRAUD} AS Fraud_Claims, {RATE} AS Fraud_Rate_Pct,
       {mean_of("Billed_Amount")} AS Avg_Billed, {big("SUM(Flag_HighValue)")} AS HighValue_Flags
FROM fa GROUP BY Claim_Month""",
    "q06d_rolling_quarters": f""", q AS (
SELECT Claim_Year, Claim_Quarter, COUNT(*) AS Claims, {RATE} AS Fraud_Rate
FROM fa WHERE Claim_Year >= 2021 GROUP BY Claim_Year, Claim_Quarter), t AS (
SELECT *, SUM(CAST(Fraud_Rate * 100 AS BIGINT)) OVER w AS s, COUNT(*) OVER w AS n
FROM q WINDOW w AS (ORDER BY Claim_Year, Claim_Quarter ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT Claim_Year, Claim_Quarter, Claims, Fraud_Rate, {hu("s", "n * 100", 2)} AS Rolling_4Q_Avg
FROM t""",
    "q06e_volume_spikes": f""", counted AS (
SELECT Provider_ID, Claim_Year, COUNT(*) AS n FROM fa GROUP BY ALL), stepped AS (
SELECT Provider_ID, n, LAG(n) OVER p AS prior, Claim_Year - LAG(Claim_Year) OVER p AS step
FROM counted WHERE Claim_Year BETWEEN 2022 AND 2024
WINDOW p AS (PARTITION BY Provider_ID ORDER BY Claim_Year)), rated AS (
SELECT Provider_ID, Provider_Name, Specialty, {RATE} AS Overall_Fraud_Rate_Pct
FROM fa GROUP BY Provider_ID, Provider_Name, Specialty)
SELECT DISTINCT Provider_ID, Provider_Name, Specialty, prior AS Prior_Year_Claims,
       n AS Current_Year_Claims, {hu("(n - prior) * 100", "prior", 1, 18)} AS Volume_Growth_Pct,
       Overall_Fraud_Rate_Pct
FROM stepped JOIN rated USING (Provider_ID) WHERE step = 1 AND n > 2 * prior
ORDER BY Volume_Growth_Pct DESC, Provider_ID, Provider_Name, Specialty, Prior_Year_Claims,
         Current_Year_Claims LIMIT 20""",
}

STATEMENTS = {**AUDIT, **DASHBOARD, **PATTERNS, **PROVIDERS, **GEOGRAPHY, **TIME}
