"""Small hand-written claims and registries."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from claimhound.sources.schema import CLAIMS, REGISTRY

CLAIM = {
    "Claim_ID": 1,
    "Provider_ID": 1,
    "Provider_Name": "Clinic 1",
    "Specialty": "Cardiology",
    "Provider_State": "TX",
    "Network_Status": "In-Network",
    "Patient_ID": 1,
    "Patient_Age": 40,
    "Patient_Gender": "F",
    "Patient_State": "TX",
    "Insurer": "Acme",
    "CPT_Code": "99213",
    "CPT_Description": "Visit",
    "Claim_Date": dt.date(2022, 3, 7),
    "Claim_Year": 2022,
    "Claim_Quarter": "Q1",
    "Claim_Month": "Mar",
    "Claim_Status": "Approved",
    "Fraud_Label": 0,
    "Fraud_Type": None,
    "Fraud_Risk_Score": 10,
    "Units_Billed": 1,
    "Units_Rendered": 1,
    "Billed_Amount": "100.00",
    "Allowed_Amount": "90.00",
    "Paid_Amount": "80.00",
    "Flag_HighValue": 0,
    "Flag_Weekend": 0,
    "Flag_SameDay_Volume": 0,
    "Flag_UnitMismatch": 0,
    "Flag_Duplicate": 0,
}
PROVIDER = {
    "Provider_ID": 1,
    "Provider_Name": "Clinic 1",
    "Specialty": "Cardiology",
    "State": "TX",
    "Years_Practice": 7,
    "Network_Status": "In-Network",
    "Is_Fraudulent": 0,
    "License_Valid": 1,
}
MONEY = ("Billed_Amount", "Allowed_Amount", "Paid_Amount")


def claims(spark: SparkSession, *changes: dict) -> DataFrame:
    rows = []
    for i, change in enumerate(changes):
        row = {**CLAIM, "Claim_ID": i + 1, **change}
        for m in MONEY:
            row[m] = None if row[m] is None else Decimal(row[m])
        rows.append(tuple(row[f.name] for f in CLAIMS))
    return spark.createDataFrame(rows, CLAIMS)


def registry(spark: SparkSession, *changes: dict) -> DataFrame:
    rows = [tuple({**PROVIDER, **c}[f.name] for f in REGISTRY) for c in changes]
    return spark.createDataFrame(rows, REGISTRY)


def values(df: DataFrame, *names: str) -> list[tuple]:
    return [tuple(r[n] for n in names) for r in df.collect()]
