"""Declared schemas of the two tables every analysis reads.

Flags are 0/1 integers rather than booleans: under ANSI mode ``flag = 1`` and
``sum(flag)`` do not accept booleans, and the analyses use both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)

CLAIMS = T.StructType(
    [
        T.StructField("Claim_ID", T.LongType()),
        T.StructField("Provider_ID", T.LongType()),
        T.StructField("Provider_Name", T.StringType()),
        T.StructField("Specialty", T.StringType()),
        T.StructField("Provider_State", T.StringType()),
        T.StructField("Network_Status", T.StringType()),
        T.StructField("Patient_ID", T.LongType()),
        T.StructField("Patient_Age", T.IntegerType()),
        T.StructField("Patient_Gender", T.StringType()),
        T.StructField("Patient_State", T.StringType()),
        T.StructField("Insurer", T.StringType()),
        T.StructField("CPT_Code", T.StringType()),
        T.StructField("CPT_Description", T.StringType()),
        T.StructField("Claim_Date", T.DateType()),
        T.StructField("Claim_Year", T.IntegerType()),
        T.StructField("Claim_Quarter", T.StringType()),
        T.StructField("Claim_Month", T.StringType()),
        T.StructField("Claim_Status", T.StringType()),
        T.StructField("Fraud_Label", T.IntegerType()),
        T.StructField("Fraud_Type", T.StringType()),
        T.StructField("Fraud_Risk_Score", T.IntegerType()),
        T.StructField("Units_Billed", T.IntegerType()),
        T.StructField("Units_Rendered", T.IntegerType()),
        T.StructField("Billed_Amount", MONEY),
        T.StructField("Allowed_Amount", MONEY),
        T.StructField("Paid_Amount", MONEY),
        T.StructField("Flag_HighValue", T.IntegerType()),
        T.StructField("Flag_Weekend", T.IntegerType()),
        T.StructField("Flag_SameDay_Volume", T.IntegerType()),
        T.StructField("Flag_UnitMismatch", T.IntegerType()),
        T.StructField("Flag_Duplicate", T.IntegerType()),
    ]
)

REGISTRY = T.StructType(
    [
        T.StructField("Provider_ID", T.LongType()),
        T.StructField("Provider_Name", T.StringType()),
        T.StructField("Specialty", T.StringType()),
        T.StructField("State", T.StringType()),
        T.StructField("Years_Practice", T.IntegerType()),
        T.StructField("Network_Status", T.StringType()),
        T.StructField("Is_Fraudulent", T.IntegerType()),
        T.StructField("License_Valid", T.IntegerType()),
    ]
)

FLAGS = [
    "Flag_HighValue",
    "Flag_Weekend",
    "Flag_SameDay_Volume",
    "Flag_UnitMismatch",
    "Flag_Duplicate",
]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast the declared columns; a source's booleans become 0/1 integers."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
