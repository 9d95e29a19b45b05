"""Claims and registry derived row by row from the order tables (see FIXTURES.md).

Join order matters at scale: orders, customer and nation are joined first, on
four narrow columns, so that line items are shuffled once (on the order key)
and not a second time on the customer key. Tables are joined one by one rather
than as joined pairs, because the size of a file is known to the optimizer and
the size of a join is not; only a known small side is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimhound.sources.schema import CLAIMS, REGISTRY, conform

SOURCE_TABLES = ["lineitem", "orders", "customer", "supplier", "nation"]

_NETWORK = "CASE WHEN {k} % 3 = 0 THEN 'Out-of-Network' ELSE 'In-Network' END"


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _spread(joined: DataFrame, lines: DataFrame) -> DataFrame:
    """Use every core on line items that come in fewer splits than there are cores.

    A table of cluster size has far more splits than that, keeps the
    partitioning of its joins and is not shuffled again.
    """
    cores = lines.sparkSession.sparkContext.defaultParallelism
    if lines.rdd.getNumPartitions() >= cores:
        return joined
    return joined.repartition(cores, "l_orderkey", "l_linenumber")


def derive_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = _table(spark, sf_dir, "supplier").filter("s_suppkey % 50 <> 9")
    nation = _table(spark, sf_dir, "nation")
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "s_suppkey AS Provider_ID",
        "s_name AS Provider_Name",
        "concat('SPEC_', CAST(s_suppkey % 8 AS STRING)) AS Specialty",
        "CASE WHEN s_suppkey % 33 = 32 THEN NULL ELSE n_name END AS State",
        "CAST((s_suppkey * 7) % 31 AS INT) AS Years_Practice",
        _NETWORK.format(k="s_suppkey") + " AS Network_Status",
        "CAST(s_suppkey % 10 = 3 AS INT) AS Is_Fraudulent",
        "CAST(s_suppkey % 4 <> 1 AS INT) AS License_Valid",
    )
    return conform(rows, REGISTRY)


def derive_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    patient_nation = nation.selectExpr("n_nationkey AS p_nation", "n_name AS Patient_State")
    provider_nation = nation.selectExpr("n_nationkey AS s_nation", "n_name AS Provider_State")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    visits = (
        _table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderpriority")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(patient_nation, F.col("c_nationkey") == F.col("p_nation"))
        .drop("c_custkey", "c_nationkey", "p_nation")
    )
    lines = _table(spark, sf_dir, "lineitem")
    joined = (
        lines.join(visits, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(provider_nation, F.col("s_nationkey") == F.col("s_nation"))
    )
    return conform(_claim_columns(_spread(joined, lines)), CLAIMS)


def _claim_columns(joined: DataFrame) -> DataFrame:
    """The mapping of FIXTURES.md, in four steps because later columns use earlier ones."""
    return (
        joined.selectExpr(
            "*",
            "(l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 100 AS h",
            "CASE WHEN l_suppkey % 10 = 3 THEN 85 WHEN l_suppkey % 8 = 5 THEN 58"
            " WHEN l_suppkey % 10 = 6 THEN 45 ELSE 8 END AS thr",
            "datediff(CAST(l_shipdate AS DATE), DATE'1995-01-01') % 1462 AS off0",
        )
        .selectExpr(
            "*",
            "CAST(h < thr AS INT) AS Fraud_Label",
            "date_add(DATE'2020-12-31', CAST(CASE"
            " WHEN l_suppkey % 10 = 3 THEN off0 - off0 % 30"
            " WHEN l_suppkey % 10 = 7 AND off0 < 731 AND l_orderkey % 3 <> 0 THEN off0 + 731"
            " ELSE off0 END AS INT)) AS Claim_Date",
            "CAST(l_quantity AS INT) AS Units_Billed",
            "CASE l_returnflag WHEN 'A' THEN 'Approved' WHEN 'R' THEN 'Denied'"
            " ELSE 'Pending' END AS Claim_Status",
        )
        .selectExpr(
            "*",
            "CASE WHEN (l_orderkey + l_partkey) % 12 = 0"
            " THEN greatest(Units_Billed - 1 - CAST(l_partkey % 3 AS INT), 0)"
            " WHEN (l_orderkey + l_partkey) % 37 = 1 THEN Units_Billed + 1"
            " ELSE Units_Billed END AS Units_Rendered",
            "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) *"
            " CASE WHEN Fraud_Label = 1 AND l_partkey % 6 = 0"
            " THEN CAST(0.60 AS DECIMAL(3,2)) ELSE CAST(0.15 AS DECIMAL(3,2)) END"
            " AS DECIMAL(12,2)) AS Billed_Amount",
        )
        .selectExpr(
            "*",
            "CAST(Billed_Amount * (CAST(1.00 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2)))"
            " AS DECIMAL(12,2)) AS Allowed_Amount",
        )
        .selectExpr(
            "(l_orderkey * 10 + l_linenumber) * 100 + l_partkey % 100 AS Claim_ID",
            "l_suppkey AS Provider_ID",
            "s_name AS Provider_Name",
            "concat('SPEC_', CAST(l_suppkey % 8 AS STRING)) AS Specialty",
            "Provider_State",
            _NETWORK.format(k="l_suppkey") + " AS Network_Status",
            "o_custkey AS Patient_ID",
            "CAST(1 + (o_custkey * 37) % 95 AS INT) AS Patient_Age",
            "CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS Patient_Gender",
            "Patient_State",
            "o_orderpriority AS Insurer",
            "concat('CPT', CAST(l_partkey % 20 AS STRING)) AS CPT_Code",
            "concat('Procedure ', CAST(l_partkey % 20 AS STRING)) AS CPT_Description",
            "Claim_Date",
            "year(Claim_Date) AS Claim_Year",
            "concat('Q', CAST(quarter(Claim_Date) AS STRING)) AS Claim_Quarter",
            "date_format(Claim_Date, 'MMM') AS Claim_Month",
            "Claim_Status",
            "Fraud_Label",
            "CASE WHEN Fraud_Label = 0 THEN NULL"
            " WHEN l_partkey % 6 = 0 THEN 'Upcoding'"
            " WHEN l_partkey % 6 = 1 THEN 'Unbundling'"
            " WHEN l_partkey % 6 = 2 THEN 'Phantom Billing'"
            " WHEN l_partkey % 6 = 3 THEN 'Duplicate Claim'"
            " WHEN l_partkey % 6 = 4 THEN 'Medical Identity Theft'"
            " ELSE 'Kickback - Referral' END AS Fraud_Type",
            "CAST(CASE WHEN Fraud_Label = 1 THEN 40 + (h * 3) % 60 ELSE (h * 11) % 55 END AS INT)"
            " AS Fraud_Risk_Score",
            "Units_Billed",
            "Units_Rendered",
            "Billed_Amount",
            "Allowed_Amount",
            "CASE WHEN l_orderkey % 997 = 0 THEN NULL WHEN Claim_Status = 'Denied' THEN 0"
            " ELSE CAST(Allowed_Amount * (CAST(1.00 AS DECIMAL(3,2)) + CAST(l_tax AS DECIMAL(3,2)))"
            " AS DECIMAL(12,2)) END AS Paid_Amount",
            "CAST(Billed_Amount > 10000 AS INT) AS Flag_HighValue",
            "CAST(weekday(Claim_Date) >= 5 AS INT) AS Flag_Weekend",
            "CAST((l_orderkey + l_suppkey) % 4 = 0 OR l_suppkey % 10 = 3 AS INT) AS Flag_SameDay_Volume",
            "CAST(Units_Billed <> Units_Rendered AND l_linenumber <> 7 AS INT) AS Flag_UnitMismatch",
            "CAST((l_orderkey * 3 + l_partkey) % 10 < 2 AS INT) AS Flag_Duplicate",
        )
    )
