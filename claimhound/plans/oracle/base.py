"""The two tables as CTEs and the exact rounding the statements share."""

from __future__ import annotations

TABLES = """
WITH step0 AS (
  SELECT l.*, o.o_custkey, o.o_orderpriority, s.s_name,
         sn.n_name AS provider_nation, cn.n_name AS patient_nation,
         (l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 100 AS h,
         CASE WHEN l_suppkey % 10 = 3 THEN 85 WHEN l_suppkey % 8 = 5 THEN 58
              WHEN l_suppkey % 10 = 6 THEN 45 ELSE 8 END AS thr,
         date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 1462 AS off0
  FROM lineitem l
  JOIN orders o ON l_orderkey = o_orderkey
  JOIN supplier s ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN customer c ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey
), step1 AS (
  SELECT *,
         CAST(h < thr AS INTEGER) AS fraud,
         DATE '2020-12-31' + CAST(CASE WHEN l_suppkey % 10 = 3 THEN off0 - off0 % 30
           WHEN l_suppkey % 10 = 7 AND off0 < 731 AND l_orderkey % 3 <> 0 THEN off0 + 731
           ELSE off0 END AS INTEGER) AS claim_day,
         CAST(l_quantity AS INTEGER) AS ub
  FROM step0
), step2 AS (
  SELECT *,
         CASE WHEN (l_orderkey + l_partkey) % 12 = 0
                THEN GREATEST(ub - 1 - CAST(l_partkey % 3 AS INTEGER), 0)
              WHEN (l_orderkey + l_partkey) % 37 = 1 THEN ub + 1 ELSE ub END AS ur,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2))
              * CASE WHEN fraud = 1 AND l_partkey % 6 = 0 THEN CAST(0.60 AS DECIMAL(3,2))
                     ELSE CAST(0.15 AS DECIMAL(3,2)) END AS DECIMAL(12,2)) AS billed
  FROM step1
), step3 AS (
  SELECT *, CAST(billed * (CAST(1.00 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2)))
                 AS DECIMAL(12,2)) AS allowed
  FROM step2
), fa AS MATERIALIZED (
  SELECT CAST((l_orderkey * 10 + l_linenumber) * 100 + l_partkey % 100 AS BIGINT) AS Claim_ID,
         CAST(l_suppkey AS BIGINT) AS Provider_ID,
         s_name AS Provider_Name,
         CONCAT('SPEC_', CAST(l_suppkey % 8 AS VARCHAR)) AS Specialty,
         provider_nation AS Provider_State,
         CASE WHEN l_suppkey % 3 = 0 THEN 'Out-of-Network' ELSE 'In-Network' END AS Network_Status,
         CAST(o_custkey AS BIGINT) AS Patient_ID,
         CAST(1 + (o_custkey * 37) % 95 AS INTEGER) AS Patient_Age,
         CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS Patient_Gender,
         patient_nation AS Patient_State,
         o_orderpriority AS Insurer,
         CONCAT('CPT', CAST(l_partkey % 20 AS VARCHAR)) AS CPT_Code,
         CONCAT('Procedure ', CAST(l_partkey % 20 AS VARCHAR)) AS CPT_Description,
         claim_day AS Claim_Date,
         CAST(year(claim_day) AS INTEGER) AS Claim_Year,
         CONCAT('Q', CAST(quarter(claim_day) AS VARCHAR)) AS Claim_Quarter,
         strftime(claim_day, '%b') AS Claim_Month,
         CASE l_returnflag WHEN 'A' THEN 'Approved' WHEN 'R' THEN 'Denied'
              ELSE 'Pending' END AS Claim_Status,
         fraud AS Fraud_Label,
         CASE WHEN fraud = 0 THEN NULL
              WHEN l_partkey % 6 = 0 THEN 'Upcoding'
              WHEN l_partkey % 6 = 1 THEN 'Unbundling'
              WHEN l_partkey % 6 = 2 THEN 'Phantom Billing'
              WHEN l_partkey % 6 = 3 THEN 'Duplicate Claim'
              WHEN l_partkey % 6 = 4 THEN 'Medical Identity Theft'
              ELSE 'Kickback - Referral' END AS Fraud_Type,
         CAST(CASE WHEN fraud = 1 THEN 40 + (h * 3) % 60 ELSE (h * 11) % 55 END AS INTEGER)
           AS Fraud_Risk_Score,
         ub AS Units_Billed,
         CAST(ur AS INTEGER) AS Units_Rendered,
         billed AS Billed_Amount,
         allowed AS Allowed_Amount,
         CASE WHEN l_orderkey % 997 = 0 THEN NULL
              WHEN l_returnflag = 'R' THEN CAST(0 AS DECIMAL(12,2))
              ELSE CAST(allowed * (CAST(1.00 AS DECIMAL(3,2)) + CAST(l_tax AS DECIMAL(3,2)))
                        AS DECIMAL(12,2)) END AS Paid_Amount,
         CAST(billed > 10000 AS INTEGER) AS Flag_HighValue,
         CAST(isodow(claim_day) >= 6 AS INTEGER) AS Flag_Weekend,
         CAST((l_orderkey + l_suppkey) % 4 = 0 OR l_suppkey % 10 = 3 AS INTEGER)
           AS Flag_SameDay_Volume,
         CAST(ub <> ur AND l_linenumber <> 7 AS INTEGER) AS Flag_UnitMismatch,
         CAST((l_orderkey * 3 + l_partkey) % 10 < 2 AS INTEGER) AS Flag_Duplicate
  FROM step3
), pr AS (
  SELECT CAST(s_suppkey AS BIGINT) AS Provider_ID,
         s_name AS Provider_Name,
         CONCAT('SPEC_', CAST(s_suppkey % 8 AS VARCHAR)) AS Specialty,
         CASE WHEN s_suppkey % 33 = 32 THEN NULL ELSE n_name END AS State,
         CAST((s_suppkey * 7) % 31 AS INTEGER) AS Years_Practice,
         CASE WHEN s_suppkey % 3 = 0 THEN 'Out-of-Network' ELSE 'In-Network' END AS Network_Status,
         CAST(s_suppkey % 10 = 3 AS INTEGER) AS Is_Fraudulent,
         CAST(s_suppkey % 4 <> 1 AS INTEGER) AS License_Valid
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  WHERE s_suppkey % 50 <> 9
)"""


def statement(body: str) -> str:
    """A whole statement; a body that starts with a comma adds CTEs of its own."""
    return TABLES + (body if body.lstrip().startswith(",") else "\n" + body)


def hu(num: str, den: str, digits: int, precision: int = 12) -> str:
    """num / den rounded half up in whole numbers; num must not be negative."""
    scale = 10**digits
    n, d = f"CAST(({num}) * {scale} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    return f"CAST(CAST((2 * {n} + {d}) // (2 * {d}) AS DOUBLE) / {scale} AS DECIMAL({precision},{digits}))"


def signed_hu(num: str, den: str, digits: int, precision: int = 12) -> str:
    return (
        f"CAST(CASE WHEN ({num}) < 0 THEN -1 ELSE 1 END * "
        f"{hu(f'ABS({num})', den, digits, precision)} AS DECIMAL({precision},{digits}))"
    )


def cents(amount: str) -> str:
    return f"CAST({amount} * 100 AS BIGINT)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


CENTS_BILLED = f"SUM({cents('Billed_Amount')})"
CENTS_PAID = f"SUM({cents('Paid_Amount')})"
CENTS_ALLOWED = f"SUM({cents('Allowed_Amount')})"
CENTS_FRAUD_PAID = f"SUM(CASE WHEN Fraud_Label = 1 THEN {cents('Paid_Amount')} ELSE 0 END)"
FRAUD = big("SUM(Fraud_Label)")
RATE = hu("SUM(Fraud_Label) * 100", "COUNT(*)", 2)


def score(digits: int = 1) -> str:
    return hu("SUM(Fraud_Risk_Score)", "COUNT(Fraud_Risk_Score)", digits)


def thousands(total: str) -> str:
    return hu(total, "100000", 1, 24)


def millions(total: str) -> str:
    return hu(total, "100000000", 3, 24)


def mean_of(column: str) -> str:
    return hu(f"SUM({cents(column)})", f"COUNT({column}) * 100", 2)


def money(total: str) -> str:
    """Whole cents as an amount."""
    return hu(total, "100", 2, 24)
