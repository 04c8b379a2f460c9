"""Tables with deterministic defects, made of the test tables by SQL that Spark and DuckDB both read.

{name} stands for a test table. Defects follow from keys, so both engines make the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST = "raj,anna,liam,maria,wei,sofia,omar,ines,noah,priya,ivan,lucia,yuki,ahmed,clara,peter"
LAST = "sharma,mueller,smith,garcia,chen,rossi,hassan,silva,brown,patel,petrov,lopez,tanaka,khan,weber,novak,dubois,jensen,kowalski,oconnor"
CITIES = "delhi,berlin,london,madrid,shanghai,rome,cairo,lisbon,boston,mumbai,moscow,bogota"

PEOPLE = f"""
SELECT c_custkey * 2 + copy AS record_id,
  CASE WHEN copy = 1 AND c_custkey % 17 = 0 THEN NULL WHEN copy = 1 AND v = 1 THEN substr(name, 1, 2) || substr(name, 4, 1) || substr(name, 3, 1) || substr(name, 5)
    WHEN copy = 1 AND v = 2 THEN '  ' || upper(name) || ' ' WHEN c_custkey % 41 = 0 THEN 'Test User' ELSE name END AS full_name,
  CASE WHEN c_custkey % 13 = 0 THEN 'nomail' WHEN copy = 1 AND v = 4 THEN 'new' || CAST(c_custkey AS STRING) || '@mail.org' WHEN c_custkey % 7 = 0 THEN 'User' || CAST(c_custkey AS STRING) || ' at Mail.com'
    WHEN c_custkey % 11 = 0 THEN 'user' || CAST(c_custkey AS STRING) || '.at.mail.com' WHEN c_custkey % 29 = 0 THEN '' ELSE 'User' || CAST(c_custkey AS STRING) || '@Mail.com ' END AS email,
  CASE WHEN copy = 1 AND v = 3 THEN 'N/A' WHEN c_custkey % 23 = 0 THEN '9999999999' WHEN c_custkey % 3 = 0 THEN '+91-' || '98' || lpad(CAST(c_custkey AS STRING), 8, '0')
    WHEN c_custkey % 5 = 0 THEN '1 (555) ' || lpad(CAST(c_custkey % 10000000 AS STRING), 7, '0') ELSE '98' || lpad(CAST(c_custkey AS STRING), 8, '0') END AS phone,
  CASE WHEN c_custkey % 19 = 0 THEN 'unknown' ELSE split_part('{CITIES}', ',', CAST(c_custkey % 12 AS INT) + 1) END AS city,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'ABC' || substr('QRSTUVWXYZ', CAST(floor(c_custkey / 10000) AS INT) % 10 + 1, 1) || 'P' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || 'K' END AS pan,
  CASE WHEN c_custkey % 31 = 0 THEN -1 WHEN c_custkey % 37 = 0 THEN 400 ELSE CAST(20 + c_custkey % 60 AS INT) END AS age,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS salary,
  CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) WHEN c_custkey % 3 = 1 THEN lower(c_mktsegment) ELSE ' ' || c_mktsegment END AS segment,
  CASE WHEN c_custkey % 2 = 0 THEN 'yes' WHEN c_custkey % 3 = 0 THEN 'F' WHEN c_custkey % 5 = 0 THEN 'maybe' ELSE 'on' END AS active,
  CASE WHEN c_custkey % 10 = 0 THEN 'x' END AS mostly_empty
FROM (SELECT *, split_part('{FIRST}', ',', CAST(c_custkey % 16 AS INT) + 1) || ' ' || substr('abcdefghijklmnopqrstuvwxyz', CAST(floor(c_custkey / 320) AS INT) % 26 + 1, 1) || ' '
    || split_part('{LAST}', ',', CAST(floor(c_custkey / 16) AS INT) % 20 + 1) AS name, c_custkey % 6 AS v
  FROM (SELECT *, 0 AS copy FROM {{customer}} UNION ALL SELECT *, 1 AS copy FROM {{customer}}) a) b
"""

SALES = """
SELECT o_orderkey, o_custkey, o_totalprice AS total_amount, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS gap_amount, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 3 = 0 THEN 'B2B ' WHEN o_orderkey % 3 = 1 THEN 'b2c' ELSE 'retail' END AS customer_type,
  CASE WHEN o_orderkey % 5 = 0 THEN '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) WHEN o_orderkey % 5 = 1 THEN '€ ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '.50'
    WHEN o_orderkey % 5 = 2 THEN '₹1,' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') WHEN o_orderkey % 5 = 3 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' USD'
    WHEN o_orderkey % 10 = 4 THEN 'about 5' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS price_text,
  CASE WHEN o_orderkey % 7 = 0 THEN '-' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) WHEN o_orderkey % 7 = 1 THEN '12d' WHEN o_orderkey % 7 = 2 THEN ' 1.5e3 ' WHEN o_orderkey % 7 = 3 THEN 'n/a' ELSE CAST(o_orderkey AS STRING) END AS cost_text,
  CAST(o_orderdate AS DATE) AS order_date,
  CAST(CASE WHEN o_orderkey % 8 = 0 THEN CAST(o_orderdate AS DATE) - INTERVAL '3' DAY ELSE CAST(o_orderdate AS DATE) + INTERVAL '4' DAY END AS DATE) AS delivery_date,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN o_orderkey % 4 = 1 THEN replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '/') WHEN o_orderkey % 4 = 2 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 10:20:30'
    ELSE 'soon' END AS date_text,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN ' ' ELSE 'Delivered' END AS delivery_status, CASE WHEN o_orderkey % 2 = 0 THEN 'T' || CAST(o_orderkey AS STRING) END AS tracking_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'DELIVERED' ELSE 'open' END AS order_status, CASE WHEN o_orderkey % 2 = 0 THEN 'Card' END AS payment_status,
  CASE WHEN o_orderkey IN (1, 2) THEN 'urgnt' WHEN o_orderkey % 11 = 0 THEN 'Urgent ' WHEN o_orderkey % 11 = 1 THEN 'HIGH' ELSE 'high' END AS urgency
FROM {orders}
"""

MEASURES = """
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_orderkey % 50 = 0 THEN -l_quantity ELSE l_quantity END AS DOUBLE) AS quantity, l_extendedprice AS price, l_discount * 1500 - 5 AS discount, l_tax AS tax_rate,
  CAST(l_quantity * 3 - 5 AS DOUBLE) AS score, l_quantity / 10 AS rating, l_quantity * 2 - 4 AS bmi, CASE WHEN l_orderkey % 97 = 0 THEN -999.0 ELSE l_extendedprice / 10 END AS metric,
  CAST(l_quantity * 4 AS DOUBLE) AS age, l_quantity * 6 AS blood_pressure, l_quantity - 5 AS salary, l_quantity / 4 - 1 AS gpa, l_quantity * 3 - 20 AS marks, l_quantity - 8 AS yield_kg, l_quantity - 9 AS call_duration,
  l_quantity - 20 AS profit_amount
FROM {lineitem}
"""

TABLES = {"people": PEOPLE, "sales": SALES, "measures": MEASURES}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of TABLES, or a test table as it is."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = TABLES[name]
    for t in ("customer", "orders", "lineitem"):
        sql = sql.replace("{" + t + "}", f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(sql)


def with_tables(*names: str) -> str:
    """WITH clause for DuckDB."""
    parts = []
    for n in names:
        sql = TABLES[n]
        for t in ("customer", "orders", "lineitem"):
            sql = sql.replace("{" + t + "}", t)
        parts.append(f"{n} AS ({sql})")
    return "WITH " + ", ".join(parts)
