"""Tables derived from the given ones, in SQL that Spark and DuckDB both run.

Spark fills ``{table}`` with a DataFrame, DuckDB gets the plain table name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from configsieve.sources.tables import dealt, read_table

BASE_TABLES = ("customer", "documents", "pages", "conversations", "events", "orders")
# Short rows that texts and answers are made of.
NARROW_TABLES = ("customer", "orders")

DERIVED = {
    # Short documents full of settings.
    "corpus": """
SELECT c_custkey AS doc_id, concat(
 CASE c_custkey % 5 WHEN 0 THEN 'Configuration Settings:' WHEN 1 THEN 'Database notes:'
   WHEN 2 THEN 'Service endpoint:' WHEN 3 THEN 'Auth policy' ELSE 'General remarks:' END, chr(10),
 'hostname = "', CASE WHEN c_custkey % 4 = 0 THEN 'localhost'
   ELSE concat('srv', CAST(c_custkey AS STRING)) END, '"', chr(10),
 'port = ', CAST(c_custkey % 9000 AS STRING), chr(10),
 'user = "', CASE WHEN c_custkey % 3 = 0 THEN 'test' ELSE lower(c_name) END, '"', chr(10),
 'conn_str = "Server=srv', CAST(c_nationkey AS STRING), ';Db=', lower(c_mktsegment), '"', chr(10),
 'timeout=', CAST(c_custkey % 120 AS STRING), chr(10),
 'log_path = /var/', lower(c_mktsegment), chr(10),
 'see https://ex.com/', CAST(c_custkey AS STRING), chr(10),
 '{{"tenantId":"t', CAST(c_custkey AS STRING), '","enableMonitoring":true}}', chr(10),
 'server:', chr(10), '  ip: 10.0.0.', CAST(c_custkey % 256 AS STRING), chr(10), '  uptime: 99', chr(10)) AS text
FROM {customer}""",
    # Whole prose documents with settings before and after the text.
    "notes": """
SELECT doc_id, concat(
 CASE doc_id % 4 WHEN 0 THEN 'Configuration Settings:' WHEN 1 THEN 'Database notes:'
   WHEN 2 THEN 'Service endpoint:' ELSE 'Remarks' END, chr(10),
 'source_path = /data/', source, '/', lang, chr(10), text, chr(10), chr(10),
 'option lang = ', lang, chr(10), 'timeout=', CAST(n_chars AS STRING), chr(10),
 '{{"doc":', CAST(doc_id AS STRING), ',"lang":"', lang, '"}}', chr(10)) AS text
FROM {documents}""",
    # Four string leaves per customer on one path.
    "fragments": """
SELECT c_custkey AS doc_id, k AS ord, 'server.host' AS path,
 CASE (c_custkey*7 + k*5) % 6 WHEN 0 THEN NULL WHEN 1 THEN 'localhost' WHEN 2 THEN ''
   WHEN 3 THEN 'db' WHEN 4 THEN 'db.example.org'
   ELSE concat('h', CAST(c_custkey % 100 AS STRING)) END AS value
FROM {customer} LATERAL_NUMBERS""",
    # Four JSON answers per customer; /server is an object, a string, null or absent.
    "answers": """
SELECT c_custkey AS doc_id, k AS chunk_id, CASE WHEN (c_custkey + k) % 11 = 0 THEN 'no configuration found'
 ELSE concat('{{"tenantId":"t', CAST((c_custkey + k) % 3 AS STRING), repeat('x', CAST((c_custkey * k) % 4 AS INT)), '",',
  CASE (c_custkey*5 + k*3) % 7 WHEN 0 THEN '"server":"none",' WHEN 1 THEN '"server":null,' WHEN 2 THEN ''
    WHEN 3 THEN '"server":{{}},' WHEN 4 THEN '"server":"localhost",'
    ELSE concat('"server":{{"host":', CASE (c_custkey + k*5) % 4 WHEN 0 THEN '"localhost"' WHEN 1 THEN 'null'
      WHEN 2 THEN '"db"' ELSE '"db.example.org"' END,
      ',"port":', CAST((c_custkey * k) % 5 AS STRING), '}},') END,
  '"enableMonitoring":', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END, '}}') END AS response
FROM {customer} LATERAL_NUMBERS""",
    # Four answers per customer: objects, some of 1,000, 1,500 or 100,000 levels, some missing, some no JSON.
    "odd_answers": """
SELECT c_custkey AS doc_id, k AS chunk_id, CASE WHEN (c_custkey + k) % 13 = 0 THEN NULL
 WHEN (c_custkey * 3 + k) % 7 = 0 THEN 'no configuration found' WHEN c_custkey % 97 = 0 AND k = 1
  THEN concat(repeat('{{"a":', CAST(CASE c_custkey % 3 WHEN 0 THEN 100000 WHEN 1 THEN 1500 ELSE 1000 END AS INT)), '1',
   repeat('}}', CAST(CASE c_custkey % 3 WHEN 0 THEN 100000 WHEN 1 THEN 1500 ELSE 1000 END AS INT)))
 ELSE concat('{{"k":"v', CAST(k AS STRING), '"}}') END AS response
FROM {customer} LATERAL_NUMBERS""",
    # Configurations with seeded faults.
    "configs": """
SELECT c_custkey AS cfg_id, concat('{{',
 CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat('"tenantId":', CASE WHEN c_custkey % 11 = 0 THEN '17'
   WHEN c_custkey % 13 = 0 THEN 'null' ELSE concat('"t', CAST(c_custkey AS STRING), '"') END, ',') END,
 '"enableMonitoring":', CASE WHEN c_custkey % 5 = 0 THEN '"yes"' ELSE 'true' END,
 ',"interfacesInScope":', CASE WHEN c_custkey % 9 = 0 THEN '["a",1]' WHEN c_custkey % 10 = 0 THEN '{{}}'
   ELSE '["a","b"]' END,
 ',"port":', CAST(c_custkey * 50 AS STRING), '}}') AS config
FROM {customer}""",
    # Flat database rows, some with a bad port, a bad type or a foreign key.
    "database_rows": """
SELECT o_orderkey AS row_id, concat('{{"host":', CASE WHEN o_orderkey % 10 = 0 THEN '7' WHEN o_orderkey % 6 = 0 THEN 'null'
   ELSE '"db"' END, ',"port":', CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey * 9 AS STRING)
   WHEN 1 THEN concat('"', CAST(o_orderkey % 70000 AS STRING), '"') WHEN 2 THEN '"x"' WHEN 3 THEN '5432.0' ELSE 'true' END,
 CASE WHEN o_orderkey % 8 = 0 THEN ',"schema":"s"' ELSE '' END, '}}') AS row
FROM {orders}""",
}

NUMBERS = "CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) t"
# Spark generates the four rows in place instead of joining.
SPARK_NUMBERS = "LATERAL VIEW explode(array(0, 1, 2, 3)) t AS k"


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; narrow rows are dealt before anything is made of them."""
    sql = DERIVED[name].replace("LATERAL_NUMBERS", SPARK_NUMBERS)
    used = {t: base(spark, sf_dir, t) for t in BASE_TABLES if f"{{{t}}}" in sql}
    used |= {t: dealt(used[t]) for t in NARROW_TABLES if t in used}
    return spark.sql(sql, **used)


def derived_sql(name: str) -> str:
    """The same table for DuckDB, as a parenthesised subquery."""
    sql = DERIVED[name].replace("LATERAL_NUMBERS", NUMBERS)
    return "(" + sql.format(**{t: t for t in BASE_TABLES}) + ")"
