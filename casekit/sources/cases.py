"""Case-table sources and sinks.

``case_table`` builds the 17-column case table from the driver's TPC-H-style
tables (one case per order). ``load_cases`` reads a complaint CSV with the
original header names. ``write_table`` persists any report.

Scale notes
-----------
* ``nation`` and ``region`` have a fixed size (25 / 5 rows, independent of the
  scale factor), so they are joined once and broadcast.
* ``customer`` grows with the data: orders and customers meet in a shuffle join
  on the customer key (AQE splits a hot customer key).
* The last ship date per order is a partial+final aggregate on ``l_orderkey``;
  its output is already hash partitioned on the order key, so the join with
  ``orders`` shuffles only the orders side. It is added only when
  ``closed_ts`` is requested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CASE_COLUMNS = [
    "case_id", "created_ts", "closed_ts", "descriptor", "borough", "location_type", "agency",
    "status", "incident_zip", "incident_address", "street_name", "cross_street_1",
    "cross_street_2", "latitude", "longitude", "resolution_description", "community_board",
]

# Original CSV header -> case-table column (fixed values: the complaint file's header names).
CSV_HEADER = {
    "Created Date": "created_ts",
    "Closed Date": "closed_ts",
    "Agency": "agency",
    "Descriptor": "descriptor",
    "Location Type": "location_type",
    "Incident Zip": "incident_zip",
    "Incident Address": "incident_address",
    "Street Name": "street_name",
    "Cross Street 1": "cross_street_1",
    "Cross Street 2": "cross_street_2",
    "Borough": "borough",
    "Latitude": "latitude",
    "Longitude": "longitude",
    "Status": "status",
    "Resolution Description": "resolution_description",
    "Community Board": "community_board",
}

DEFAULT_TS_FORMAT = "MM/dd/yyyy hh:mm:ss a"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add_hours(ts: Column, n: Column) -> Column:
    return F.timestamp_add("HOUR", n.cast("int"), ts)


def case_table(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The ``cases`` view over the driver tables (FIXTURES.md §2)."""
    cols = list(columns or CASE_COLUMNS)
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    geo = (read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
           .join(read_table(spark, sf_dir, "region").select("r_regionkey", "r_name"),
                 F.col("n_regionkey") == F.col("r_regionkey")))
    # nation x region: 25 rows by definition of the schema, a proven bound.
    cust = customer.join(F.broadcast(geo), customer.c_nationkey == geo.n_nationkey)
    b = orders.join(cust, orders.o_custkey == cust.c_custkey)
    if "closed_ts" in cols:
        ship = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
                .agg(F.max("l_shipdate").alias("last_ship")))
        b = b.join(ship, b.o_orderkey == ship.l_orderkey, "left")

    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    h = (k * 31 + ck * 17) % 100
    created = _add_hours(F.col("o_orderdate"), (k * 7 + ck) % 24)
    exprs = {
        "case_id": k,
        "created_ts": created,
        "closed_ts": (F.when(F.col("last_ship") >= F.col("o_orderdate"),
                             _add_hours(created, (k * 13 + ck * 5) % 97))
                      if "closed_ts" in cols else None),
        "descriptor": (F.when(h < 6, "Tortured").when(h < 17, "Chained").when(h < 55, "Neglected")
                       .when(h < 65, "No Shelter").when(h < 72, "In Car")
                       .when(h < 73, "Noise, Barking Dog (NR5)")
                       .when(h < 99, "Other (complaint details)")),
        "location_type": (F.when(F.col("c_mktsegment") == "AUTOMOBILE", "Park/Playground")
                          .when(F.col("c_mktsegment") == "BUILDING", "Residential Building/House")
                          .when(F.col("c_mktsegment") == "FURNITURE", "Store/Commercial")
                          .when(F.col("c_mktsegment") == "HOUSEHOLD", "Street/Sidewalk")
                          .when(k % 3 != 0, "Subway Station")),
        "agency": F.when(k % 20 == 0, "DOHMH").otherwise("NYPD"),
        "status": (F.when(F.col("o_orderstatus") == "F", "Closed")
                   .when(F.col("o_orderstatus") == "O", "Open").otherwise("Pending")),
        "incident_zip": F.when(k % 12 != 0, (F.lit(10000) + ck % 1700).cast("double")),
        "incident_address": F.when(k % 9 != 0, F.col("n_name")),
        "street_name": F.when(k % 8 != 0, F.col("n_name")),
        "cross_street_1": F.when(k % 4 != 0, F.col("r_name")),
        "cross_street_2": F.when(k % 6 != 0, F.col("c_mktsegment")),
        "latitude": F.when(k % 10 != 0, (k % 4000).cast("double") / 10000 + 40.5),
        "longitude": F.when(k % 10 != 0, (ck % 5000).cast("double") / 10000 - 74.25),
        "resolution_description": F.when(k % 7 != 0, F.col("o_orderpriority")),
        "community_board": F.col("n_nationkey").cast("string"),
    }
    borough = (F.when(F.col("r_name") == "AFRICA", "BRONX").when(F.col("r_name") == "AMERICA", "BROOKLYN")
               .when(F.col("r_name") == "ASIA", "MANHATTAN").when(F.col("r_name") == "EUROPE", "QUEENS")
               .otherwise("STATEN ISLAND"))
    exprs["borough"] = F.when(k % 50 != 0, borough)
    return b.select(*[exprs[c].alias(c) for c in cols])


def cases_sql_duckdb() -> str:
    """The same view as DuckDB SQL, for oracle queries (``WITH cases AS (...)``)."""
    return _CASES_SQL.replace("{ADD1}", "o.o_orderdate + to_hours(CAST((o.o_orderkey*7 + o.o_custkey) % 24 AS INTEGER))") \
                     .replace("{ADD2}", "created_ts + to_hours(CAST((k*13 + ck*5) % 97 AS INTEGER))")


_CASES_SQL = """
WITH ship AS (
  SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey),
b AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS ck, o.o_orderdate, o.o_orderstatus, o.o_orderpriority,
         {ADD1} AS created_ts,
         (o.o_orderkey*31 + o.o_custkey*17) % 100 AS h,
         s.last_ship, c.c_mktsegment, n.n_name, n.n_nationkey, r.r_name
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN ship s ON o.o_orderkey = s.l_orderkey)
SELECT k AS case_id, created_ts,
  CASE WHEN last_ship >= o_orderdate THEN {ADD2} END AS closed_ts,
  CASE WHEN h < 6 THEN 'Tortured' WHEN h < 17 THEN 'Chained' WHEN h < 55 THEN 'Neglected'
       WHEN h < 65 THEN 'No Shelter' WHEN h < 72 THEN 'In Car'
       WHEN h < 73 THEN 'Noise, Barking Dog (NR5)'
       WHEN h < 99 THEN 'Other (complaint details)' END AS descriptor,
  CASE WHEN k % 50 <> 0 THEN CASE r_name
       WHEN 'AFRICA' THEN 'BRONX' WHEN 'AMERICA' THEN 'BROOKLYN' WHEN 'ASIA' THEN 'MANHATTAN'
       WHEN 'EUROPE' THEN 'QUEENS' ELSE 'STATEN ISLAND' END END AS borough,
  CASE c_mktsegment
       WHEN 'AUTOMOBILE' THEN 'Park/Playground' WHEN 'BUILDING' THEN 'Residential Building/House'
       WHEN 'FURNITURE' THEN 'Store/Commercial' WHEN 'HOUSEHOLD' THEN 'Street/Sidewalk'
       ELSE CASE WHEN k % 3 <> 0 THEN 'Subway Station' END END AS location_type,
  CASE WHEN k % 20 = 0 THEN 'DOHMH' ELSE 'NYPD' END AS agency,
  CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Open' ELSE 'Pending' END AS status,
  CASE WHEN k % 12 <> 0 THEN CAST(10000 + ck % 1700 AS DOUBLE) END AS incident_zip,
  CASE WHEN k % 9 <> 0 THEN n_name END AS incident_address,
  CASE WHEN k % 8 <> 0 THEN n_name END AS street_name,
  CASE WHEN k % 4 <> 0 THEN r_name END AS cross_street_1,
  CASE WHEN k % 6 <> 0 THEN c_mktsegment END AS cross_street_2,
  CASE WHEN k % 10 <> 0 THEN CAST(k % 4000 AS DOUBLE) / 10000 + 40.5 END AS latitude,
  CASE WHEN k % 10 <> 0 THEN CAST(ck % 5000 AS DOUBLE) / 10000 - 74.25 END AS longitude,
  CASE WHEN k % 7 <> 0 THEN o_orderpriority END AS resolution_description,
  CAST(n_nationkey AS VARCHAR(10)) AS community_board
FROM b
"""


def load_cases(spark: SparkSession, path: str, ts_format: str = DEFAULT_TS_FORMAT,
               strict: bool = False) -> DataFrame:
    """Complaint CSV with a header row -> case table.

    Columns are taken by header name, whatever their order; others are ignored and
    absent ones are NULL. Files of one folder must share a header. Types are declared,
    not inferred (no extra pass over the file). Bad timestamps become NULL
    (``strict=False``) or fail the job (``strict=True``). NaN is mapped to NULL so
    missing is one thing (N20). ``case_id`` is a hash of the row's text; repeated rows
    are told apart by a running number, so keys depend neither on file splits nor on
    the cluster. It is needed for deterministic splits.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).option("escape", '"').csv(path)
    have = set(raw.columns)
    raw = raw.select(*[(F.col(f"`{h}`") if h in have else F.lit(None).cast("string")).alias(h) for h in CSV_HEADER])
    # each value is marked present or absent: the hash itself passes over NULLs
    marks = [x for h in CSV_HEADER for x in (F.col(f"`{h}`"), F.col(f"`{h}`").isNull())]
    raw = raw.withColumn("__h", F.xxhash64(*marks))
    same = Window.partitionBy("__h").orderBy(*[F.col(f"`{h}`") for h in CSV_HEADER])
    raw = raw.withColumn("__n", F.row_number().over(same))
    key = F.when(F.col("__n") == 1, F.col("__h")).otherwise(F.xxhash64("__h", "__n")).alias("case_id")
    parse = F.to_timestamp_ntz if strict else F.try_to_timestamp
    out = []
    for h, c in CSV_HEADER.items():
        x = F.col(f"`{h}`")
        if c in ("created_ts", "closed_ts"):
            x = parse(x, F.lit(ts_format))
            if not strict:
                x = x.cast("timestamp_ntz")
        elif c in ("incident_zip", "latitude", "longitude"):
            x = x.try_cast("double")
            x = F.nanvl(x, F.lit(None).cast("double"))
        out.append(x.alias(c))
    return raw.select(key, *out)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Persist a report or feature table as Parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
