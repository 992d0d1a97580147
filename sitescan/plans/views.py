"""Views over the driver's tables that stand for photos, boxes, truth, points, cameras, assets and a register.

Each view is a select list that Spark SQL and DuckDB read alike: integer arithmetic, then a cast. `spark_view` gives it as a DataFrame,
`CTE` as text for a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (table, select list, tail)
VIEWS = {
    "v_photos": ("customer", "CAST(c_custkey % 50 AS BIGINT) AS site_id, c_custkey AS photo, CAST(c_nationkey % 18 AS INT) AS sweep, 1024 AS width, 1024 AS height", ""),
    "v_det": (
        "orders",
        "CAST(o_custkey % 50 AS BIGINT) AS site_id, o_custkey AS photo, o_orderkey AS det_id, "
        "CAST((o_orderkey*131)%160 AS DOUBLE) AS x1, CAST((o_orderkey*57)%160 AS DOUBLE) AS y1, "
        "CAST((o_orderkey*131)%160 + 60 + (o_orderkey*17)%60 AS DOUBLE) AS x2, CAST((o_orderkey*57)%160 + 60 + (o_orderkey*23)%60 AS DOUBLE) AS y2, "
        "CAST(100 + (o_orderkey*7919)%850 AS DOUBLE)/1000 AS conf, CAST(o_orderkey%3 AS INT) AS cls",
        "",
    ),
    "v_truth": (
        "customer",
        "CAST(c_custkey % 50 AS BIGINT) AS site_id, c_custkey AS photo, c_custkey*3+k AS truth_id, CAST(c_nationkey AS INT) AS object_id, "
        "CAST((c_custkey*29+k*67)%160 AS DOUBLE) AS x1, CAST((c_custkey*43+k*41)%160 AS DOUBLE) AS y1, "
        "CAST((c_custkey*29+k*67)%160+90 AS DOUBLE) AS x2, CAST((c_custkey*43+k*41)%160+90 AS DOUBLE) AS y2, "
        "CASE WHEN (c_custkey+k)%2 = 0 THEN 'clear' ELSE 'hard: small' END AS difficulty",
        "CROSS JOIN (VALUES (0), (1), (2)) AS t(k)",
    ),
    "v_points": (
        "lineitem",
        "CAST(0 AS BIGINT) AS site_id, CAST(l_suppkey%18 AS INT) AS sweep, l_orderkey, l_linenumber, l_partkey, l_suppkey, "
        "CAST((l_partkey*37+l_linenumber*11)%140 AS DOUBLE)/10 - CAST(10.75 AS DOUBLE) AS x, "
        "CAST((l_orderkey*13+l_suppkey)%120 AS DOUBLE)/10 - CAST(8.75 AS DOUBLE) AS y, "
        "CAST((l_partkey+l_linenumber*7)%30 AS DOUBLE)/10 - CAST(0.45 AS DOUBLE) AS z",
        "",
    ),
    # one camera for each sweep and cube face that the customers name; odd offsets keep points off the borders of the frames
    "v_images": (
        "customer",
        "DISTINCT CAST(0 AS BIGINT) AS site_id, CAST((c_custkey%18)*10 + c_nationkey%6 AS BIGINT) AS photo, CAST(c_custkey%18 AS INT) AS sweep, CAST(c_nationkey%6 AS INT) AS face, 1024 AS width, 1024 AS height, "
        "CAST(512 AS DOUBLE) AS fx, CAST(512 AS DOUBLE) AS fy, CAST(512 AS DOUBLE) AS cx, CAST(512 AS DOUBLE) AS cy, "
        "CAST(CASE WHEN c_nationkey%6 = 3 THEN 0 ELSE 1 END AS DOUBLE) AS qw, CAST(CASE c_nationkey%6 WHEN 1 THEN 1 WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END AS DOUBLE) AS qx, "
        "CAST(CASE c_nationkey%6 WHEN 4 THEN 1 WHEN 5 THEN -1 ELSE 0 END AS DOUBLE) AS qy, CAST(0 AS DOUBLE) AS qz, "
        "CAST((c_custkey%18%6)*2 - 8 AS DOUBLE) + CAST(0.0137 AS DOUBLE) AS tx, CAST((c_custkey%18%5)*2 - 6 AS DOUBLE) + CAST(0.0291 AS DOUBLE) AS ty, CAST(1.0173 AS DOUBLE) AS tz",
        "",
    ),
    "v_plates": (
        "orders",
        "CAST(0 AS BIGINT) AS site_id, CAST((o_custkey%18)*10 + o_orderkey%6 AS BIGINT) AS photo, o_orderkey AS box_id, "
        "CAST((o_orderkey*131)%930 AS DOUBLE) + CAST(0.37 AS DOUBLE) AS x1, CAST((o_orderkey*57)%930 AS DOUBLE) + CAST(0.41 AS DOUBLE) AS y1, "
        "CAST((o_orderkey*131)%930 + 40 + (o_orderkey*17)%80 AS DOUBLE) + CAST(0.37 AS DOUBLE) AS x2, CAST((o_orderkey*57)%930 + 40 + (o_orderkey*23)%80 AS DOUBLE) + CAST(0.41 AS DOUBLE) AS y2",
        "",
    ),
    "v_assets": (
        "customer",
        "CAST(c_custkey % 5 AS BIGINT) AS site_id, c_custkey AS asset_id, c_mktsegment AS product, "
        "CAST((c_custkey*37)%200 AS DOUBLE)/16 AS x, CAST((c_custkey*53)%160 AS DOUBLE)/16 AS y, CAST((c_custkey*11)%24 AS DOUBLE)/16 AS z",
        "",
    ),
    "v_register": (
        "supplier",
        "CAST(s_suppkey % 5 AS BIGINT) AS site_id, s_suppkey AS entry_id, s_name AS tag_name, "
        "CAST((s_suppkey*91)%200 AS DOUBLE)/16 AS x, CAST((s_suppkey*29)%160 AS DOUBLE)/16 AS y, CAST((s_suppkey*7)%24 AS DOUBLE)/16 AS z",
        "",
    ),
    "v_clustered": (
        "orders",
        "CAST(o_custkey % 5 AS BIGINT) AS site_id, CAST(o_orderkey%3 AS INT) AS cls, CAST(o_orderkey%200 AS BIGINT) AS cluster, CAST(o_custkey % 18 AS INT) AS sweep, o_custkey AS photo, o_orderkey AS det_id, o_orderkey AS join_no, "
        "CAST(100 + (o_orderkey*7919)%850 AS DOUBLE)/1000 AS conf, CAST((o_orderkey*131)%900 AS DOUBLE) AS x1, CAST((o_orderkey*57)%900 AS DOUBLE) AS y1, "
        "CAST((o_orderkey*131)%900 + 60 + (o_orderkey*17)%60 AS DOUBLE) AS x2, CAST((o_orderkey*57)%900 + 60 + (o_orderkey*23)%60 AS DOUBLE) AS y2, "
        "CAST((o_orderkey*37)%200 AS DOUBLE)/16 AS x, CAST((o_custkey*53)%160 AS DOUBLE)/16 AS y, CAST((o_orderkey*11)%24 AS DOUBLE)/16 AS z",
        "",
    ),
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, select, tail = VIEWS[name]
    return spark.sql(f"SELECT {select} FROM {{{table}}} {tail}", **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def cte(*names: str) -> str:
    """The views as the beginning of a WITH clause."""
    return ", ".join(f"{n} AS (SELECT {VIEWS[n][1]} FROM {VIEWS[n][0]} {VIEWS[n][2]})" for n in names)
