"""Views over the given tables that the registered queries run on; one SQL text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DAYS = "CASE {dow} WHEN 0 THEN 'Sunday' WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday' WHEN 3 THEN 'Wednesday' WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday' ELSE 'Saturday' END"
_ID = "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING))"
_RAW = (
    "CASE l_returnflag || l_linestatus WHEN 'NO' THEN 'BENIGN' WHEN 'NF' THEN ' benign ' WHEN 'RO' THEN 'DoS Hulk'"
    " WHEN 'RF' THEN 'DDoS' WHEN 'AO' THEN 'PortScan' ELSE 'Web Attack – XSS' END"
)
VIEWS = {
    "flows": f"SELECT {_ID} AS id, l_quantity AS f0, l_extendedprice AS f1, l_discount + 0.0 AS f2, l_tax AS f3, {_RAW} AS raw_label,"
    f" CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_returnflag || l_linestatus = 'RO' THEN 1 WHEN l_returnflag || l_linestatus = 'RF' THEN 2 WHEN l_linestatus = 'O' THEN 3 ELSE 4 END AS cls,"
    f" CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS y, {_DAYS} AS day FROM {{lineitem}}",
    "dirty": f"SELECT {_ID} AS id, CASE WHEN l_partkey % 7 = 0 THEN 'Infinity' WHEN l_partkey % 11 = 0 THEN 'NaN' WHEN l_partkey % 13 = 0 THEN '' WHEN l_partkey % 17 = 0 THEN 'abc' ELSE CAST(l_quantity AS STRING) END AS t0,"
    " CASE WHEN l_suppkey % 7 = 0 THEN '-Infinity' ELSE CAST(l_extendedprice AS STRING) END AS t1 FROM {lineitem}",
    "scored": "SELECT event_id AS id, value AS score, user_id, ts, CAST(CAST(ts AS DATE) AS STRING) AS day,"
    " CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS cls,"
    " CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS y, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS flag FROM {events}",
    "vectors": "SELECT vec_id AS id, embedding, label FROM {embeddings}",
    "agents": "SELECT * FROM (VALUES (0), (1), (2), (3), (4)) AS t(agent)",
}
VIEWS["decisions"] = f"SELECT s.*, a.agent, CASE WHEN flag = 1 THEN CAST((id * (agent + 3)) % 6 % 5 AS INT) ELSE 0 END AS pred FROM ({VIEWS['scored']}) s CROSS JOIN ({VIEWS['agents']}) a"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name].replace("{dow}", "dayofweek(l_shipdate) - 1")
    for t in ("lineitem", "events", "embeddings"):
        sql = sql.replace(f"{{{t}}}", f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(sql)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views it names as common table expressions."""
    text = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names).replace("{dow}", "dayofweek(l_shipdate)")
    for t in ("lineitem", "events", "embeddings"):
        text = text.replace(f"{{{t}}}", t)
    return f"WITH {text} {sql}"
