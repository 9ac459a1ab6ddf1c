"""Views of the benchmark tables as activities, jobs, inventory, memberships and lineage.

Plain, deterministic expressions over one table each, so a reference SQL can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.graph.model import Graph

ITEM_TYPES = [
    "Notebook", "DataPipeline", "Lakehouse", "Report", "SemanticModel", "SparkJobDefinition",
    "Warehouse", "Custom",
]
DOMAINS = ["Finance", "Sales", "Operations", "IT", "Analytics"]
LOCATIONS = ["EMEA", "Americas", "APAC"]
ENV_SUFFIXES = [" DEV", " TEST", " UAT", " PROD", ""]
REASONS = [
    "Connection timeout", "Insufficient permissions", "Out of memory", "Schema mismatch",
    "Source unavailable",
]
SOURCE_KINDS = ["AdlsGen2", "AmazonS3", "Snowflake", "OneDriveSharePoint", "OneLake"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


_K = r"cast(regexp_extract(props, '([0-9]+)', 1) as int)"


def _labels(values: list[str], index: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({index} as int) + 1)"


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as activities, with null items, workspaces, users, ends and reasons among them."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr("*", f"{_K} as k", "if(event_id % 9 <> 0, cast(floor(value * 10) as double), null) as duration_seconds")
        .selectExpr(
            "cast(event_id as string) as event_id",
            "concat('act_', event_id) as activity_id",
            "case event_type when 'error' then 'ExecuteNotebook' when 'purchase' then 'RunArtifact' when 'signup' then 'ReadLakehouse' "
            "when 'view' then 'ViewReport' else 'CustomClick' end as activity_type",
            "if(event_id % 50 <> 7, concat('item_', k), null) as item_id",
            "concat('Item ', k) as item_name",
            f"{_labels(ITEM_TYPES, 'k % 8')} as item_type",
            "if(event_id % 40 <> 11, concat('ws_', k % 25), null) as workspace_id",
            f"concat('NATION_', k % 25, {_labels(ENV_SUFFIXES, '(k % 25) % 5')}) as workspace_name",
            "if(event_id % 60 <> 13, case user_id % 10 when 0 then concat('00000000-0000-0000-0000-', lpad(user_id, 12, '0')) "
            "when 1 then concat('svc_app_', user_id) else concat('user.', user_id, '@corp', user_id % 3, '.com') end, null) as submitted_by",
            "concat('user.', (user_id * 7) % 50) as created_by",
            "concat('user.', (user_id * 3) % 20) as last_updated_by",
            f"{_labels(DOMAINS, 'k % 5')} as domain",
            f"{_labels(LOCATIONS, 'k % 3')} as location",
            "cast(null as string) as object_url",
            "case when event_type = 'error' then 'Failed' when event_type = 'purchase' and event_id % 11 = 0 then 'Cancelled' "
            "when event_type = 'signup' and event_id % 13 = 0 then 'InProgress' when event_type = 'view' then 'Completed' else 'Succeeded' end as status",
            "ts as start_time",
            "timestampadd(SECOND, cast(duration_seconds as int), ts) as end_time",
            "duration_seconds",
            f"{_labels(['Scheduled', 'Manual', 'OnDemand'], 'event_id % 3')} as invoke_type",
            f"if(event_type = 'error' and event_id % 6 <> 0, {_labels(REASONS, 'event_id % 6 - 1')}, null) as failure_reason",
            "cast(null as string) as error_message",
            "if(event_type = 'error', concat('E', event_id % 4), null) as error_code",
            "if(event_id % 8 <> 5, concat('root_', event_id div 3), null) as root_activity_id",
        )
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase and error events as job runs that start up to 400 s around the event."""
    start = "timestampadd(SECOND, cast((event_id * 37) % 800 - 400 as int), ts)"
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type").isin("purchase", "error"))
        .selectExpr(
            "concat('job_', event_id) as job_instance_id",
            f"concat('item_', {_K}) as item_id",
            f"{start} as job_start_time",
            f"if(event_id % 7 <> 0, timestampadd(SECOND, cast(event_id % 1000 as int), {start}), null) as job_end_time",
            "if(event_id % 5 = 0, 'Failed', 'Completed') as job_status",
            "if(event_id % 5 = 0, concat('Job failed: ', event_id % 4), null) as job_failure_reason",
            "if(event_id % 2 = 0, 'RunNotebook', 'Refresh') as job_type",
            "concat('svc_', user_id % 10) as job_invoker",
        )
    )


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspace inventory: one per customer, capacity by market segment."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("W"), key.cast("string")).alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "PersonalGroup").otherwise("Workspace").alias("type"),
        F.when(F.col("c_acctbal") < 0, "Deleted").otherwise("Active").alias("state"),
        F.when(F.col("c_nationkey") < 20, F.concat(F.lit("cap_"), F.col("c_nationkey").cast("string"))).alias("capacityId"),
        (F.col("c_mktsegment") == "BUILDING").alias("isOnDedicatedCapacity"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships: one per order, the customer's workspace and a principal by priority."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("W"), F.col("o_custkey").cast("string")).alias("workspace_id"),
        F.when(key % 2 == 0, F.concat(F.lit("grp-"), F.substring("o_orderpriority", 1, 1))).alias("identifier"),
        F.concat(F.lit("GRP-"), F.substring("o_orderpriority", 1, 1)).alias("objectId"),
        F.when(F.col("o_orderstatus") == "F", "Admin").when(F.col("o_orderstatus") == "O", "Member").alias("groupUserAccessRight"),
        F.lit("viewer").alias("role"),
        key.alias("seq"),
    )


def lineage_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts and customers as items, brands and segments as workspaces, suppliers as
    external sources, (type, size) pairs as tables."""
    part, cust = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    supp = table(spark, sf_dir, "supplier")
    used = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    s = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    p, c = F.col("p_partkey"), F.col("c_custkey")
    null = F.lit(None).cast("string")
    table_key = F.concat(F.lower("p_type"), F.lit("_tbl_"), F.col("p_size").cast("string"))

    def node(df: DataFrame, key, label, name, kind, location=null, database=null, schema=null, path=null, kind2=null):
        return df.select(
            key.alias("id"), F.lit(label).alias("label"), name.alias("name"), kind.alias("type"),
            location.alias("location"), database.alias("database"), schema.alias("schema"),
            path.alias("full_path"), kind2.alias("table_type"),
        )

    nodes = (
        node(part.select("p_brand").distinct(), F.col("p_brand"), "Workspace", F.col("p_brand"), null)
        .unionByName(node(cust.select("c_mktsegment").distinct(), F.col("c_mktsegment"), "Workspace", F.col("c_mktsegment"), null))
        .unionByName(node(part, s("p", p), "Item", F.col("p_name"), F.col("p_type")))
        .unionByName(node(cust, s("c", c), "Item", F.col("c_name"), F.lit("Report")))
        .unionByName(
            node(
                supp, s("s", F.col("s_suppkey")), "Source", F.col("s_name"), pick(SOURCE_KINDS, F.col("s_suppkey") % 5),
                location=s("nation_", F.col("s_nationkey")), database=F.when(F.col("s_suppkey") % 5 == 2, s("DB", F.col("s_nationkey"))),
            )
        )
        .unionByName(
            node(
                part.select("p_type", "p_size").distinct(), s("t_", table_key), "Table", s("TBL_", F.col("p_size")), null,
                database=F.when(F.col("p_size") % 3 == 0, s("DB", F.col("p_size") % 7)), schema=F.col("p_type"),
                path=F.concat(F.lit("Tables/"), F.col("p_type"), F.lit("/TBL_"), F.col("p_size").cast("string")),
                kind2=F.when(F.col("p_size") % 3 == 0, "mirrored").otherwise("shortcut"),
            )
        )
    )

    def edge(df: DataFrame, src, rel, dst):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"))

    inner = part.filter(p >= 1)
    edges = (
        edge(part, F.col("p_brand"), "CONTAINS", s("p", p))
        .unionByName(edge(cust.filter(F.col("c_acctbal") >= 0), F.col("c_mktsegment"), "CONTAINS", s("c", c)))
        .unionByName(edge(inner, s("p", p), "DEPENDS_ON", s("p", F.floor(p / 2))))
        .unionByName(edge(inner.filter(F.floor(p / 3) != F.floor(p / 2)), s("p", p), "DEPENDS_ON", s("p", F.floor(p / 3))))
        .unionByName(edge(cust.filter("c_mktsegment = 'BUILDING'"), s("c", c), "DEPENDS_ON", s("p", c)))
        .unionByName(edge(used, s("p", F.col("l_partkey")), "CONSUMES", s("s", F.col("l_suppkey"))))
        .unionByName(edge(part, s("p", p), "PROVIDES_TABLE", s("t_", table_key)))
        .unionByName(edge(part, s("p", F.floor(p / 5)), "USES_TABLE", s("t_", table_key)).distinct())
        .unionByName(
            edge(
                part.join(cust, p == c).filter("c_mktsegment = 'MACHINERY'"), s("c", c), "MIRRORS", s("t_", table_key)
            )
        )
        .unionByName(edge(cust.filter("c_mktsegment = 'FURNITURE'"), s("c", c), "READS_FROM", s("p", c)))
    )
    return Graph(nodes, edges)


def lineage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lineage records, one per (part, supplier) pair that ships and one per upstream part.

    ``seq`` keeps the arrival order."""
    part = table(spark, sf_dir, "part")
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    p = F.col("p_partkey")
    s = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))

    def record(df, seq, conn, kind, shortcut, definition=F.lit(None).cast("string")):
        return df.select(
            seq.cast("bigint").alias("seq"),
            F.col("p_brand").alias("Workspace ID"),
            F.concat(F.lit("WS "), F.col("p_brand")).alias("Workspace Name"),
            s("p", p).alias("Item ID"),
            F.col("p_name").alias("Item Name"),
            F.concat(F.col("p_type"), F.lit(shortcut)).alias("Item Type"),
            s("sc_", p).alias("Shortcut Name"),
            F.lit("Tables").alias("Shortcut Path"),
            kind.alias("Source Type"),
            conn.alias("Source Connection"),
            definition.alias("Full Definition"),
        )

    upstream = record(
        part, p,
        F.to_json(
            F.struct(
                F.lit("OneLake").alias("type"),
                F.struct(
                    s("w", p % 7).alias("workspaceId"),
                    s("p", F.when(p % 9 == 8, -p - 1).otherwise(F.floor(p / 2))).alias("itemId"),
                    F.concat(F.lit("Tables/"), F.col("p_type"), F.lit("/TBL_"), F.col("p_size").cast("string")).alias("path"),
                ).alias("oneLake"),
            )
        ),
        F.lit("OneLake"), " Shortcut",
    )
    # The file of parts is small for its rows, so the planner would send millions of them through the driver.
    shipped = pairs.hint("merge").join(part, F.col("l_partkey") == p)
    sup = F.col("l_suppkey")
    # A Python literal, as some extracts write it.
    blob = F.concat(F.lit("{'type': 'AdlsGen2', 'adlsGen2': {'location': 'https://acc"), (sup % 10).cast("string"), F.lit("', 'container': 'box"), sup.cast("string"), F.lit("', 'path': None}}"))
    snow = F.to_json(
        F.struct(F.lit("Snowflake").alias("type"), F.struct(s("conn", sup % 5).alias("connection"), s("DB", sup).alias("database")).alias("snowflake"))
    )
    external = record(
        shipped, F.lit(1_000_000_000) + p * 1_000_000 + sup, F.when(sup % 2 == 0, blob).otherwise(snow),
        F.when(sup % 2 == 0, "AdlsGen2").otherwise("Snowflake"), "",
    )
    return upstream.unionByName(external)
