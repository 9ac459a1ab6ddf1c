"""Row-level functions over whole columns."""

from pyspark.sql import functions as F

from tidewatch.catalog.base import ENV_CASE, act, export_sk, query, r2, sk
from tidewatch.functions import basics as B
from tidewatch.functions import enrich as E
from tidewatch.functions import labels as L
from tidewatch.functions import lineage as X
from tidewatch.sources.adapters import activities as A, lineage_records, table


def t(s, d, name, *cols):
    return table(s, d, name).select(*cols)


_DOM = " ".join(f"WHEN {' OR '.join(f'''contains(x,'{w}')''' for w in ws)} THEN '{n}'" for n, ws in __import__("tidewatch.constants", fromlist=["x"]).DOMAIN_RULES)
_LOC = " ".join(f"WHEN {' OR '.join(f'''contains(x,'{w}')''' for w in ws)} THEN '{n}'" for n, ws in __import__("tidewatch.constants", fromlist=["x"]).LOCATION_RULES)


@query("domain_of_documents", f"SELECT doc_id, CASE {_DOM} ELSE 'General' END AS domain FROM (SELECT doc_id, lower(text) AS x FROM documents)")
def _(s, d):
    return t(s, d, "documents", "doc_id", E.infer_domain("text").alias("domain"))


@query("location_of_documents", f"SELECT doc_id, CASE WHEN lang='en' THEN lang WHEN {_LOC[5:]} ELSE 'Global' END AS location FROM (SELECT doc_id, lang, lower(text) AS x FROM documents)")
def _(s, d):
    return t(s, d, "documents", "doc_id", E.infer_location(F.when(F.col("lang") == "en", F.col("lang")), "text").alias("location"))


@query("domain_of_words", """SELECT doc_id, CASE WHEN list_has_any(w, ['hr','human','resource']) THEN 'Human Resources' WHEN list_has_any(w, ['finance','financial','budget']) THEN 'Finance'
 WHEN list_has_any(w, ['sales','crm','customer']) THEN 'Sales' WHEN list_has_any(w, ['ops','operation','admin']) THEN 'Operations' WHEN list_has_any(w, ['it','tech','system']) THEN 'IT'
 WHEN list_has_any(w, ['analytics','bi','data']) THEN 'Analytics' WHEN list_has_any(w, ['dev','test','prod']) THEN 'Development' ELSE 'General' END AS domain
 FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS w FROM documents)""")
def _(s, d):
    return t(s, d, "documents", "doc_id", E.infer_domain("text", whole_word=True).alias("domain"))


@query("truncated_texts", "SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text,1,150) ELSE text END AS long_cut, CASE WHEN length(text) > 70 THEN substr(text,1,70)||'...' ELSE text END AS short_cut FROM documents")
def _(s, d):
    return t(s, d, "documents", "doc_id", B.truncate("text", 150).alias("long_cut"), B.truncate("text", 70, "...").alias("short_cut"))


@query("table_of_url", r"""SELECT page_id, CASE WHEN len(p) >= 2 THEN p[-2] END AS schema_name, regexp_replace(p[-1], '\.(parquet|csv|delta|json)$', '', 'i') AS table_name FROM (SELECT page_id, string_split(trim(url,'/'),'/') AS p FROM pages)""")
def _(s, d):
    found = X.table_from_path("url")
    return t(s, d, "pages", "page_id", found["schema_name"].alias("schema_name"), found["table_name"].alias("table_name"))


@query("normalised_users", """SELECT conv_id, turn, CASE WHEN text='' THEN NULL WHEN contains(v,'@') THEN split_part(v,'@',1) ELSE nullif(v,'') END AS u FROM (SELECT *, string_split(trim(text,' '),'|')[-1] AS v FROM conversations)""")
def _(s, d):
    return t(s, d, "conversations", "conv_id", "turn", E.normalize_user("text").alias("u"))


@query("environment_of_workspaces", act(f"SELECT DISTINCT workspace_name, {ENV_CASE.format(c='workspace_name')} AS environment FROM act"))
def _(s, d):
    return A(s, d).select("workspace_name", E.infer_environment("workspace_name").alias("environment")).distinct()


@query("item_classes", act("""SELECT DISTINCT item_type, CASE WHEN item_type IN ('Notebook','DataPipeline','SparkJobDefinition') THEN 'Compute' WHEN item_type IN ('Lakehouse','Warehouse') THEN 'Storage'
 WHEN item_type IN ('Report','SemanticModel') THEN 'Analytics' ELSE 'Other' END AS category, CASE WHEN item_type='Custom' THEN 'Unknown' WHEN item_type IN ('Report','SemanticModel') THEN 'Power BI' ELSE 'Fabric' END AS platform,
 item_type NOT IN ('Custom','Report','SemanticModel') AS is_native FROM act"""))
def _(s, d):
    return A(s, d).select("item_type", E.item_category("item_type").alias("category"), E.platform("item_type").alias("platform"), E.is_native("item_type").alias("is_native")).distinct()


@query("user_classes", act("""SELECT DISTINCT submitted_by, CASE WHEN submitted_by IS NULL THEN 'Unknown' WHEN submitted_by LIKE '00000000-%' THEN 'ServicePrincipal' WHEN submitted_by LIKE '%app%' THEN 'System' ELSE 'User' END AS user_type,
 CASE WHEN contains(submitted_by,'@') THEN split_part(submitted_by,'@',2) END AS upn_domain, split_part(submitted_by,'@',1) AS display_name FROM act"""))
def _(s, d):
    return A(s, d).select("submitted_by", E.user_type("submitted_by").alias("user_type"), E.upn_domain("submitted_by").alias("upn_domain"), E.display_name("submitted_by").alias("display_name")).distinct()


@query("object_urls", act("""SELECT event_id, 'https://app.powerbi.com/groups/'||workspace_id||'/'||CASE item_type WHEN 'Notebook' THEN 'notebooks' WHEN 'DataPipeline' THEN 'datapipelines' WHEN 'Lakehouse' THEN 'lakehouses' WHEN 'Report' THEN 'reports'
 WHEN 'SemanticModel' THEN 'datasets' WHEN 'SparkJobDefinition' THEN 'sparkjobdefinitions' WHEN 'Warehouse' THEN 'warehouses' ELSE 'items' END||'/'||item_id AS url FROM act"""))
def _(s, d):
    return A(s, d).select("event_id", E.object_url("workspace_id", "item_id", "item_type").alias("url"))


@query("surrogate_keys", f"SELECT c_custkey, {sk('customer', 'c_name')} AS one, {export_sk('part', "c_custkey||'|'||c_mktsegment")} AS two FROM customer")
def _(s, d):
    return t(s, d, "customer", "c_custkey", B.surrogate_key("customer", "c_name").alias("one"), B.export_key("part", "c_custkey", "c_mktsegment").alias("two"))


@query("key_collisions", f"SELECT {export_sk('customer', 'c_mktsegment')} % 3 AS k, count(DISTINCT c_mktsegment) AS members FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def _(s, d):
    return B.key_collisions(t(s, d, "customer", "c_mktsegment", (B.export_key("customer", "c_mktsegment") % 3).alias("k")), "k", "c_mktsegment")


@query("derived_durations", r"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN round_even(CAST(o_totalprice AS DOUBLE)/1000.0*1000.0,0)/1000.0 WHEN o_orderkey % 4 = 1 THEN CAST(o_orderkey % 5000 AS DOUBLE) END AS seconds FROM orders""")
def _(s, d):
    o = table(s, d, "orders").selectExpr(
        "o_orderkey", "if(o_orderkey % 4 = 0, cast(o_totalprice as string), null) as ms", "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as start",
        "if(o_orderkey % 4 = 1, date_format(timestampadd(SECOND, cast(o_orderkey % 5000 as int), o_orderdate), \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), if(o_orderkey % 4 = 2, 'no date', null)) as finish",
        "cast(null as string) as none",
    )
    return o.select("o_orderkey", E.duration_seconds("ms", "start", "none", "finish", "none").alias("seconds"))


@query("parsed_times", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN o_orderdate END AS parsed FROM orders""")
def _(s, d):
    o = table(s, d, "orders").selectExpr(
        "o_orderkey",
        "case o_orderkey % 5 when 0 then date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") when 1 then date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") "
        "when 2 then date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') when 3 then date_format(o_orderdate, 'yyyy-MM-dd') else concat('x', o_orderkey) end as txt",
    )
    return o.select("o_orderkey", B.safe_timestamp("txt").cast("timestamp_ntz").alias("parsed"))


@query("status_names", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderstatus='F' THEN 'Failed' ELSE 'Succeeded' END WHEN o_orderkey % 3 = 1 THEN 'Succeeded' ELSE
 CASE o_orderpriority WHEN '1-URGENT' THEN '1-Urgent' WHEN '2-HIGH' THEN '2-High' WHEN '3-MEDIUM' THEN '3-Medium' WHEN '4-NOT SPECIFIED' THEN '4-Not Specified' ELSE '5-Low' END END AS status FROM orders""")
def _(s, d):
    o = table(s, d, "orders").selectExpr("o_orderkey", "if(o_orderkey % 3 = 0, o_orderstatus <> 'F', null) as ok", "case o_orderkey % 3 when 1 then ' NaN ' else concat(' ', o_orderpriority) end as st")
    return o.select("o_orderkey", E.normalize_status("ok", "st").alias("status"))


@query("safe_integers", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN CAST(trunc(o_totalprice) AS BIGINT) END AS v FROM orders")
def _(s, d):
    o = table(s, d, "orders").selectExpr("o_orderkey", "case o_orderkey % 4 when 0 then cast(o_orderkey as string) when 1 then cast(o_totalprice as string) when 2 then 'NaN' else 'text' end as v")
    return o.select("o_orderkey", B.safe_int64("v").alias("v"))


@query("fact_flags", act("""SELECT event_id, CASE WHEN lower(status) IN ('failed','cancelled','error') THEN 1 ELSE 0 END AS is_failed, CASE WHEN lower(status) IN ('succeeded','completed','success') THEN 1 ELSE 0 END AS is_success,
 CASE WHEN duration_seconds > 3600 THEN 1 ELSE 0 END AS is_long_running, CAST(strftime(start_time,'%Y%m%d') AS INTEGER) AS date_sk, CAST(hour(start_time)*100+(minute(start_time)//15)*15 AS INTEGER) AS time_sk, CAST(start_time AS DATE) AS activity_date FROM act"""))
def _(s, d):
    return A(s, d).select("event_id", *L.fact_flags("status", "duration_seconds"), *L.date_time_keys("start_time", "end_time"))


@query("platform_activities", act("SELECT event_id FROM act WHERE item_type <> 'Custom' OR activity_type IN ('RunArtifact','ExecuteNotebook','ReadLakehouse')"))
def _(s, d):
    return A(s, d).filter(E.is_platform_activity(source=None)).select("event_id")


@query("calendar_flags", "SELECT o_orderkey, isodow(o_orderdate) > 5 AS is_weekend, CAST(o_orderdate AS DATE)=DATE '1999-06-01' AS is_today, CAST(DATE '1999-06-01'-CAST(o_orderdate AS DATE) AS INTEGER) AS days_ago, o_orderpriority='PRD' AS is_production FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", *L.calendar_flags(F.to_date("o_orderdate"), F.lit("1999-06-01").cast("date"), "o_orderpriority"))


@query("analysis_labels", act("""SELECT event_id, coalesce(workspace_name, workspace_id,'Unknown') AS workspace, item_name, item_type, activity_type AS invoke_type, start_time, end_time, duration_seconds, submitted_by AS user_id,
 CASE WHEN submitted_by LIKE 'user.%' THEN 'User '||regexp_extract(submitted_by,'user.([0-9]+)',1) WHEN submitted_by LIKE 'svc%' THEN 'Svc_App_'||substr(submitted_by,9) ELSE submitted_by END AS user_name,
 coalesce(failure_reason, error_message, error_code,'Unknown Error') AS error_message, error_code, status FROM act"""))
def _(s, d):
    return L.analysis_labels(A(s, d))


@query("parsed_connections", """SELECT 'p'||l_partkey AS item_id, 'src_'||substr(md5(CASE WHEN l_suppkey % 2 = 0 THEN 'AdlsGen2|https://acc'||(l_suppkey % 10)||'|box'||l_suppkey ELSE 'Snowflake|conn'||(l_suppkey % 5)||'|DB'||l_suppkey END),1,12) AS source_id,
 CASE WHEN l_suppkey % 2 = 0 THEN 'ADLS: box'||l_suppkey ELSE 'Snowflake: DB'||l_suppkey END AS display_name FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON p_partkey=l_partkey""")
def _(s, d):
    r = lineage_records(s, d).filter("`Source Type` <> 'OneLake'").select(F.col("`Item ID`").alias("item_id"), X.parse_connection("`Source Connection`").alias("conn"))
    r = r.withColumn("kind", F.col("conn.type"))
    return r.select("item_id", X.source_id("kind", "conn").alias("source_id"), X.source_details("kind", "conn")["display_name"].alias("display_name"))


@query("tables_of_connections", "SELECT 'p'||p_partkey AS item_id, 'TBL_'||p_size AS table_name, p_type AS schema_name, 'Tables/'||p_type||'/TBL_'||p_size AS full_path, 'shortcut' AS table_type FROM part")
def _(s, d):
    r = lineage_records(s, d).filter("`Source Type` = 'OneLake'").select(F.col("`Item ID`").alias("item_id"), X.parse_connection("`Source Connection`").alias("conn"))
    return r.select("item_id", F.explode(X.tables_from_connection("conn")).alias("t")).select("item_id", "t.table_name", "t.schema_name", "t.full_path", "t.table_type")


# Every kind of connection by the supplier's number: as JSON or as a Python literal, with and without optional fields, one of
# a kind without rules, and one text that does not parse.
KINDS = ["AdlsGen2", "AzureBlob", "AmazonS3", "OneDriveSharePoint", "OneDriveSharePoint", "Snowflake", "Dataverse", "AmazonS3"]


def connections(s, d):
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    forms = [
        F.format_string('{"type":"AdlsGen2","adlsGen2":{"location":"https://a%s","container":"box%s","path":"raw/t%s.parquet"}}', n, k, k),
        F.format_string('{"type":"AzureBlob","azureBlob":{"location":"https://b%s","subpath":"sub%s","name":"only%s.csv"}}', n, k, k),
        F.format_string("{'type': 'AmazonS3', 'amazonS3': {'location': 's3://bucket%s', 'subpath': None, 'bucket': 'bucket%s', 'key': 'in/sales/day%s.csv'}}", n, n, k),
        F.format_string('{"type":"OneDriveSharePoint","oneDriveSharePoint":{"location":"https://site%s","driveId":"d%s","subpath":"docs"}}', n, k),
        F.format_string('[{"type":"OneDriveSharePoint","oneDriveSharePoint":{"location":"https://site%s","driveId":""}}, {"type":"AmazonS3"}]', n),
        F.format_string('{"type":"Snowflake","typeProperties":{"connection":"c%s","database":"DB%s"}}', n, k),
        F.format_string('{"type":"Dataverse","environment":"x%s"}', k),
        F.lit("not a connection"),
    ]
    at = (F.col("s_suppkey") % 8).cast("int")
    return table(s, d, "supplier").select("s_suppkey", F.get(F.array(*map(F.lit, KINDS)), at).alias("kind"), X.parse_connection(F.get(F.array(*forms), at)).alias("conn"))


@query("connection_kinds", f"""SELECT s_suppkey, kind, 'src_'||CASE WHEN m = 7 THEN kind||'_unknown' ELSE substr(md5(concat_ws('|', kind, a, b)),1,12) END AS source_id,
 CASE m WHEN 0 THEN 'ADLS: box'||s_suppkey WHEN 1 THEN 'ADLS: sub'||s_suppkey WHEN 2 THEN 'S3: '||a WHEN 3 THEN 'SharePoint: docs' WHEN 4 THEN 'SharePoint: '||a WHEN 5 THEN 'Snowflake: '||b ELSE kind END AS display_name,
 CASE WHEN m IN (0,1,2,3,4) THEN a END AS location, CASE m WHEN 0 THEN b WHEN 1 THEN b WHEN 2 THEN '' END AS container, CASE WHEN m = 5 THEN b END AS database
 FROM (SELECT s_suppkey, s_suppkey % 8 AS m, ({KINDS!r})[s_suppkey % 8 + 1] AS kind,
  CASE s_suppkey % 8 WHEN 0 THEN 'https://a'||s_nationkey WHEN 1 THEN 'https://b'||s_nationkey WHEN 2 THEN 's3://bucket'||s_nationkey WHEN 3 THEN 'https://site'||s_nationkey WHEN 4 THEN 'https://site'||s_nationkey WHEN 5 THEN 'c'||s_nationkey END AS a,
  CASE s_suppkey % 8 WHEN 0 THEN 'box'||s_suppkey WHEN 1 THEN 'sub'||s_suppkey WHEN 3 THEN 'd'||s_suppkey WHEN 5 THEN 'DB'||s_suppkey END AS b FROM supplier)""")
def _(s, d):
    return connections(s, d).select("s_suppkey", "kind", X.source_id("kind", "conn").alias("source_id"), X.source_details("kind", "conn").alias("d")).select("s_suppkey", "kind", "source_id", "d.*")


@query("external_tables", """SELECT s_suppkey, CASE m WHEN 0 THEN 't'||s_suppkey WHEN 1 THEN 'only'||s_suppkey ELSE 'day'||s_suppkey END AS table_name, CASE m WHEN 0 THEN 'raw' WHEN 2 THEN 'sales' END AS schema_name,
 CASE m WHEN 0 THEN 'box'||s_suppkey WHEN 2 THEN 'bucket'||s_nationkey END AS database, CASE m WHEN 0 THEN 'box'||s_suppkey||'/raw/t'||s_suppkey||'.parquet' WHEN 2 THEN 'bucket'||s_nationkey||'/in/sales/day'||s_suppkey||'.csv' END AS full_path,
 'external' AS table_type FROM (SELECT *, s_suppkey % 8 AS m FROM supplier) WHERE m IN (0, 2)""")
def _(s, d):
    found = connections(s, d).select("s_suppkey", F.explode(X.tables_from_connection("conn")).alias("t"))
    return found.select("s_suppkey", "t.table_name", "t.schema_name", "t.database", "t.full_path", "t.table_type")
