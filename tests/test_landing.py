import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.operators import compliance as C
from tidewatch.operators import inventory as I
from tidewatch.operators import quality as Q
from tidewatch.sources import landed as L
from tidewatch.sources import readers as RD
from tidewatch.sources import scan as SC
from tidewatch.sources import sinks as SK


def put(path, name, text):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text, encoding="utf-8")


def test_activities_from_csv_with_differing_headers(spark, tmp_path):
    put(tmp_path / "daily", "fabric_activities_1.csv", 'Id,ActivityId,WorkspaceName,CreationTime,DurationSeconds\ne1,,"W, one",2024-01-01T00:00:00Z,bad\n')
    put(tmp_path / "daily", "fabric_activities_2.csv", "_workspace_name,Id,StartTime,CompletionTime\nW2,e2,2024-01-02T00:00:00Z,2024-01-02T01:00:00Z\n")
    got = {r["event_id"]: r for r in RD.load_activities(spark, str(tmp_path)).collect()}
    assert (got["e1"]["activity_id"], got["e1"]["workspace_name"], got["e1"]["duration_seconds"], got["e1"]["start_time"]) == ("e1", "W, one", 0.0, dt.datetime(2024, 1, 1))
    assert (got["e2"]["workspace_name"], got["e2"]["end_time"], got["e2"]["item_id"]) == ("W2", dt.datetime(2024, 1, 2, 1), None)


def test_gated_csv(spark, tmp_path):
    put(tmp_path, "a.csv", "x,y\n1,2\n")
    put(tmp_path, "b.csv", "y,x\n3,4\n")
    put(tmp_path, "c.csv", '"x","y"\n5,6\n')
    assert rows(RD.load_gated_csv(spark, f"{tmp_path}/*.csv", ["x", "y"])) == [("1", "2"), ("5", "6")]


def test_quoted_header_with_a_comma(spark, tmp_path):
    put(tmp_path, "a.csv", '"name, long",k\n"x, y",1\n')
    assert rows(RD.read_csv_union(spark, f"{tmp_path}/*.csv"), "`name, long`", "k") == [("x, y", "1")]


def test_jobs_without_id_are_kept(spark, tmp_path):
    put(tmp_path, "a.json", json.dumps([{"id": "j1", "itemId": "i"}, {"itemId": "i", "status": "Failed"}]))
    assert rows(RD.load_jobs(spark, str(tmp_path)), "job_instance_id", "item_id") == [("j1", "i"), (None, "i")]


def test_jobs_from_json_skip_bad_file(spark, tmp_path):
    put(tmp_path, "a.json", json.dumps([{"id": "j1", "itemId": "i", "startTimeUtc": "2024-01-01T00:00:00Z", "status": "Failed", "failureReason": {"message": "m", "errorCode": "c"}}, {"id": "j2", "failureReason": "text"}]))
    put(tmp_path, "b.json", "{not json")
    got = {r["job_instance_id"]: r for r in RD.load_jobs(spark, str(tmp_path)).collect()}
    assert set(got) == {"j1", "j2"} and got["j1"]["job_failure_reason"]["errorCode"] == "c" and got["j2"]["job_failure_reason"]["message"] == "text"
    assert got["j1"]["job_start_time"] == dt.datetime(2024, 1, 1)


def test_landed_files_to_star_schema(spark, tmp_path):
    from tidewatch.operators.asof import enrich_errors, smart_merge
    from tidewatch.operators.facts import build_schema

    put(tmp_path / "daily", "fabric_activities_1.csv", "Id,ItemId,ItemType,WorkspaceId,WorkspaceName,SubmittedBy,Status,Activity,StartTime\ne1,i,Notebook,w,DEV x,ann@x.y,Completed,RunArtifact,2024-01-01T10:00:00Z\ne2,i,Notebook,w,DEV x,ann@x.y,Completed,RunArtifact,2024-01-01T12:00:00Z\n")
    put(tmp_path / "jobs", "a.json", json.dumps([{"id": "j1", "itemId": "i", "startTimeUtc": "2024-01-01T10:01:00Z", "endTimeUtc": "2024-01-01T10:03:00Z", "status": "Failed", "failureReason": {"message": "m", "errorCode": "c"}}]))
    acts = RD.load_activities(spark, str(tmp_path)).withColumns({c: F.lit(None).cast("string") for c in ("failure_reason", "error_code")})
    merged = smart_merge(acts, RD.load_jobs(spark, str(tmp_path / "jobs")))
    by = {r["event_id"]: r for r in merged.collect()}
    assert (by["e1"]["status"], by["e1"]["duration_seconds"], json.loads(by["e1"]["failure_reason"])["message"]) == ("Failed", 180.0, "m")
    assert (by["e2"]["status"], by["e2"]["job_instance_id"], by["e2"]["duration_seconds"]) == ("Completed", None, 0.0)
    errors = {r["event_id"]: r["error_code"] for r in enrich_errors(merged, nested_reason=True).collect()}
    assert errors == {"e1": "c", "e2": None}
    star = build_schema(merged)
    assert rows(star.fact_daily_metrics, "total_activities", "failed_activities", "unique_items") == [(2, 1, 1)]
    assert star.dim_date.count() == 1


def test_lineage_json_and_csv(spark, tmp_path):
    put(tmp_path, "l.json", json.dumps({"lineage": [{"Item ID": "a", "Mirrored Tables": [{"tableName": "t"}]}, {"Item ID": "b"}]}))
    put(tmp_path, "l.csv", 'Item ID,Source Connection\na,"{\'type\': \'X\', \'k\': 1}"\n')
    one = RD.load_lineage(spark, f"{tmp_path}/l.json").orderBy("seq").collect()
    assert [r["Item ID"] for r in one] == ["a", "b"] and one[1]["seq"] == one[0]["seq"] + 1
    put(tmp_path, "m.json", json.dumps({"lineage": [{"Item ID": "c"}, {"Item ID": "d"}]}))
    both = [r["seq"] for r in RD.load_lineage(spark, f"{tmp_path}/*.json").collect()]
    assert len(set(both)) == 4, "records of two files have places of their own"
    assert RD.load_lineage(spark, f"{tmp_path}/l.csv").first()["Source Connection"].startswith("{'type'")


def test_standardise_events(df, drop_empty=True):
    raw = df([("1", "Op", "2024-01-01T05:00:00Z", "12"), ("2", "Op", "bad", "x")], "Id string, Operation string, Timestamp string, DurationMs string")
    out = RD.standardise_events(raw, drop_empty=True)
    assert set(out.columns) == {"Id", "Activity", "CreationTime", "Duration", "DurationMs"}
    assert rows(out, "Id", "CreationTime", "DurationMs") == [("1", "2024-01-01 05:00:00 UTC", 12.0), ("2", None, None)]


def test_snapshot_newest_wins_and_csv_fallback(spark, df, tmp_path):
    a = lambda v: df([(v, "2024-01-01T00:00:00Z"), (v, "bad")], "event_id string, start_time string")
    SK.write_snapshot(a("old"), str(tmp_path), "20240101")
    SK.write_snapshot(a("new"), str(tmp_path), "20240102")
    got = RD.load_snapshot(spark, str(tmp_path))
    assert rows(got, "event_id", "start_time") == [("new", dt.datetime(2024, 1, 1)), ("new", None)]
    put(tmp_path / "c", "activities_1.csv", "Id,StartTime\nx,2024-01-01T00:00:00Z\n")
    assert RD.load_snapshot(spark, str(tmp_path / "c")).first()["event_id"] == "x"


def test_flatten_scan_counts(spark, tmp_path):
    ws = {
        "id": "w", "name": "W", "lakehouses": [{"id": "l", "name": "L", "upstreamDataflows": [{"id": "u"}], "downstreamDataflows": [], "datasourceUsages": []}],
        "datasets": [{"id": "d", "name": "D", "tables": [{"name": "t", "columns": [{"id": "c"}], "source": [{"expression": "e"}]}]}],
        "shortcuts": [{"itemId": "l", "name": "s", "path": "p", "target": {"path": "tp"}}], "reports": [{"id": "r", "datasetId": "d"}],
    }
    put(tmp_path, "s.json", json.dumps(ws))
    flat = SC.flatten_scan(spark.read.schema(SC.SCAN_SCHEMA).json(f"{tmp_path}/s.json"))
    by = {r["item_type"]: r for r in flat.collect()}
    assert set(by) == {"Lakehouse", "Lakehouse Shortcut", "SemanticModel", "DatasetTable", "Report"}
    assert (by["Lakehouse"]["upstream_count"], by["Lakehouse"]["downstream_count"], by["DatasetTable"]["column_count"], by["DatasetTable"]["measure_count"]) == (1, 0, 1, 0)
    assert (by["DatasetTable"]["source_connection"], by["Lakehouse Shortcut"]["source_type"], by["Report"]["item_name"]) == ("e", "Unknown", "Unknown")


def test_schemas_conform_and_sink(spark, df, tmp_path):
    assert set(schemas.table_schemas()) >= {"fact_activity", "dim_date", "activities_master"}
    assert len(schemas.table_schemas()["activities_master"]) == 30
    out = schemas.conform(df([("3", 2)], "total_runs string, failed_runs int"), "compute_analysis")
    assert (out.first()["total_runs"], out.first()["user"]) == (3, None)
    path = SK.save_table(df([("7.0", "x")], "a_sk string, b string"), str(tmp_path), "t")
    assert dict(spark.read.parquet(path).dtypes) == {"a_sk": "bigint", "b": "string"}


def test_empty_report_keeps_header(spark, df, tmp_path):
    out = SK.write_reports({"r": df([], "a string, b int")}, str(tmp_path))
    assert spark.read.option("header", True).csv(out["r"]).columns == ["a", "b"]


def test_retention_rewrites_in_place(spark, df, tmp_path):
    d = dt.date
    df([(1, d(2024, 1, 1)), (2, d(2023, 1, 1)), (3, None)], "v int, date date").write.partitionBy("date").parquet(f"{tmp_path}/t")
    SK.apply_retention(spark, f"{tmp_path}/t", 180, "2024-02-01")
    assert rows(spark.read.parquet(f"{tmp_path}/t"), "v") == [(1,), (3,)]


def test_upserts(df):
    old = df([("a", "A", 1), ("b", "B", 2)], "id string, name string, n int")
    new = df([("a", "A2", 9), ("c", "C", 3)], "id string, name string, n int")
    assert rows(SK.merge_nodes(old, new)) == [("a", "A2", 9), ("b", "B", 2), ("c", "C", 3)]
    assert rows(SK.merge_nodes(old, new, on_match=["n"])) == [("a", "A", 9), ("b", "B", 2), ("c", "C", 3)]
    assert rows(SK.merge_nodes(old, new, on_match=[])) == [("a", "A", 1), ("b", "B", 2), ("c", "C", 3)]
    e = "src string, dst string, rel string"
    assert rows(SK.merge_edges(df([("a", "b", "R")], e), df([("a", "b", "R"), ("b", "a", "R"), ("b", "a", "R"), ("a", "zz", "R")], e), old)) == [("a", "b", "R"), ("b", "a", "R")]


# ---- compliance --------------------------------------------------------------------
WS = "id string, name string, type string, state string, capacityId string, isOnDedicatedCapacity boolean"
REQ = [{"objectId": "G1", "displayName": "Admins", "role": "Admin"}, {"objectId": "G2", "displayName": "Readers", "role": "Viewer"}]


def spaces(df):
    return df(
        [
            ("w1", "One", "Workspace", "Active", "c", False), ("w2", "Two", "Workspace", "Active", None, True), ("w3", "Three", "Workspace", "Active", "00000000-0000-0000-0000-000000000000", False),
            ("w4", "Four", "PersonalGroup", "Active", "c", False), ("w5", "Five", "Workspace", "Deleted", "c", False), (None, "NoId", "Workspace", "Active", "c", False),
        ],
        WS,
    )


def people(df):
    return df(
        [("w1", "g1", None, "Admin", None, 1), ("w1", None, "G2", None, "viewer", 2), ("w2", "G1", None, "Member", None, 3), ("w2", "G1", None, "Admin", None, 4)],
        "workspace_id string, identifier string, objectId string, groupUserAccessRight string, role string, seq int",
    )


def test_scope(df):
    assert rows(C.scope(spaces(df), premium_only=True), "name") == [("NoId",), ("One",), ("Two",)]
    assert rows(C.scope(spaces(df), names=["W1", "two"]), "id") == [("w1",), ("w2",)]
    assert rows(C.scope(spaces(df).filter("id is not null"), first_n=1), "id") == [("w1",)]


def test_statuses_summary_metrics(df):
    rules = df([("id", "W3"), ("name", "fOUR")], "kind string, token string")
    status = dict(rows(C.workspace_status(spaces(df), rules), "name", "status"))
    assert status == {"One": "evaluated", "Two": "evaluated", "Three": "suppressed", "Four": "suppressed", "Five": "evaluated", "NoId": "skipped"}
    assert rows(C.suppressed(spaces(df), rules), "id") == [("w3",), ("w4",)]
    summary = C.access_summary(spaces(df), rules, REQ, people(df))
    by = {r["workspace_name"]: r for r in summary.collect()}
    assert by["One"]["actions"] == "Admins: already_compliant; Readers: already_compliant" and not by["One"]["needs_action"]
    assert by["Two"]["actions"] == "Admins: role_mismatch; Readers: dry_run" and by["Two"]["needs_action"]
    assert tuple(C.access_metrics(summary).first()) == (6, 1, 2, 2, 1)


def test_audit_and_limits(df):
    got = rows(C.principal_audit(spaces(df).filter("id is not null"), people(df), "g1"), "workspace_id", "is_member", "current_role")
    assert got == [("w1", True, "Admin"), ("w2", True, "Member"), ("w4", False, "None"), ("w5", False, "None")]
    many = [{"objectId": f"x{i}", "displayName": f"Extra {i}", "role": "Viewer"} for i in range(3000)]
    found = C.assess_access(spaces(df), [*REQ, *many], people(df))
    assert found.count() == spaces(df).count() * (len(REQ) + 3000)
    assert found.filter("current_role is not null").count() == C.assess_access(spaces(df), REQ, people(df)).filter("current_role is not null").count()
    table = df([(r["objectId"], r.get("displayName"), r.get("role")) for r in [*REQ, *many]], "objectId string, displayName string, role string")
    assert rows(C.assess_access(spaces(df).select("id"), table, people(df))) == rows(found.select("id", *[c for c in found.columns if c in ("principal", "group", "target_role", "current_role")]), *C.assess_access(spaces(df).select("id"), table, people(df)).columns)


def test_merge_inventory(df):
    a = df([("1", "A", None, False), ("2", None, "c", None)], "id string, name string, capacityId string, isOnDedicatedCapacity boolean")
    b = df([("1", "", "k", True), ("2", "B", None, None), ("3", None, None, None), (None, "x", None, None)], "id string, name string, capacityId string, isOnDedicatedCapacity boolean")
    assert rows(I.merge_inventory(a, b)) == [("1", "A", "k", True, "fabric"), ("2", "B", "c", False, "fabric"), ("3", "Unnamed", None, False, "powerbi")]


def test_workspace_lookups(df):
    look = df([("w1", "Known", 11), ("w2", None, 12), ("w3", "Shared", 13), ("w4", "Shared", 14)], "workspace_id string, workspace_name string, workspace_sk bigint")
    acts = df([("w1", "x"), ("w9", " Given "), ("w9", "UNKNOWN"), (None, "Shared")], "workspace_id string, workspace_name string")
    assert sorted(r["workspace_name"] for r in I.workspace_name(acts, look).collect()) == ["Given", "Known", "Shared", "Unknown"]
    assert sorted(r["workspace_sk"] for r in I.workspace_sk(acts, look).collect()) == [-1, -1, 11, 14]


def test_quality(df):
    a = df([("1", "i", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1)), ("1", None, None, None), (None, "i", None, None)], "activity_id string, item_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    r = Q.pre_merge_checks(a, df([("i",), (None,)], "item_id string")).first()
    assert (r["duplicate_ids"], r["null_starts"], r["ends_before_start"], r["job_key_coverage"]) == (1, 2, 1, 0.5)
    from pyspark.sql.types import StructType

    assert rows(Q.check_config(df([("x", 1)], "a string, b int"), StructType().add("a", "string").add("b", "integer"), ["a"])) == []
    got = rows(Q.check_config(df([(None, 1)], "a string, b int"), StructType().add("a", "string").add("b", "string").add("c", "integer"), ["a"]), "column", "problem")
    assert got == [("a", "null in required column"), ("b", "expected string, got int"), ("c", "missing column")]


def test_many_files_of_one_header(spark, tmp_path, monkeypatch):
    """A thousand files are two scans, rejected files are opened for their first block only, and empty ones are skipped."""
    for i in range(1000):
        put(tmp_path, f"a{i:04d}.csv", f"x,y\n{i},1\n")
    put(tmp_path, "b [1].csv", '\ufeff"x",y\nb,"two\nlines"\n')
    put(tmp_path, "empty.csv", "")
    put(tmp_path, "other.csv", "z\n" + "q\n" * 200_000)
    files = L.file_catalogue(spark, f"{tmp_path}/*.csv")
    assert rows(files.groupBy("header").count()) == [('["x", "y"]', 1001), ('["z"]', 1)]
    got = RD.load_gated_csv(spark, f"{tmp_path}/*.csv", ["x", "y"])
    assert got.count() == 1001 and rows(got.filter("x = 'b'")) == [("b", "two\nlines")]
    assert not any("other.csv" in f for f in got.inputFiles()) and len(got.inputFiles()) == 1001
    union = RD.read_csv_union(spark, f"{tmp_path}/*.csv")
    assert union.count() == 201_001
    with pytest.raises(FileNotFoundError):
        RD.read_csv_union(spark, f"{tmp_path}/none*.csv")


def test_headers_longer_than_a_block_and_with_line_ends(tmp_path, monkeypatch):
    names = [f"column {i}, with a comma" for i in range(500)] + ["two\nlines"]
    put(tmp_path, "a.csv", ",".join(f'"{n}"' for n in names) + "\n" + "1," * 500 + "1\n")
    monkeypatch.setattr(L, "BLOCK", 100)
    path = tmp_path / "a.csv"
    assert L.header_of(f"file:{path}", path.stat().st_size) == names


def test_large_files_are_split_unless_a_field_has_a_line_end(spark, tmp_path):
    put(tmp_path, "plain.csv", "k,v\n" + "".join(f'{i},"a, b"\n' for i in range(30_000)))
    put(tmp_path, "broken.csv", "k,v\n" + "".join(f'{i},"a\nb"\n' for i in range(30_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        plain, broken = (RD.load_gated_csv(spark, f"{tmp_path}/{n}.csv", ["k", "v"]) for n in ("plain", "broken"))
        assert plain.rdd.getNumPartitions() > 3 and broken.rdd.getNumPartitions() == 1
        assert plain.filter("v = 'a, b'").count() == broken.filter("v = 'a\nb'").count() == 30_000
        assert RD.load_gated_csv(spark, f"{tmp_path}/broken.csv", ["k", "v"], multi_line=True).count() == 30_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_places_of_records_follow_file_names(spark, tmp_path):
    for n in ("b", "a", "c d"):
        put(tmp_path, f"{n}.json", json.dumps({"lineage": [{"Item ID": f"{n}{i}"} for i in range(3)]}))
    got = [r["Item ID"] for r in RD.load_lineage(spark, f"{tmp_path}/*.json").orderBy("seq").collect()]
    assert got == ["a0", "a1", "a2", "b0", "b1", "b2", "c d0", "c d1", "c d2"]


def test_events_are_neither_sorted_nor_scanned_by_default(spark, df):
    frame = df([("e1", "2024-01-02T00:00:00Z"), ("e2", "2024-01-01T00:00:00Z")], "Id string, CreationTime string")
    plan = RD.standardise_events(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "Aggregate" not in plan
    assert [r["Id"] for r in RD.standardise_events(frame, drop_empty=True, ordered=True).collect()] == ["e2", "e1"]


def test_arrays_are_landed_compressed_without_a_shuffle(spark, tmp_path):
    from tidewatch.catalog.landing import land_arrays

    glob = land_arrays(spark.range(25).selectExpr("id", "concat('n', id) as name"), str(tmp_path / "arrays"), 4, '{"lineage": %s}')
    files = list((tmp_path / "arrays").glob("part-*"))
    assert all(f.name.endswith(".gz") for f in files)
    sizes = [len(r[0]) for r in spark.read.schema("lineage array<struct<id: bigint, name: string>>").option("multiLine", True).json(glob).collect()]
    assert len(sizes) == len(files) and sum(sizes) == 25 and max(sizes) <= 4
