import datetime as dt
import hashlib
import os
import subprocess
import sys

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewatch.functions import basics as B
from tidewatch.functions import enrich as E
from tidewatch.functions import labels as L
from tidewatch.functions import lineage as X


def apply(df, value, fn, ddl="v string"):
    return df([(value,)], ddl).select(fn("v").alias("o")).first()["o"]


@pytest.mark.parametrize("value,want", [("a|b@c.com", "b"), ("joe@x.y", "joe"), ("plain", "plain"), ("", None), (None, None), (" x|y ", "y"), ("|", None)])
def test_normalize_user(df, value, want):
    assert apply(df, value, E.normalize_user) == want


@pytest.mark.parametrize(
    "value,want",
    [("42", 42), ("42.9", 42), ("-3.7", -3), ("NaN", None), ("Infinity", None), ("abc", None), (None, None), ("9007199254740993", 9007199254740993)],
)
def test_safe_int64(df, value, want):
    assert apply(df, value, B.safe_int64) == want


@pytest.mark.parametrize(
    "value,want",
    [
        ("2024-01-15T10:30:00Z", dt.datetime(2024, 1, 15, 10, 30)), ("2024-01-15T10:30:00.123456Z", dt.datetime(2024, 1, 15, 10, 30, 0, 123456)),
        ("2024-01-15T10:30:00", dt.datetime(2024, 1, 15, 10, 30)), ("2024-01-15 10:30:00", dt.datetime(2024, 1, 15, 10, 30)), ("2024-01-15", dt.datetime(2024, 1, 15)),
        ("not a date", None), ("", None), (None, None), ("2024-01-15T12:30:00+02:00", dt.datetime(2024, 1, 15, 10, 30)),
    ],
)
def test_safe_timestamp(df, value, want):
    got = df([(value,)], "v string").select(B.safe_timestamp("v").cast("timestamp_ntz").alias("o")).first()["o"]
    assert got == want


@pytest.mark.parametrize(
    "row,want",
    [
        (("1500", None, None, None, None), 1.5), ((None, "2024-01-15T10:00:00Z", None, "2024-01-15T10:05:00.5Z", None), 300.5),
        ((None, None, "2024-01-15T10:00:00Z", None, "2024-01-15T10:01:00Z"), 60.0), ((None, "2024-01-15T10:00:00Z", None, None, None), None),
        ((None, "2024-01-15T10:00:00Z", None, "2024-01-15T09:00:00Z", None), None), (("bad", "2024-01-15T10:00:00Z", None, "2024-01-15T10:00:02Z", None), 2.0),
    ],
)
def test_duration(df, row, want):
    got = df([row], "ms string, s string, c string, e string, d string").select(E.duration_seconds("ms", "s", "c", "e", "d").alias("o")).first()["o"]
    assert got == want


@pytest.mark.parametrize("ok,status,want", [(True, "x", "Succeeded"), (False, None, "Failed"), (None, "in progress", "In Progress"), (None, None, "Succeeded"), (None, " NaN ", "Succeeded"), (None, "IN-PROGRESS", "In-Progress")])
def test_normalize_status(df, ok, status, want):
    assert df([(ok, status)], "ok boolean, s string").select(E.normalize_status("ok", "s").alias("o")).first()["o"] == want


def test_rules_substring_and_whole_word(df):
    assert apply(df, "Audit log", E.infer_domain) == "IT"
    assert apply(df, "Audit log", lambda c: E.infer_domain(c, whole_word=True)) == "General"
    assert apply(df, "Finance Ops", E.infer_domain) == "Finance"
    assert apply(df, None, E.infer_domain) == "General"
    assert apply(df, "Customer hub", lambda c: E.infer_location(None, c)) == "Americas"
    assert apply(df, "x", lambda c: E.infer_domain(c, rules=[])) == "General"


@pytest.mark.parametrize("name,want", [("DEV - Analytics", "DEV"), ("PROD - Sales", "PRD"), ("Staging area", "UAT"), ("QA", "TEST"), ("plain", "Unknown"), (None, "Unknown"), ("test dev", "DEV")])
def test_environment(df, name, want):
    assert apply(df, name, E.infer_environment) == want


@pytest.mark.parametrize("upn,want", [("6f9619ff-8b86-d011-b42d-00c04fc964ff", "ServicePrincipal"), ("svc-automation", "System"), ("ann@example.com", "User"), (None, "Unknown"), ("", "Unknown")])
def test_user_type(df, upn, want):
    assert apply(df, upn, E.user_type) == want


def test_item_classes(df):
    got = rows(df([("Notebook",), ("Lakehouse",), ("Report",), ("Odd",), (None,)], "t string").select("t", E.item_category("t"), E.platform("t"), E.is_native("t")))
    assert got == [("Lakehouse", "Storage", "Fabric", True), ("Notebook", "Compute", "Fabric", True), ("Odd", "Other", "Unknown", False), ("Report", "Analytics", "Power BI", False), (None, "Other", "Unknown", False)]


def test_surrogate_key_matches_definition(df):
    digest = hashlib.md5(b"workspace|abc")
    assert apply(df, "abc", lambda c: B.surrogate_key("workspace", c)) == int(digest.hexdigest()[:15], 16)
    assert apply(df, "abc", lambda c: B.export_key("workspace", c)) == int.from_bytes(digest.digest()[:4], "big") % (2**31 - 1)


def test_key_collisions_are_reported(df):
    dim = df([(1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, None)], "k int, natural string")
    assert rows(B.key_collisions(dim, "k", "natural")) == [(2, 2)]


def test_rename_coalesce_and_ensure(df):
    raw = df([("id", None, "given", "other")], "Id string, WorkspaceName string, workspace_name string, _workspace_name string")
    out = B.ensure_columns(B.rename_coalesce(raw), ["event_id", "missing"])
    r = out.first()
    assert (r["event_id"], r["workspace_name"], r["missing"]) == ("id", "given", None)
    raw = df([(None, "from id")], "WorkspaceName string, _workspace_name string")
    assert B.rename_coalesce(raw).first()["workspace_name"] == "from id"


def test_flags_and_keys(df):
    d = df([("Cancelled", 3601.0, None, dt.datetime(2024, 3, 5, 14, 44))], "s string, d double, a timestamp_ntz, b timestamp_ntz")
    r = d.select(*L.fact_flags("s", "d"), *L.date_time_keys("a", "b")).first()
    assert tuple(r) == (1, 0, 1, 20240305, 1430, dt.date(2024, 3, 5))


@pytest.mark.parametrize("v,left,right", [(60.0, "1-5 min", "< 1 min"), (30.0, "< 1 min", "< 1 min"), (None, None, None), (9999.0, "> 1 hour", "> 1 hour")])
def test_buckets(df, v, left, right):
    d = df([(v,)], "v double")
    assert tuple(d.select(L.duration_bucket("v"), L.duration_bucket("v", closed="right")).first()) == (left, right)


def test_ratings(df):
    d = df([(99.0, 0, 1.5), (95.0, 10, -2.0), (10.0, 11, None)], "r double, f int, c double")
    got = [tuple(r) for r in d.select(L.rate_colour("r"), L.failure_colour("f"), L.trend_mark("c"), L.trend_colour("c")).collect()]
    assert got == [("#107C10", "#107C10", "▲", "#107C10"), ("#FFB900", "#FFB900", "▼", "#E81123"), ("#E81123", "#E81123", "―", "#107C10")]
    d = df([(69.0, 1), (90.0, 101), (84.0, 1), (90.0, 51), (90.0, 1)], "r double, n int")
    assert [r[0] for r in d.select(L.user_risk("r", "n")).collect()] == ["High", "High", "Medium", "Medium", "Low"]


def test_round_half_even(df):
    d = df([(33.125,), (2.675,), (0.5,)], "v double").select(B.round_half_even("v"))
    assert [r[0] for r in d.collect()] == [33.12, 2.68, 0.5]


@pytest.mark.parametrize(
    "path,want",
    [
        ("Tables/EDW/DIM", ("EDW", "DIM")), ("Tables/CUSTOMER", (None, "CUSTOMER")), ("Tables/a/b/c", ("a", "c")), ("box/folder/data.parquet", ("folder", "data")),
        ("box/x.JSON", ("box", "x")), ("plain", None), ("", None), (None, None), ("Tables/", None),
    ],
)
def test_table_from_path(df, path, want):
    got = apply(df, path, X.table_from_path)
    assert (None if got is None else tuple(got)) == want


@pytest.mark.parametrize(
    "text,kind",
    [
        ('{"type":"OneLake","oneLake":{"itemId":"x"}}', "OneLake"), ("{'type': 'Snowflake', 'snowflake': {'database': 'D', 'schema': None}}", "Snowflake"),
        ("[{'type': 'AmazonS3'}, {'type': 'OneLake'}]", "AmazonS3"), ("Unknown", None), ("{broken", None), (None, None),
    ],
)
def test_parse_connection(df, text, kind):
    got = apply(df, text, X.parse_connection)
    assert (got["type"] if got else None) == kind


def test_source_identity_and_details(df):
    conn = "{'type':'AdlsGen2','adlsGen2':{'location':'https://a','container':'','subpath':'s'}}"
    d = df([(conn,), (None,)], "v string").select(X.parse_connection("v").alias("c")).select(X.source_id(F.lit("AdlsGen2"), "c").alias("i"), X.source_details(F.lit("AdlsGen2"), "c").alias("d"))
    first, second = d.collect()
    assert first["i"] == "src_" + hashlib.md5(b"AdlsGen2|https://a").hexdigest()[:12]
    assert first["d"]["display_name"] == "ADLS: https://a"
    assert second["i"] == "src_AdlsGen2_unknown" and second["d"]["display_name"] == "AdlsGen2"


def test_tables_from_connection(df):
    texts = [
        '{"type":"Snowflake","snowflake":{"database":"D","schema":"S","table":"T"}}', '{"type":"AmazonS3","amazonS3":{"bucket":"b","key":"f/t.csv"}}',
        '{"type":"OneLake","oneLake":{"itemId":"i","path":"Tables/A/B"}}', '{"type":"OneLake","oneLake":{"itemId":"i","path":"Files"}}', '{"type":"Other"}',
    ]
    d = df([(t,) for t in texts], "v string").select(F.explode(X.tables_from_connection(X.parse_connection("v"))).alias("t")).select("t.*")
    assert [tuple(r) for r in d.collect()] == [
        ("T", "S", "D", "D/S/T", "external", None), ("t", "f", "b", "b/f/t.csv", "external", None), ("B", "A", None, "Tables/A/B", "shortcut", "i"),
    ]


def test_decode_payload(df):
    import base64

    good = base64.b64encode(b'{"a": 1}').decode()
    assert apply(df, good, X.decode_payload) == '{"a": 1}'
    assert apply(df, "%%%", X.decode_payload) is None
    assert apply(df, base64.b64encode(b"nope").decode(), X.decode_payload) is None


def test_title_case_and_display_user(df):
    assert apply(df, "joe.van-dyk@x", E.display_user) == "Joe Van-Dyk"


def test_platform_activity_predicate(df):
    d = df([("JobHistory", None, None), ("x", "Notebook", None), ("x", "Odd", "RunArtifact"), ("x", None, None), (None, "Odd", "Other")], "source string, item_type string, activity_type string")
    assert [r[0] for r in d.select(E.is_platform_activity()).collect()] == [True, True, True, False, False]


def test_scratch_is_removed(tmp_path):
    """In a process of its own, as the folder of this one is in use."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from tidewatch.session import build_session, clear_scratch, cut_lineage
s = build_session("scratch", "local[1]", spark__ui__enabled="false", spark__checkpoint__dir={str(tmp_path)!r})
assert cut_lineage(s.range(5)).count() == 5
clear_scratch(s)
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
