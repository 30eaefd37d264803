"""Readers, reports, vulnerability queries, passes and streams on small files."""

import json

from pyspark.sql import functions as F

from relafix.plans import passes, vulnerabilities
from relafix.sinks import reports
from relafix.sources import rules, textual_ir
from relafix.streaming import deltas

PROGRAM = """public class app.Main extends java.lang.Object implements javax.net.ssl.HostnameVerifier
{
    private int unused;

    public void <init>()
    {
        app.Main r0;

        r0 := @this: app.Main;
        specialinvoke r0.<java.lang.Object: void <init>()>();
        return;
    }

    public boolean verify(java.lang.String, javax.net.ssl.SSLSession)
    {
        java.lang.String r1;
        int i0, i1, i9;

        r1 = "AES/ECB, x";
        staticinvoke <javax.crypto.Cipher: javax.crypto.Cipher getInstance(java.lang.String)>(r1);
        i0 = 3;
        if i0 > 2 goto label1;

        i1 = i0 + 4;
        goto label2;

     label1:
        i1 = 1;

     label2:
        return i1;
    }
}
"""


def facts_of(spark, tmp_path):
    (tmp_path / "ir").mkdir(exist_ok=True)
    (tmp_path / "ir" / "Main.txt").write_text(PROGRAM)
    return textual_ir.read_facts(spark, str(tmp_path / "ir"))


def test_textual_ir(spark, tmp_path):
    facts = facts_of(spark, tmp_path)
    assert [(r.name, r.super, r.interfaces) for r in facts["class"].collect()] == [("app.Main", "java.lang.Object", ["javax.net.ssl.HostnameVerifier"])]
    assert sorted(r.subsig for r in facts["method"].collect()) == ["boolean verify(java.lang.String,javax.net.ssl.SSLSession)", "void <init>()"]
    verify = facts["unit"].where("method like '%verify%'").orderBy("idx").collect()
    assert [u.kind for u in verify] == ["assign", "invoke", "assign", "if", "assign", "goto", "assign", "return"]
    cfg = sorted((r.src, r.dst) for r in facts["cfg"].where("method like '%verify%'").collect())
    assert cfg == [(0, 1), (1, 2), (2, 3), (3, 4), (3, 6), (4, 5), (5, 7), (6, 7)]
    assert sorted(r.target_sig for r in facts["invoke"].collect()) == ["<java.lang.Object: void <init>()>", "<javax.crypto.Cipher: javax.crypto.Cipher getInstance(java.lang.String)>"]
    assert [r.name for r in passes.unused_locals(facts["local"], facts["operand"]).collect()] == ["i9"]
    assert facts["field"].count() == 1 and passes.unused_fields(facts["field"], facts["operand"]).count() == 1
    assert passes.unreachable_units(facts["cfg"], facts["unit"]).count() == 0


def test_vulnerabilities_and_report(spark, tmp_path):
    facts = facts_of(spark, tmp_path)
    listed = rules.constant_rules(spark, [("ecb", "<javax.crypto.Cipher: javax.crypto.Cipher getInstance(java.lang.String)>", 0, "regex", '^"AES/ECB', "weak mode")])
    found = vulnerabilities.literal_misuse(facts, listed).unionByName(vulnerabilities.always_true_verifier(facts))
    assert sorted((r.desc, r.custom) for r in found.collect()) == [("custom hostname verifier", None), ("weak mode", '"AES/ECB, x"')]
    report = json.loads(reports.to_json(reports.reports(found.withColumn("md5hash", F.lit("h")))).first().value)
    assert round(report["score"], 3) == 0.8 and len(report["results"]) == 2 and report["results"][0]["vulnKind"] == 0
    app = spark.createDataFrame([(None, None, None)], "target_sdk int, debuggable boolean, allow_backup boolean")
    assert sorted(r.desc for r in vulnerabilities.manifest_findings(app).collect()) == ["backup is not disabled", "target level below 17"]
    parts = spark.createDataFrame([("a", None, None, 1), ("b", None, None, 0), ("c", True, False, 1), ("d", False, None, 2)], "name string, exported boolean, enabled boolean, n_filters int")
    assert [r.name for r in vulnerabilities.exported_components(parts).collect()] == ["a"]


def test_rule_files(spark, tmp_path):
    (tmp_path / "ss.txt").write_text("% note\n<a.B: int m(int)> P1 P2 -> _SOURCE_\n<a.B: int m(int)> -> _SINK_\n<a.C: void n()> -> _NONE_|CAT\n")
    found = {r.sig: (r.is_source, r.is_sink, r.perms) for r in rules.source_sinks(spark, str(tmp_path / "ss.txt")).collect()}
    assert found == {"<a.B: int m(int)>": (True, True, ["P1", "P2"]), "<a.C: void n()>": (False, False, [])}
    assert rules.source_sinks(spark, str(tmp_path / "ss.txt"), ["CAT"]).count() == 1
    (tmp_path / "w.txt").write_text("%c\n^java.\n~<a.B: int x()>\n-<a.B: int y()>\n<a.B: int z()>\n")
    assert sorted((r["class"], r.subsig, r.action) for r in rules.wrapper_rules(spark, str(tmp_path / "w.txt")).na.fill("").collect()) == [("a.B", "int x()", "exclude"), ("a.B", "int y()", "kill"), ("a.B", "int z()", "create"), ("java.", "", "include")]
    (tmp_path / "p.txt").write_text("Permission:CAMERA\n1 Callers:\n<a.B: int m()> (x)\n<a.B: int n()>\nPermission:NFC\n<a.C: int m()>\n")
    assert sorted((r.permission, r.sig) for r in rules.permission_map(spark, str(tmp_path / "p.txt")).collect()) == [("CAMERA", "<a.B: int m()>"), ("CAMERA", "<a.B: int n()>"), ("NFC", "<a.C: int m()>")]
    (tmp_path / "x.xml").write_text('<root><method signature="&lt;a.B: int m(int)&gt;"><param index="0"><accessPath isSource="false" isSink="true"><pathElement field="f" type="T"/></accessPath></param><return><accessPath isSource="true" isSink="false"/></return></method></root>')
    assert sorted((r.position, r.fields, r.is_source, r.is_sink) for r in rules.source_sinks_xml(spark, str(tmp_path / "x.xml")).collect()) == [("param0", ["f"], False, True), ("return", [], True, False)]


def test_folding(spark):
    m = "method string, node int, local string"
    cfg = spark.createDataFrame([("m", i, i + 1) for i in range(4)], "method string, src int, dst int")
    assigned = spark.createDataFrame([("m", 0, "a", 6), ("m", 1, "b", 7)], m + ", value int")
    copies = spark.createDataFrame([("m", 3, "d", "c")], m + ", source string")
    binary = spark.createDataFrame([("m", 2, "c", "*", "a", "b")], m + ", op string, left string, right string")
    out = {r.local: r.value for r in passes.folded_constants(cfg, assigned, copies, binary).collect()}
    assert out == {"a": 6, "b": 7, "c": 42, "d": 42}


def test_streams(spark, tmp_path):
    edges = tmp_path / "edges"
    spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "src int, dst int").write.parquet(str(edges))
    seeds = spark.createDataFrame([(1,)], "node int")
    for more in (None, [(3, 9)]):
        if more:
            spark.createDataFrame(more, "src int, dst int").write.mode("append").parquet(str(edges))
        deltas.maintain_reachability(deltas.read_new_rows(spark, str(edges), "src int, dst int"), str(tmp_path / "known"), str(tmp_path / "cp"), seeds).awaitTermination(120)
    assert sorted(r.node for r in spark.read.parquet(str(tmp_path / "known/nodes")).collect()) == [1, 2, 3, 8, 9]
