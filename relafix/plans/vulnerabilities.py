"""User-facing queries over a program's fact tables; each returns findings.

``facts`` is the dictionary that ``sources.textual_ir.read_facts`` returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relafix.functions.scalar import exported, sdk_below
from relafix.operators import flow, pointsto
from relafix.operators.fixpoint import Relations, fixpoint
from relafix.storage import bounded_broadcast

# Fixed scores of findings.
METHOD_SCORE, CONSTANT_SCORE, MANIFEST_SCORE = 0.5, 0.3, 5.0


def _finding(rows: DataFrame, kind: int, desc: Column, score: float, dest_stmt: Column | None = None, dest_method: Column | None = None, custom: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit(kind).alias("vuln_kind"),
        none.alias("source_stmt"),
        none.alias("source_method"),
        (none if dest_stmt is None else dest_stmt).alias("dest_stmt"),
        (none if dest_method is None else dest_method).alias("dest_method"),
        desc.alias("desc"),
        F.array().cast("array<struct<stmt:string,method:string>>").alias("paths"),
        (none if custom is None else custom).alias("custom"),
        F.lit(score).cast("float").alias("score"),
    )


def accepted(op: Column, operand: Column, value: Column) -> Column:
    """A rule's predicate on a printed constant (string constants with their quotes)."""
    return F.when(op == "always", True).when(op == "eq", value == operand).when(op == "regex", F.coalesce(F.regexp(value, operand), F.lit(False))).otherwise(False)


def literal_misuse(facts: dict[str, DataFrame], rules: DataFrame) -> DataFrame:
    """Listed arguments that are a constant, or a local with a constant definition, which a rule accepts.

    Rules of one signature share the argument position (the largest rule name's) and
    any of them may accept.
    """
    shared = rules.groupBy("sig").agg(F.max_by("arg_idx", "rule").alias("arg_idx"), F.max_by("desc", "rule").alias("desc"))
    calls = facts["invoke"].join(bounded_broadcast(shared, 100_000), facts["invoke"]["target_sig"] == shared["sig"])
    calls = calls.select("method", "idx", "sig", "desc", F.try_element_at("args", F.col("arg_idx") + 1).alias("value")).where("value is not null")
    assigned = facts["operand"].where("role = 'def' and kind = 'local'").select("method", "idx", F.col("text").alias("local"))
    constant = facts["operand"].where("role = 'use' and kind = 'const'").select("method", "idx", F.col("text").alias("constant"))
    uses = calls.select("method", F.col("idx").alias("node"), F.col("value").alias("local"))
    defs = assigned.select("method", F.col("idx").alias("node"), "local")
    relevant = facts["cfg"].join(uses.select("method").distinct(), "method", "left_semi")
    reached = flow.def_use(relevant, defs, uses).join(constant.withColumnRenamed("idx", "def_node"), ["method", "def_node"])
    by_local = calls.join(reached.select("method", F.col("node").alias("idx"), F.col("local").alias("value"), "constant"), ["method", "idx", "value"])
    is_literal = F.col("value").rlike(r'^(-?[\d.]+.*|".*"|null)$')
    values = calls.where(is_literal).withColumn("constant", F.col("value")).unionByName(by_local)
    hit = values.join(rules.select("sig", "op", "operand"), "sig").groupBy("method", "idx", "desc", "constant").agg(F.bool_or(accepted(F.col("op"), F.col("operand"), F.col("constant"))).alias("bad")).where("bad")
    placed = hit.join(facts["unit"], ["method", "idx"])
    return _finding(placed, 0, F.col("desc"), CONSTANT_SCORE, F.col("text"), F.col("method"), F.col("constant"))


def implementers(classes: DataFrame, target: str) -> DataFrame:
    """``name``: what a hierarchy rule looks at.

    For an interface: declared implementers of it and of its sub-interfaces, and one
    level of their subclasses; for a class: its direct subclasses only.
    """
    declared = classes.select("name", F.explode("interfaces").alias("super"), "is_interface")
    spark = classes.sparkSession
    start = spark.createDataFrame([(target,)], "super string")

    def step(known: Relations, delta: Relations) -> Relations:
        return {"i": delta["i"].join(declared.where("is_interface"), "super").select(F.col("name").alias("super"))}

    interfaces = fixpoint({"i": start}, step)["i"]
    direct = declared.where("not is_interface").join(interfaces, "super").select("name").distinct()
    hop = classes.select("name", "super").join(direct.withColumnRenamed("name", "super").union(start), "super").select("name")
    return direct.union(hop).distinct()


def hierarchy_methods(facts: dict[str, DataFrame], target: str, subsig: str) -> DataFrame:
    """``sig, class`` of methods with a subsignature in the implementers of a type."""
    return facts["method"].where((F.col("subsig") == subsig) & F.col("has_body")).join(implementers(facts["class"], target).withColumnRenamed("name", "class"), "class").select("sig", "class")


def always_true_verifier(facts: dict[str, DataFrame]) -> DataFrame:
    found = hierarchy_methods(facts, "javax.net.ssl.HostnameVerifier", "boolean verify(java.lang.String,javax.net.ssl.SSLSession)")
    return _finding(found, 0, F.lit("custom hostname verifier"), METHOD_SCORE, dest_method=F.col("sig"))


def empty_trust_manager(facts: dict[str, DataFrame]) -> DataFrame:
    found = hierarchy_methods(facts, "javax.net.ssl.X509TrustManager", "void checkServerTrusted(java.security.cert.X509Certificate[],java.lang.String)")
    throws = facts["unit"].where("kind = 'throw'").select(F.col("method").alias("sig"))
    return _finding(found.join(throws, "sig", "left_anti"), 0, F.lit("trust manager accepts every certificate"), METHOD_SCORE, dest_method=F.col("sig"))


def ssl_error_proceed(facts: dict[str, DataFrame]) -> DataFrame:
    found = hierarchy_methods(facts, "android.webkit.WebViewClient", "void onReceivedSslError(android.webkit.WebView,android.webkit.SslErrorHandler,android.net.http.SslError)")
    proceed = facts["invoke"].where(F.col("target_sig") == "<android.webkit.SslErrorHandler: void proceed()>").select(F.col("method").alias("sig"))
    return _finding(found.join(proceed, "sig", "left_semi"), 0, F.lit("certificate errors are ignored"), METHOD_SCORE, dest_method=F.col("sig"))


# Fixed masks of the settings; the labels of the last two are swapped in reports.
_WEBVIEW = (("setAllowFileAccess", 0x100), ("setAllowFileAccessFromFileURLs", 0x010), ("setAllowUniversalAccessFromFileURLs", 0x001))


def webview_file_access(facts: dict[str, DataFrame]) -> DataFrame:
    """Bit mask of enabled settings per method; the score is a tenth of the mask."""
    calls = facts["invoke"].where(F.get("args", F.lit(0)) == "1")
    mask = F.lit(0)
    for name, bit in _WEBVIEW:
        mask = F.when(F.col("target_sig") == f"<android.webkit.WebSettings: void {name}(boolean)>", bit).otherwise(mask)
    per = calls.select("method", mask.alias("bit")).groupBy("method").agg(F.bit_or("bit").alias("mask")).where("mask > 0")
    label = F.format_string("file=%d universal=%d fromfile=%d", (F.col("mask").bitwiseAND(0x100) > 0).cast("int"), (F.col("mask").bitwiseAND(0x010) > 0).cast("int"), (F.col("mask").bitwiseAND(0x001) > 0).cast("int"))
    found = _finding(per, 0, F.lit("web view reads files"), 0.0, dest_method=F.col("method"), custom=label)
    scores = per.select(F.col("method").alias("dest_method"), (F.col("mask") * 0.1).cast("float").alias("score"))
    return found.drop("score").join(scores, "dest_method").select(*found.columns)


def webview_saved_passwords(facts: dict[str, DataFrame]) -> DataFrame:
    """Classes that take a web view's settings and never switch saving of passwords off."""
    owner = facts["method"].select(F.col("sig").alias("method"), "class")
    calls = facts["invoke"].join(owner, "method")
    uses = calls.where(F.col("target_sig") == "<android.webkit.WebView: android.webkit.WebSettings getSettings()>").select("class").distinct()
    off = calls.where((F.col("target_sig") == "<android.webkit.WebSettings: void setSavePassword(boolean)>") & (F.get("args", F.lit(0)) == "0")).select("class")
    return _finding(uses.join(off, "class", "left_anti"), 0, F.lit("web view saves passwords"), METHOD_SCORE, dest_method=F.col("class"))


def zip_entries(facts: dict[str, DataFrame]) -> DataFrame:
    found = facts["local"].where(F.col("type") == "java.util.zip.ZipEntry").select("method").distinct()
    return _finding(found, 0, F.lit("archive entries are read"), METHOD_SCORE, dest_method=F.col("method"))


def capability_leaks(facts: dict[str, DataFrame], calls: DataFrame, entries: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed signatures that a method reachable from the entries invokes."""
    reach = pointsto.reachable_methods(calls, entries)
    found = facts["invoke"].join(reach, "method", "left_semi").join(listed.select(F.col("sig").alias("target_sig")), "target_sig", "left_semi").join(facts["unit"].select("method", "idx", "text"), ["method", "idx"])
    return _finding(found, 5, F.lit("capability is reachable"), 0.0, F.col("text"), F.col("method"))


def exported_components(components: DataFrame) -> DataFrame:
    return components.where(exported(F.col("exported"), F.col("n_filters"), F.col("enabled")))


def manifest_findings(app: DataFrame) -> DataFrame:
    """``app(target_sdk, debuggable, allow_backup)``: backup counts as on, and the level as -1, where absent."""
    old = _finding(app.where(sdk_below(F.col("target_sdk"), 17)), 3, F.lit("target level below 17"), MANIFEST_SCORE)
    debug = _finding(app.where(F.coalesce("debuggable", F.lit(False))), 3, F.lit("debuggable"), MANIFEST_SCORE)
    backup = _finding(app.where(F.coalesce("allow_backup", F.lit(True))), 3, F.lit("backup is not disabled"), MANIFEST_SCORE)
    return old.unionByName(debug).unionByName(backup)


def fragment_injection(components: DataFrame, subtype: DataFrame, app: DataFrame) -> DataFrame:
    """Exported preference activities of apps with a target level below 17."""
    old = app.where(sdk_below(F.col("target_sdk"), 17)).limit(1)
    prefs = subtype.where(F.col("super") == "android.preference.PreferenceActivity").select(F.col("sub").alias("name"))
    found = exported_components(components).join(prefs, "name", "left_semi").join(old.select(F.lit(1).alias("one")), F.lit(1) == F.col("one"))
    return _finding(found, 3, F.lit("fragment injection"), MANIFEST_SCORE, dest_method=F.col("name"))
