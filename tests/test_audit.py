import json

from pyspark.sql import functions as F

from docwarden.operators import audit as au
from docwarden.operators import plan as pl
from docwarden.operators import rules as ru
from docwarden.operators.rules import RuleSet
from docwarden.sources import rule_files
from tests.helpers import BARE, BROKEN, CLEAN, PARTIAL, RULES, audit_of, docs_of, fired

SAMPLES = [CLEAN, BROKEN, PARTIAL, BARE]


def test_samples(spark):
    assert fired(audit_of(spark, SAMPLES)) == [
        [],
        ["FM002", "FM004", "FM005", "CT001", "CT002", "CT003", "CT004", "ST001"],
        ["FM002", "FM003", "CT002", "CT003", "CT004", "ST001"],
        ["FM001", "CT002"],
    ]


def test_summaries(spark):
    audited = audit_of(spark, SAMPLES)
    assert audited.count() == 4
    assert au.summary(audited).first().asDict() == {"files_audited": 4, "total_findings": 16, "error": 4, "warning": 5, "info": 7}
    counts = {r["severity"]: r["n"] for r in au.by_severity(audited).collect()}
    assert counts == {"error": 4, "warning": 5, "info": 7}
    assert {r["path"]: r["finding_count"] for r in au.file_results(audited).collect()} == {"d000.md": 0, "d001.md": 8, "d002.md": 6, "d003.md": 2}


def test_nothing_to_audit(spark):
    audited = audit_of(spark, [])
    assert au.summary(audited).first().asDict() == {"files_audited": 0, "total_findings": 0, "error": 0, "warning": 0, "info": 0}
    assert {r["severity"]: r["n"] for r in au.by_severity(audited).collect()} == {"error": 0, "warning": 0, "info": 0}
    assert pl.plan_items(au.findings(audited)).count() == 0
    assert {(r["dimension"], r["n"]) for r in pl.plan_summary(au.findings(audited)).collect()} == {("total", 0), ("fixable", 0)}


def test_details(spark):
    found = au.findings(audit_of(spark, [PARTIAL])).collect()
    details = {r["rule_id"]: r for r in found}
    assert list(details["FM003"]["missing_fields"]) == ["tags", "version"]
    assert list(details["FM002"]["schema_errors"]) == ["(root): 'version' is a required property", "(root): 'tags' is a required property"]
    assert details["CT002"]["schema_errors"] is None and details["CT002"]["missing_fields"] is None


def block(text, body="\n# Head\n\nFor example, this is long enough.\n"):
    return f"---\n{text}\n---\n{body}"


def test_blocks_that_are_no_mapping(spark):
    blocks = ["- a", "- verification", "plain text", "verification of text", "5", "yes", "2024-01-01", "# comment", "- id"]
    rows = fired(audit_of(spark, [block(b) for b in blocks]))
    assert rows == [["FM002", "CT003"], ["FM002"], ["FM002", "CT003"], ["FM002"], ["FM002"], ["FM002"], ["FM002"], ["FM001"], ["FM002", "CT003"]]


def test_null_and_odd_values(spark):
    rows = fired(audit_of(spark, [block("id:\nname: n\ndescription: long enough\nversion: 1.0\ntags: {a: 1}\nverification: 0")]))
    assert rows == [["FM002", "FM004", "CT003", "CT004"]]


def test_bodies(spark):
    assert fired(audit_of(spark, [block("id: a", "   \n"), block("id: a", "12345678901234567890"), block("id: a", "　1234567890123456789\x1f\n")], RuleSet(tuple(r for r in RULES.rules if r["id"] == "CT001")))) == [["CT001"], [], ["CT001"]]


def external(spark, entries):
    files = spark.createDataFrame([("x", "rules.json", json.dumps(entries))], "location string, name string, text string")
    return rule_files.rules_of_files(files)


def test_override_replaces_the_whole_rule(spark):
    merged = ru.merge(ru.built_in(spark), external(spark, [
        {"id": "CT002", "severity": "error"},
        {"id": "NEW2", "name": "second"},
        {"id": "NEW1", "fixable": "yes", "effort": None},
        {"id": "CT002", "name": None, "effort": "high"},
        {"name": "no id"},
        "not a rule",
    ]))
    rules = RuleSet.of_table(merged)
    table = {r["id"]: r for r in rules.table(spark).collect()}
    assert [r["id"] for r in rules.table(spark).orderBy("ord").collect()] == [*[r[0] for r in ru.BUILT_IN], "NEW2", "NEW1"]
    assert [r["id"] for r in rules.rules] == [r[0] for r in ru.BUILT_IN] and rules.provenance()["rule_count"] == 12
    ct002 = rules.by_id["CT002"]
    assert (ct002["name"], ct002["severity"], ct002["description"], ct002["effort"], ct002["fixable"]) == (None, "info", "", "high", False)
    assert (table["NEW1"]["fixable"], table["NEW1"]["effort"], table["NEW1"]["name"]) == (True, None, "NEW1")
    assert table["NEW2"]["effort"] == "unknown"
    assert fired(audit_of(spark, [BARE], rules)) == [["FM001", "CT002"]]  # NEW1 and NEW2 have no test
    scored = {r["id"]: (r["score"], r["risk"], r["action"]) for r in ru.with_scores(rules.table(spark)).collect()}
    assert scored["CT002"] == (23.5, "high", ru.ADVICE["CT002"])
    assert scored["NEW1"] == (22.0, "medium", ru.OTHER_ADVICE)
    assert {r["id"]: rules.urgency(r)[0] for r in rules.rules} == {k: v[0] for k, v in scored.items() if not k.startswith("NEW")}


def test_unknown_severity_is_counted(spark):
    odd = RuleSet(({**RULES.by_id["CT002"], "severity": "fatal"},))
    counts = {r["severity"]: r["n"] for r in au.by_severity(audit_of(spark, [BARE], odd)).collect()}
    assert counts == {"error": 0, "warning": 0, "info": 0, "fatal": 1}


def test_rule_files(spark, tmp_path):
    assert rule_files.fetch_rules(spark).is_baseline
    empty = rule_files.fetch_rules(spark, str(tmp_path), commit_sha="abc")
    assert empty.is_baseline and empty.commit_sha == "abc" and len(empty.rules) == 10
    (tmp_path / "rules.json").write_text("{broken")
    (tmp_path / "rules.yaml").write_text("rules:\n- id: FM001\n  severity: info\n")
    (tmp_path / "rules.yml").write_text("- id: FM002\n")
    rules = rule_files.fetch_rules(spark, str(tmp_path), commit_sha="abc")
    assert rules.by_id["FM001"]["severity"] == "info" and rules.by_id["FM001"]["fixable"] is False
    assert rules.by_id["FM002"]["severity"] == "error" and not rules.is_baseline
    assert rules.provenance()["rule_count"] == 10 and rules.provenance()["commit_sha"] == "abc"


def test_own_rule(spark):
    ru.register_rule("MY001", lambda d: F.contains(d.body, F.lit("secret")))
    try:
        mine = RuleSet(({"ord": 0, "id": "MY001", "name": "it's", "severity": "error", "description": "a\\b", "effort": "low", "fixable": None},))
        rows = au.findings(audit_of(spark, ["a secret", "nothing"], mine)).collect()
        assert [(r["path"], r["rule_id"], r["name"], r["description"], r["fixable"]) for r in rows] == [("d000.md", "MY001", "it's", "a\\b", None)]
    finally:
        del ru.CHECKS["MY001"]


def test_plan_of_one_document(spark):
    items = pl.plan_items(au.findings(audit_of(spark, [BROKEN]))).orderBy("rank").collect()
    assert [r["rule_id"] for r in items] == ["FM002", "FM004", "FM005", "CT004", "CT001", "ST001", "CT003", "CT002"]
    assert [r["rank"] for r in items] == list(range(1, 9))
    assert [r["risk"] for r in items] == ["medium", "low", "low", "medium", "high", "low", "medium", "high"]


def test_rank_equals_one_big_window(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 13).alias("score"), F.lit("r").alias("repo"), F.col("id").cast("string").alias("path"))
    got = pl.global_rank(df.repartition(7), ("score", "repo", "path"))
    df.createOrReplaceTempView("ranked")
    want = spark.sql("SELECT *, row_number() OVER (ORDER BY score, repo, path) AS rank FROM ranked")
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == 5000


def test_partitioning_does_not_matter(spark):
    texts = SAMPLES * 5
    one = au.findings(au.audit_docs(docs_of(spark, texts).coalesce(1), RULES))
    many = au.findings(au.audit_docs(docs_of(spark, texts).orderBy(F.desc("path")).repartition(11), RULES))
    assert one.exceptAll(many).count() == 0 and one.count() == many.count() == 80
    assert pl.plan_items(one).exceptAll(pl.plan_items(many)).count() == 0
