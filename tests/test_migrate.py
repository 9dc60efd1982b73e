import pytest
from pyspark.sql import functions as F

from docwarden.functions.frontmatter import with_frontmatter
from docwarden.operators import migrate as mg
from docwarden.sources.corpus import as_docs
from tests.helpers import BARE, BROKEN, CLEAN, parsed_of


def plan_of(spark, texts, **options):
    return mg.migrate_plan(parsed_of(spark, texts), **options)


def block(text):
    return f"---\n{text}\n---\nbody\n"


def test_domains_and_ids(spark):
    texts = [block("tags: [Code Review, b]"), block("tags: []"), block("tags: x"), block("tags: ['--']"), block("tags: [ÄB]"), block("tags: [7]"), BARE, block("id: 7\ntags: [a]"), block("id: ''"), block("id: 2024-01-02")]
    rows = plan_of(spark, texts).orderBy("path").collect()
    assert [r["domain"] for r in rows] == ["code-review", "general", "general", "general", "b", "7", "general", "a", "general", "general"]
    assert rows[6]["skill_id"] == "owner-repo-d006" and rows[7]["skill_id"] == "7"
    assert rows[8]["skill_id"] == "owner-repo-d008" and rows[9]["dest_rel"] == "skills/general/2024-01-02.md"


def test_odd_blocks(spark):
    rows = plan_of(spark, [block("- a"), block("text"), block("[]"), block("''"), block("# c"), block("5")]).orderBy("path").collect()
    assert [r["status"] == "ok" for r in rows] == [False, False, True, True, True, False]
    assert rows[0]["dest_rel"] is None


def test_destination_is_beside_the_root(spark):
    assert plan_of(spark, [CLEAN], skills_root="/lib/anything/").first()["dest_path"] == "/lib/skills/logs/log-reader.md"
    assert plan_of(spark, [CLEAN]).first()["dest_path"] == "skills/logs/log-reader.md"


def flags(plan, **options):
    r = mg.migrate_actions(plan, **options).first()
    return r["applied"], r["wrote_pointer"], r["deleted_source"]


def test_flags(spark):
    plan = plan_of(spark, [CLEAN])
    assert flags(plan) == (False, False, False)
    assert flags(plan, apply=True) == (False, False, False)
    assert flags(plan, apply=True, dry_run=False) == (True, True, False)
    assert flags(plan, apply=True, dry_run=False, allow_delete=True) == (True, True, False)
    assert flags(plan, apply=True, dry_run=False, allow_delete=True, write_pointer=False) == (True, False, True)
    with pytest.raises(ValueError):
        mg.migrate_actions(plan, allow_delete=True)
    summary = mg.migrate_summary(mg.migrate_actions(plan, apply=True, dry_run=False)).first().asDict()
    assert summary == {"total": 1, "applied": 1, "pointers_written": 1, "deleted": 0}


def test_blank_paths_are_skipped(spark):
    df = spark.createDataFrame([("r", "a.md", "", "x"), ("r", "b.md", "/b.md", "x")], "repo string, path string, abs_path string, content string")
    assert mg.migrate_plan(with_frontmatter(as_docs(df))).count() == 1


def test_rendered(spark):
    rows = mg.migrate_rendered(plan_of(spark, [block("tags: [a]\nsource: old\nwhen: 2024-01-02"), BARE]), "NOW").orderBy("path").collect()
    assert rows[0]["content"] == "---\ntags:\n- a\nsource: https://github.com/owner/repo\nwhen: 2024-01-02\nid: owner-repo-d000\nmigrated_at: NOW\n---\nbody\n"
    assert rows[1]["content"] == "---\nid: owner-repo-d001\nsource: https://github.com/owner/repo\nmigrated_at: NOW\n---\n" + BARE


def test_pointer(spark):
    text = mg.migrate_pointers(plan_of(spark, [CLEAN]), "me/lib").first()["content"]
    url = "https://github.com/me/lib/blob/main/skills/logs/log-reader.md"
    assert text == f"<!-- This file was migrated to [me/lib]({url}). -->\n\n**Skill `log-reader` has been migrated.**  \nSee: {url}\n"


def test_collisions(spark):
    plan = plan_of(spark, [block("id: same")] * 3 + [block("id: other"), BROKEN, block("- bad")])
    rows = mg.migrate_collisions(plan).collect()
    assert [(r["dest_rel"], r["n_sources"], r["kept"]) for r in rows] == [("skills/general/same.md", 3, "/x/d002.md")]
    assert sorted(r["path"] for r in mg.surviving(plan).collect()) == ["d002.md", "d003.md", "d004.md", "d005.md"]


def test_one_hot_destination(spark):
    """A third of all documents share one destination, others collide in pairs."""
    raw = spark.range(6000).select(
        F.lit("r").alias("repo"),
        F.format_string("%05d.md", "id").alias("path"),
        F.format_string("/r/%05d.md", "id").alias("abs_path"),
        F.format_string("---\nid: %s\n---\n", F.when(F.col("id") < 2000, "hot").otherwise(F.format_string("k%s", F.col("id") % 2000))).alias("content"),
    )
    plan = mg.migrate_plan(with_frontmatter(as_docs(raw)))
    kept = mg.surviving(plan).select("path", "skill_id")
    last = plan.groupBy("skill_id").agg(F.max("path").alias("path")).select("path", "skill_id")
    assert kept.count() == 2001 and kept.exceptAll(last).count() == 0
