from pyspark.sql import functions as F

from docwarden.functions.frontmatter import with_frontmatter
from docwarden.operators import audit as au
from docwarden.operators import fix as fx
from docwarden.operators import plan as pl
from docwarden.operators.rules import RuleSet
from tests.helpers import BARE, BROKEN, CLEAN, PARTIAL, RULES, audit_of, docs_of, fired


def fixed_texts(spark, texts, rules=RULES):
    fixed = fx.fix_audited(audit_of(spark, texts, rules), rules)
    return [(r["content"], list(r["applied"])) for r in fixed.orderBy("path").collect()]


def only(rule_id, **changes):
    return RuleSet(({**RULES.by_id[rule_id], **changes},))


def test_stub(spark):
    texts = ["# My  Awesome Skill! \n\nBody.", "no heading", "## ÄÖ\n", "---\nid: [x\n---\nbody"]
    got = fixed_texts(spark, texts, only("FM001"))
    stub = '---\nid: "%s"\nname: "%s"\ndescription: "TODO: describe this skill."\nversion: "0.1.0"\ntags: []\n---\n'
    names = [("my-awesome-skill", "My  Awesome Skill!"), ("untitled-skill", "Untitled Skill"), ("untitled-skill", "ÄÖ"), ("untitled-skill", "Untitled Skill")]
    assert [g[0] for g in got] == [stub % n + t for n, t in zip(names, texts)]


def test_kebab_id(spark):
    texts = [
        "---\nid: BadID\nname: x\n---\nid: BadID\n",
        '---\nid: "Bad ID"\n---\n',
        "---\nid: 'Single'\n---\n",
        "---\nuuid: BadID\nid: BadID\n---\n",
        "---\nid: good-id\n---\n",
        "---\nid: 1.5\n---\n",
    ]
    got = [g[0] for g in fixed_texts(spark, texts, only("FM004"))]
    assert got == [
        "---\nid: badid\nname: x\n---\nid: BadID\n",
        '---\nid: "bad-id"\n---\n',
        texts[2],
        "---\nuuid: badid\nid: BadID\n---\n",
        texts[4],
        "---\nid: 1-5\n---\n",
    ]


def test_version(spark):
    texts = [
        "---\nid: x\nversion: v2\n---\nversion: v2\n",
        "---\nversion:\n  v2\n---\n",
        "---\nversion: 1.2\n---\n",
        "---\n  version: v9\n---\nversion: later",
        "---\nversion: \"v2\" # note $1\n---\n",
    ]
    got = [g[0] for g in fixed_texts(spark, texts, only("FM005"))]
    assert got == [
        '---\nid: x\nversion: "0.1.0"\n---\nversion: v2\n',
        '---\nversion:\n  "0.1.0"\n---\n',
        texts[2],
        '---\n  version: v9\n---\nversion: "0.1.0"',
        '---\nversion: "0.1.0"\n---\n',
    ]


def test_heading(spark):
    texts = ["---\nname: My Doc\n---\n\n\nBody", "Body", "---\nid: x\n---\nBody", '---\nname: ""\n---\nBody', "---\nname:\n---\nB", "---\n- a\n---\nB", "---\n[]\n---\nB", "# Has\n"]
    got = [g[0] for g in fixed_texts(spark, texts, only("ST001"))]
    assert got == [
        "---\nname: My Doc\n---\n\n\n# My Doc\n\nBody",
        "# Skill\n\nBody",
        "---\nid: x\n---\n# Skill\n\nBody",
        '---\nname: ""\n---\n# \n\nBody',
        "---\nname:\n---\n# None\n\nB",
        texts[5],
        "---\n[]\n---\n# Skill\n\nB",
        texts[7],
    ]


def test_chain_and_reaudit(spark):
    fixed = fx.fix_audited(audit_of(spark, [CLEAN, BROKEN, PARTIAL, BARE]), RULES)
    done = {r["path"]: list(r["applied"]) for r in fixed.collect()}
    assert done == {"d000.md": [], "d001.md": ["FM004", "FM005", "ST001"], "d002.md": ["ST001"], "d003.md": ["FM001"]}
    again = fx.reaudit(fixed, RULES)
    assert fired(again) == [["FM002", "CT001", "CT002", "CT003", "CT004", "ST001"], ["FM002", "FM003", "CT002", "CT003", "CT004"], ["FM002", "CT002", "CT003", "CT004"]]
    delta = {r["rule_id"]: (r["before"], r["after"]) for r in fx.fix_delta(again).collect()}
    assert delta["FM001"] == (1, 0) and delta["ST001"] == (2, 1) and delta["FM002"] == (2, 3)
    actions = fx.fix_actions(fixed).collect()
    assert len(actions) == 5 and not any(r["applied"] for r in actions)
    assert {r["diff_summary"] for r in actions} == {f"Rule {i} fix applied." for i in ("FM001", "FM004", "FM005", "ST001")}


def test_heading_takes_the_name_the_stub_gave(spark):
    got = fixed_texts(spark, ["no heading here"])
    assert got[0][1] == ["FM001", "ST001"] and "---\n# Untitled Skill\n\nno heading here" in got[0][0]


def test_order_follows_the_rule_scores(spark):
    urgent = RuleSet(tuple({**r, "severity": "error", "ord": -1} if r["id"] == "ST001" else r for r in RULES.rules))
    assert fx.fixer_order(urgent) == ["ST001", "FM001", "FM004", "FM005"]
    got = fixed_texts(spark, ["no heading here"], urgent)
    assert got[0][1] == ["ST001", "FM001"]
    assert got[0][0].endswith("---\n# Skill\n\nno heading here") and 'name: "Skill"' in got[0][0]


def test_stub_with_a_quote_in_its_name(spark):
    fixed = fx.fix_audited(audit_of(spark, ['# Say "hi"\n']), RULES)
    assert "FM001" in fired(fx.reaudit(fixed, RULES))[0]


def test_unfixable_rules_are_left(spark):
    manual = RuleSet(tuple({**r, "fixable": False} for r in RULES.rules))
    assert [g[1] for g in fixed_texts(spark, [BROKEN, BARE], manual)] == [[], []]


def test_fixing_twice_changes_nothing(spark):
    first = fx.fix_audited(audit_of(spark, [CLEAN, PARTIAL, BARE, "text", "---\nid: A B\nname: n\nversion: x\n---\ntext"]), RULES)
    again = fx.fix_audited(au.audit_docs(fx.fixed_docs(first), RULES), RULES)
    assert again.where("touched").count() == 0 and again.count() == 4


def test_stored_plan(spark):
    docs = docs_of(spark, [CLEAN, BROKEN, PARTIAL, BARE])
    audited = au.audit_docs(docs, RULES)
    items = pl.plan_items(au.findings(audited))
    direct = fx.fixed_docs(fx.fix_audited(audited, RULES))
    planned = fx.fixed_docs(fx.fix_planned(items, docs, RULES))
    assert direct.exceptAll(planned).count() == 0 and planned.count() == 3
    some = fx.fix_planned(items.where("rule_id = 'FM005'"), docs, RULES)
    assert [list(r["applied"]) for r in some.collect()] == [["FM005"]]


def test_own_fixer(spark):
    fx.register_fixer("CT002", lambda: F.concat("content", F.lit("\nExample: none.\n")), edits_block=False)
    try:
        assert fixed_texts(spark, [BARE], only("CT002", fixable=True))[0][0] == BARE + "\nExample: none.\n"
    finally:
        del fx.FIXERS["CT002"]


def test_reparse_matches_a_fresh_parse(spark):
    fixed = fx.fix_audited(audit_of(spark, [CLEAN, BROKEN, PARTIAL, BARE, "x", "---\nid: [x\n---\nb"]), RULES)
    fresh = with_frontmatter(fixed.select("path", "content")).select("path", "fm", "head")
    assert fixed.select("path", "fm", "head").exceptAll(fresh).count() == 0


def test_a_stored_plan_decides(spark):
    """Items are fixed as they say, whatever the rule table says, in the order of their ranks."""
    manual = RuleSet(tuple({**r, "fixable": False} for r in RULES.rules))
    docs = audit_of(spark, [BROKEN, BARE]).select(*au.IDENTITY, "content", "findings")
    keys = [r["doc_key"] for r in docs.orderBy("path").collect()]
    rows = [(keys[0], "/x", "FM005", True, 1), (keys[0], "/x", "FM004", True, 2), (keys[0], "/x", "ST001", False, 3), (keys[1], "/x", "FM001", True, 4)]
    items = lambda r: spark.createDataFrame(r, "doc_key string, abs_path string, rule_id string, fixable boolean, rank long")
    for plan in (rows, rows + [(keys[1], "/x", "FM004", True, 5), (keys[1], "/x", "FM005", True, 6)]):  # the second has two orders
        fixed = {r["doc_key"]: list(r["applied"]) for r in fx.fix_planned(items(plan), docs, manual).collect()}
        assert fixed[keys[0]] == ["FM005", "FM004"] and fixed[keys[1]][0] == "FM001"
