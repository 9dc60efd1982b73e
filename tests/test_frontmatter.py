import pytest
from pyspark.sql import functions as F

from docwarden.functions import frontmatter as fm
from docwarden.functions.schema import schema_errors
from tests.helpers import BROKEN, CLEAN, PARTIAL, docs_of, parsed_of


def block(*lines):
    return "---\n" + "\n".join(lines) + "\n---\nbody\n"


def rows(df):
    return df.orderBy("path").collect()


def test_value_kinds(spark):
    lines = ["version: 1.0", "version: 1.0.0", "version: 007", "version: yes", "version: 2024-01-02", "version:", "version: [1, a]", "version: {a: 1}"]
    out = rows(parsed_of(spark, [block(x) for x in lines]).select("path", "fm.version.*"))
    assert [(r["kind"], r["text"]) for r in out] == [
        ("float", "1.0"),
        ("string", "1.0.0"),
        ("int", "7"),
        ("bool", "True"),
        ("date", "2024-01-02"),
        ("null", "None"),
        ("list", "[1, 'a']"),
        ("map", "{'a': 1}"),
    ]
    assert [r["truthy"] for r in out] == [True, True, True, True, True, False, True, True]


def test_bodies(spark):
    texts = ["---\nid: [a\n---\nrest\n", "---\n# only a comment\n---\n\nrest\n", "no fence", "---\nid: x\n---\n\n  rest"]
    out = rows(parsed_of(spark, texts).select("path", "body", fm.present(F.col("fm")).alias("has")))
    assert [r["body"] for r in out] == [texts[0], "rest\n", "no fence", "  rest"]
    assert [r["has"] for r in out] == [False, False, False, True]


def test_odd_blocks_do_not_stop_the_job(spark):
    texts = [block("a: 2024-13-45"), block('a: "\\ud800"'), block("? [x]\n: y"), block("- a\n- b"), block("just text"), block("a: &x [1]\nb: *x"), block("n: " + "9" * 5000), block("a: 1\na: 2")]
    out = rows(parsed_of(spark, texts).select("path", "fm.kind", "fm.json"))
    assert [r["kind"] for r in out] == [None, "map", None, "list", "string", "map", None, "map"]
    assert out[7]["json"] == '{"a": 2}'


def test_long_form(spark):
    out = fm.frontmatter_long(parsed_of(spark, [CLEAN])).drop("doc_key").collect()
    got = {r["key_path"]: (r["kind"], r["value"]) for r in out}
    assert got["inputs.0.required"] == ("bool", "True")
    assert got["tooling.min_context_tokens"] == ("int", "2048")
    assert got["tags.1"] == ("string", "ops")
    assert got["outputs.0.name"] == ("string", "report")
    assert got["tooling.models.0"] == ("string", "m1")


def errors_of(spark, texts):
    out = rows(parsed_of(spark, texts).select("path", schema_errors("fm").alias("e")))
    return [[(e["path"], e["keyword"]) for e in r["e"]] for r in out]


def test_schema_of_samples(spark):
    assert errors_of(spark, [CLEAN, BROKEN, PARTIAL, "none", block("- a")]) == [
        [],
        [("description", "minLength"), ("id", "pattern"), ("name", "minLength"), ("tags", "minItems"), ("version", "pattern")],
        [("(root)", "required"), ("(root)", "required")],
        [],
        [("(root)", "type")],
    ]


GOOD = ["id: a", "name: b", "description: ten letters", "version: 1.0.0", "tags: [x]"]


def test_each_constraint(spark):
    cases = {
        "id: 5": [("id", "type")],
        "name: 5": [("name", "type")],
        "description:": [("description", "type")],
        "version: 1.0": [("version", "type")],
        "tags: x": [("tags", "type")],
        "tags: [1, '', a]": [("tags.0", "type"), ("tags.1", "minLength")],
        "tags: [a, b, a]": [("tags", "uniqueItems")],
        "tags: [1, 1.0]": [("tags", "uniqueItems"), ("tags.0", "type"), ("tags.1", "type")],
        "tags: [1, true]": [("tags.0", "type"), ("tags.1", "type")],
        "inputs: x": [("inputs", "type")],
        "inputs: [x]": [("inputs.0", "type")],
        "inputs: [{name: a}]": [("inputs.0", "required")],
        "inputs: [{type: 1, name: 2, description: 3, required: 4}]": [("inputs.0.description", "type"), ("inputs.0.name", "type"), ("inputs.0.required", "type"), ("inputs.0.type", "type")],
        "outputs: 1": [("outputs", "type")],
        "outputs: [[]]": [("outputs.0", "type")],
        "outputs: [{}]": [("outputs.0", "required"), ("outputs.0", "required")],
        "outputs: [{type: 1, name: 2, description: 3, required: 4}]": [("outputs.0.description", "type"), ("outputs.0.name", "type"), ("outputs.0.type", "type")],
        "tooling: x": [("tooling", "type")],
        "tooling: {models: 1, tools: 2, min_context_tokens: x}": [("tooling.min_context_tokens", "type"), ("tooling.models", "type"), ("tooling.tools", "type")],
        "tooling: {models: [1], tools: [2], min_context_tokens: -1}": [("tooling.min_context_tokens", "minimum"), ("tooling.models.0", "type"), ("tooling.tools.0", "type")],
        "tooling: {min_context_tokens: 4096.0}": [],
        "tooling: {min_context_tokens: 1.5}": [("tooling.min_context_tokens", "type")],
        "tooling: {min_context_tokens: true}": [("tooling.min_context_tokens", "type")],
        "verification: 1": [("verification", "type")],
        "source: 1": [("source", "type")],
        "migrated_at: 2024-01-01": [("migrated_at", "type")],
        "extra: {anything: goes}": [],
    }
    texts = [block(*[g for g in GOOD if g.split(":")[0] != c.split(":")[0]], c) for c in cases]
    for case, got in zip(cases, errors_of(spark, texts)):
        assert got == cases[case], case


def test_list_elements_sort_by_number(spark):
    tags = "tags: [" + ", ".join(["1"] + [f"t{i}" for i in range(1, 10)] + ["2"]) + "]"
    assert errors_of(spark, [block(*GOOD[:4], tags)]) == [[("tags.0", "type"), ("tags.10", "type")]]


def test_render_keeps_order_and_unicode(spark):
    docs = docs_of(spark, [block("name: Ä", "id: ''", "when: 2024-01-02", "tags: [a]")])
    cut = fm.with_block(docs)
    text = cut.select(fm.render_block(F.col("block"), F.lit("new"), F.lit("src"), F.lit("now"))).first()[0]
    assert text == "name: Ä\nid: new\nwhen: 2024-01-02\ntags:\n- a\nsource: src\nmigrated_at: now\n"


def test_long_view_has_every_key_at_any_depth(spark):
    block = "id: a\ncustom:\n  deep: [1, {x: y}]\ntooling:\n  other: z\ninputs:\n- name: n\n  more: [q]\n"
    docs = parsed_of(spark, [f"---\n{block}---\n", "---\n- 1\n- {k: v}\n---\n", "---\n[bad\n---\n", "no block"])
    rows = fm.frontmatter_long(docs).collect()
    got = {(r["key_path"], r["kind"], r["value"]) for r in rows}
    for row in [("id", "string", "a"), ("custom.deep.0", "int", "1"), ("custom.deep.1.x", "string", "y"), ("tooling.other", "string", "z"), ("inputs.0.more.0", "string", "q"), ("0", "int", "1"), ("1.k", "string", "v")]:
        assert row in got
    assert len(rows) == len(got) == 16


def test_long_view_of_deep_values_and_of_values_in_themselves(spark):
    deep = "a:\n" + "".join("  " * i + f"k{i}:\n" for i in range(1, 60)) + "  " * 60 + "end: 1\n"
    own = "b: &b\n  c: 1\n  again: *b\nd: &d\n- *d\n- x\ntwice: [&e {f: 1}, *e]\n"
    docs = parsed_of(spark, [f"---\n{deep}---\n", f"---\n{own}---\n"])
    got = {r["key_path"]: r["kind"] for r in fm.frontmatter_long(docs).collect()}
    path = "a." + ".".join(f"k{i}" for i in range(1, 60)) + ".end"
    assert got[path] == "int" and len([p for p in got if p.startswith("a")]) == 61
    assert got["b.c"] == "int" and got["b.again"] == "map" and "b.again.again" not in got
    assert got["d.0"] == "list" and got["d.1"] == "string" and "d.0.0" not in got
    assert got["twice.0.f"] == got["twice.1.f"] == "int"


@pytest.mark.parametrize("shared", [20_000, 0])
def test_each_distinct_block_is_parsed_once(spark, monkeypatch, shared):
    monkeypatch.setattr(fm, "MAX_SHARED_BLOCKS", shared)
    texts = [f"---\nid: a{i % 40 if i < 200 else i}\n---\nbody {i}" for i in range(260)] + ["---\n[bad\n---\nx"] * 5 + ["no block", "---\n\n---\nempty"] * 3
    docs = docs_of(spark, texts).repartition(7)
    loads = spark.sparkContext.accumulator(0)
    got = fm.with_distinct_frontmatter(docs, loads=loads).select("path", "fm", "body").collect()
    assert loads.value == len({t.split("---")[1] for t in texts if t.startswith("---")})
    want = fm.with_frontmatter(docs).select("path", "fm", "body").collect()
    assert sorted(got, key=lambda r: r["path"]) == sorted(want, key=lambda r: r["path"])


class _Row(dict):
    alive = most = 0

    def __init__(self, *args):
        super().__init__(*args)
        _Row.alive += 1
        _Row.most = max(_Row.most, _Row.alive)

    def __del__(self):
        _Row.alive -= 1


def test_few_parsed_blocks_are_python_values_at_once(monkeypatch):
    import pyarrow as pa

    from docwarden.functions import frontmatter as fm

    typed = fm._typed
    monkeypatch.setattr(fm, "_typed", lambda block: _Row(typed(block)))
    out = fm._parse_udf().func(pa.array([f"id: a{i}" for i in range(3000)]))
    assert [x["id"]["text"] for x in out.to_pylist()] == [f"a{i}" for i in range(3000)]
    assert _Row.most <= 1000


def test_rows_without_a_block_are_not_converted(monkeypatch):
    import pyarrow as pa

    from docwarden.functions import frontmatter as fm

    made = []

    class Watched:
        def __getattr__(self, name):
            return getattr(pa, name)

        def array(self, values, *args, **more):
            made.append(len(values))
            return pa.array(values, *args, **more)

    monkeypatch.setattr(fm, "pa", Watched())
    blocks = [None] * 5000
    blocks[7] = blocks[4000] = "id: one"
    blocks[9] = "id: [broken"
    out = fm._parse_udf().func(pa.array(blocks, pa.string()))
    assert [i for i, x in enumerate(out.to_pylist()) if x is not None] == [7, 4000] and out[7] == out[4000]
    assert sum(made) <= 10
    assert len(fm._parse_udf().func(pa.array([None] * 3, pa.string()))) == 3
