"""Text functions give what the same patterns give in Python."""

import re
from pathlib import PurePosixPath

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docwarden.functions import text as tx
from docwarden.operators import candidates as cd
from tests.helpers import column_values

EDGES = [
    "",
    " ",
    "---\n---\nBody",
    "---\nid: x\n---",
    "---\nid: x\n---\n",
    "---\n\n---\n",
    "---\nid: x\n---\n\n\n  indented\n",
    "--- \t\nid: x\n---\x1c\nrest",
    "--- \nid: x\n--- \n\nrest",
    "---x\nid: x\n---\n",
    " ---\nid: x\n---\n",
    "---\nid: x\n----\nmore\n---\nend",
    "---\na\rb\n---\nend",
    "---\na ---\n \n---\nend",
    "# Head\n",
    "#Head\n",
    "####### seven\n",
    "#\n\nfoo",
    "text\n## Two  \x1f\nmore",
    "a\r# no heading\r",
    "a # no heading",
    "a\u0085# no heading",
    "  # indented",
    "# ",
    "#  \n",
    "```\n# in code\n```",
    "ÀÉ You Are, éact as",
    "you are you are² you are_ you are",
    "instruction instructions INSTRUCTIOŃ",
    "x{{a}}y {{b}} `{{c}}`",
    "é{{a\nb}}é é{{a}}é",
    "{UPPER_} {lower} {}",
    "ſystem prompt, SYSTEM PROMPT",
    "tail \x1c\x1d\x1e\x1f　",
    "﻿---\nid: x\n---\n",
]
# The signals as Python patterns.
PY_FENCE = re.compile(r"^---\s*\n(.*?)\n---\s*\n", re.DOTALL)
PY_SIGNALS = [
    re.compile(r"^---\s*\n", re.M),
    re.compile(r"\byou are\b", re.I),
    re.compile(r"\bsystem prompt\b", re.I),
    re.compile(r"\binstruction\b", re.I),
    re.compile(r"\bact as\b", re.I),
    re.compile(r"\b{{.*?}}\b"),
    re.compile(r"\{[A-Z_]+\}"),
]
alphabet = st.sampled_from(list("-# \n\t\r\x1c  aAéİı:{}_.1²/") + ["---\n", "you are", "{{x}}", "act as"])
random_texts = st.lists(st.lists(alphabet, max_size=14).map("".join), min_size=20, max_size=60)
few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def check(spark, values, make, expect):
    got = column_values(spark, values, make)
    for value, g in zip(values, got):
        assert g == expect(value), repr(value)


def all_of(spark, values):
    check(spark, values, tx.fence_head, lambda s: (m := PY_FENCE.match(s)) and m.group(0) or "")
    check(spark, values, lambda c: tx.fence_block(tx.fence_head(c)), lambda s: (m := PY_FENCE.match(s)) and m.group(1))
    check(spark, values, tx.strip, str.strip)
    check(spark, values, lambda c: c.rlike(tx.HEADING), lambda s: bool(re.search(r"^#{1,6}\s+\S", s, re.M)))
    check(spark, values, tx.first_heading, lambda s: (m := re.search(r"^#{1,6}\s+(.+)$", s, re.M)) and m.group(1).strip())
    check(spark, values, lambda c: F.concat_ws("|", tx.tokenise(c)), lambda s: "|".join(s.lower().split()))
    check(spark, values, tx.kebab, lambda s: re.sub(r"[^a-z0-9]+", "-", s.lower()).strip("-"))
    check(spark, values, cd.content_signals, lambda s: sum(bool(p.search(s)) for p in PY_SIGNALS))


def test_edges(spark):
    all_of(spark, EDGES)


@few
@given(random_texts)
def test_random(spark, values):
    all_of(spark, values)


def test_long_text_is_linear(spark):
    values = ["---\n" + "a: b\n" * 300_000, " " * 500_000 + "x" + " " * 500_000, "a-" * 200_000 + "a"]
    assert column_values(spark, values, tx.fence_head)[0] == ""
    assert column_values(spark, values, tx.strip)[1] == "x"
    assert column_values(spark, values, lambda c: c.rlike(tx.KEBAB_ID)) == [False, False, True]


def test_ids_and_versions(spark):
    ids = ["a", "a-b", "a--b", "-a", "a-", "A", "a_b", "a\n", "a\r", "", "a-b-c1", "٣"]
    check(spark, ids, lambda c: c.rlike(tx.KEBAB_ID), lambda s: bool(re.match(r"^[a-z0-9]+(-[a-z0-9]+)*$", s)))
    versions = ["1.0", "1.0.0", "v1.0", "1", "1.0-rc.1", "1.0.0-", "1.0.0\n", "1.0.0.0", "٣.١", "1.0 "]
    check(spark, versions, lambda c: c.rlike(tx.SEMVER), lambda s: bool(re.match(r"^\d+\.\d+(\.\d+)?(-[a-zA-Z0-9.]+)?$", s)))


def test_malformed_bytes(spark):
    values = [b"ok\r\nline\rend", b"a\xffb", b"\xe2\x82", b"\xf0\x9f\x98", b"\xc0\xaf", b"\xed\xa0\x80x", "é☃".encode()]
    expect = lambda b: b.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
    got = column_values(spark, values, tx.normalise_text, "binary")
    assert got == [expect(v) for v in values]


def test_stable_id(spark):
    cases = [
        ("owner/repo", "prompts/Code Review.md", "owner-repo-prompts-code-review"),
        ("o/r", "a.b/c", "o-r-a"),
        ("Repo", "x.tar.gz", "repo-x-tar"),
        ("r", "---", "r"),
    ]
    df = spark.createDataFrame(cases, "repo string, path string, want string")
    for row in df.select("want", tx.stable_id(F.col("repo"), F.col("path")).alias("got")).collect():
        assert row["got"] == row["want"]


def test_replace_first_is_literal(spark):
    cases = [("id: a.b id: a.b", "id: a.b", "id: $1"), ("none", "x", "y"), ("ééid: x", "id: x", "id: z")]
    df = spark.createDataFrame(cases, "t string, o string, n string")
    rows = df.select("t", "o", "n", tx.replace_first(F.col("t"), F.col("o"), F.col("n")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["t"].replace(r["o"], r["n"], 1) for r in rows]


def test_repositories(spark):
    specs = ["owner/name", "https://host/a/b.git", "git@host:a/b.git", "plain", "/srv/repo/", "https://host/a/b/", "owner/name "]
    assert column_values(spark, specs, tx.repo_url)[:4] == ["https://github.com/owner/name.git", *specs[1:4]]
    assert column_values(spark, specs, tx.source_label) == ["owner/name", "b", "b", "plain", "/srv/repo/", "b", "owner/name"]


PATHS = ["a/b.md", "a/.md", "a/b.", "a/..md", "a/b.MD", "a/b.tar.gz", "a/b.skill", "b.prompt", "x/y.markdown", "x.txt/y", "n.t.xt"]


def test_extension(spark):
    suffix = lambda p: "" if p.endswith(".") else PurePosixPath(p).suffix.lower()
    check(spark, PATHS, cd.extension, suffix)


def test_path_signals(spark):
    names = ["my-prompt.md", "SKILL.md", "system_message.md", "systemmessage.txt", "system  message.md", "temPlate.md", "notes.md", "ſkill.md"]
    patterns = ["prompt", "skill", "instruction", "system[-_]?message", "template"]
    check(spark, names, cd.name_signal, lambda s: any(re.search(p, s, re.I) for p in patterns))
    dirs = ["a/prompts/x", "chai/x", "mumbai", "aix/b", "x/agents", "agent s/x", "AI", "copilot/x", "llms/x", "x/Skill\n/y", "ski ll/y"]
    ends = r"(prompts?|skills?|instructions?|templates?|agents?|ai|copilot|llm)$"
    check(spark, dirs, cd.dir_signal, lambda s: any(re.search(ends, p, re.I) for p in s.split("/")))


def test_candidates(spark):
    cases = [
        ("prompts/anything.md", "content", True),
        ("image.png", "You are. Act as.", False),
        ("regular.md", "hello world", False),
        ("misc.md", "You are a helper.\nAct as a judge.", True),
        ("notes.md", "---\nfoo: bar\n---\nYou are here.", True),
        ("notes.md", "you are one signal", False),
    ]
    df = spark.createDataFrame(cases, "path string, content string, want boolean")
    for r in df.select("want", cd.is_candidate(F.col("path"), F.col("content")).alias("got")).collect():
        assert r["got"] == r["want"]
    assert column_values(spark, ["misc.md"], lambda c: cd.is_candidate(c)) == [False]


def test_ignored_folders(spark):
    paths = ["a/.git/x.md", "node_modules/x.md", "Build/x.md", "build.md", "x/dist/y.md", "dist", "x/.venvs/y.md"]
    assert column_values(spark, paths, cd.in_ignored_dir) == [True, True, False, False, True, False, False]
