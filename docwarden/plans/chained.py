"""More named queries: every schema constraint, stages that start from stored reports, and search by mode.

Expected rows of the schema query are written out here by hand, apart from the code that finds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.functions import frontmatter as fm
from docwarden.functions import text as tx
from docwarden.operators import audit as au
from docwarden.operators import candidates as cd
from docwarden.operators import fix as fx
from docwarden.operators import migrate as mg
from docwarden.operators import plan as pl
from docwarden.operators import search as se
from docwarden.operators import word_index as wi
from docwarden.plans import registry as rg
from docwarden.plans.jobs import Audit, audit_manifest, run_fix, run_migrate
from docwarden.plans.oracles import ORACLES
from docwarden.plans.sample_corpus import raw_corpus
from docwarden.scratch import materialise, scratch_path
from docwarden.sources import corpus, reports, snapshots, writers
from docwarden.sources.tree import read_tree
from docwarden.streaming import running as ru

CHAINED: dict = {}
CHAINED_SQL: dict[str, str] = {}


def query(f):
    CHAINED[f.__name__] = f
    return f


# ---------------------------------------------------------------------------------------------
# Every constraint of the schema

_GOOD = {"id": "doc", "name": "Doc", "description": "A synthetic document", "version": "1.0.0", "tags": "[a, b]"}
_KEBAB = "^[a-z0-9]+(-[a-z0-9]+)*$"
_SEMVER = r"^\\d+\\.\\d+(\\.\\d+)?(-[a-zA-Z0-9.]+)?$"


def _block(**changed: str | None) -> str:
    return "".join(f"{k}: {v}\n" for k, v in (_GOOD | changed).items() if v is not None)


def _no(value: str, kind: str) -> str:
    return f"{value} is not of type '{kind}'"


def _lacks(name: str) -> str:
    return f"'{name}' is a required property"


# A block, and the (field, keyword, message) of each error it must give.
VARIANTS: list[tuple[str, list[tuple[str, str, str]]]] = [
    (_block(inputs="[{name: a, type: t, description: d, required: true}]", outputs="[{name: a, type: t}]", tooling="{models: [m], tools: [], min_context_tokens: 8}"), []),
    ("- a\n- b\n", [("(root)", "type", _no("['a', 'b']", "object"))]),
    ("just text\n", [("(root)", "type", _no("'just text'", "object"))]),
    (_block(id="5"), [("id", "type", _no("5", "string"))]),
    (_block(id="Bad_ID"), [("id", "pattern", f"'Bad_ID' does not match '{_KEBAB}'")]),
    (_block(name='""'), [("name", "minLength", "'' should be non-empty")]),
    (_block(name="[x]"), [("name", "type", _no("['x']", "string"))]),
    (_block(description="short"), [("description", "minLength", "'short' is too short")]),
    (_block(description="true"), [("description", "type", _no("True", "string"))]),
    (_block(version="v2"), [("version", "pattern", f"'v2' does not match '{_SEMVER}'")]),
    (_block(version="1.5"), [("version", "type", _no("1.5", "string"))]),
    (_block(tags="x"), [("tags", "type", _no("'x'", "array"))]),
    (_block(tags="[]"), [("tags", "minItems", "[] should be non-empty")]),
    (_block(tags="[a, a]"), [("tags", "uniqueItems", "['a', 'a'] has non-unique elements")]),
    (_block(tags='[a, 1, ""]'), [("tags.1", "type", _no("1", "string")), ("tags.2", "minLength", "'' should be non-empty")]),
    ("other: 1\n", [("(root)", "required", _lacks(n)) for n in _GOOD]),
    (_block(inputs="text"), [("inputs", "type", _no("'text'", "array"))]),
    (_block(inputs="[7, {name: a}]"), [("inputs.0", "type", _no("7", "object")), ("inputs.1", "required", _lacks("type"))]),
    (_block(inputs="[{type: t}]"), [("inputs.0", "required", _lacks("name"))]),
    (
        _block(inputs="[{name: 1, type: 2, description: 3, required: maybe}]"),
        [(f"inputs.0.{f}", "type", _no(v, "string")) for f, v in (("name", "1"), ("type", "2"), ("description", "3"))]
        + [("inputs.0.required", "type", _no("'maybe'", "boolean"))],
    ),
    (_block(outputs="3"), [("outputs", "type", _no("3", "array"))]),
    (_block(outputs="[x, {name: a}]"), [("outputs.0", "type", _no("'x'", "object")), ("outputs.1", "required", _lacks("type"))]),
    (_block(outputs="[{type: t}]"), [("outputs.0", "required", _lacks("name"))]),
    (
        _block(outputs="[{name: 1, type: 2, description: 3}]"),
        [(f"outputs.0.{f}", "type", _no(v, "string")) for f, v in (("name", "1"), ("type", "2"), ("description", "3"))],
    ),
    (_block(tooling="x"), [("tooling", "type", _no("'x'", "object"))]),
    (
        _block(tooling="{models: m, tools: t, min_context_tokens: many}"),
        [("tooling.models", "type", _no("'m'", "array")), ("tooling.tools", "type", _no("'t'", "array")), ("tooling.min_context_tokens", "type", _no("'many'", "integer"))],
    ),
    (
        _block(tooling="{models: [1], tools: [2.5], min_context_tokens: -5}"),
        [
            ("tooling.models.0", "type", _no("1", "string")),
            ("tooling.tools.0", "type", _no("2.5", "string")),
            ("tooling.min_context_tokens", "minimum", "-5 is less than the minimum of 0"),
        ],
    ),
    (
        _block(verification="1", source="2", migrated_at="2024-01-02"),
        [("verification", "type", _no("1", "string")), ("source", "type", _no("2", "string")), ("migrated_at", "type", _no("2024-01-02", "string"))],
    ),
    (_block(tags="[t0, t1, t2, t3, t4, t5, t6, t7, t8, t9, t10, 5]"), [("tags.11", "type", _no("5", "string"))]),
    (_block(custom="{deep: [1]}"), []),
    ("id: [broken\n", []),
    ("# only a comment\n", []),
]


def _text(value: str, escape: bool) -> str:
    value = value.replace("\\", "\\\\") if escape else value
    return "'" + (value.replace("'", "\\'") if escape else value.replace("'", "''")) + "'"


@query
def schema_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, each behind one of the blocks above: what the schema says of them."""
    blocks = F.array(*(F.lit(block) for block, _ in VARIANTS))
    block = F.element_at(blocks, (F.col("doc_id") % len(VARIANTS) + 1).cast("int"))
    content = F.concat(F.lit("---\n"), block, F.lit("---\n"), F.col("text"))
    docs = corpus.corpus_from_table(rg.documents(spark, sf), F.lit("r"), F.col("doc_id").cast("string"), content)
    checked = au.with_schema_errors(fm.with_frontmatter(docs)).select(F.col("path").cast("long").alias("doc_id"), F.explode_outer("schema_errors").alias("e"))
    return checked.where("e IS NOT NULL").select("doc_id", F.col("e.path").alias("field"), F.col("e.keyword").alias("keyword"), F.col("e.message").alias("message"))


CHAINED_SQL["schema_constraints"] = (
    "SELECT doc_id, field, keyword, message FROM documents JOIN (VALUES "
    + ", ".join(f"({k}, {_text(f, False)}, '{w}', {_text(m.replace(chr(92) * 2, chr(92) * 2), False)})" for k, (_, errors) in enumerate(VARIANTS) for f, w, m in errors)
    + f") AS e(k, field, keyword, message) ON doc_id % {len(VARIANTS)} = k"
)


# ---------------------------------------------------------------------------------------------
# Stages that start from what the one before stored


def _stored_plan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "plan")
    items = pl.plan_items(au.findings(rg.audited(spark, sf)))
    reports.write_plan(items, items, rg.RULES, path, rg.STAMP)
    return reports.read_plan(spark, path)


@query
def plan_json(spark: SparkSession, sf: str) -> DataFrame:
    return _stored_plan(spark, sf).drop("doc_key")


CHAINED_SQL["plan_json"] = ORACLES["plan_items"]


@query
def fix_from_plan(spark: SparkSession, sf: str) -> DataFrame:
    docs = rg.docs(spark, sf).select(*au.IDENTITY, "content")
    return fx.fix_actions(fx.fix_planned(_stored_plan(spark, sf), docs, rg.RULES))


CHAINED_SQL["fix_from_plan"] = ORACLES["fix_actions"]


@query
def plan_from_report(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "audit")
    reports.write_audit(rg.results(spark, sf), rg.RULES, path, rg.STAMP)
    return pl.plan_items(au.findings(reports.read_audit(spark, path))).drop("doc_key")


CHAINED_SQL["plan_from_report"] = ORACLES["plan_items"]


@query
def audit_from_manifest_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of all entries of that manifest: of those with joined texts and of those whose texts are gone."""
    path = scratch_path(spark, "manifest")
    docs = rg.docs(spark, sf)
    every = docs.where(cd.has_text_extension(F.col("path")))
    reports.write_manifest(cd.describe(every), spark.createDataFrame([("local",)], "type string"), path, rg.STAMP)
    there = docs.where(~F.col("path").rlike(r"\Aprompts/"))
    audited = au.audit_docs(audit_manifest(reports.read_manifest(spark, path), there), rg.RULES)
    return au.findings(audited).select("repo", "path", "rule_id")


# Entries are all but the images, doc_id % 7 = 5.
CHAINED_SQL["audit_from_manifest_findings"] = (
    f"SELECT repo, path, rule_id FROM ({ORACLES['findings']}) f WHERE NOT starts_with(path, 'prompts/') AND NOT ends_with(path, '.png') "
    "UNION ALL SELECT 'owner/' || source, 'prompts/doc-' || doc_id || '.md', rule_id "
    "FROM documents, (SELECT unnest(['FM001', 'CT001', 'CT002', 'ST001']) AS rule_id) r WHERE doc_id % 7 = 0"
)


def _on_disk(spark: SparkSession, sf: str) -> tuple[str, DataFrame, DataFrame]:
    """The corpus as files: their root, the documents as they are read back, and the list of files."""
    root = scratch_path(spark, "files")
    raw = raw_corpus(rg.documents(spark, sf))
    files = raw.select("repo", "path", F.concat_ws("/", F.lit(root), "repo", "path").alias("abs_path"), "content")
    written = materialise(writers.write_files(files), "written")
    if not written.where(~F.col("done")).isEmpty():
        raise OSError(f"could not write below {root}")
    names = materialise(files.drop("content"), "names")
    return root, materialise(corpus.read_files(names), "read-back"), names


_NUMBER = r"(\d+)\.[A-Za-z]+\z"


@query
def migrate_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Documents moved on disk, where a folder stands in the way of every third destination; what is there afterwards."""
    root, docs, names = _on_disk(spark, sf)
    skills = f"{root}/moved/skills"
    number = F.regexp_extract("path", _NUMBER, 1).cast("long")
    planned = mg.migrate_plan(fm.with_frontmatter(docs), skills)
    blocked = planned.where(number % 3 == 0).select(F.concat("dest_path", F.lit("/in-the-way.txt")).alias("abs_path"), F.lit("x").alias("content"))
    materialise(writers.write_files(blocked), "blocked")
    try:
        run_migrate(docs, skills, allow_delete=True, in_place=True)
        raise AssertionError("a deletion that is not applied must be refused")
    except ValueError:
        pass
    moved = run_migrate(docs, skills, apply=True, dry_run=False, allow_delete=True, write_pointer=False, in_place=True, migrated_at=rg.STAMP)
    source = corpus.read_contents(names).select("abs_path", F.col("content").isNotNull().alias("source_there"))
    left = read_tree(spark, [("moved", f"{root}/moved")]).select("abs_path", "content")  # folders are no copies
    flags = moved.actions.join(source, F.col("source_path") == F.col("abs_path")).drop("abs_path")
    copy = left.select("abs_path", F.sha2("content", 256).alias("copy_hash"))
    flags = flags.join(copy, F.col("dest_path") == F.col("abs_path"), "left")
    return flags.select(number.alias("doc_id"), "applied", "deleted_source", "wrote_pointer", "source_there", "copy_hash")


CHAINED_SQL["migrate_applied"] = f"""SELECT doc_id, doc_id % 3 <> 0 AS applied, doc_id % 3 <> 0 AS deleted_source, FALSE AS wrote_pointer, doc_id % 3 = 0 AS source_there,
CASE WHEN doc_id % 3 <> 0 THEN content_hash END AS copy_hash
FROM (SELECT CAST(regexp_extract(path, '(\\d+)\\.[A-Za-z]+$', 1) AS BIGINT) AS doc_id, content_hash FROM ({ORACLES['migrate_rendered']}) r) m"""


@query
def migrate_pointed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents copied on disk, with pointers written over their sources; what is there afterwards."""
    root, docs, names = _on_disk(spark, sf)
    moved = run_migrate(docs, f"{root}/moved/skills", skills_repo="owner/library", apply=True, dry_run=False, in_place=True, migrated_at=rg.STAMP)
    flags = moved.actions.where("applied AND wrote_pointer AND NOT deleted_source").select("source_path")
    left = corpus.read_files(names).join(flags, F.col("abs_path") == F.col("source_path"))
    return left.select("repo", "path", "content")


CHAINED_SQL["migrate_pointed"] = ORACLES["migrate_pointers"]


@query
def fix_in_place(spark: SparkSession, sf: str) -> DataFrame:
    """Documents read from files, fixed there, and read back: those that differ from what they were."""
    _, docs, names = _on_disk(spark, sf)
    before = docs.select("abs_path", F.col("content_hash").alias("was"))
    audited = au.audit_docs(docs, rg.RULES)
    done = run_fix(Audit(audited, audited, rg.RULES, rg.STAMP), apply=True, dry_run=False, in_place=True)
    if not done.written.where(~F.col("done")).isEmpty():
        raise OSError("a file could not be written")
    after = corpus.read_files(names).join(before, "abs_path").where(F.col("content_hash") != F.col("was"))
    return after.select("repo", "path", F.char_length("content").cast("long").alias("n_chars"), "content_hash")


CHAINED_SQL["fix_in_place"] = ORACLES["fix_apply"]


@query
def scan_object_store(spark: SparkSession, sf: str) -> DataFrame:
    """A whole tree, hidden folders and names with blanks included, through Spark's own file reading."""
    roots, _ = rg._as_tree(spark, sf)
    root = roots.select(F.regexp_replace("root", r"/owner/[^/]+\z", "")).first()[0]
    return corpus.scan_object_store(spark, "all", root).select("path", "content_hash", "size_bytes")


@query
def audit_from_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Findings per rule of all entries of a stored manifest, those whose texts are gone included."""
    return audit_from_manifest_findings(spark, sf).groupBy("rule_id").agg(F.count("*").alias("n"))


CHAINED_SQL["audit_from_manifest"] = f"SELECT rule_id, count(*) AS n FROM ({CHAINED_SQL['audit_from_manifest_findings']}) f GROUP BY rule_id"


# ---------------------------------------------------------------------------------------------
# Search by mode


@query
def document_index(spark: SparkSession, sf: str) -> DataFrame:
    """By words; by a vector table; and, without either, nothing."""
    words = se.DocumentIndex(rg.texts(spark, sf))
    vectors = rg.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.lit("").alias("content"))
    each = vectors.join(rg.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id").select("label", F.posexplode("embedding").alias("at", "v"))
    cells = each.groupBy("label", "at").agg(F.avg("v").alias("v")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("cells"))
    asked = cells.select(F.col("label").cast("long").alias("qid"), F.transform("cells", lambda c: c["v"]).alias("embedding"))
    dense = se.DocumentIndex(vectors.select("id", "content"), vectors=vectors.select("id", "embedding"))
    none = se.DocumentIndex(vectors.select("id", "content"), words=False)
    found = [("words", words.search(rg.questions(spark, sf))), ("vectors", dense.search(asked)), ("none", none.search(asked))]
    out = [rg._rounded(f).withColumn("mode", F.lit(name)) for name, f in found]
    return out[0].unionByName(out[1]).unionByName(out[2])


CHAINED_SQL["document_index"] = f"SELECT 'words' AS mode, w.* FROM ({ORACLES['bm25_topk']}) w UNION ALL SELECT 'vectors', v.qid, v.rank, v.id, v.score FROM ({ORACLES['cosine_topk']}) v"


@query
def embedding_cache_updated(spark: SparkSession, sf: str) -> DataFrame:
    """A stored cache that grows by versions: two updates, and between them a writer that adds known keys once more."""
    path = scratch_path(spark, "cache")
    d = rg.documents(spark, sf)
    first = se.update_cache(d.where(F.col("lang").isin("en", "fr")).select("text"), path, rg.letter_counts)
    version, content = snapshots.latest(spark, path)
    first.where(F.col("content_key") < "8").write.parquet(f"{path}/parts/double")
    snapshots.publish(spark, path, version, {"parts": [*content["parts"], "parts/double"]})
    everything = d.select("text").unionAll(rg.table(spark, sf, "conversations").select("text"))
    found = se.embed_texts(everything, se.update_cache(everything, path, rg.letter_counts))
    vector = rg.joined(F.transform("embedding", lambda v: v.cast("long").cast("string")))
    return found.groupBy("content_key").agg(F.count("*").alias("copies"), F.max(vector).alias("embedding"))


CHAINED_SQL["embedding_cache_updated"] = ORACLES["embedding_cache"]


@query
def search_index_grown(spark: SparkSession, sf: str) -> DataFrame:
    """An index of two thirds of the documents, to which the others are added, and every tenth once more and taken out again."""
    path = scratch_path(spark, "index")
    texts = rg.texts(spark, sf)
    twice = texts.where("id % 10 = 0").withColumn("id", -F.col("id") - 1)
    wi.build_index(texts.where("id % 3 > 0"), path)
    wi.add_documents(texts.where("id % 3 = 0").unionByName(twice), path)
    wi.remove_documents(spark, path, twice.select("id"))
    return rg._rounded(wi.search_index(spark, path, rg.questions(spark, sf)))


CHAINED_SQL["search_index_grown"] = ORACLES["search_index"]


# ---------------------------------------------------------------------------------------------
# Stored reports of changes


@query
def fix_report(spark: SparkSession, sf: str) -> DataFrame:
    """The stored report of a fix that is not applied: its counts, and its actions per rule."""
    path = scratch_path(spark, "fix-report")
    audited = au.audit_docs(rg.docs(spark, sf), rg.RULES)
    run_fix(Audit(audited, audited, rg.RULES, rg.STAMP), report_path=path)
    head, actions = reports.read_fix(spark, path)
    counts = head.where("dry_run AND NOT applied").select(F.inline(F.array(
        F.struct(F.lit("actions").alias("what"), F.col("actions_count").alias("n")),
        F.struct(F.lit("findings left").alias("what"), F.col("post_fix_audit_summary.total_findings").alias("n")),
    )))
    return counts.unionByName(actions.groupBy(F.col("rule_id").alias("what")).agg(F.count("*").alias("n")))


CHAINED_SQL["fix_report"] = f"""SELECT 'actions' AS what, count(*) AS n FROM ({ORACLES['fix_actions']}) a UNION ALL SELECT 'findings left', count(*) FROM ({ORACLES['fix_reaudit']}) r
UNION ALL SELECT rule_id, count(*) FROM ({ORACLES['fix_actions']}) a GROUP BY rule_id"""


@query
def migrate_from_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Relocated documents of a stored manifest, some of whose entries name no file, or one that is gone; counted in a report."""
    path = scratch_path(spark, "manifest")
    _, docs, _ = _on_disk(spark, sf)
    entries = cd.describe(docs)
    lost = entries.where(F.col("path").startswith("prompts/"))
    lost = lost.withColumn("abs_path", F.when(F.col("size_bytes") % 2 == 0, F.lit(" ")).otherwise(F.concat("abs_path", F.lit(".gone"))))
    reports.write_manifest(entries.unionByName(lost), spark.createDataFrame([("local",)], "type string"), path, rg.STAMP)
    moved = run_migrate(reports.read_manifest(spark, path), migrated_at=rg.STAMP, report_path=f"{path}/report")
    head, actions = reports.read_migrate(spark, f"{path}/report")
    rendered = moved.documents.select("repo", "path", F.char_length("content").cast("long").alias("n_chars"), tx.content_hash(F.col("content")).alias("content_hash"))
    planned = actions.where("NOT applied").select("repo", "path", "dest_rel")
    total = head.where("dry_run").select(F.lit("(all)").alias("repo"), F.lit("").alias("path"), F.lit("").alias("dest_rel"), F.col("summary.total").alias("n_chars"), F.lit("").alias("content_hash"))
    return rendered.join(planned, ["repo", "path"]).unionByName(total)


CHAINED_SQL["migrate_from_manifest"] = f"SELECT repo, path, dest_rel, n_chars, content_hash FROM ({ORACLES['migrate_rendered']}) r UNION ALL SELECT '(all)', '', '', count(*), '' FROM documents"


# ---------------------------------------------------------------------------------------------
# Documents that arrive in batches


BATCHES = 4


def _deliver(docs: DataFrame, inbox: str) -> int:
    """Write the documents as files that arrive in :data:`BATCHES` batches, and tell how many files a batch has.

    There are at least as many files as ``docs`` has splits, so that a task's share does not grow with the corpus.
    """
    per_batch = -(-max(1, docs.rdd.getNumPartitions()) // BATCHES)
    docs.repartition(BATCHES * per_batch, "doc_key").write.parquet(inbox)
    files = docs.sparkSession.read.schema(docs.schema).parquet(inbox).inputFiles()  # empty shares leave none
    return max(1, -(-len(files) // BATCHES))


def _forget_last_commit(spark: SparkSession, checkpoint: str) -> None:
    """As after a failure between the last batch's output and its commit: the batch will run again."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{checkpoint}/commits")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max(int(f.getPath().getName()) for f in system.listStatus(folder) if f.getPath().getName().isdigit())
    system.delete(hadoop.Path(folder, str(last)), False)


@query
def running_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus arrives in four batches, the last of which runs twice: findings per rule, and shared destinations."""
    name = F.concat_ws(".", F.concat_ws("/", "lang", "source"), F.col("doc_id").cast("string"))
    shared = corpus.corpus_from_table(rg.documents(spark, sf), F.lit("owner/all"), name, F.col("text"))
    frames = []
    for what, docs in (("findings", rg.docs(spark, sf)), ("destinations", shared)):
        inbox, out, checkpoint = (scratch_path(spark, f"{what}-{part}") for part in ("inbox", "totals", "checkpoint"))
        per_batch = _deliver(docs, inbox)
        for turn in range(2):
            stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", per_batch).parquet(inbox)
            run = ru.count_findings(stream, rg.RULES, out, checkpoint) if what == "findings" else ru.keep_destinations(stream, out, checkpoint)
            run.awaitTermination()
            if not turn:
                _forget_last_commit(spark, checkpoint)
        if what == "findings":
            frames.append(ru.finding_counts(spark, out).select(F.concat_ws("/", "rule_id", "severity").alias("key"), "n", F.lit(None).cast("string").alias("kept")))
        else:
            frames.append(ru.destinations(spark, out).select(F.col("dest_rel").alias("key"), F.col("n_sources").alias("n"), "kept"))
    return frames[0].unionByName(frames[1])


CHAINED_SQL["running_audit"] = f"""SELECT rule_id || '/' || severity AS key, count(*) AS n, NULL AS kept FROM ({ORACLES['findings']}) f GROUP BY rule_id, severity
UNION ALL SELECT * FROM (SELECT 'skills/general/owner-all-' || lang || '-' || source || '.md' AS key, count(*) AS n, '/corpus/owner/all/' || max(lang || '/' || source || '.' || doc_id) AS kept FROM documents GROUP BY 1) d"""
