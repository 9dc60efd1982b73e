"""Named queries over the standard test tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.functions import frontmatter as fm
from docwarden.functions import text as tx
from docwarden.functions.shaping import spread
from docwarden.operators import audit as au
from docwarden.operators import candidates as cd
from docwarden.operators import fix as fx
from docwarden.operators import migrate as mg
from docwarden.operators import plan as pl
from docwarden.operators import rules as ru
from docwarden.operators import search as se
from docwarden.operators import vector_index as vi
from docwarden.operators import word_index as wi
from docwarden.operators.rules import RuleSet
from docwarden.plans.jobs import describe_sources
from docwarden.plans.sample_corpus import raw_corpus, sample_corpus
from docwarden.scratch import materialise, scratch_path
from docwarden.sources import corpus, reports, rule_files, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
STAMP = "2024-01-01T00:00:00Z"
RULES = RuleSet.baseline(fetched_at=STAMP)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return sample_corpus(documents(spark, sf))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return fm.with_frontmatter(docs(spark, sf))


def audited(spark: SparkSession, sf: str) -> DataFrame:
    return au.audit_docs(docs(spark, sf), RULES)


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Audit results without texts, written once for steps that read them several times."""
    return materialise(audited(spark, sf).select(*au.IDENTITY, "content_hash", "findings"), "audited")


def fixed(spark: SparkSession, sf: str) -> DataFrame:
    return fx.fix_audited(audited(spark, sf), RULES)


def planned(spark: SparkSession, sf: str) -> DataFrame:
    return mg.migrate_plan(fm.with_frontmatter(docs(spark, sf)))


def joined(column: Column) -> Column:
    return F.concat_ws("|", column)


# ---------------------------------------------------------------------------------------------
# Sources


def _as_tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The corpus as files in the scratch folder: its roots, and its ``(path)`` list."""
    root = scratch_path(spark, "tree")
    raw = raw_corpus(documents(spark, sf)).withColumn("root", F.concat(F.lit(root + "/"), F.col("repo")))
    files = raw.select("repo", "root", F.concat_ws("/", "root", "path").alias("abs_path"), "content")
    done = materialise(writers.write_files(files), "tree-written")
    if not done.where(~F.col("done")).isEmpty():
        raise OSError(f"could not write below {root}")
    return raw.select("repo", "root").distinct(), done.select("path")


@query
def scan_tree(spark: SparkSession, sf: str) -> DataFrame:
    roots, _ = _as_tree(spark, sf)
    found = cd.candidates(corpus.scan_tree(roots), "relative")
    return found.select("repo", "path", "content_hash", "size_bytes")


@query
def scan_files(spark: SparkSession, sf: str) -> DataFrame:
    _, paths = _as_tree(spark, sf)
    return corpus.scan_files(paths).select("path", "content_hash", "size_bytes")


@query
def corpus_from_table(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    made = corpus.corpus_from_table(documents(spark, sf), F.col("source"), name, F.col("text"))
    return made.select("doc_key", "repo", "path", "abs_path", "content_hash", "size_bytes")


@query
def scan_sources(spark: SparkSession, sf: str) -> DataFrame:
    specs = documents(spark, sf).select(F.concat(F.lit("owner/"), F.col("source")).alias("spec")).distinct()
    roots = describe_sources(specs).select("label", "url")
    return corpus.sources_table(roots, cd.candidates(docs(spark, sf)))


@query
def scan_manifest(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "manifest")
    entries = cd.describe(cd.candidates(docs(spark, sf)))
    specs = documents(spark, sf).select(F.concat(F.lit("owner/"), F.col("source")).alias("spec")).distinct()
    reports.write_manifest(entries, describe_sources(specs), path, STAMP)
    return spark.read.schema(entries.schema).json(f"{path}/candidates").drop("frontmatter", "abs_path")


@query
def scan_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return cd.describe(cd.candidates(docs(spark, sf)))


# ---------------------------------------------------------------------------------------------
# Filters and signals


@query
def filter_extension(spark: SparkSession, sf: str) -> DataFrame:
    kept = docs(spark, sf).where(cd.has_text_extension(F.col("path")))
    return kept.select("repo", "path", cd.extension(F.col("path")).alias("extension"))


@query
def filter_ignored_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).where(~cd.in_ignored_dir(F.col("path"))).select("repo", "path")


@query
def signal_name(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("repo", "path", cd.name_signal(F.col("path")).alias("signal"))


@query
def signal_dir(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("repo", "path", cd.dir_signal(F.col("path")).alias("signal"))


@query
def signal_content(spark: SparkSession, sf: str) -> DataFrame:
    texts = docs(spark, sf).select(F.concat_ws("/", "repo", "path").alias("name"), "content")
    pages = spread(table(spark, sf, "pages")).select("url", "page_id", "html")
    talk = spread(table(spark, sf, "conversations"))
    texts = texts.unionAll(pages.select(F.concat_ws("#", "url", "page_id"), "html"))
    texts = texts.unionAll(talk.select(F.concat_ws("/", F.lit("talk"), "conv_id", "turn"), "text"))
    return texts.select("name", cd.content_signals(F.col("content")).alias("n_signals"))


@query
def is_candidate(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("repo", "path", cd.is_candidate(F.col("abs_path"), F.col("content")).alias("candidate"))


# ---------------------------------------------------------------------------------------------
# Text functions


@query
def source_labels(spark: SparkSession, sf: str) -> DataFrame:
    by_name = documents(spark, sf).select(
        F.explode(
            F.array(
                F.concat(F.lit("owner/"), F.col("source")),
                F.concat(F.lit("git@github.com:owner/"), F.col("source"), F.lit(".git")),
                F.concat(F.lit("/srv/"), F.col("source"), F.lit("/")),
                F.col("source"),
            )
        ).alias("spec")
    )
    pages = table(spark, sf, "pages").select(F.col("url").alias("spec"))
    return describe_sources(by_name.unionAll(pages).distinct())


@query
def normalise_text(spark: SparkSession, sf: str) -> DataFrame:
    text = tx.normalise_text(F.col("content"))
    raw = raw_corpus(documents(spark, sf)).select("repo", "path", text.alias("text"))
    return raw.select("repo", "path", F.char_length("text").cast("long").alias("n_chars"), tx.content_hash(F.col("text")).alias("content_hash"))


@query
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


@query
def split_frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    cut = fm.with_block(docs(spark, sf))
    body = tx.after_head(F.col("content"), F.col("head"))
    return cut.select("repo", "path", "block", tx.content_hash(body).alias("body_hash"))


def _fields(parsed: DataFrame) -> DataFrame:
    f = F.col("fm")
    return parsed.where(fm.present(f)).select(
        "repo",
        "path",
        *[f[k]["text"].alias(k) for k in ("id", "name", "description", "version", "verification")],
        f["version"]["kind"].alias("version_kind"),
        joined(F.transform(f["tags"]["items"], lambda t: t["text"])).alias("tags"),
        joined(f["keys"]).alias("keys"),
    )


@query
def frontmatter_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _fields(parsed(spark, sf))


@query
def frontmatter_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus twice, under two names, so that every block occurs twice and is parsed once."""
    twice = docs(spark, sf).unionByName(docs(spark, sf).withColumn("repo", F.concat(F.col("repo"), F.lit("-copy"))))
    return _fields(fm.with_distinct_frontmatter(twice))


@query
def frontmatter_long(spark: SparkSession, sf: str) -> DataFrame:
    return fm.frontmatter_long(parsed(spark, sf))


@query
def stable_id(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("repo", "path", tx.stable_id(F.col("repo"), F.col("path")).alias("stable_id"))


@query
def kebab_id(spark: SparkSession, sf: str) -> DataFrame:
    slug = documents(spark, sf).select("doc_id", tx.kebab(F.col("text")).alias("slug"))
    return slug.select("doc_id", F.char_length("slug").cast("long").alias("n_chars"), tx.content_hash(F.col("slug")).alias("slug_hash"))


@query
def domain_from_tags(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).select("repo", "path", tx.domain_of(F.col("fm")["tags"]).alias("domain"))


@query
def first_heading(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("repo", "path", tx.first_heading(F.col("content")).alias("heading"))


# ---------------------------------------------------------------------------------------------
# Audit


@query
def schema_errors(spark: SparkSession, sf: str) -> DataFrame:
    checked = au.with_schema_errors(parsed(spark, sf))
    each = checked.select("repo", "path", F.posexplode("schema_errors").alias("pos", "e"))
    return each.select(
        "repo", "path", F.col("pos").cast("long").alias("pos"), F.col("e.path").alias("field"), F.col("e.keyword").alias("keyword"), F.col("e.message").alias("message")
    )


def _rule_query(rule_id: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        checked = au.with_schema_errors(parsed(spark, sf))
        return checked.where(ru.fires(rule_id)).select("repo", "path")

    QUERIES[f"rule_{rule_id.lower()}"] = run


for _id in ru.CHECKS:
    _rule_query(_id)


@query
def findings(spark: SparkSession, sf: str) -> DataFrame:
    return au.findings(audited(spark, sf)).select("repo", "path", "rule_id", "name", "severity", "description", "effort", "fixable")


@query
def finding_details(spark: SparkSession, sf: str) -> DataFrame:
    found = au.findings(audited(spark, sf)).where(F.col("rule_id").isin("FM002", "FM003"))
    return found.select("repo", "path", "rule_id", joined(F.col("schema_errors")).alias("schema_errors"), joined(F.col("missing_fields")).alias("missing_fields"))


@query
def file_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = au.file_results(audited(spark, sf))
    ids = F.transform("findings", lambda f: f["rule_id"])
    return rows.select("repo", "path", "abs_path", "content_hash", "finding_count", joined(ids).alias("rule_ids"))


@query
def by_severity(spark: SparkSession, sf: str) -> DataFrame:
    return au.by_severity(audited(spark, sf))


@query
def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    return au.summary(audited(spark, sf))


@query
def audit_report(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "report")
    stored = results(spark, sf)
    reports.write_audit(stored, RULES, path, STAMP)
    kind = au.file_results(stored).drop("doc_key").schema
    files = spark.read.schema(kind).json(f"{path}/files")
    return files.select("repo", "path", "content_hash", "finding_count", reports.findings_json().alias("findings_json"))


@query
def audit_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return reports.audit_markdown(results(spark, sf), RULES, STAMP)


# ---------------------------------------------------------------------------------------------
# Rules and plan


@query
def rules_load(spark: SparkSession, sf: str) -> DataFrame:
    """Every document stands for a place with up to three candidate rule files."""
    d = documents(spark, sf)
    n = F.col("doc_id").cast("string")
    good_json = F.format_string('[{"id": "X%s", "name": "rule %s", "severity": "error", "fixable": true}, {"name": "no id"}, {"id": "FM00%s", "effort": null}]', n, n, (F.col("doc_id") % 9 + 1).cast("string"))
    good_yaml = F.format_string("rules:\n- id: Y%s\n  description: from %s\n  severity: warning\n  fixable: no\n", n, F.col("source"))
    files = F.array(
        F.struct(F.lit("rules.json").alias("name"), F.when(F.col("doc_id") % 3 == 0, F.lit('{"rules": [')).otherwise(good_json).alias("text")),
        F.struct(F.lit("rules.yml").alias("name"), F.when(F.col("doc_id") % 6 == 0, F.lit("rules: [a: b: c]")).otherwise(good_yaml).alias("text")),
        F.struct(F.lit("skills-best-practices.json").alias("name"), F.format_string('{"rules": [{"id": "Z%s"}]}', n).alias("text")),
    )
    loaded = rule_files.rules_of_files(d.select(F.concat(F.lit("place/"), n).alias("location"), F.inline(files)))
    return loaded.select("location", "pos", "id", joined(F.col("given")).alias("given"), "name", "severity", "description", "effort", "fixable")


@query
def rules_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The built-in rules, overlaid with one rule per document."""
    n = F.col("doc_id")
    known = F.concat(F.lit("FM00"), (n % 3 + 1).cast("string"))
    external = documents(spark, sf).select(
        n.alias("pos"),
        F.when(n % 5 == 0, known).otherwise(F.concat(F.lit("X-"), F.col("source"))).alias("id"),
        F.when(n % 2 == 0, F.array(F.lit("name"), F.lit("severity"))).otherwise(F.array(F.lit("description"), F.lit("fixable"))).alias("given"),
        F.concat(F.lit("rule "), F.col("lang")).alias("name"),
        F.when(n % 4 == 0, "warning").alias("severity"),
        F.concat(F.lit("from "), n.cast("string")).alias("description"),
        F.lit(None).cast("string").alias("effort"),
        (n % 3 == 0).alias("fixable"),
    )
    return ru.merge(ru.built_in(spark), external)


@query
def rule_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = ru.with_scores(au.findings(audited(spark, sf)), "rule_id")
    return scored.select("repo", "path", "rule_id", "score", "risk", "action")


@query
def plan_items(spark: SparkSession, sf: str) -> DataFrame:
    return pl.plan_items(au.findings(audited(spark, sf))).drop("doc_key")


@query
def plan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return pl.plan_summary(au.findings(audited(spark, sf)))


@query
def plan_markdown(spark: SparkSession, sf: str) -> DataFrame:
    items = pl.plan_items(au.findings(audited(spark, sf)))
    return reports.plan_markdown(items, items, STAMP)


# ---------------------------------------------------------------------------------------------
# Rewrites


def _fix_query(rule_id: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        only = RuleSet(tuple(r for r in RULES.rules if r["id"] == rule_id))
        done = fx.fix_audited(au.audit_docs(docs(spark, sf), only), only)
        return fx.fixed_docs(done).select("repo", "path", "content_hash", "size_bytes")

    QUERIES[f"fix_{rule_id.lower()}"] = run


for _id in fx.FIXERS:
    _fix_query(_id)


@query
def fix_actions(spark: SparkSession, sf: str) -> DataFrame:
    return fx.fix_actions(fixed(spark, sf))


@query
def fixed_docs(spark: SparkSession, sf: str) -> DataFrame:
    return fx.fixed_docs(fixed(spark, sf)).select("repo", "path", "abs_path", "content_hash", "size_bytes")


@query
def fix_apply(spark: SparkSession, sf: str) -> DataFrame:
    stored = writers.write_docs(fx.fixed_docs(fixed(spark, sf)), scratch_path(spark, "fixed"))
    return stored.select("repo", "path", F.char_length("content").cast("long").alias("n_chars"), tx.content_hash(F.col("content")).alias("content_hash"))


@query
def fix_reaudit(spark: SparkSession, sf: str) -> DataFrame:
    return au.findings(fx.reaudit(fixed(spark, sf), RULES)).select("repo", "path", "rule_id", "severity")


@query
def fix_delta(spark: SparkSession, sf: str) -> DataFrame:
    return fx.fix_delta(fx.reaudit(fixed(spark, sf), RULES))


# ---------------------------------------------------------------------------------------------
# Relocation


@query
def migrate_plan(spark: SparkSession, sf: str) -> DataFrame:
    return planned(spark, sf).select("skill_id", "repo", "path", F.col("abs_path").alias("source_path"), "dest_path", "dest_rel", "domain", "status")


@query
def migrate_rendered(spark: SparkSession, sf: str) -> DataFrame:
    done = mg.migrate_rendered(planned(spark, sf), STAMP)
    return done.select("repo", "path", "dest_rel", F.char_length("content").cast("long").alias("n_chars"), tx.content_hash(F.col("content")).alias("content_hash"))


@query
def migrate_pointers(spark: SparkSession, sf: str) -> DataFrame:
    return mg.migrate_pointers(planned(spark, sf), "owner/library").select("repo", "path", "content")


@query
def migrate_actions(spark: SparkSession, sf: str) -> DataFrame:
    done = mg.migrate_actions(planned(spark, sf), apply=True, allow_delete=True, dry_run=False, write_pointer=False)
    return done.drop("doc_key")


@query
def migrate_outputs(spark: SparkSession, sf: str) -> DataFrame:
    stored = writers.write_by_domain(mg.migrate_rendered(planned(spark, sf), STAMP), scratch_path(spark, "skills"))
    return stored.select("domain", "skill_id", "dest_rel", tx.content_hash(F.col("content")).alias("content_hash"))


@query
def migrate_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Names that differ in their last part only: a few destinations share the whole corpus."""
    name = F.concat_ws(".", F.concat_ws("/", "lang", "source"), F.col("doc_id").cast("string"))
    made = corpus.corpus_from_table(documents(spark, sf), F.lit("owner/all"), name, F.col("text"))
    plan = mg.migrate_plan(fm.with_frontmatter(made))
    lost = mg.overwritten(plan).agg(F.count("*").alias("n"))
    both = mg.migrate_collisions(plan).select("dest_rel", "n_sources", "kept")
    return both.unionByName(lost.select(F.lit("(overwritten)").alias("dest_rel"), F.col("n").alias("n_sources"), F.lit(None).cast("string").alias("kept")))


@query
def migrate_summary(spark: SparkSession, sf: str) -> DataFrame:
    return mg.migrate_summary(mg.migrate_actions(planned(spark, sf), apply=True, dry_run=False))


# ---------------------------------------------------------------------------------------------
# Search


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("qid", "rank", "id", F.round("score", 6).alias("score"))


@query
def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    return se.token_stats(texts(spark, sf))


@query
def bm25_stats(spark: SparkSession, sf: str) -> DataFrame:
    row = se.bm25_stats(materialise(se.vocabulary(texts(spark, sf)), "vocabulary"))
    return row.select("n_docs", "n_terms", F.round("avg_words", 6).alias("avg_words"), F.round("mean_weight", 6).alias("mean_weight"))


@query
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(se.bm25_topk(texts(spark, sf), questions(spark, sf)))


@query
def search_index(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "index")
    wi.build_index(texts(spark, sf), path)
    return _rounded(wi.search_index(spark, path, questions(spark, sf)))


def label_means(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the mean vector of every label as a query."""
    vectors = spread(table(spark, sf, "embeddings"))
    each = vectors.select("label", F.posexplode("embedding").alias("at", "v"))
    means = each.groupBy("label", "at").agg(F.avg("v").alias("v"))
    cells = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("cells"))  # one per dimension
    asked = cells.select(F.col("label").cast("long").alias("qid"), F.transform("cells", lambda c: c["v"]).alias("embedding"))
    return vectors.select(F.col("vec_id").alias("id"), "embedding"), asked


@query
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest vectors to the mean vector of every label."""
    return _rounded(se.cosine_topk(*label_means(spark, sf)))


@query
def cosine_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The same with queries in groups, as for more of them than are sent at once."""
    return _rounded(se.cosine_topk(*label_means(spark, sf), max_shared=256))


@query
def vector_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same from vectors stored in clusters."""
    vectors, asked = label_means(spark, sf)
    path = scratch_path(spark, "vectors")
    vi.build_vectors(vectors, path)
    return _rounded(vi.search_vectors(spark, path, materialise(asked, "label-means")))


def letter_counts(text: Column) -> Column:
    """A stand-in for an embedding model: how often each vowel occurs."""
    return F.array(*[(F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))).cast("float") for c in "aeiou"])


@query
def embedding_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of documents and conversations, the documents of two languages being cached already."""
    d = documents(spark, sf)
    known = d.where(F.col("lang").isin("en", "fr")).select("text")
    none = se.cache_table(spark, scratch_path(spark, "no-cache"))
    cache = materialise(se.extend_cache(known, none, letter_counts), "cache")
    everything = d.select("text").unionAll(spread(table(spark, sf, "conversations")).select("text"))
    full = materialise(se.extend_cache(everything, cache, letter_counts), "cache")
    found = se.embed_texts(everything, full)
    vector = joined(F.transform("embedding", lambda v: v.cast("long").cast("string")))
    return found.groupBy("content_key").agg(F.count("*").alias("copies"), F.max(vector).alias("embedding"))
