"""Taking clips and project folders into a store."""

from __future__ import annotations

import functools
import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import shingles as S
from ..functions.chunking import chunked
from ..functions.parsers import PARSERS, Entry, attempt, script_parser, segment
from ..functions.text import normalize_to_ascii, strip_source_suffix
from ..operators import families, merge, neardup, sync
from ..session import durable
from ..sources import clips
from ..sources.config import BUILT_IN, DocType, Project
from ..sources.store import Store, with_ids

Parser = Callable[[str], list[Entry]]
LOG = logging.getLogger(__name__)


def segmented(described: DataFrame, own: dict[str, Parser] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, failures): clips by an own parser named like their type, the script of their type, or its parser.

    ``failures`` has path and error of each clip on which its parser failed; the others go on.
    """
    own = own or {}
    name = F.coalesce("doctype_name", F.lit(""))
    scripts = [r.preprocessor for r in described.select("preprocessor").distinct().collect() if r.preprocessor]  # one per configured type at most
    own_name, scripted = name.isin(*own) if own else F.lit(False), F.col("preprocessor").isNotNull()
    parts = [attempt(described.filter(name == doctype), function) for doctype, function in own.items()]
    parts += [attempt(described.filter(~own_name & (F.col("preprocessor") == script)), script_parser(os.path.expanduser(script))) for script in scripts]
    parts += [attempt(described.filter(~own_name & ~scripted & (F.col("parser") == parser)), parser) for parser in PARSERS]
    tried = durable(functools.reduce(DataFrame.unionByName, parts))
    kept = [c for c in described.columns if c != "preprocessor"]
    entries = tried.filter("error IS NULL").select(*kept, F.posexplode("entries").alias("position", "__e")).select(*kept, "position", "__e.*")
    return entries, tried.filter("error IS NOT NULL").select("path", "error")


def tidied(entries: DataFrame, types: tuple[DocType, ...]) -> DataFrame:
    """Entries after the clean-up patterns and the author merging that their types ask for.

    An extra step for callers: plain ingest reads these options but leaves entries
    as they are.
    """
    body = F.col("body")
    for t in types:
        for pattern in t.cleanup_patterns:
            body = F.when(F.col("doctype_name") == t.name, F.regexp_replace(body, pattern, "")).otherwise(body)
    clean = entries.withColumn("body", F.trim(body)).filter("body <> ''")
    merging = [t.name for t in types if t.merge_consecutive_same_author]
    if not merging:
        return clean
    chosen = F.coalesce(F.col("doctype_name").isin(*merging), F.lit(False))
    runs = merge.author_runs(clean.filter(chosen), "path").select("path", F.col("first_position").alias("position"), F.col("body").alias("__body"))
    joined = clean.filter(chosen).join(runs, ["path", "position"]).withColumn("body", F.col("__body")).drop("__body")
    return clean.filter(~chosen).unionByName(joined.select(*clean.columns))


def add_children(store: Store, entries: DataFrame) -> None:
    """Append entries (document_id, position, ...) and their chunks."""
    numbered = durable(with_ids(entries, store.top_id("entries"), ["document_id", "position"]))
    signed = S.signatures(numbered.withColumn("__text", F.col("body")), "__text").withColumnRenamed("signature", "minhash")
    store.append("entries", signed)
    pieces = chunked(numbered.select(F.col("id").alias("entry_id"), "body"))
    store.append("chunks", with_ids(durable(pieces), store.top_id("chunks"), ["entry_id", "chunk_index"]))


def recompute(store: Store) -> None:
    """Families and their supersession tags, all anew."""
    tagged = store.version("document_tags")
    found = durable(families.families(store.read("document_relations"), store.read("documents")))
    store.write("document_families", found.select("document_id", "family"))
    store.write("document_tags", families.repaired_tags(store.read("document_tags"), found), after=tagged)


def relate(store: Store, links: DataFrame, dated: DataFrame | None = None) -> None:
    """Families after new superseded links (a, b) and after new dates of documents (id): only those touched are written."""
    if not store.exists("document_families"):
        return recompute(store)
    if dated is not None:
        links = links.unionByName(store.pick("document_families", dated.select(F.col("id").alias("document_id"))).select(F.col("document_id").alias("a"), F.col("family").alias("b")))
    members = durable(families.merged(store.read("document_families"), links))
    if not members.limit(1).count():
        return
    store.upsert("document_families", members)
    found = families.with_current(members, store.pick("documents", members.select(F.col("document_id").alias("id"))))
    wanted = durable(families.superseded_tags(found))
    ids = members.select("document_id", F.lit("superseded").alias("tag"))
    there = durable(store.pick("document_tags", ids))
    stale, fresh = there.join(wanted, ["document_id", "tag"], "left_anti"), wanted.join(there, ["document_id", "tag"], "left_anti")
    if stale.limit(1).count():
        store.delete("document_tags", stale)
    if fresh.limit(1).count():
        store.append("document_tags", fresh)


def repair_family(store: Store, document: int) -> DataFrame:
    """Families and tags of the members of one document's family anew; gives its pairs that were kept both.

    Links are only looked up among the members known so far: a family may fall
    apart, and what joins others comes by ``relate``.
    """
    if not store.exists("document_families"):
        recompute(store)
    known = store.read("document_families")
    own = known.filter(F.col("document_id") == document).select("family")
    before = durable(known.join(F.broadcast(own), "family", "left_semi").select("document_id"))
    of = lambda s: before.withColumnRenamed("document_id", s)
    relations = durable(store.read("document_relations").join(of("from_document_id"), "from_document_id", "left_semi").join(of("to_document_id"), "to_document_id", "left_semi"))
    found = durable(families.families(relations, store.read("documents")))
    store.delete("document_families", before)
    store.append("document_families", found.select("document_id", "family"))
    store.delete("document_tags", before.withColumn("tag", F.lit("superseded")))
    store.append("document_tags", families.superseded_tags(found))
    return families.conflicts(relations, found)


def ingest(store: Store, batch: DataFrame, types: tuple[DocType, ...] = BUILT_IN, own: dict[str, Parser] | None = None, force: bool = False, on_gray: str = "queue", now: str | None = None, tidy: bool = False) -> DataFrame:
    """Take in clips (path, raw): merge growing threads, store the rest, link near-duplicates; gives the review queue.

    Clips of one thread (equal merge key) are taken one after another in the order
    of their paths, each by what the ones before it left in the store; clips of
    different threads are taken together. A clip that isn't UTF-8 or on which its
    parser fails is logged and passed over.

    ``on_gray``: what becomes of a pair that is only likely: ``queue`` (stored,
    left for review), ``supersede`` or ``keep_both``. ``tidy`` applies the clean-up
    options of the types.
    """
    unread = durable(clips.unseen(batch, store.read("documents"), force))
    fresh = durable(clips.described(unread.filter("raw IS NOT NULL"), types, now).withColumn("merge_key", strip_source_suffix(F.col("source_title"))))
    entries, failures = segmented(fresh, own)
    told(unread.filter("raw IS NULL").select("path", F.lit("not UTF-8").alias("error")).unionByName(failures))
    fresh = fresh.drop("preprocessor").join(failures, "path", "left_anti")
    entries = entries.drop("merge_key")
    entries = durable(tidied(entries, types) if tidy else entries)
    thread = (F.col("merge_strategy") == "positional") & (F.col("merge_key") != "")
    turn = F.row_number().over(Window.partitionBy("merge_key").orderBy("path"))
    turns = durable(fresh.filter(thread).withColumn("turn", turn).unionByName(fresh.filter(~thread).withColumn("turn", F.lit(1))))
    last = turns.agg(F.max("turn")).first()[0] or 1
    queues = []
    for n in range(1, last + 1):
        part = turns.filter(F.col("turn") == n).drop("turn")
        queues.append(take(store, part, entries.join(part.select("path"), "path", "left_semi"), on_gray))
    return functools.reduce(DataFrame.unionByName, queues)


def told(failures: DataFrame, most: int = 20) -> None:
    """Log how many clips failed, and the first of them."""
    failed = durable(failures)
    count = failed.count()
    for row in failed.orderBy("path").limit(most).collect():
        LOG.warning("passed over %s: %s", row.path, row.error)
    if count > most:
        LOG.warning("passed over %d clips in all", count)


def take(store: Store, fresh: DataFrame, entries: DataFrame, on_gray: str) -> DataFrame:
    """Take in described clips, at most one of each thread, with their entries; gives the review queue."""
    stored = store.read("documents").filter("merge_strategy = 'positional'").select(F.col("id").alias("document_id"), strip_source_suffix(F.col("source_title")).alias("merge_key"))
    old = stored.filter("merge_key <> ''").join(store.read("entries").select("document_id", "position", "author", "body"), "document_id")
    growing = fresh.filter("merge_strategy = 'positional' AND merge_key <> ''").select("path", "merge_key")
    new = entries.join(growing, "path").select("merge_key", F.col("path").alias("new_doc"), "position", "author", "body")
    hits = durable(merge.overlaps(old, new).select(F.col("new_doc").alias("path"), "document_id"))
    merged = durable(merge.positional_merge(old, new))
    if merged.limit(1).count():
        facts = fresh.select(F.col("path").alias("new_doc"), "source_title", "clip_date", "clip_date_source", F.col("path").alias("file_path"))
        told_of = entries.select(F.col("path").alias("new_doc"), F.col("position").alias("new_position"), "timestamp", "heading_level", "heading_title", "is_quote")
        rows = durable(merged.join(facts, "new_doc").join(told_of, ["new_doc", "new_position"]))
        add_children(store, rows)
        dates = rows.groupBy(F.col("document_id").alias("id")).agg(F.max(F.struct("clip_date", "clip_date_source")).alias("d"))
        store.update("documents", dates.select("id", "d.clip_date", "d.clip_date_source"))
        relate(store, store.spark.createDataFrame([], "a long, b long"), dates.select("id"))

    kept = fresh.join(hits.select("path").distinct(), "path", "left_anti")
    bodies = entries.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "body"))), lambda x: x["body"]), "\n").alias("joined"), F.min_by("heading_title", F.when(F.col("heading_title").isNotNull(), F.col("position"))).alias("title"))
    signed = S.signatures(kept.drop("text").join(bodies, "path").withColumnRenamed("joined", "text")).drop("names", "text")
    rows = signed.withColumn("title", normalize_to_ascii(F.col("title"))).withColumn("origin_path", F.col("path")).withColumn("document_minhash", F.col("signature")).withColumn("document_shingle_count", F.col("n_shingles").cast("long"))
    numbered = durable(with_ids(durable(rows), store.top_id("documents"), ["path"]))
    before = durable(store.read("documents"))
    store.append("documents", numbered)
    ids = numbered.select("path", F.col("id").alias("document_id"), "source_title", "clip_date")
    add_children(store, entries.drop("source_title", "clip_date").join(ids, "path").withColumnRenamed("path", "file_path"))

    side = lambda df: df.filter("document_minhash IS NOT NULL").select("id", "clip_date", F.col("document_minhash").alias("signature"), F.col("document_shingle_count").alias("n_shingles"), strip_source_suffix(F.col("source_title")).alias("title"))
    new_docs = side(store.read("documents").join(numbered.select("id"), "id", "left_semi"))
    cases = neardup.signature_candidates(new_docs, side(before).unionByName(new_docs)).filter("old_id < new_id")
    texts = store.read("entries").groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "body"))), lambda x: x["body"]), "\n").alias("text"))
    graded = durable(graded_cases(durable(cases), texts))
    decided = durable(neardup.decided(graded))
    resolution = F.when(F.col("resolution") == "superseded", "superseded").when(F.lit(on_gray) == "supersede", "superseded").when(F.lit(on_gray) == "keep_both", "kept_both")
    links = decided.withColumn("resolution", resolution).filter("resolution IS NOT NULL")
    relations = links.select(F.col("new_id").alias("from_document_id"), F.col("old_id").alias("to_document_id"), F.lit("near_duplicate").alias("relation"), "similarity", "shared_block_words", "resolution")
    if relations.limit(1).count():
        relations = durable(relations)
        store.upsert("document_relations", with_ids(relations, store.top_id("document_relations"), ["from_document_id", "to_document_id"]))
        relate(store, families.superseded_edges(relations))
    return decided.filter("resolution = 'review'")


def graded_cases(cases: DataFrame, texts: DataFrame) -> DataFrame:
    """Cases of the signature stage as auto or gray; exact text work is done for those alone that need it."""
    open_cases = cases.filter("verdict <> 'auto'").select(F.col("new_id").alias("b"), F.col("old_id").alias("a"), "verdict")
    named = lambda s: S.with_shingles(texts.join(open_cases.select(F.col(s).alias("id")).distinct(), "id", "left_semi")).select(F.col("id").alias(s), F.transform("shingles", lambda x: F.xxhash64(x)).alias(f"q_{s}"))
    both = open_cases.join(named("a"), "a").join(named("b"), "b")
    sized = both.withColumn("shared", F.size(F.array_intersect("q_a", "q_b"))).withColumn("least", F.least(F.size(F.array_distinct("q_a")), F.size(F.array_distinct("q_b"))))
    contained = S.containment(F.col("shared"), F.col("least"), F.col("least")) >= S.CONTAINED
    possible = sized.withColumn("contained", contained).filter((F.col("verdict") == "gray") | F.col("contained") | (F.col("shared") + 2 >= S.BLOCK_WORDS))
    blocks = possible.withColumn("shared_block_words", S.shared_block_words("q_a", "q_b")).filter((F.col("verdict") == "gray") | F.col("contained") | (F.col("shared_block_words") >= S.BLOCK_WORDS))
    gray = cases.join(blocks.select(F.col("b").alias("new_id"), F.col("a").alias("old_id"), "shared_block_words"), ["new_id", "old_id"]).withColumn("verdict", F.lit("gray"))
    auto = cases.filter("verdict = 'auto'").withColumn("shared_block_words", F.lit(None).cast("int"))
    return auto.unionByName(gray)


def ingest_folder(spark: SparkSession, store: Store, folder: str, **options) -> DataFrame:
    return ingest(store, clips.read_clips(spark, folder), **options)


def sync_project(store: Store, project: Project, disk: DataFrame, now: str, touched: DataFrame | None = None) -> DataFrame:
    """Bring a project's documents up to date with (relative_path, text, content_hash); gives counts by category.

    Rows that are new or changed get their children anew under their old id; files
    that are gone are marked missing; a file that no rule fits is left alone. With
    ``touched`` (relative_path) ``disk`` tells of those paths alone, and others stay
    as they are. Hashes of texts are written last, so what a crash leaves unfinished
    counts as changed the next time.
    """
    ruled = disk.withColumn("project", F.lit(project.name)).withColumn("status", clips.manifest_match(F.col("relative_path"), project.rules)).withColumn("role", clips.manifest_match(F.col("relative_path"), project.rules, "role"))
    stored = store.read("documents").filter(F.col("project") == project.name).select("id", "project", "relative_path", "content_hash")
    stored = stored.join(touched.select("relative_path").distinct(), "relative_path", "left_semi") if touched is not None else stored
    seen = ruled.select("project", "relative_path", F.when(F.col("status").isNotNull(), F.col("content_hash")).alias("content_hash"))
    found = durable(sync.classify(seen, stored))
    rows = durable(found.drop("content_hash").join(ruled.drop("project"), "relative_path", "left"))
    fresh = with_ids(durable(rows.filter("category = 'new'").drop("id")), store.top_id("documents"), ["relative_path"])
    named = lambda df: df.select("id", "project", "relative_path", F.col("status").alias("doc_status"), F.col("role").alias("doc_role"), F.lit(now).alias("synced_at"), F.col("relative_path").alias("source_title"), F.lit("project_markdown").alias("doctype_name"), F.lit("none").alias("merge_strategy"), F.lit(now).alias("clip_date"), F.lit("metadata").alias("clip_date_source"))
    fresh = durable(fresh)
    if fresh.limit(1).count():
        store.append("documents", named(fresh))
    changed = rows.filter("category = 'updated'")
    store.update("documents", rows.filter("category IN ('updated', 'unchanged')").select("id", F.col("status").alias("doc_status"), F.col("role").alias("doc_role"), F.lit(now).alias("synced_at")))
    store.update("documents", rows.filter("category = 'missing'").select("id", F.lit("missing").alias("doc_status"), F.lit(now).alias("synced_at")))
    if changed.limit(1).count():
        store.replace_children(changed.select("id"))
    texts = fresh.select("id", "text", "relative_path").unionByName(changed.select("id", "text", "relative_path"))
    entries = segment(texts.withColumnRenamed("id", "document_id"), "markdown").withColumn("clip_date", F.lit(now)).withColumn("source_title", F.col("relative_path")).withColumn("file_path", F.col("relative_path"))
    add_children(store, entries.drop("text", "relative_path"))
    store.update("documents", fresh.select("id", "content_hash").unionByName(changed.select("id", "content_hash")))
    return sync.summary(found)


