"""Enrichment of a store: embeddings, summaries, claims, summaries of changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.backends import Backend, answers, embeddings
from ..functions.text import claim_prompt, claims, detailed_prompt, length_tier, prompt_hash
from ..operators import worklists
from ..session import durable
from ..sources.config import Models
from ..sources.store import Store, with_ids

def now():
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


def embed(store: Store, backend: Backend, model: str, limit: int | None = None) -> int:
    """Vectors for chunks, then claims, that have none."""
    done = 0
    for rows, text, table in (("chunks", "body", "vec_chunks"), ("claims", "content", "vec_claims")):
        todo = worklists.lacking(store.read(rows).select("id", text), store.read(table), "id", "id")
        todo = todo.orderBy("id").limit(limit) if limit else todo
        made = durable(embeddings(todo, text, backend, model).select("id", "embedding"))
        n = made.count()
        if n:
            store.upsert(table, made)
        done += n
    return done


def derive(store: Store, backend: Backend, models: Models, force: bool = False, stale: bool = False, limit: int | None = None, reasons: tuple[str, ...] = worklists.REASONS) -> int:
    """Detailed, then brief summaries. A short document's brief is its detailed one.

    ``reasons`` says which documents are taken, ``force`` takes all. Where the brief
    alone is bad, the detailed one stays and only the brief is made anew from it.
    """
    documents, derived = store.read("documents"), store.read("derived_content")
    hashes = worklists.source_hash(store.read("entries"))
    stale = stale or ("stale" in reasons and reasons != worklists.REASONS)
    work = documents.select("id", F.lit("force").alias("reason")) if force else worklists.needs_derivation(documents, derived, hashes if stale else None, reasons).select("id", "reason")
    work = work.orderBy("id").limit(limit) if limit else work
    texts = worklists.full_text(store.read("entries")).withColumnRenamed("document_id", "id")
    rows = work.join(texts, "id").join(hashes.withColumnRenamed("document_id", "id"), "id").withColumn("tier", length_tier(F.col("text"), models.short_bytes, models.medium_bytes))
    instructions = F.lit(models.instructions("short"))
    for tier in ("medium", "long"):
        instructions = F.when(F.col("tier") == tier, models.instructions(tier)).otherwise(instructions)
    rows = durable(rows)
    asked = answers(rows.filter("reason <> 'bad_brief'"), F.concat(instructions, F.lit("\n"), F.col("text")), backend, models.model("detailed")).filter("error IS NULL")
    stays = derived.filter("content_type = 'detailed' AND quality = 'ok'").select(F.col("document_id").alias("id"), F.col("content").alias("detailed"), F.col("source_hash").alias("was"))
    kept = rows.filter("reason = 'bad_brief'").drop("source_hash").join(stays, "id").select("id", "tier", F.col("was").alias("source_hash"), "detailed")
    detailed = durable(asked.select("id", "tier", "source_hash", F.col("answer").alias("detailed")).unionByName(kept))
    briefs = answers(detailed.filter("tier <> 'short'"), detailed_prompt(F.col("detailed"), models.brief), backend, models.model("brief")).filter("error IS NULL").select("id", F.col("answer").alias("brief"))
    both = detailed.join(briefs, "id", "left").withColumn("brief", F.when(F.col("tier") == "short", F.col("detailed")).otherwise(F.col("brief")))
    made = both.select("id", "source_hash", F.explode(F.array(F.struct(F.lit("detailed").alias("content_type"), F.col("detailed").alias("content")), F.struct(F.lit("brief").alias("content_type"), F.col("brief").alias("content")))).alias("c")).select(F.col("id").alias("document_id"), "source_hash", "c.*").filter("content IS NOT NULL")
    numbered = with_ids(durable(made), store.top_id("derived_content"), ["document_id", "content_type"])
    n = numbered.count()
    if n:
        store.upsert("derived_content", numbered.withColumn("quality", F.lit("ok")).withColumn("model", F.lit(models.model("detailed"))).withColumn("created_at", now()))
    return n


def extract(store: Store, backend: Backend, models: Models, skip_types: tuple[str, ...] = (), limit: int | None = None, force: bool = False) -> int:
    """Claims of documents that have none of this model and prompt, or with ``force`` of all. Old claims go with their vectors."""
    model, rules = models.model("extract"), models.rules
    key = prompt_hash(rules)
    claimed = store.read("claims").limit(0) if force else store.read("claims")
    work = worklists.needs_extraction(store.read("documents"), claimed, model, key, skip_types).select("id", "doctype_name")
    work = work.orderBy("id").limit(limit) if limit else work
    entries = store.read("entries")
    framing = F.lit(models.framing(None))
    for name in models.framings:
        framing = F.when(F.col("doctype_name") == name, models.framing(name)).otherwise(framing)
    rows = work.join(worklists.full_text(entries).withColumnRenamed("document_id", "id"), "id").join(worklists.single_author(entries).withColumnRenamed("document_id", "id"), "id")
    asked = durable(answers(rows, claim_prompt(F.col("text"), rules, framing), backend, model).filter("error IS NULL").select("id", "author", "answer"))
    made = asked.select(F.col("id").alias("document_id"), "author", F.posexplode(claims(F.col("answer"))).alias("n", "content"))
    fresh = with_ids(durable(made), store.top_id("claims"), ["document_id", "n"])
    done = asked.select(F.col("id").alias("document_id"))
    store.delete("claims", done, ["document_id"])
    store.clean()
    store.append("claims", fresh.withColumn("model", F.lit(model)).withColumn("prompt_hash", F.lit(key)).withColumn("created_at", now()))
    return fresh.count()


def summarise_changes(store: Store, backend: Backend, model: str, instructions: str, force: bool = False) -> int:
    """Summaries of what changed between the documents of each relation; a failing one is left for the next run."""
    key = prompt_hash(instructions)
    relations = store.read("document_relations")
    work = relations if force else worklists.needs_diff(relations, model, key)
    prompts = worklists.diff_worklist(work.select("id", "from_document_id", "to_document_id"), store.read("entries"), instructions)
    done = durable(answers(prompts, F.col("prompt"), backend, model).filter("error IS NULL").select("id", F.col("answer").alias("summary"), F.lit(model).alias("summary_model"), F.lit(key).alias("summary_prompt_hash")))
    n = done.count()
    if n:
        store.update("document_relations", done)
    return n
