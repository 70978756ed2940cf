"""Searches and reads over a store, as DataFrames; JSON comes from ``rows_json``."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.backends import Backend, Offline
from .operators import families, filters, grouping, lexical, listing, vector, worklists
from .operators.text_index import TextIndex
from .operators.vector_index import VectorIndex
from .plans import enrich, ingest
from .sources.config import Models, Tags, load_projects
from .sources.clips import walk_project
from .sources.store import Store
from .sources.versions import Versions


class NotEmbedded(RuntimeError):
    """A semantic search before any vectors were made."""


class Collection:
    """One store with its configuration."""

    def __init__(self, spark: SparkSession, folder: str, tags: Tags | None = None, models: Models | None = None, backend: Backend | None = None):
        self.spark, self.store = spark, Store(spark, folder)
        self.tags, self.models, self.backend = tags or Tags(), models or Models(), backend or Offline()

    # --- reading

    def chunk_rows(self) -> DataFrame:
        """Chunks with the columns of their entries and documents."""
        e = self.store.read("entries").select(F.col("id").alias("entry_id"), "document_id", F.col("position").alias("entry_position"), "author", "heading_title", "clip_date", "source_title")
        d = self.store.read("documents").select(F.col("id").alias("document_id"), "doc_status", "project")
        c = self.store.read("chunks").select(F.col("id").alias("chunk_id"), "entry_id", "chunk_index", "start_char", "end_char", "body")
        return c.join(e, "entry_id").join(d, "document_id")

    def current(self) -> DataFrame:
        return families.families(self.store.read("document_relations"), self.store.read("documents")).select("document_id", "current_document_id")

    def hidden(self, exclude: list[str] | None, include_all: bool) -> tuple[str, ...]:
        return tuple(self.tags.hidden(exclude, include_all))

    def annotated(self, rows: DataFrame) -> DataFrame:
        return grouping.annotate(rows, self.store.read("document_tags"), self.current())

    def text_index(self) -> TextIndex:
        return TextIndex(self.spark, f"{self.store.folder}/text_index")

    def vector_index(self) -> VectorIndex | None:
        """The newest index, if it was made from the present vectors."""
        _, lines = Versions(self.spark, f"{self.store.folder}/vector_index/manifests").latest()
        fits = lines and lines[0] == str(self.store.version("vec_chunks"))
        return VectorIndex(self.spark, f"{self.store.folder}/vector_index/{lines[1]}") if fits else None

    def index(self) -> None:
        """Bring the stored indexes up to date; searches use them until the store changes again, and scan after that."""
        version = str(self.store.version("chunks"))
        if self.store.exists("chunks") and self.text_index().mark() != version:
            self.text_index().follow(self.store.read("chunks").select(F.col("id").alias("chunk_id"), "body"), version)
        version = str(self.store.version("vec_chunks"))
        if self.store.exists("vec_chunks") and self.vector_index() is None:
            made, manifests = f"v-{uuid.uuid4().hex}", Versions(self.spark, f"{self.store.folder}/vector_index/manifests")
            VectorIndex.build(self.store.read("vec_chunks"), f"{self.store.folder}/vector_index/{made}")
            manifests.commit(manifests.latest()[0], [version, made])

    def search(self, query: str, author: str | None = None, date_from: str | None = None, date_to: str | None = None, project: str | None = None, exclude: list[str] | None = None, include_all: bool = False, sort: str = "score") -> DataFrame:
        """Lexical search, grouped per document."""
        chunks = self.chunk_rows()
        wanted = filters.Filters(author, date_from, date_to, project, self.hidden(exclude, include_all))
        tags, index = self.store.read("document_tags"), self.text_index()
        if index.mark() == str(self.store.version("chunks")):
            hits = lexical.search_index(chunks, index, tags, query, wanted)
        else:
            hits = lexical.search(chunks, lexical.postings(chunks), lexical.lengths(chunks), tags, query, wanted)
        return grouping.ordered(self.annotated(grouping.group_lexical(lexical.snippets(hits, query).withColumn("chunk_body", F.col("body")), sort)), sort)  # a join may have undone the order

    def similar(self, query: str, limit: int = 10, author: str | None = None, date_from: str | None = None, date_to: str | None = None, project: str | None = None, exclude: list[str] | None = None, include_all: bool = False, sort: str = "score", mode: str = "overfetch") -> DataFrame:
        """Semantic search, grouped per document.

        ``mode``: ``overfetch`` and ``exact`` look at all vectors; ``index`` asks the
        stored index where that is of the present vectors, and may miss some of the
        nearest (its probes hold 0.97 of them on sampled queries).
        """
        if not self.store.exists("vec_chunks"):
            raise NotEmbedded("run embed first")
        wanted = filters.Filters(author, date_from, date_to, project, self.hidden(exclude, include_all))
        probe = self.backend.embed(query, self.models.model("embed"))
        index = self.vector_index() if mode == "index" else None
        hits = vector.search(self.chunk_rows(), self.store.read("vec_chunks"), self.store.read("document_tags"), probe, limit, wanted, mode, index)
        return grouping.ordered(self.annotated(grouping.group_semantic(hits, sort)), sort)

    def similar_claims(self, query: str, limit: int = 10, exclude: list[str] | None = None, include_all: bool = False) -> DataFrame:
        if not self.store.exists("vec_claims"):
            raise NotEmbedded("run embed first")
        rows = self.store.read("claims").select(F.col("id").alias("claim_id"), "document_id", "content", "author").join(self.store.read("documents").select(F.col("id").alias("document_id"), "source_title"), "document_id")
        probe = self.backend.embed(query, self.models.model("embed"))
        return self.annotated(vector.claims(rows, self.store.read("vec_claims"), self.store.read("document_tags"), probe, limit, self.hidden(exclude, include_all))).orderBy(F.desc("similarity"), "claim_id")

    def document(self, document_id: int) -> DataFrame:
        """A document with entries and chunks; always annotated, never hidden."""
        d = self.store.read("documents").filter(F.col("id") == document_id).drop("document_minhash")
        e = self.store.read("entries").filter(F.col("document_id") == document_id).drop("minhash")
        c = self.store.read("chunks").join(e.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
        return self.annotated(listing.nested(d, e, c).withColumnRenamed("id", "document_id"))

    def entries(self, document_id: int) -> DataFrame:
        return self.store.read("entries").filter(F.col("document_id") == document_id).drop("minhash").orderBy("position")

    def claims(self, document_id: int) -> DataFrame:
        return self.store.read("claims").filter(F.col("document_id") == document_id).orderBy("id")

    def derived(self, document_id: int, content_type: str | None = None) -> DataFrame:
        """Summaries of a document, both or one type's, from their buckets alone."""
        kinds = [content_type] if content_type else ["detailed", "brief"]
        return self.store.pick("derived_content", self.spark.createDataFrame([(document_id, k) for k in kinds], "document_id long, content_type string")).orderBy("content_type")

    def mark_derived(self, document_id: int, content_type: str, quality: str) -> None:
        """Call a summary ok or bad; ``derive`` makes bad ones anew."""
        row = self.derived(document_id, content_type).withColumn("quality", F.lit(quality))
        self.store.upsert("derived_content", row)

    def difference(self, old: int, new: int) -> DataFrame:
        """What a reviewer sees of a pair: added and removed lines of the newer document."""
        pair = self.spark.createDataFrame([(new, old)], "from_document_id long, to_document_id long")
        entries = self.store.read("entries").filter(F.col("document_id").isin(old, new))
        return worklists.diff_worklist(pair, entries, "").select("from_document_id", "to_document_id", "added", "removed")

    def listing(self, sort: str = "date", descending: bool = True, include: list[str] | None = None, exclude: list[str] | None = None, tag: str | None = None, include_all: bool = False) -> DataFrame:
        """All documents but hidden ones; explicit tags switch the default exclusions off."""
        s = self.store
        rows = listing.list_documents(s.read("documents"), s.read("entries"), s.read("chunks"), s.read("document_tags"), s.read("derived_content"))
        hidden = [] if include and exclude is None else list(self.hidden(exclude, include_all))
        rows = filters.without_tags(rows, s.read("document_tags"), hidden, "id")
        for wanted in (include, self.tags.expand([tag]) if tag else None):
            rows = filters.with_tags(rows, s.read("document_tags"), self.tags.expand(wanted) if wanted else [], "id")
        return listing.sort_listing(rows, sort, descending)

    def dump(self, title: str | None = None) -> DataFrame:
        return listing.dump(self.store.read("documents"), self.store.read("entries"), title)

    def stats(self) -> DataFrame:
        s = self.store
        return worklists.counts(documents=s.read("documents"), entries=s.read("entries"), chunks=s.read("chunks"), claims=s.read("claims"), chunks_with_embeddings=s.read("vec_chunks"), claims_with_embeddings=s.read("vec_claims"))

    def derive_status(self) -> DataFrame:
        return worklists.derive_status(self.store.read("documents"), self.store.read("derived_content"))

    def extraction_status(self) -> DataFrame:
        return worklists.extraction_status(self.store.read("documents"), self.store.read("claims"))

    # --- writing

    def ingest(self, folder: str, **options) -> DataFrame:
        return ingest.ingest_folder(self.spark, self.store, folder, **options)

    def sync(self, registry: str, now: str, only: str | None = None) -> list[DataFrame]:
        return [ingest.sync_project(self.store, p, walk_project(self.spark, p.root), now) for p in load_projects(registry, only)]

    def embed(self, limit: int | None = None) -> int:
        return enrich.embed(self.store, self.backend, self.models.model("embed"), limit)

    def derive(self, **options) -> int:
        return enrich.derive(self.store, self.backend, self.models, **options)

    def extract(self, **options) -> int:
        return enrich.extract(self.store, self.backend, self.models, **options)

    def diff(self, force: bool = False) -> int:
        return enrich.summarise_changes(self.store, self.backend, self.models.model("diff"), "Say what changed.", force)

    def repair(self, document: int | None = None) -> DataFrame:
        """Set supersession tags of all families, or of one document's, anew; gives pairs that were kept both although one family holds them."""
        if document is not None:
            return ingest.repair_family(self.store, document)
        ingest.recompute(self.store)
        found = families.families(self.store.read("document_relations"), self.store.read("documents"))
        return families.conflicts(self.store.read("document_relations"), found)

    def scan(self, decisions: DataFrame | None = None) -> DataFrame:
        """Exact comparison of all captured documents; links are stored, the review queue is returned."""
        from .functions.text import strip_source_suffix
        from .operators import neardup
        from .session import durable
        from .sources.store import with_ids

        s = self.store
        docs = filters.captured(s.read("documents")).select("id", strip_source_suffix(F.col("source_title")).alias("title"))
        texts = worklists.joined_bodies(s.read("entries")).withColumnRenamed("document_id", "id")
        whole = docs.join(texts, "id")
        relations, queue = neardup.scan(whole, s.read("document_relations"), decisions, title="title")
        relations = durable(relations)
        if relations.limit(1).count():
            s.upsert("document_relations", with_ids(relations, s.top_id("document_relations"), ["from_document_id", "to_document_id"]))
            ingest.recompute(s)
        return queue


def rows_json(df: DataFrame) -> list[dict]:
    """Rows as plain objects without missing values, for short results."""
    return [json.loads(r[0]) for r in listing.to_json(df).collect()]
