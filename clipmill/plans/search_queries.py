"""Queries on listings, search, vectors and tags, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import snippets_similar
from ..operators import filters, grouping, lexical, listing, vector, worklists
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..session import scratch
from ..sources.config import Tags
from . import model as m

QUERY = "ther on"
TAGS = Tags(includes={"hidden": ("archived", "junk")})
WANTED = filters.Filters(author="USER", date_from="2024-01-01 10:00:00", date_to="2024-01-20", project="p1", excluded_tags=("junk",))
NEAR = filters.Filters(author="ROLE", date_to="2024-01-05", excluded_tags=("junk",))

DOCS = "docs AS (SELECT doc_id AS id, concat_ws('/', source, lang) AS source_title, strftime(TIMESTAMP '2024-01-01' + to_hours(doc_id), '%Y-%m-%d %H:%M:%S') AS clip_date, text FROM documents)"
TAG_ROWS = "tags AS (SELECT doc_id AS document_id, 'junk' AS tag FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'archived' FROM labels WHERE quality = 0)"
TURNS = """turns AS (SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS document_id, turn AS entry_position, role AS author, text AS body,
  strftime(TIMESTAMP '2024-01-01' + to_hours(conv_id), '%Y-%m-%d %H:%M:%S') AS clip_date, 'thread ' || (conv_id % 7) AS source_title, 'p' || (conv_id % 3) AS project,
  CASE WHEN conv_id % 5 = 0 THEN 0.8 WHEN conv_id % 7 = 0 THEN 0.5 ELSE 1.0 END AS weight FROM conversations)"""
BM25 = (
    TURNS
    + r""", toks AS (SELECT chunk_id, regexp_extract_all(lower(strip_accents(body)), '[\p{L}\p{N}]+') AS t FROM turns),
q AS (SELECT unnest([0, 1]) AS q, unnest(['ther', 'on']) AS p),
hits AS (SELECT chunk_id, q, len(list_filter(t, lambda x: starts_with(x, p))) AS tf, len(t) AS dl FROM toks, q),
stat AS (SELECT count(*) AS n_all, avg(len(t)) AS avgdl FROM toks),
dfs AS (SELECT q, count(*) AS n FROM hits WHERE tf > 0 GROUP BY q),
ranked AS (
  SELECT chunk_id, -sum(CASE WHEN ln((n_all - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_all - n + 0.5) / (n + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS rank
  FROM hits JOIN dfs USING (q), stat WHERE tf > 0 GROUP BY chunk_id HAVING count(*) = 2)"""
)
VECTORS = """probe AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
sims AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS similarity FROM embeddings, probe),
vc AS (SELECT vec_id AS chunk_id, vec_id // 4 AS document_id, vec_id % 4 AS chunk_index, 'role ' || label AS author, 'p' || (label % 3) AS project, similarity,
  strftime(TIMESTAMP '2024-01-01' + to_hours(vec_id // 4), '%Y-%m-%d %H:%M:%S') AS clip_date, CASE WHEN label % 4 = 0 THEN 0.5 ELSE 1.0 END AS weight FROM sims)"""


def index_of(spark, sf):
    turns = m.turns(spark, sf)
    return turns, lexical.postings(turns), lexical.lengths(turns)


def probe(spark, sf) -> list[float]:
    return list(m.vectors(spark, sf).filter("id = 0").first()["embedding"])


def stats_counts(spark, sf):
    return worklists.counts(documents=m.documents(spark, sf), entries=m.turns(spark, sf), embeddings=m.vectors(spark, sf), tags=m.tags(spark, sf))


def derived(spark, sf):
    rows = m.table(spark, sf, "labels")
    state = lambda c: F.when(c, "ok").otherwise("bad").alias("quality")
    content = F.concat(F.lit("brief of "), F.col("doc_id")).alias("content")
    one = rows.select(F.col("doc_id").alias("document_id"), F.lit("detailed").alias("content_type"), content, state(F.col("quality") == 1))
    return one.unionByName(rows.select(F.col("doc_id").alias("document_id"), F.lit("brief").alias("content_type"), content, state(F.col("toxic") == 0)))


def derive_status(spark, sf):
    return worklists.derive_status(m.documents(spark, sf), derived(spark, sf))


def extraction_status(spark, sf):
    claims = m.turns(spark, sf).filter("author = 'user'").select("document_id")
    return worklists.extraction_status(m.documents(spark, sf), claims)


def list_documents(spark, sf):
    turns = m.turns(spark, sf)
    entries = turns.select(F.col("entry_id").alias("id"), "document_id", F.col("entry_position").alias("position"), "body")
    rows = listing.list_documents(m.threads(spark, sf), entries, turns.filter("body <> ''").select("entry_id"), m.tags(spark, sf), derived(spark, sf))
    return rows.select("id", "source_title", "clip_date", "entry_count", "chunk_count", "first_line", "tags", "brief")


def dump_filtered(spark, sf):
    turns = m.turns(spark, sf).select("document_id", F.col("entry_position").alias("position"), "author", "heading_title", "body")
    return listing.dump(m.threads(spark, sf), turns, "READ 3").select("document_id", "source_title", F.col("position").cast("bigint").alias("position"), "author", "body")


def document_nested(spark, sf):
    turns = m.turns(spark, sf)
    entries = turns.select(F.col("entry_id").alias("id"), "document_id", F.col("entry_position").alias("position"), "author", "heading_title", "body")
    chunks = turns.select("entry_id", "chunk_index", F.lit(0).alias("start_char"), F.octet_length("body").alias("end_char"), "body")
    return listing.nested(m.threads(spark, sf), entries, chunks)


def tag_counts(spark, sf):
    return listing.tag_counts(m.tags(spark, sf))


def tag_exclusion(spark, sf):
    return filters.without_tags(m.documents(spark, sf).select("id", "source_title"), m.tags(spark, sf), TAGS.hidden(["junk"]), "id")


def tag_expansion(spark, sf):
    return filters.with_tags(m.documents(spark, sf).select("id"), m.tags(spark, sf), TAGS.expand(["hidden"]), "id")


def global_filter(spark, sf):
    ids = m.documents(spark, sf).select(F.col("id").alias("document_id"))
    return filters.global_filter(ids, m.tags(spark, sf), ["archived", "other"], ["junk"], TAGS.expand(["hidden"])).select(F.col("document_id").alias("id"))


def fts_prefix_hits(spark, sf):
    _, index, _ = index_of(spark, sf)
    return lexical.prefix_hits(index, lexical.fold_query(QUERY)).select("chunk_id", "q", "tf", "dl")


def fts_bm25_topk(spark, sf):
    turns, index, sizes = index_of(spark, sf)
    hits = lexical.search(turns, index, sizes, m.tags(spark, sf), QUERY)
    return hits.select("chunk_id", "document_id", F.round("rank", 9).alias("rank"))


def fts_filters(spark, sf):
    turns, index, sizes = index_of(spark, sf)
    return lexical.search(turns, index, sizes, m.tags(spark, sf), QUERY, WANTED).select("chunk_id", F.round("rank", 9).alias("rank"))


def text_index(spark, sf):
    """All turns in an index of two segments, of which one replaces the turns of role user that the first holds too."""
    index, turns = TextIndex(spark, scratch(spark, "text-index")), m.turns(spark, sf)
    index.add(turns)
    again = turns.filter("author = 'user'")
    index.remove(again)
    index.add(again)
    return turns, index


def fts_index_topk(spark, sf):
    turns, index = text_index(spark, sf)
    return lexical.search_index(turns, index, m.tags(spark, sf), QUERY).select("chunk_id", "document_id", F.round("rank", 9).alias("rank"))


def fts_index_filters(spark, sf):
    turns, index = text_index(spark, sf)
    return lexical.search_index(turns, index, m.tags(spark, sf), QUERY, WANTED).select("chunk_id", F.round("rank", 9).alias("rank"))


def fts_grouped(spark, sf):
    turns, index, sizes = index_of(spark, sf)
    hits = lexical.search(turns, index, sizes, m.tags(spark, sf), QUERY).withColumn("snippet", F.col("body")).withColumn("chunk_body", F.col("body"))
    return grouping.group_lexical(hits).select("document_id", "clip_date", F.round("best_rank", 9).alias("best_rank"))


def fts_snippets(spark, sf):
    turns, index, sizes = index_of(spark, sf)
    hits = lexical.snippets(lexical.search(turns, index, sizes, m.tags(spark, sf), QUERY), QUERY).withColumn("chunk_body", F.col("body"))
    return grouping.group_lexical(hits, "date").select("document_id", "best_rank", F.inline("chunks")).select("document_id", "best_rank", "entry_position", "chunk_index", "snippet", "rank")


def term_frequencies(spark, sf):
    _, index, _ = index_of(spark, sf)
    return index.groupBy("term").agg(F.count("*").alias("n_chunks"), F.sum("tf").alias("n"))


def knn_topk(spark, sf):
    return vector.knn(m.vectors(spark, sf), probe(spark, sf), 10).select("id", F.round("similarity", 6).alias("similarity"))


def vector_index(spark, sf):
    return VectorIndex.build(m.vectors(spark, sf), scratch(spark, "vector-index"))


def knn_index(spark, sf):
    """The index with all lists probed: the exact result from codes and the vectors that they leave open."""
    index = vector_index(spark, sf)
    return index.search(probe(spark, sf), 10, probes=len(index.ids)).select("id", F.round("similarity", 6).alias("similarity"))


def knn_index_batch(spark, sf):
    """The ten nearest of every hundredth vector, all in one search."""
    index = vector_index(spark, sf)
    asked = [(r.id, r.embedding) for r in m.vectors(spark, sf).filter("id % 100 = 0").orderBy("id").collect()]
    return index.search_many(asked, 10, probes=len(index.ids)).select("query", "id", F.round("similarity", 6).alias("similarity"))


def knn_index_allowed(spark, sf):
    """The nearest among the vectors of documents that aren't hidden."""
    index = vector_index(spark, sf)
    shown = filters.without_tags(m.vectors(spark, sf).select("id"), m.tags(spark, sf), ("junk", "archived"), "id")
    return index.search(probe(spark, sf), 10, probes=len(index.ids), allowed=shown).select("id", F.round("similarity", 6).alias("similarity"))


def knn_overfetch(spark, sf):
    hits = vector.search(m.vector_chunks(spark, sf), m.vectors(spark, sf), m.tags(spark, sf), probe(spark, sf), 10, NEAR)
    return hits.select("chunk_id", "author", F.round("similarity", 6).alias("similarity"))


def knn_project(spark, sf):
    hits = vector.search(m.vector_chunks(spark, sf), m.vectors(spark, sf), m.tags(spark, sf), probe(spark, sf), 10, filters.Filters(project="p1"))
    return hits.select("chunk_id", F.round("similarity", 6).alias("similarity"))


def knn_grouped(spark, sf):
    hits = vector.search(m.vector_chunks(spark, sf), m.vectors(spark, sf), m.tags(spark, sf), probe(spark, sf), 50)
    return grouping.group_semantic(hits).select("document_id", F.round("best_rank", 6).alias("best_rank"), F.size("chunks").cast("bigint").alias("n_hits"))


def chunk_nms(spark, sf):
    chunks = m.vector_chunks(spark, sf).withColumn("end_char", F.col("start_char") + 150)
    hits = chunks.join(m.vectors(spark, sf).select(F.col("id").alias("chunk_id"), "embedding"), "chunk_id").withColumn("similarity", F.round(vector.cosine(F.col("embedding"), vector.vector(probe(spark, sf))), 6))
    return vector.suppress_overlaps(hits).select("chunk_id", "document_id")


def claims_topk(spark, sf):
    rows = m.vectors(spark, sf).select(F.col("id").alias("claim_id"), F.col("id").alias("document_id"))
    hits = vector.claims(rows, m.vectors(spark, sf), m.tags(spark, sf), probe(spark, sf), 10, ("junk", "archived"))
    return hits.select("claim_id", F.round("similarity", 6).alias("similarity"))


def similar_turns(spark, sf):
    from pyspark.sql import Window

    turns = m.turns(spark, sf).select("document_id", "entry_position", "body")
    before = F.lag("body").over(Window.partitionBy("document_id").orderBy("entry_position"))
    pairs = turns.withColumn("previous", before).filter("previous IS NOT NULL")
    return pairs.select("document_id", F.col("entry_position").cast("bigint").alias("entry_position"), snippets_similar(F.col("body"), F.col("previous")).alias("similar"))


def hit_numbers(spark, sf):
    turns, index, sizes = index_of(spark, sf)
    hits = lexical.search(turns, index, sizes, m.tags(spark, sf), QUERY).withColumn("snippet", F.col("body")).withColumn("chunk_body", F.col("body"))
    return grouping.numbered(grouping.group_lexical(hits)).select("number", "document_id", F.col("chunk.entry_position").alias("entry_position"))


QUERIES = {
    f.__name__: f
    for f in (
        stats_counts, derive_status, extraction_status, list_documents, dump_filtered, document_nested, tag_counts, tag_exclusion, tag_expansion, global_filter, fts_prefix_hits, fts_bm25_topk,
        fts_filters, fts_index_topk, fts_index_filters, fts_grouped, fts_snippets, hit_numbers, term_frequencies, knn_topk, knn_index, knn_index_batch, knn_index_allowed, knn_overfetch, knn_project, knn_grouped, chunk_nms, claims_topk, similar_turns,
    )
}

FTS_TOP = f"WITH {BM25} SELECT chunk_id, document_id, round(rank, 9) AS rank FROM ranked JOIN turns USING (chunk_id) ORDER BY ranked.rank, chunk_id LIMIT 200"
FTS_FILTERED = f"WITH {TAG_ROWS}, {BM25} SELECT chunk_id, round(rank, 9) AS rank FROM ranked JOIN turns USING (chunk_id) WHERE author ILIKE '%USER%' AND clip_date >= '2024-01-01 10:00:00' AND clip_date <= '2024-01-20' AND project = 'p1' AND NOT EXISTS (SELECT 1 FROM tags t WHERE t.document_id = turns.document_id AND tag = 'junk') ORDER BY ranked.rank, chunk_id LIMIT 200"

ORACLE = {
    "fts_index_topk": FTS_TOP,
    "fts_index_filters": FTS_FILTERED,
    "stats_counts": f"WITH {TAG_ROWS} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM conversations) AS entries, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM tags) AS tags",
    "derive_status": "SELECT (SELECT count(*) FROM documents) AS total_documents, count_if(quality = 1)::BIGINT AS detailed_ok, count_if(quality <> 1)::BIGINT AS detailed_bad, count_if(toxic = 0)::BIGINT AS brief_ok, count_if(toxic <> 0)::BIGINT AS brief_bad, 0::BIGINT AS detailed_stale FROM labels",
    "extraction_status": "SELECT (SELECT count(*) FROM documents) AS total, count(DISTINCT conv_id) AS with_claims, count(*) AS claims, (SELECT count(*) FROM documents) - count(DISTINCT conv_id) AS missing FROM conversations WHERE role = 'user'",
    "list_documents": f"""WITH {TAG_ROWS}, {TURNS}, firsts AS (
  SELECT document_id, count(*) AS entry_count, count_if(body <> '')::BIGINT AS chunk_count, arg_min(substr(body, 1, 100), entry_position) FILTER (WHERE trim(body) <> '') AS first_line, min(source_title) AS source_title, min(clip_date) AS clip_date FROM turns GROUP BY document_id),
tl AS (SELECT document_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY document_id),
br AS (SELECT doc_id AS document_id, 'brief of ' || doc_id AS brief FROM labels WHERE toxic = 0)
SELECT document_id AS id, source_title, clip_date, entry_count, chunk_count, first_line, tags, brief FROM firsts LEFT JOIN tl USING (document_id) LEFT JOIN br USING (document_id)""",
    "dump_filtered": f"WITH {TURNS} SELECT document_id, source_title, entry_position AS position, author, body FROM turns WHERE source_title ILIKE '%READ 3%'",
    "tag_counts": f"WITH {TAG_ROWS} SELECT tag, count(*) AS n_documents FROM tags GROUP BY tag",
    "tag_exclusion": f"WITH {TAG_ROWS}, {DOCS} SELECT id, source_title FROM docs WHERE NOT EXISTS (SELECT 1 FROM tags WHERE document_id = id AND tag IN ('junk'))",
    "tag_expansion": f"WITH {TAG_ROWS}, {DOCS} SELECT id FROM docs WHERE EXISTS (SELECT 1 FROM tags WHERE document_id = id AND tag IN ('hidden', 'archived', 'junk'))",
    "global_filter": f"WITH {TAG_ROWS}, {DOCS} SELECT id FROM docs WHERE EXISTS (SELECT 1 FROM tags WHERE document_id = id AND tag = 'archived') AND NOT EXISTS (SELECT 1 FROM tags WHERE document_id = id AND tag = 'junk')",
    "fts_prefix_hits": f"WITH {BM25} SELECT chunk_id, q, tf::BIGINT AS tf, dl::INTEGER AS dl FROM hits WHERE tf > 0",
    "fts_bm25_topk": FTS_TOP,
    "fts_filters": FTS_FILTERED,
    "fts_grouped": f"WITH {BM25}, top AS (SELECT * FROM ranked JOIN turns USING (chunk_id) ORDER BY ranked.rank, chunk_id LIMIT 200) SELECT document_id, clip_date, round(min(rank * weight), 9) AS best_rank FROM top GROUP BY document_id, clip_date",
    "term_frequencies": "WITH " + TURNS + r", t AS (SELECT chunk_id, unnest(regexp_extract_all(lower(strip_accents(body)), '[\p{L}\p{N}]+')) AS term FROM turns) SELECT term, count(DISTINCT chunk_id) AS n_chunks, count(*) AS n FROM t GROUP BY term",
    "knn_topk": f"WITH {VECTORS} SELECT vec_id AS id, round(similarity, 6) AS similarity FROM sims ORDER BY sims.similarity DESC, id LIMIT 10",
    "knn_index": f"WITH {VECTORS} SELECT vec_id AS id, round(similarity, 6) AS similarity FROM sims ORDER BY sims.similarity DESC, id LIMIT 10",
    "knn_index_batch": """WITH s AS (SELECT a.vec_id AS query, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0)
SELECT query, id, round(similarity, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY s.similarity DESC, id) <= 10""",
    "knn_index_allowed": f"WITH {TAG_ROWS}, {VECTORS} SELECT vec_id AS id, round(similarity, 6) AS similarity FROM sims WHERE NOT EXISTS (SELECT 1 FROM tags WHERE document_id = vec_id) ORDER BY sims.similarity DESC, id LIMIT 10",
    "knn_overfetch": f"WITH {TAG_ROWS}, {VECTORS}, near AS (SELECT * FROM vc ORDER BY similarity DESC, chunk_id LIMIT 50) SELECT chunk_id, author, round(similarity, 6) AS similarity FROM near WHERE contains(lower(author), 'role') AND clip_date <= '2024-01-05' AND NOT EXISTS (SELECT 1 FROM tags t WHERE t.document_id = near.document_id AND tag = 'junk') ORDER BY near.similarity DESC, chunk_id LIMIT 10",
    "knn_project": f"WITH {VECTORS} SELECT chunk_id, round(similarity, 6) AS similarity FROM vc WHERE project = 'p1' ORDER BY vc.similarity DESC, chunk_id LIMIT 10",
    "knn_grouped": f"WITH {VECTORS}, near AS (SELECT * FROM vc ORDER BY similarity DESC, chunk_id LIMIT 50) SELECT document_id, round(min(-similarity * weight), 6) AS best_rank, count(*) AS n_hits FROM near GROUP BY document_id",
    "chunk_nms": f"""WITH RECURSIVE {VECTORS}, r AS (SELECT chunk_id, document_id, chunk_index * 100 AS a, chunk_index * 100 + 150 AS b, row_number() OVER (PARTITION BY document_id ORDER BY round(similarity, 6) DESC, chunk_id) AS r FROM vc),
fold AS (SELECT document_id, 1::BIGINT AS step, [chunk_id] AS kept, [a] AS starts FROM r WHERE r = 1
  UNION ALL SELECT f.document_id, f.step + 1, CASE WHEN len(list_filter(f.starts, lambda s: s < x.b AND x.a < s + 150)) > 0 THEN f.kept ELSE list_append(f.kept, x.chunk_id) END, CASE WHEN len(list_filter(f.starts, lambda s: s < x.b AND x.a < s + 150)) > 0 THEN f.starts ELSE list_append(f.starts, x.a) END FROM fold f JOIN r x ON x.document_id = f.document_id AND x.r = f.step + 1)
SELECT unnest(kept) AS chunk_id, document_id FROM fold f WHERE step = (SELECT max(r) FROM r WHERE r.document_id = f.document_id)""",
    "claims_topk": f"WITH {TAG_ROWS}, {VECTORS}, near AS (SELECT * FROM sims ORDER BY similarity DESC, vec_id LIMIT 50) SELECT vec_id AS claim_id, round(similarity, 6) AS similarity FROM near WHERE NOT EXISTS (SELECT 1 FROM tags WHERE document_id = vec_id) ORDER BY near.similarity DESC, vec_id LIMIT 10",
    "similar_turns": "WITH " + TURNS + r""", p AS (SELECT document_id, entry_position, trim(body) AS a, trim(lag(body) OVER (PARTITION BY document_id ORDER BY entry_position)) AS b FROM turns),
w AS (SELECT *, list_filter(regexp_split_to_array(a, '\s+'), lambda x: x <> '') AS wa, list_filter(regexp_split_to_array(b, '\s+'), lambda x: x <> '') AS wb FROM p WHERE b IS NOT NULL)
SELECT document_id, entry_position, a = b OR (least(len(wa), len(wb)) >= 5 AND len(list_filter(wa, lambda x: list_contains(wb, x))) / least(len(wa), len(wb)) > 0.8) AS similar FROM w""",
}
