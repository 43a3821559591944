"""One query per operator over the standard tables, and the SQL that gives the same rows.

The documents table plays files and chunks (/source/lang/doc_id.txt), labels give tags, embeddings are chunk vectors whose label is
their file, pages are HTML files, events are the change log, conversations are ordered paragraphs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.paths import excluded
from foliant.functions.text import any_term, highlights, html_escape, lexical_tokens, matched_terms, one_line, snippet, split_tags, time_text
from foliant.operators import clusters, fusion, grouping, indexer, lexical, links, mindmap, snapshot, status, tags, vectors
from foliant.operators.export import export_rows
from foliant.operators.search import Engine, chunks_of, exclude_rows, files_with_tags
from foliant.operators.vectorindex import VectorIndex
from foliant.plans.compiler import any_value, predicate
from foliant.plans.querylang import combine, parse_query, tag_query
from foliant.scale import numbered, read_table, release, shared_dir, ship, spread, stash
from foliant.sources.parsing import ChunkConfig, chunk_files, explode_chunks, paragraphs_of, title_of
from foliant.sources.parsing import section_ids as section_ids_of
from foliant.sources.scan import documents_as_files
from foliant.streaming.watch import debounce

TEXT = "licensed under the apache license"
NESTED = '(tag:quality OR path:/src1/*) "license" -tag:toxic'


def chunks(spark: SparkSession, d: str) -> DataFrame:
    labels = read_table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    f = documents_as_files(read_table(spark, d, "documents")).join(labels, "doc_id", "left")
    lang = F.element_at(F.split("file_path", "/"), 3)
    own = F.array(lang, F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))
    rest = [F.lit(None).cast("string").alias("title"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.filter(own, lambda t: t.isNotNull()).alias("file_tags")]
    return f.select(F.col("doc_id").alias("id"), "file_path", "file_name", "source", *rest)


def file_tags(spark, d):
    return chunks(spark, d).select("file_path", F.posexplode("file_tags").alias("ord", "tag"))


def texts(spark, d):
    return read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")


def engine(spark, d, mode="keyword"):
    return Engine(chunks(spark, d), None, mode)


def bm25_topk(spark, d):
    """Flagship: tokenise, score and cut all documents in one scan; snippet and terms for the ten that stay."""
    best = lexical.top(lexical.bm25(texts(spark, d), TEXT), "lexical_score", 10)
    t = texts(spark, d).join(F.broadcast(best), "id").withColumn("matched_terms", matched_terms(F.col("text"), TEXT.split()))
    return t.select("id", F.round("lexical_score", 6).alias("lexical_score"), "rank", F.array_join("matched_terms", ",").alias("terms"))


def bm25_filtered(spark, d):
    best = lexical.top(lexical.bm25(texts(spark, d), TEXT, where="source = 'src1'"), "lexical_score", 10)
    return best.select("id", F.round("lexical_score", 6).alias("lexical_score"), "rank")


def bm25_postings(spark, d):
    post = lexical.postings(texts(spark, d))
    best = lexical.top(lexical.bm25_indexed(post, lexical.query_terms(spark, TEXT)), "lexical_score", 10)
    return best.select("id", F.round("lexical_score", 6).alias("lexical_score"), "rank")


def tokenize(spark, d):
    return texts(spark, d).select("id", F.md5(F.encode(F.array_join(lexical_tokens(F.col("text")), " "), "UTF-8")).alias("tokens_md5"))


def keyword_tags(spark, d):
    """Candidates come from the first 5,000 characters, as the SQL has it; elsewhere whole texts count."""
    t = texts(spark, d).withColumn("title", F.concat(F.lit("doc "), F.col("id").cast("string")))
    return tags.keyword_tags(t, "id", body_chars=5000)


def _where(condition):
    return lambda spark, d: chunks(spark, d).where(predicate(parse_query(condition).expr)).select("id")


def tags_and(spark, d):
    ft = file_tags(spark, d)
    return chunks_of(chunks(spark, d), files_with_tags(ft, ["en", "quality"])).select("id")


def browse(spark, d):
    return engine(spark, d).search("tag:quality path:src1").select("id", "file_path", "rank", "search_mode")


def snippets(spark, d):
    t = texts(spark, d).withColumn("terms", matched_terms(F.col("text"), ["license", "token", "rights"]))
    return t.select("id", F.md5(F.encode(snippet(F.col("text"), F.col("terms")), "UTF-8")).alias("snippet_md5"))


def matched(spark, d):
    return texts(spark, d).select("id", F.array_join(matched_terms(F.col("text"), ["license", "token", "the"]), ",").alias("terms"))


def _vectors(spark, d):
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _probe(spark, d):
    return list(read_table(spark, d, "embeddings").where("vec_id = 0").first().embedding)


def _ranked(t, score):
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "id")))


def knn(spark, d):
    return _ranked(vectors.knn(_vectors(spark, d), _probe(spark, d), 10), "similarity").select("id", F.round("similarity", 6).alias("similarity"), "rank")


def knn_prefiltered(spark, d):
    return _ranked(vectors.knn(_vectors(spark, d), _probe(spark, d), 10, where=any_value(label=[1, 2])), "similarity").select("id", F.round("similarity", 6).alias("similarity"), "rank")


def knn_all_blocks(spark, d):
    v = _vectors(spark, d)
    near = vectors.knn_join(v, v.where("id % 20 = 0"), 5)
    return near.select(F.col("query").alias("probe"), "id", F.round("similarity", 6).alias("similarity"), "rank")


def knn_index(spark, d):
    """The nearest five of every row whose id is divisible by 20, from inverted lists over all rows; about those of ``knn_query_blocks``."""
    v = _vectors(spark, d)
    root = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    near = stash(VectorIndex.build(v, root).search_all(v.where("id % 20 = 0"), 5))
    release(spark, [root])
    return near.select(F.col("query").alias("probe"), "id", F.round("similarity", 6).alias("similarity"), "rank")


def similar(spark, d):
    t = vectors.similar_files(_vectors(spark, d).withColumn("label", F.col("label").cast("string")), "0", 5, "label")
    return t.select("label", "id", F.round("similarity", 6).alias("similarity"))


def mean_pool(spark, d):
    t = vectors.file_vectors(_vectors(spark, d), "label")
    return t.select("label", F.posexplode("vec").alias("pos", "v")).select("label", "pos", F.round("v", 6).alias("v"))


def dup_pairs(spark, d):
    t = vectors.duplicate_pairs(_vectors(spark, d), 0.3, "id", "embedding")
    return t.select("a", "b", F.round("similarity", 6).alias("similarity"))


def _lists(spark, d):
    near = _ranked(vectors.knn(_vectors(spark, d), _probe(spark, d), 30), "similarity").select("id", "similarity", "rank")
    lex = lexical.top(lexical.bm25(texts(spark, d), TEXT), "lexical_score", 30)
    return near, lex


def rrf(spark, d):
    near, lex = _lists(spark, d)
    return fusion.rrf(near, lex, top_n=20).select("id", "rrf_score", "rank")


def hybrid(spark, d):
    near, lex = _lists(spark, d)
    t = fusion.rrf(near, lex, top_n=10)
    shown = F.coalesce("similarity", fusion.display_score(F.col("lexical_score")))
    return t.select("id", "rrf_score", "rank", F.round(shown, 6).alias("similarity"), F.round("lexical_score", 6).alias("lexical_score"))


def min_max(spark, d):
    _, lex = _lists(spark, d)
    return fusion.min_max(lex, "lexical_score").select("id", F.round("lexical_score_norm", 6).alias("lexical_score_norm"))


def keyword_search(spark, d):
    return engine(spark, d).search(TEXT, 10).select("id", F.round("similarity", 6).alias("similarity"), "rank")


def indexed_search(spark, d):
    """Keyword search over stored postings and statistics; the texts are only read for the rows that are shown."""
    c = chunks(spark, d)
    post = stash(lexical.postings(c.select("id", "content"), text="content").repartitionByRange("term").sortWithinPartitions("term"))
    e = Engine(c, None, "keyword", post, stash(lexical.index_stats(post)))
    return e.search(TEXT, 10).select("id", F.round("similarity", 6).alias("similarity"), "rank")


def boolean_search(spark, d):
    return engine(spark, d).search("(license OR token) NOT tag:toxic", 10).select("id", F.round("lexical_score", 6).alias("lexical_score"), "rank")


def _hits(spark, d):
    return engine(spark, d).search("license", 50)


def group_file(spark, d):
    rows = _hits(spark, d).withColumn("file_path", F.regexp_replace("file_path", "/[^/]*$", ""))
    return grouping.by_file(rows).select("file_path", "first_rank", "n_hits", F.round("best_similarity", 6).alias("best_similarity"))


def group_tag(spark, d):
    return grouping.by_tag(_hits(spark, d))


def group_source(spark, d):
    roots = spark.createDataFrame([("/src1", 0), ("/src2", 1), ("/src3", 2)], "source string, ord int")
    return grouping.by_source(_hits(spark, d), roots)


def cap(spark, d):
    rows = _hits(spark, d).withColumn("file_path", F.regexp_replace("file_path", "/[^/]*/[^/]*$", ""))
    return grouping.per_file_cap(rows, 2).select("id", "file_path", "nth")


def best_group(spark, d):
    q = F.array(*[F.lit(float(x)) for x in _probe(spark, d)])
    t = _vectors(spark, d).withColumn("similarity", F.round(vectors.dot(vectors.doubles(F.col("embedding")), q), 6))
    return grouping.best_per_group(t, "label", "similarity", "id")


def _old_new(spark, d):
    f = documents_as_files(read_table(spark, d, "documents")).select("file_path", "md5_hash", "source")
    # The index lacks one source and holds older versions of one language; another source has left the disk.
    old = f.where("source <> '/src2'").withColumn("md5_hash", F.when(F.col("file_path").contains("/de/"), F.lit("old")).otherwise(F.col("md5_hash")))
    return f.where("source <> '/src3'").drop("source"), old.drop("source")


def incremental(spark, d):
    return indexer.diff(*_old_new(spark, d)).select("file_path", "change")


def change_counts(spark, d):
    return indexer.diff(*_old_new(spark, d)).groupBy("change").agg(F.count(F.lit(1)).alias("n_files"))


def content_files(spark, d):
    """The documents as files with content, for an index."""
    f = documents_as_files(read_table(spark, d, "documents")).withColumn("modified_time", F.lit(None).cast("timestamp")).withColumn("content", F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return spread(f.select("file_path", "file_name", "file_extension", "file_size", "modified_time", "source", "content"), "file_path")


def _synced(spark, d, config=ChunkConfig()):
    """An index of all files, synced again after a source has left, another has come and one language's texts have changed."""
    f = content_files(spark, d)
    older = f.where("source <> '/src2'").withColumn("content", F.when(F.col("file_path").contains("/de/"), F.encode(F.lit("older licensed license"), "UTF-8")).otherwise(F.col("content")))
    index = indexer.Index(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", config=config)
    index.sync_files(older)
    return index, index.sync_files(f.where("source <> '/src3'"))


def index_sync(spark, d):
    """The files of an index after two syncs, and the second's counts."""
    index, counts = _synced(spark, d)
    out = stash(index.table("files").select("file_path", "md5_hash", (F.col("n_lex") > 0).alias("has_tokens"), *[F.lit(counts[k]).alias(f"n_{k}") for k in ("new", "updated", "unchanged", "removed")]))
    release(spark, [index.root])
    return out


def index_search(spark, d):
    """Keyword search over an index after two syncs, a chunk a file: the terms' live postings, and statistics from the manifest."""
    index, _ = _synced(spark, d, ChunkConfig(max_size=1 << 40))
    out = stash(index.engine("keyword").search(TEXT, 10).select("file_path", F.round("lexical_score", 6).alias("lexical_score"), "rank"))
    release(spark, [index.root])
    return out


def orphan(spark, d):
    return indexer.orphans(*_old_new(spark, d)).select("file_path")


def merge_tags(spark, d):
    ft = file_tags(spark, d)
    new = ft.select("file_path").distinct().select("file_path", F.explode(F.array(F.lit("en"), F.lit("added"))).alias("tag")).withColumn("ord", F.when(F.col("tag") == "en", 0).otherwise(1))
    return tags.tags_of(tags.add_tags(ft, new)).select("file_path", F.array_join("file_tags", ",").alias("tags"))


def per_source(spark, d):
    f = documents_as_files(read_table(spark, d, "documents"))
    roots = spark.createDataFrame([(f"/src{i}", True) for i in range(1, 8)] + [("/src9", False)], "source string, enabled boolean")
    return status.files_per_source(f, roots)


def overview(spark, d):
    c = chunks(spark, d)
    star = c.where("array_contains(file_tags, 'toxic')").select("file_path")
    return status.overview(c, c, file_tags(spark, d), star)


def recent(spark, d):
    e = read_table(spark, d, "events").select(F.col("event_id").cast("string").alias("file_path"), F.col("ts").alias("modified_time"))
    return status.recent_updates(e).select("file_path", time_text(F.col("modified_time")).alias("updated"))


def starred(spark, d):
    c = chunks(spark, d).select("file_path", "file_name")
    out = status.starred_first(c, c.where(F.col("file_path").contains("/en/")))
    return numbered(out, [F.desc("starred"), F.lower("file_name"), F.col("file_path")], "pos").select("file_path", "starred", F.col("pos").cast("int").alias("pos"))


def exact_dups(spark, d):
    return status.exact_duplicates(documents_as_files(read_table(spark, d, "documents")))


def html_title(spark, d):
    return read_table(spark, d, "pages").select("page_id", title_of(F.col("html"), F.lit(".html"), F.lit("page")).alias("title"))


def html_links(spark, d):
    return links.html_links(read_table(spark, d, "pages"))


def _edges(spark, d):
    p = read_table(spark, d, "pages")
    urls = p.groupBy("url").agg(F.min("page_id").alias("target"))
    return links.html_links(p).join(urls, F.col("href") == F.col("url"), "left").select(F.col("page_id").alias("source"), "href", "target")


def incoming(spark, d):
    e = _edges(spark, d).select("source", F.coalesce(F.col("target").cast("string"), "href").alias("target"))
    return links.incoming(e).select("target", F.size("sources").alias("n_sources"))


def dangling(spark, d):
    return _edges(spark, d).where("target is null").select("href").distinct()


def sessions(spark, d):
    e = read_table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    t = debounce(e, ["user_id"], 1_800_001)
    return t.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_bursts"), F.sum("n_events").alias("n_events"), F.max("n_events").alias("largest"))


def searches(spark, d):
    log = read_table(spark, d, "events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("q"), "ts")
    return snapshot.recent_searches(log).select("q", time_text(F.col("ts")).alias("last"))


def section_ids(spark, d):
    """Conversations as paragraphs: a user's turn is a heading."""
    t = read_table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", "heading").otherwise("paragraph").alias("type"), F.lit(1).alias("level"))
    return section_ids_of(t).select(F.col("id").alias("conv_id"), F.col("pos").alias("turn"), "section")


def exclude(spark, d):
    return exclude_rows(chunks(spark, d), ["license", "token"]).select("id")


def plain_filter(spark, d):
    return chunks(spark, d).where(~any_term(F.col("content"), ["the"]) & F.col("file_path").startswith("/src1/")).select("id")


def chunk_documents(spark, d):
    f = documents_as_files(read_table(spark, d, "documents")).withColumn("title", F.col("file_name")).withColumn("content", F.encode("text", "UTF-8"))
    return explode_chunks(chunk_files(spread(f, "file_path"), ChunkConfig()))


def parse_pages(spark, d):
    return paragraphs_of(read_table(spark, d, "pages").select(F.col("page_id").cast("string"), "html"), "html")


def kmeans(spark, d):
    v = _vectors(spark, d).select(F.concat(F.lit("/v/"), F.col("id").cast("string")).alias("file_path"), F.lit(None).cast("string").alias("title"), F.col("embedding").alias("vec"), "label")
    t = v.select("file_path", F.concat(F.lit("t"), F.col("label").cast("string")).alias("tag"))
    return clusters.cluster_files(v.drop("label"), t)


def hash_embedding(spark, d):
    ship(spark)
    return vectors.embed(texts(spark, d).withColumnRenamed("text", "content"), vectors.HashEmbedder(64)).select("id", "embedding")


def semantic_search(spark, d):
    """The vectors are stored, so that a search's passes over the chunks don't each compute all of them."""
    c = stash(vectors.embed(chunks(spark, d), vectors.HashEmbedder(64)))
    return Engine(c, vectors.HashEmbedder(64), "hybrid").search(TEXT, 10)


def mindmap_rows(spark, d):
    return mindmap.from_files(documents_as_files(read_table(spark, d, "documents")).select("file_path", "text"))


def mindmap_results(spark, d):
    return mindmap.from_results(_hits(spark, d)).withColumn("weight", F.round("weight", 6))


def mindmap_many(spark, d):
    return mindmap.from_many(documents_as_files(read_table(spark, d, "documents")).select("file_path", "text"), "documents")


def shared_topics(spark, d):
    return mindmap.shared_keywords(keyword_tags(spark, d).withColumnRenamed("id", "file_path"))


def exclude_paths(spark, d):
    f = documents_as_files(read_table(spark, d, "documents"))
    return f.where(~excluded(F.col("file_path"), "/", ["src2", "  ", "FR", "1?.txt", "src4/en/*"])).select("file_path")


def tag_picker(spark, d):
    both = combine(parse_query("license -token"), tag_query(["toxic", "de"], "OR"))
    return chunks(spark, d).where(predicate(both.expr)).select("id")


def highlight(spark, d):
    t = texts(spark, d).select("id", F.explode(highlights(F.col("text"), ["License", "licens", "token"])).alias("x"))
    return t.select("id", "x.start", "x.end")


def file_names(spark, d):
    return tags.filter_names(chunks(spark, d), "/EN/1").select("file_path")


def distinct_hits(spark, d):
    return grouping.distinct_rows(_hits(spark, d).withColumn("file_path", F.regexp_replace("file_path", "/[^/]*$", ""))).select("file_path")


def _label_clusters(spark, d):
    c = _vectors(spark, d).groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("files"))
    return c.select(F.col("label").alias("id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"), "files")


def merged_clusters(spark, d):
    return tags.merge_clusters(_label_clusters(spark, d), [2, 1], "both").select("id", "label", F.array_join(F.transform("files", lambda x: x.cast("string")), ",").alias("files"))


def cluster_sizes(spark, d):
    return clusters.cluster_sizes(_label_clusters(spark, d))


def retagged(spark, d):
    ft = file_tags(spark, d)
    new = ft.where("tag = 'toxic'").select("file_path", F.explode(F.array(F.lit("review"), F.lit("hidden"))).alias("tag")).withColumn("ord", F.when(F.col("tag") == "review", 0).otherwise(1))
    return tags.tags_of(tags.set_tags(ft, new)).select("file_path", F.array_join("file_tags", ",").alias("tags"))


def removed_files(spark, d):
    ft = file_tags(spark, d)
    return tags.drop_files(ft, tags.files_by_tag(ft, "toxic")).select("file_path", "tag")


def link_neighbours(spark, d):
    return links.neighbours(_edges(spark, d).select("source", F.coalesce(F.col("target"), F.lit(-1)).alias("target")), 0)


def node_cap(spark, d):
    return links.render_cap(_edges(spark, d).select(F.col("href").alias("path")).distinct())


def _notes(spark, d):
    """Pages as Markdown notes: a heading, anchors to known pages as wikilinks, other anchors as links, one fenced link."""
    e = _edges(spark, d).groupBy(F.col("source").alias("page_id")).agg(F.array_sort(F.collect_list(F.coalesce(F.concat(F.lit("[["), F.col("target").cast("string"), F.lit("|x]]")), F.concat(F.lit("[x](../b/"), F.md5("href"), F.lit(".md)"))))).alias("l"))
    p = read_table(spark, d, "pages").select("page_id").join(e, "page_id", "left")
    text = F.concat(F.lit("# note\n```\n[[hidden]]\n```\n"), F.array_join(F.coalesce("l", F.array().cast("array<string>")), "\n"))
    return p.select(F.concat(F.lit("/a/"), F.col("page_id").cast("string"), F.lit(".md")).alias("file_path"), F.lit("/a").alias("source"), F.lit(None).cast("string").alias("title"), text.alias("text"))


def markdown_links(spark, d):
    return links.extract_links(_notes(spark, d)).select("source", "target_raw", "link_type", "line")


def note_graph_edges(spark, d):
    n = _notes(spark, d)
    return links.graph(n, links.extract_links(n))[1].select("source", "target", "link_type")


def note_graph_nodes(spark, d):
    n = _notes(spark, d)
    return links.graph(n, links.extract_links(n))[0].select("path", "kind")


def summaries(spark, d):
    return texts(spark, d).select("id", F.md5(F.encode(one_line(F.col("text"), 100), "UTF-8")).alias("summary_md5"))


def escaped(spark, d):
    return texts(spark, d).select("id", F.md5(F.encode(html_escape(F.col("text")), "UTF-8")).alias("html_md5"))


def tag_input(spark, d):
    return texts(spark, d).select("id", F.size(split_tags(F.col("text"))).alias("n_tags"))


def text_paragraphs(spark, d):
    t = paragraphs_of(read_table(spark, d, "documents").select(F.col("doc_id").cast("string"), "text"), "text")
    return t.select("id", "pos", "line", F.md5(F.encode("content", "UTF-8")).alias("content_md5"))


def markdown_paragraphs(spark, d):
    return paragraphs_of(_notes(spark, d).select("file_path", "text"), "markdown")


def export_results(spark, d):
    return export_rows(_hits(spark, d))


QUERIES = {
    "bm25_topk": bm25_topk,
    "bm25_filtered_by_source": bm25_filtered,
    "bm25_postings": bm25_postings,
    "term_df": lambda s, d: lexical.term_stats(lexical.postings(texts(s, d))),
    "doc_stats": lambda s, d: lexical.doc_stats(texts(s, d)),
    "corpus_stats": lambda s, d: lexical.corpus_stats(texts(s, d)).select("n", F.round("avgdl", 6).alias("avgdl")),
    "tokenize_ascii": tokenize,
    "keyword_tags_top5": keyword_tags,
    "tag_counts": lambda s, d: tags.tag_counts(file_tags(s, d)),
    "all_tags": lambda s, d: tags.all_tags(file_tags(s, d)),
    "files_by_tag": lambda s, d: tags.files_by_tag(file_tags(s, d), "toxic"),
    "tag_distribution_top15": lambda s, d: status.top_tags(file_tags(s, d)),
    "filter_tags_and": tags_and,
    "filter_tags_or": _where("tag:toxic OR tag:de"),
    "filter_not": _where("tag:quality NOT tag:en"),
    "filter_path_glob": _where("path:/src1*/en/*"),
    "filter_exclude_terms": exclude,
    "filter_contains": plain_filter,
    "bool_nested": _where(NESTED),
    "browse_by_metadata": browse,
    "snippet_window": snippets,
    "matched_terms": matched,
    "knn_topk": knn,
    "knn_prefiltered": knn_prefiltered,
    "knn_query_blocks": knn_all_blocks,
    "knn_index_blocks": knn_index,
    "query_similar_by_label": similar,
    "file_vector_meanpool": mean_pool,
    "dup_pairs_cosine": dup_pairs,
    "rrf_fusion": rrf,
    "hybrid_search": hybrid,
    "normalize_minmax": min_max,
    "keyword_normalised": keyword_search,
    "indexed_search": indexed_search,
    "boolean_search": boolean_search,
    "exact_dups_md5": exact_dups,
    "group_by_file": group_file,
    "group_by_tag": group_tag,
    "group_by_source": group_source,
    "best_per_group": best_group,
    "per_file_cap": cap,
    "incremental_diff": incremental,
    "change_counts": change_counts,
    "index_sync": index_sync,
    "index_search": index_search,
    "orphans": orphan,
    "merge_tags": merge_tags,
    "status_per_source": per_source,
    "status_overview": overview,
    "recent_updates": recent,
    "starred_first": starred,
    "html_title": html_title,
    "html_links": html_links,
    "link_edges": _edges,
    "incoming_links": incoming,
    "dangling_nodes": dangling,
    "debounce_sessions": sessions,
    "recent_searches": searches,
    "section_groups": section_ids,
    "chunk_documents": chunk_documents,
    "parse_html_pages": parse_pages,
    "kmeans_clusters": kmeans,
    "hash_embedding": hash_embedding,
    "semantic_hybrid_search": semantic_search,
    "mindmap_rows": mindmap_rows,
    "mindmap_results": mindmap_results,
    "mindmap_many": mindmap_many,
    "shared_topics": shared_topics,
    "exclude_paths": exclude_paths,
    "tag_picker_or": tag_picker,
    "highlight_spans": highlight,
    "filter_file_names": file_names,
    "filter_tag_names": lambda s, d: tags.filter_tags(tags.tag_counts(file_tags(s, d)), "TO"),
    "tags_of_files": lambda s, d: tags.tags_of(file_tags(s, d)).select("file_path", F.array_join("file_tags", ",").alias("tags")),
    "distinct_hits": distinct_hits,
    "cluster_merge": merged_clusters,
    "cluster_sizes": cluster_sizes,
    "set_tags": retagged,
    "remove_files": removed_files,
    "link_neighbours": link_neighbours,
    "graph_node_cap": node_cap,
    "markdown_links": markdown_links,
    "note_graph_edges": note_graph_edges,
    "note_graph_nodes": note_graph_nodes,
    "one_line_summary": summaries,
    "html_escape": escaped,
    "split_tag_input": tag_input,
    "text_paragraphs": text_paragraphs,
    "markdown_paragraphs": markdown_paragraphs,
    "export_rows": export_results,
}

_C = """c AS (SELECT d.doc_id AS id, '/'||source||'/'||lang||'/'||d.doc_id||'.txt' AS file_path, d.doc_id||'.txt' AS file_name, '/'||source AS source, text AS content,
  list_filter([lang, CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS file_tags
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""
_FT = f"WITH {_C}, ft AS (SELECT file_path, unnest(file_tags) AS tag, generate_subscripts(file_tags, 1) AS ord FROM c)"
_TOK = "tok AS (SELECT doc_id AS id, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)"


def _bm25(terms: list[str], where: str = "true", extra: str = "") -> str:
    """CTEs that end in s (id, lexical_score)."""
    q = ", ".join(f"('{t}')" for t in terms)
    return f"""{_TOK}, st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok WHERE len(t) > 0), q(term) AS (VALUES {q}),
  tf AS (SELECT id, source, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS f FROM tok, q),
  df AS (SELECT term, count(*) AS df FROM tf WHERE f > 0 GROUP BY term),
  s AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS lexical_score
    FROM tf JOIN df USING (term), st WHERE f > 0 AND {where} GROUP BY id)"""


_SRC1 = "source = 'src1'"
_TERMS = ["licensed", "under", "the", "apache", "license"]
_TOP = "SELECT id, round(lexical_score, 6) AS lexical_score, CAST(row_number() OVER (ORDER BY lexical_score DESC, id) AS INT) AS rank FROM s QUALIFY rank <= {k}"
_V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), p AS (SELECT e AS q FROM v WHERE id = 0)"
_NEAR = "SELECT id, round(sim, 6) AS similarity, CAST(row_number() OVER (ORDER BY sim DESC, id) AS INT) AS rank FROM (SELECT id, list_cosine_similarity(e, q) AS sim FROM v, p WHERE {w}) QUALIFY rank <= {k}"
_FUSED = f"""WITH {_bm25(_TERMS)}, {_V}, l AS (SELECT id, lexical_score, row_number() OVER (ORDER BY lexical_score DESC, id) AS r FROM s QUALIFY r <= 30),
  m AS (SELECT id, sim, row_number() OVER (ORDER BY sim DESC, id) AS r FROM (SELECT id, list_cosine_similarity(e, q) AS sim FROM v, p) QUALIFY r <= 30),
  f AS (SELECT coalesce(m.id, l.id) AS id, sim, lexical_score, coalesce(1.0::DOUBLE / (60 + m.r), 0) + coalesce(1.0::DOUBLE / (60 + l.r), 0) AS x, m.r AS mr, l.r AS lr FROM m FULL JOIN l ON m.id = l.id),
  g AS (SELECT *, CAST(row_number() OVER (ORDER BY x DESC, mr NULLS LAST, lr NULLS LAST, id) AS INT) AS rank FROM f)"""
_HITS = f"""WITH {_C}, {_bm25(["license"])}, h AS (SELECT c.*, lexical_score / max(lexical_score) OVER () AS similarity, rank FROM
  (SELECT id, lexical_score, CAST(row_number() OVER (ORDER BY lexical_score DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 50) JOIN c USING (id))"""
_OLDNEW = """WITH f AS (SELECT '/'||source||'/'||lang||'/'||doc_id||'.txt' AS file_path, md5(text) AS h, source, lang FROM documents),
  o AS (SELECT file_path, CASE WHEN lang = 'de' THEN 'old' ELSE h END AS h FROM f WHERE source <> 'src2'), n AS (SELECT file_path, h FROM f WHERE source <> 'src3')"""
_DIFF = f"{_OLDNEW}, d AS (SELECT n.file_path, CASE WHEN o.h IS NULL THEN 'new' WHEN o.h = n.h THEN 'unchanged' ELSE 'updated' END AS change FROM n LEFT JOIN o ON n.file_path = o.file_path)"
_HREF = """WITH a AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS h FROM pages),
  b AS (SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS INT) AS pos, unnest(h) AS href FROM a),
  e AS (SELECT page_id AS source, href, u.target FROM b LEFT JOIN (SELECT url, min(page_id) AS target FROM pages GROUP BY url) u ON href = u.url)"""
_HAS = "list_filter({0}, lambda x: contains(lower({1}), x))"
_STOP_SQL = ", ".join(f"'{w}'" for w in tags.STOP_WORDS)

ORACLE = {
    "bm25_topk": f"""WITH {_bm25(_TERMS)}, k AS ({_TOP.format(k=10)})
  SELECT id, lexical_score, rank, array_to_string({_HAS.format("['apache', 'license', 'licensed', 'the', 'under']", "text")}, ',') AS terms FROM k JOIN documents ON id = doc_id""",
    "bm25_filtered_by_source": f"WITH {_bm25(_TERMS, _SRC1)} {_TOP.format(k=10)}",
    "bm25_postings": f"WITH {_bm25(_TERMS)} {_TOP.format(k=10)}",
    "term_df": f"WITH {_TOK} SELECT term, count(*) AS df FROM (SELECT id, unnest(list_distinct(t)) AS term FROM tok) GROUP BY term",
    "doc_stats": f"WITH {_TOK} SELECT id, CAST(len(t) AS INT) AS dl FROM tok WHERE len(t) > 0",
    "corpus_stats": f"WITH {_TOK} SELECT count(*) AS n, round(avg(len(t)), 6) AS avgdl FROM tok WHERE len(t) > 0",
    "tokenize_ascii": f"WITH {_TOK} SELECT id, md5(array_to_string(t, ' ')) AS tokens_md5 FROM tok",
    "keyword_tags_top5": f"""WITH w AS (SELECT doc_id AS id, text, list_filter(string_split_regex(lower('doc ' || doc_id), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: len(x) > 0) AS a,
    list_filter(string_split_regex(lower(substr(text, 1, 5000)), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: len(x) > 0) AS b FROM documents),
  u AS (SELECT id, unnest(list_concat(a, b)) AS tag, generate_subscripts(list_concat(a, b), 1) AS pos, len(a) AS na FROM w),
  g AS (SELECT id, tag, sum(CASE WHEN pos <= na THEN 3 ELSE 1 END) AS k, min(pos) AS first FROM u WHERE len(tag) > 1 AND tag NOT IN ({_STOP_SQL}) GROUP BY id, tag),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC, first) AS r FROM g QUALIFY r <= 10),
  n AS (SELECT r.id, tag, r, CAST((length(lower(text)) - length(replace(lower(text), tag, ''))) // length(tag) AS BIGINT) AS n FROM r JOIN documents ON id = doc_id)
  SELECT id, tag, CAST(row_number() OVER (PARTITION BY id ORDER BY n DESC, r) AS INT) AS ord, n FROM n WHERE n > 0 QUALIFY ord <= 5""",
    "tag_counts": f"{_FT} SELECT tag, count(DISTINCT file_path) AS n_files FROM ft GROUP BY tag",
    "all_tags": f"{_FT} SELECT DISTINCT tag FROM ft",
    "files_by_tag": f"{_FT} SELECT DISTINCT file_path FROM ft WHERE tag = 'toxic'",
    "tag_distribution_top15": f"{_FT} SELECT tag, count(DISTINCT file_path) AS n_files FROM ft GROUP BY tag ORDER BY n_files DESC, tag LIMIT 15",
    "filter_tags_and": f"WITH {_C} SELECT id FROM c WHERE list_contains(file_tags, 'en') AND list_contains(file_tags, 'quality')",
    "filter_tags_or": f"WITH {_C} SELECT id FROM c WHERE list_contains(file_tags, 'toxic') OR list_contains(file_tags, 'de')",
    "filter_not": f"WITH {_C} SELECT id FROM c WHERE list_contains(file_tags, 'quality') AND NOT list_contains(file_tags, 'en')",
    "filter_path_glob": f"WITH {_C} SELECT id FROM c WHERE regexp_matches(file_path, '^/src1.*/en/.*$')",
    "filter_exclude_terms": f"WITH {_C} SELECT id FROM c WHERE NOT contains(lower(content), 'license') AND NOT contains(lower(content), 'token')",
    "filter_contains": f"WITH {_C} SELECT id FROM c WHERE NOT contains(lower(content), 'the') AND starts_with(file_path, '/src1/')",
    "bool_nested": f"WITH {_C} SELECT id FROM c WHERE (list_contains(file_tags, 'quality') OR file_path LIKE '/src1/%') AND contains(lower(content), 'license') AND NOT list_contains(file_tags, 'toxic')",
    "browse_by_metadata": f"WITH {_C} SELECT id, file_path, CAST(row_number() OVER (ORDER BY file_path, id) AS INT) AS rank, 'browse' AS search_mode FROM c WHERE list_contains(file_tags, 'quality') AND contains(lower(file_path), 'src1') QUALIFY rank <= 10",
    "snippet_window": f"""WITH a AS (SELECT doc_id AS id, text, length(text) AS n, {_HAS.format("['license', 'rights', 'token']", "text")} AS t FROM documents),
  b AS (SELECT *, list_min(list_transform(t, lambda x: instr(lower(text), x))) - 1 AS i FROM a), e AS (SELECT *, least(n, greatest(0, i - 40) + 240) AS e FROM b)
  SELECT id, md5(CASE WHEN len(t) = 0 THEN CASE WHEN n > 240 THEN substr(text, 1, 240) || '…' ELSE text END
    ELSE (CASE WHEN e > 240 THEN '…' ELSE '' END) || substr(text, CAST(greatest(0, e - 240) + 1 AS BIGINT), CAST(e - greatest(0, e - 240) AS BIGINT)) || (CASE WHEN e < n THEN '…' ELSE '' END) END) AS snippet_md5 FROM e""",
    "matched_terms": f"""SELECT doc_id AS id, array_to_string({_HAS.format("['license', 'the', 'token']", "text")}, ',') AS terms FROM documents""",
    "knn_topk": f"WITH {_V} {_NEAR.format(w='true', k=10)}",
    "knn_prefiltered": f"WITH {_V} {_NEAR.format(w='label IN (1, 2)', k=10)}",
    "knn_query_blocks": f"""WITH {_V} SELECT a.id AS probe, b.id AS id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity,
  CAST(row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) AS INT) AS rank FROM v a, v b WHERE a.id % 20 = 0 QUALIFY rank <= 5""",
    "query_similar_by_label": f"""WITH {_V}, x AS (SELECT label, unnest(e) AS y, generate_subscripts(e, 1) AS i FROM v), m AS (SELECT list(y ORDER BY i) AS q FROM (SELECT i, avg(y) AS y FROM x WHERE label = 0 GROUP BY i)),
  z AS (SELECT CAST(label AS VARCHAR) AS label, id, list_cosine_similarity(e, m.q) AS s FROM v, m WHERE label <> 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, id) = 1)
  SELECT label, id, round(s, 6) AS similarity FROM z ORDER BY s DESC, label LIMIT 5""",
    "file_vector_meanpool": f"WITH {_V}, x AS (SELECT label, unnest(e) AS y, CAST(generate_subscripts(e, 1) - 1 AS INT) AS pos FROM v) SELECT label, pos, round(avg(y), 6) AS v FROM x GROUP BY label, pos",
    "dup_pairs_cosine": f"WITH {_V} SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.3",
    "rrf_fusion": f"{_FUSED} SELECT id, round(x, 6) AS rrf_score, rank FROM g WHERE rank <= 20",
    "hybrid_search": f"{_FUSED} SELECT id, round(x, 6) AS rrf_score, rank, round(coalesce(sim, lexical_score / max(lexical_score) OVER ()), 6) AS similarity, round(lexical_score, 6) AS lexical_score FROM g WHERE rank <= 10",
    "normalize_minmax": f"WITH {_bm25(_TERMS)}, k AS (SELECT id, lexical_score AS x FROM s ORDER BY x DESC, id LIMIT 30) SELECT id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS lexical_score_norm FROM k",
    "keyword_normalised": f"WITH {_bm25(_TERMS)}, k AS (SELECT id, lexical_score AS x, CAST(row_number() OVER (ORDER BY lexical_score DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 10) SELECT id, round(x / max(x) OVER (), 6) AS similarity, rank FROM k",
    "indexed_search": f"WITH {_bm25(_TERMS)}, k AS (SELECT id, lexical_score AS x, CAST(row_number() OVER (ORDER BY lexical_score DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 10) SELECT id, round(x / max(x) OVER (), 6) AS similarity, rank FROM k",
    "boolean_search": f"""WITH {_C}, {_bm25(["license", "token"])}, k AS (SELECT s.id, lexical_score FROM s JOIN c USING (id) WHERE (contains(lower(content), 'license') OR contains(lower(content), 'token')) AND NOT list_contains(file_tags, 'toxic'))
  SELECT id, round(lexical_score, 6) AS lexical_score, CAST(row_number() OVER (ORDER BY lexical_score DESC, id) AS INT) AS rank FROM k QUALIFY rank <= 10""",
    "exact_dups_md5": "SELECT md5(text) AS md5_hash, count(*) AS n_files, min('/'||source||'/'||lang||'/'||doc_id||'.txt') AS first_path FROM documents GROUP BY md5(text) HAVING count(*) > 1",
    "group_by_file": f"{_HITS} SELECT regexp_replace(file_path, '/[^/]*$', '') AS file_path, min(rank) AS first_rank, count(*) AS n_hits, round(max(similarity), 6) AS best_similarity FROM h GROUP BY 1",
    "group_by_tag": f"{_HITS} SELECT tag, count(*) AS n_hits, min(rank) AS first_rank FROM (SELECT unnest(file_tags) AS tag, rank FROM h) GROUP BY tag",
    "group_by_source": f"{_HITS} SELECT CASE WHEN source IN ('/src1', '/src2', '/src3') THEN source ELSE '其他' END AS source, count(*) AS n_hits FROM h GROUP BY 1",
    "best_per_group": f"WITH {_V} SELECT label, id, similarity FROM (SELECT label, id, round(list_dot_product(e, q), 6) AS similarity FROM v, p) QUALIFY row_number() OVER (PARTITION BY label ORDER BY similarity DESC, id) = 1",
    "per_file_cap": f"{_HITS} SELECT id, source AS file_path, CAST(row_number() OVER (PARTITION BY source ORDER BY rank) AS INT) AS nth FROM h QUALIFY nth <= 2",
    "incremental_diff": f"{_DIFF} SELECT file_path, change FROM d",
    "change_counts": f"{_DIFF} SELECT change, count(*) AS n_files FROM d GROUP BY change",
    "index_search": f"""WITH {_bm25(_TERMS).replace("FROM documents", "FROM (SELECT * FROM documents WHERE source <> 'src3')")}, p AS (SELECT '/'||source||'/'||lang||'/'||doc_id||'.txt' AS file_path, lexical_score FROM s JOIN documents ON id = doc_id)
  SELECT file_path, round(lexical_score, 6) AS lexical_score, CAST(row_number() OVER (ORDER BY lexical_score DESC, file_path) AS INT) AS rank FROM p QUALIFY rank <= 10""",
    "index_sync": """WITH f AS (SELECT '/'||source||'/'||lang||'/'||doc_id||'.txt' AS file_path, md5(coalesce(text, '')) AS h, source, text FROM documents),
  o AS (SELECT file_path, CASE WHEN contains(file_path, '/de/') THEN md5('older licensed license') ELSE h END AS h FROM f WHERE source <> 'src2'), n AS (SELECT * FROM f WHERE source <> 'src3'),
  c AS (SELECT count(*) FILTER (o.h IS NULL) AS n_new, count(*) FILTER (o.h <> n.h) AS n_updated, count(*) FILTER (o.h = n.h) AS n_unchanged FROM n LEFT JOIN o USING (file_path))
  SELECT file_path, h AS md5_hash, regexp_matches(lower(text), '[a-z0-9]') AS has_tokens, CAST(n_new AS INT) AS n_new, CAST(n_updated AS INT) AS n_updated, CAST(n_unchanged AS INT) AS n_unchanged,
    CAST((SELECT count(*) FROM o WHERE file_path NOT IN (SELECT file_path FROM n)) AS INT) AS n_removed FROM n, c""",
    "orphans": f"{_OLDNEW} SELECT file_path FROM o WHERE file_path NOT IN (SELECT file_path FROM n)",
    "merge_tags": f"WITH {_C} SELECT file_path, array_to_string(list_concat(file_tags, CASE WHEN list_contains(file_tags, 'en') THEN ['added'] ELSE ['en', 'added'] END), ',') AS tags FROM c",
    "status_per_source": "SELECT s AS source, count(doc_id) AS n_files FROM (SELECT '/src' || i AS s FROM range(1, 8) t(i)) LEFT JOIN documents ON s = '/' || source GROUP BY s",
    "status_overview": f"{_FT} SELECT (SELECT count(*) FROM c) AS indexed_files, (SELECT count(*) FROM c) AS total_chunks, (SELECT CAST(sum(length(content)) AS BIGINT) FROM c) AS total_chars, (SELECT count(DISTINCT tag) FROM ft) AS n_tags, (SELECT count(*) FROM c WHERE list_contains(file_tags, 'toxic')) AS starred_count",
    "recent_updates": "SELECT CAST(event_id AS VARCHAR) AS file_path, strftime(ts, '%Y-%m-%d %H:%M') AS updated FROM events ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 10",
    "starred_first": f"WITH {_C} SELECT file_path, contains(file_path, '/en/') AS starred, CAST(row_number() OVER (ORDER BY contains(file_path, '/en/') DESC, lower(file_name), file_path) AS INT) AS pos FROM c",
    "html_title": "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages",
    "html_links": f"{_HREF} SELECT page_id, pos, href FROM b",
    "link_edges": f"{_HREF} SELECT source, href, target FROM e",
    "incoming_links": f"{_HREF} SELECT coalesce(CAST(target AS VARCHAR), href) AS target, CAST(count(DISTINCT source) AS INT) AS n_sources FROM e GROUP BY 1",
    "dangling_nodes": f"{_HREF} SELECT DISTINCT href FROM e WHERE target IS NULL",
    "debounce_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1800001 MILLISECOND THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  b AS (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a), g AS (SELECT user_id, s, count(*) AS n FROM b GROUP BY user_id, s)
  SELECT user_id, count(*) AS n_bursts, CAST(sum(n) AS BIGINT) AS n_events, max(n) AS largest FROM g GROUP BY user_id""",
    "recent_searches": "SELECT q, strftime(t, '%Y-%m-%d %H:%M') AS last FROM (SELECT event_type || ':' || user_id AS q, max(ts) AS t FROM events GROUP BY 1) ORDER BY t DESC, q LIMIT 50",
    "exclude_paths": f"WITH {_C} SELECT file_path FROM c WHERE source <> '/src2' AND NOT contains(file_path, '/fr/') AND NOT regexp_matches(file_name, '^1.\\.txt$') AND NOT starts_with(file_path, '/src4/en/')",
    "tag_picker_or": f"WITH {_C} SELECT id FROM c WHERE contains(lower(content), 'license') AND NOT contains(lower(content), 'token') AND (list_contains(file_tags, 'toxic') OR list_contains(file_tags, 'de'))",
    "highlight_spans": """WITH q(t) AS (VALUES ('license'), ('token')), a AS (SELECT doc_id AS id, lower(text) AS x, t FROM documents, q WHERE contains(lower(text), t))
  SELECT id, CAST(i AS INT) AS start, CAST(i + length(t) AS INT) AS "end" FROM a, unnest(range(0, length(x) - length(t) + 1)) u(i) WHERE substr(x, i + 1, length(t)) = t""",
    "filter_file_names": f"WITH {_C} SELECT file_path FROM c WHERE contains(lower(file_path), '/en/1')",
    "filter_tag_names": f"{_FT} SELECT tag, count(DISTINCT file_path) AS n_files FROM ft WHERE contains(tag, 'to') GROUP BY tag",
    "tags_of_files": f"WITH {_C} SELECT file_path, array_to_string(file_tags, ',') AS tags FROM c WHERE len(file_tags) > 0",
    "distinct_hits": f"{_HITS} SELECT DISTINCT regexp_replace(file_path, '/[^/]*$', '') AS file_path FROM h",
    "cluster_merge": """WITH c AS (SELECT label AS id, 'c' || label AS label, string_agg(vec_id, ',' ORDER BY vec_id) AS files FROM embeddings GROUP BY 1, 2)
  SELECT * FROM c WHERE id NOT IN (1, 2) UNION ALL SELECT 2, 'both', concat_ws(',', max(files) FILTER (id = 2), max(files) FILTER (id = 1)) FROM c HAVING count(*) FILTER (id IN (1, 2)) > 0""",
    "cluster_sizes": "SELECT 'c' || label AS label, CAST(count(*) AS INT) AS n_files FROM embeddings GROUP BY label",
    "set_tags": f"WITH {_C} SELECT file_path, CASE WHEN list_contains(file_tags, 'toxic') THEN 'review,hidden' ELSE array_to_string(file_tags, ',') END AS tags FROM c WHERE len(file_tags) > 0",
    "remove_files": f"{_FT} SELECT file_path, tag FROM ft WHERE file_path NOT IN (SELECT file_path FROM ft WHERE tag = 'toxic')",
    "link_neighbours": f"{_HREF} SELECT DISTINCT coalesce(target, -1) AS path, 'out' AS direction FROM e WHERE source = 0 UNION SELECT source, 'in' FROM e WHERE target = 0",
    "graph_node_cap": f"{_HREF} SELECT DISTINCT href AS path FROM e ORDER BY path LIMIT 500",
    "markdown_links": f"""{_HREF}, k AS (SELECT source, target, href, CASE WHEN target IS NULL THEN '[x](../b/' || md5(href) || '.md)' ELSE '[[' || target || '|x]]' END AS s FROM e)
  SELECT '/a/' || source || '.md' AS source, CASE WHEN target IS NULL THEN '../b/' || md5(href) || '.md' ELSE CAST(target AS VARCHAR) END AS target_raw, CASE WHEN target IS NULL THEN 'relpath' ELSE 'wikilink' END AS link_type,
    CAST(row_number() OVER (PARTITION BY source ORDER BY s) + 3 AS INT) AS line FROM k""",
    "note_graph_edges": f"{_HREF} SELECT '/a/' || source || '.md' AS source, CASE WHEN target IS NULL THEN '../b/' || md5(href) || '.md' ELSE '/a/' || target || '.md' END AS target, CASE WHEN target IS NULL THEN 'relpath' ELSE 'wikilink' END AS link_type FROM e",
    "note_graph_nodes": f"{_HREF} SELECT '/a/' || page_id || '.md' AS path, 'article' AS kind FROM pages UNION SELECT '../b/' || md5(href) || '.md', 'missing' FROM e WHERE target IS NULL",
    "one_line_summary": r"SELECT doc_id AS id, md5(CASE WHEN length(x) > 100 THEN substr(x, 1, 100) || '...' ELSE x END) AS summary_md5 FROM (SELECT doc_id, trim(regexp_replace(text, '[\x09-\x0D ]+', ' ', 'g'), ' ') AS x FROM documents)",
    "html_escape": "SELECT doc_id AS id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS html_md5 FROM documents",
    "split_tag_input": r"SELECT doc_id AS id, CAST(len(list_filter(string_split_regex(text, '[,，\x09-\x0D ]+'), lambda x: length(x) > 0)) AS INT) AS n_tags FROM documents",
    "text_paragraphs": """WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
  b AS (SELECT doc_id, i, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS x, count(*) FILTER (NOT regexp_matches(x, '\\S')) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM a)
  SELECT CAST(doc_id AS VARCHAR) AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS INT) AS pos, CAST(min(i) AS INT) AS line, md5(string_agg(x, chr(10) ORDER BY i)) AS content_md5 FROM b WHERE x <> '' GROUP BY doc_id, g""",
    "section_groups": "SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' OR f = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS section FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM conversations)",
    "markdown_paragraphs": f"""{_HREF}, k AS (SELECT source, CASE WHEN target IS NULL THEN '[x](../b/' || md5(href) || '.md)' ELSE '[[' || target || '|x]]' END AS s FROM e)
  SELECT '/a/' || page_id || '.md' AS id, 0::INT AS pos, 'heading' AS type, 'note' AS content, 0::INT AS line, 1::INT AS level FROM pages
  UNION ALL SELECT '/a/' || page_id || '.md', 1, 'code', '```' || chr(10) || '[[hidden]]' || chr(10) || '```', 1, 0 FROM pages
  UNION ALL SELECT '/a/' || source || '.md', 2, 'paragraph', string_agg(s, chr(10) ORDER BY s), 4, 0 FROM k GROUP BY source""",
    "mindmap_results": f"""{_HITS} SELECT 'results' AS root_id, file_path AS node_id, '0' AS parent_id, rank AS ord, 1::INT AS level, CAST(id AS VARCHAR) AS label, 0.8::DOUBLE AS weight FROM h
  UNION ALL SELECT 'results', file_path || '#1', file_path, 1, 2, substr(content, 1, 100) || '...', round(similarity, 6) FROM h""",
    "export_rows": f"""{_HITS}, i AS (SELECT *, length(content) AS n, instr(lower(content), 'license') - 1 AS i FROM h), x AS (SELECT *, least(n, greatest(0, i - 40) + 240) AS e FROM i)
  SELECT file_path, file_name AS filename, CASE WHEN i < 0 THEN CASE WHEN n > 240 THEN substr(content, 1, 240) || '…' ELSE content END
    ELSE (CASE WHEN e > 240 THEN '…' ELSE '' END) || substr(content, CAST(greatest(0, e - 240) + 1 AS BIGINT), CAST(e - greatest(0, e - 240) AS BIGINT)) || (CASE WHEN e < n THEN '…' ELSE '' END) END AS snippet,
    CAST(round(similarity, 4) AS VARCHAR) AS score FROM x""",
}
ORACLE["shared_topics"] = f"SELECT tag, count(DISTINCT id) AS n_files, count(DISTINCT id) * 0.3::DOUBLE AS weight FROM ({ORACLE['keyword_tags_top5']}) GROUP BY tag HAVING count(DISTINCT id) >= 2 ORDER BY n_files DESC, tag LIMIT 10"
