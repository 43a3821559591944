"""Search: browse, keyword, semantic and hybrid over one chunks table, with the boolean language in front.

``chunks`` has id, file_path, file_name, title, start_line, end_line, chunk_index, content, file_tags and, for semantic search,
embedding. Filters come before scoring and before the top-k cut; ``compat`` gives the older order and readings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import any_term, matched_terms, snippet
from foliant.operators import fusion, lexical, vectors
from foliant.plans.compiler import content_level, file_level, predicate
from foliant.plans.querylang import And, Node, Not, Path, ParsedQuery, Tag, Term, combine, parse_query

MODES = ("semantic", "keyword", "hybrid")
RESULT = ("id", "file_path", "file_name", "title", "start_line", "end_line", "chunk_index", "content", "distance", "similarity", "lexical_score", "rrf_score", "file_tags", "matched_terms", "snippet", "search_mode", "rank")
_TYPES = {"start_line": "int", "end_line": "int", "chunk_index": "int", "distance": "double", "similarity": "double", "lexical_score": "double", "rrf_score": "double"}


def overfetch(k: int) -> int:
    return max(3 * k, 30)


@dataclass
class Engine:
    chunks: DataFrame
    embedder: vectors.Embedder | None = None
    mode: str = "hybrid"
    #: The stored index of the chunks: (id, term, tf, dl) and one row (n, avgdl). Without it keyword searches read all texts.
    postings: DataFrame | None = None
    stats: DataFrame | None = None

    def __post_init__(self):
        self.set_mode(self.mode)

    def set_mode(self, mode: str) -> None:
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.mode = mode

    def search(self, query: str = "", top_k: int = 10, mode: str | None = None, tags: list[str] = (), paths: list[str] = (), exclude: list[str] = (), picked: ParsedQuery | None = None, compat: bool = False) -> DataFrame:
        """At most top_k rows of the result schema, by rank. Blank text with conditions browses; without any, it finds nothing."""
        mode = mode or self.mode
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        parsed = combine(parse_query(query), picked)
        where, text = self._condition(parsed, list(tags), list(paths), list(exclude))
        if not text.strip():
            return self.finish(self.browse(None if where is None else predicate(where, compat), top_k), "", None, "browse", top_k)
        if not compat:
            rows = self.retrieve(text, mode, top_k, None if where is None else predicate(where))
        else:
            rows = self._older(text, mode, top_k, where)
        return self.finish(rows, text, parsed.phrase, mode, top_k)

    def _condition(self, parsed: ParsedQuery, tags, paths, exclude) -> tuple[Node | None, str]:
        """The row condition. Terms are enforced only where the query is boolean; else they rank."""
        from foliant.plans.querylang import Or

        parts: list[Node] = [Tag(t) for t in tags]
        if paths:
            parts.append(Or(tuple(map(Path, paths))) if len(paths) > 1 else Path(paths[0]))
        parts += [Not(Term(t)) for t in [*exclude, *([] if parsed.has_boolean else parsed.exclude_terms)] if t]
        if parsed.has_boolean and parsed.expr is not None:
            parts.append(parsed.expr)
        else:
            parts += [Tag(t) for t in parsed.tag_filters]
            own = [Path(p) for p in parsed.path_filters]
            parts += [Or(tuple(own))] if len(own) > 1 else own
        node = None if not parts else parts[0] if len(parts) == 1 else And(tuple(parts))
        return node, parsed.clean_query

    def browse(self, where, k: int) -> DataFrame:
        if where is None:
            return self.chunks.limit(0).withColumn("rank", F.lit(None).cast("int"))
        t = self.chunks.where(where).orderBy("file_path", "chunk_index", "id").limit(k)
        return t.withColumn("rank", F.row_number().over(Window.orderBy("file_path", "chunk_index", "id")))

    def _semantic(self, text: str, k: int, where) -> DataFrame:
        if self.embedder is None:
            raise ValueError("semantic search needs an embedder")
        from foliant.operators.lexical import lexical_tokens

        words = self.chunks.sparkSession.range(1).select(F.array_join(lexical_tokens(F.lit(text)), " ").alias("t")).first().t
        near = vectors.knn(self.chunks, list(self.embedder.encode([words])[0]), k, where=where).select("id", "similarity", "distance")
        return near.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))

    def _keyword(self, text: str, where) -> DataFrame:
        if self.postings is None:
            return lexical.bm25(self.chunks, text, text="content", where=where)
        scored = lexical.bm25_indexed(self.postings, lexical.query_terms(self.chunks.sparkSession, text), "id", self.stats)
        return scored if where is None else scored.join(self.chunks.where(where).select("id"), "id", "left_semi")

    def retrieve(self, text: str, mode: str, k: int, where, fetch: int | None = None) -> DataFrame:
        """Ranked ids with scores, joined back to the k rows they name, so wide columns stay out of ranking."""
        fetch = fetch or overfetch(k)
        lex = sem = None
        if mode != "semantic":
            lex = lexical.top(self._keyword(text, where), "lexical_score", k if mode == "keyword" else fetch)
        if mode != "keyword":
            sem = self._semantic(text, k if mode == "semantic" else fetch, where)
        if mode == "hybrid":
            ranked = fusion.rrf(sem, lex, top_n=k).drop("sem_rank", "lex_rank")
        else:
            ranked = lex if mode == "keyword" else sem
        return self.chunks.join(F.broadcast(ranked), "id")  # at most k rows

    def _older(self, text: str, mode: str, k: int, where: Node | None) -> DataFrame:
        """File conditions before a semantic cut and after a lexical one; content conditions last: may give fewer than k rows."""
        files = file_level(where)
        if mode == "semantic":
            rows = self.retrieve(text, mode, overfetch(k), files)
        else:
            rows = self.retrieve(text, mode, overfetch(k) if mode == "keyword" else k, None, overfetch(k))
            rows = rows.where(files) if files is not None else rows
        return rows.orderBy("rank").limit(k).where(content_level(where))

    def finish(self, rows: DataFrame, text: str, phrase: str | None, mode: str, k: int) -> DataFrame:
        for c, kind in _TYPES.items():
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(kind))
        if mode == "keyword":
            rows = rows.withColumn("similarity", fusion.display_score(F.col("lexical_score")))
        elif mode == "hybrid":
            rows = rows.withColumn("similarity", F.coalesce("similarity", fusion.display_score(F.col("lexical_score"))))
        terms = matched_terms(F.col("content"), [*([phrase] if phrase else []), text.strip(), *text.split()])
        rows = rows.withColumn("matched_terms", terms).withColumn("snippet", snippet(F.col("content"), F.col("matched_terms"))).withColumn("search_mode", F.lit(mode))
        return rows.withColumn("rank", F.row_number().over(Window.orderBy("rank", "id"))).select(*RESULT).orderBy("rank").limit(k)

    def similar(self, path: str, k: int = 5) -> DataFrame:
        """The k most similar other files, one row each with its best chunk, in the result schema."""
        best = vectors.similar_files(self.chunks, path, k).select("id", "similarity")
        best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "id"))).withColumn("distance", 1 - F.col("similarity"))
        out = self.finish(self.chunks.join(F.broadcast(best), "id"), "", None, "similar", k)
        return out.withColumn("id", F.col("file_path"))


def exclude_rows(rows: DataFrame, terms: list[str]) -> DataFrame:
    return rows.where(~any_term(F.col("content"), terms))


def files_with_tags(file_tags: DataFrame, tags: list[str]) -> DataFrame:
    """Files that have all tags: one grouped pass."""
    return file_tags.where(F.col("tag").isin(tags)).groupBy("file_path").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(set(tags))).select("file_path")


def chunks_of(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.join(files, "file_path", "left_semi")
