"""From a source tree and a query to a text within a token budget."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import cache, chunk, graph, rank, render, select
from skein.operators.durable import written
from skein.sources import github

# Fixed value: the text for a tree without files that fit.
NO_FILES = "No files found matching the criteria."
# Fixed values by profile: chunks that are reranked, and the share of their own score in the new one.
RERANKED, OWN = {"P": 50, "B": 20}, {"P": 0.4, "B": 0.3}


class ContextEngine:
    """profile P or B.

    tokens: a text column's token count. cache_dir: folder of the chunk cache. embed: DataFrame(chunk_id, path, content, ...) to
    (chunk_id, vector), see embed.vectors; embed_query: a text's vector, empty if there is none; imagine: a made-up answer to a query,
    embedded with it (P) or in its place (B). judge: (chunks, query) to (chunk_id, relevance), of the best RERANKED chunks.
    """

    def __init__(self, spark: SparkSession, profile: str = "P", budget: int | str = 50_000, strict: bool = False, fast: bool = False, follow_imports: bool = True, import_depth: int = 1, embed: Callable | None = None, embed_query: Callable | None = None, imagine: Callable | None = None, judge: Callable | None = None, tokens: Callable[[Column], Column] = T.token_estimate, cache_dir: str | None = None, clones: str = "~/.cache/skein"):
        self.spark, self.profile, self.budget, self.strict, self.fast = spark, profile, T.parse_budget(budget), strict, fast
        self.follow, self.depth, self.tokens, self.cache_dir, self.clones = follow_imports, import_depth, tokens, cache_dir, os.path.expanduser(clones)
        self.embed, self.embed_query, self.imagine, self.judge = embed, embed_query, imagine, judge
        self.stats: dict | None = None  # of the last build: files scanned and included, chunks, tokens, budget

    def scan(self, path: str, include: list[str] = (), exclude: list[str] = (), force_large: bool = False) -> DataFrame:
        """Files of a folder, or of a GitHub repository's shallow clone, as they are listed now."""
        from skein.sources import codebase

        if github.is_github(path):
            path = github.clone(github.parse(path), self.clones, profile=self.profile)
        self.spark.dataSource.register(codebase.Codebase)
        return codebase.scan(self.spark, {"path": path, "profile": self.profile, "include": ",".join(include), "exclude": ",".join(exclude), "forceLarge": str(force_large).lower()})

    def graph(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges and (path, centrality)."""
        nodes = files.select("path")
        if self.profile == "P":
            edges = graph.resolve_p(graph.extract_imports_p(files), files, self.strict)
            return edges, graph.centrality_p(nodes, edges)
        edges = graph.resolve_b(graph.extract_imports_b(files), files, self.strict)
        return edges, graph.pagerank_b(nodes, edges)

    def chunks(self, files: DataFrame) -> DataFrame:
        """Chunks with tokens and chunk_id; files that are in the cache aren't chunked again."""
        make = (lambda f: chunk.chunk_p(f, self.strict)) if self.profile == "P" else chunk.chunk_b
        if self.cache_dir:
            stored = cache.ChunkCache(self.spark, self.cache_dir)
            stored.prune(time.time())
            seconds = files.withColumn("mtime", F.col("mtime_ms") / 1000) if "mtime_ms" in files.columns else files
            made = stored.refresh(seconds, make, time.time(), self.profile)
        else:
            made = make(files)
        return made.withColumn("tokens", self.tokens(F.col("content"))).withColumn("chunk_id", F.concat_ws(":", "path", "start_line"))

    def _query_vector(self, query: str) -> list[float]:
        try:
            made_up = self.imagine(query) if self.imagine else None
        except Exception:  # without an answer the query stands alone
            made_up = None
        if made_up:
            query = f"{query}\n---\n{made_up[:1000]}" if self.profile == "P" else made_up
        return self.embed_query(query)

    def score(self, files: DataFrame, query: str, chunks: DataFrame | None = None) -> DataFrame:
        chunks = self.chunks(files) if chunks is None else chunks
        ranked = rank.keyword_rank_p(chunks, query) if self.profile == "P" else rank.keyword_rank_b(chunks, query)
        if self.profile == "B" and self.fast:
            return ranked
        ranked, embedded = ranked.withColumnRenamed("score", "kw"), self.embed is not None
        vector = self._query_vector(query) if embedded else []
        if vector:
            ranked = rank.embedding_rank(ranked, self.embed(chunks), vector)
        else:
            ranked = ranked.withColumn("emb", F.col("kw") if embedded and self.profile == "P" else F.lit(0.0))
        _, central = self.graph(files)
        ranked = ranked.join(central, "path", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0 if self.profile == "P" else 0.5)))
        if self.profile == "P":
            out = rank.hybrid_p(ranked.withColumn("importance", T.importance_p(F.col("path"))), embedded)
        else:
            out = rank.hybrid_b(ranked.withColumn("combined", 0.6 * T.importance_b(F.col("path")) + 0.4 * (F.lit(0.5) if self.strict else F.col("centrality"))))
        if not self.judge:
            return out
        best = rank.top(out, "chunk_id", RERANKED[self.profile])
        judged = self.judge(chunks.join(F.broadcast(best.select("chunk_id")), "chunk_id", "left_semi"), query)
        return rank.rerank(out, judged, "chunk_id", RERANKED[self.profile], OWN[self.profile])

    def select(self, files: DataFrame, query: str) -> DataFrame:
        """Chunks are read several times, so they are stored."""
        chunks = written(self.chunks(files))
        edges = written(self.graph(files)[0]) if self.profile == "P" and self.follow else None

        def choose(rows: DataFrame) -> DataFrame:
            if self.profile == "B":
                return select.pack_single(rows, self.budget)
            if edges is None:
                return select.greedy(rows, 0.7 * self.budget).withColumn("pass", F.lit(1))
            return select.pack_two_pass(rows, self.budget, edges, self.depth)

        return select.packed(self.score(files, query, chunks), chunks, ["path", "start_line"], choose)

    def build(self, path: str, query: str, fmt: str = "markdown", **scan) -> str:
        files = written(self.scan(path, **scan))
        if self.profile == "B" and files.isEmpty():
            return NO_FILES
        out = self.select(files, query)
        if self.profile == "P" and github.is_github(path):
            repo = github.parse(path)
            out = out.withColumn("path", F.concat(F.lit(f"{repo.owner}/{repo.name}/"), "path"))
        out = written(out)
        self.stats = select.stats(files, out, self.budget).first().asDict()
        text = render.markdown_b(out) if self.profile == "B" else render.xml_p(out) if fmt == "xml" else render.markdown_p(out)
        return text.first()[0]


def fetch_context(spark: SparkSession, path: str, query: str, budget: int | str = 50_000, include: list[str] = (), exclude: list[str] = (), semantic: bool = False, force_large: bool = False, **engine) -> str:
    """Profile B's text for a query; by keywords alone unless semantic."""
    return ContextEngine(spark, "B", budget, fast=not semantic, **engine).build(path, query, include=include, exclude=exclude, force_large=force_large)


def ask(spark: SparkSession, path: str, query: str, answer: Callable[[str, str], str], **options) -> str:
    """answer(context, query) with the context of fetch_context."""
    return answer(fetch_context(spark, path, query, **options), query)
