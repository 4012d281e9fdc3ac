"""Scores of chunks for a query, in one pass over their contents.

What the scores need of a chunk's content are a few counts, so the contents are read once, into a stored table of the chunks'
other columns and these counts. Corpus figures, maxima and minima are one-row aggregates of that table, which go into the plan
as numbers; the rows come back without content, for the chosen ones to be joined with theirs (select.packed).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import bag_p, counts_p, important_terms, query_tokens_b, query_tokens_p, stem_word, tokenize_b

from .durable import written

K1, B = 1.5, 0.75


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def _others(chunks: DataFrame) -> list[str]:
    return [c for c in chunks.columns if c != "content"]


def doc_frequencies(chunks: DataFrame) -> DataFrame:
    """term, df: in how many chunks each term is."""
    terms = chunks.select(F.explode(F.array_distinct(bag_p(F.col("content")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """n_docs and avgdl, the mean number of tokens."""
    n, _ = counts_p(F.col("content"), [])
    return chunks.select(n.alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("avgdl"))


def counted(chunks: DataFrame, query: str) -> DataFrame:
    """The stored table of chunks without content, with _n (tokens), _f0, _f1, ... (occurrences of each query term), _path and _name
    (how many query terms are in those). Null counts as empty."""
    terms = sorted(set(query_tokens_p(query)))
    q = F.array(*(F.lit(t) for t in terms)).cast("array<string>")
    n, f = counts_p(F.col("content"), terms)
    inside = lambda c: F.size(F.array_intersect(bag_p(F.coalesce(F.col(c), F.lit(""))), q))
    named = inside("name") if "name" in chunks.columns else F.lit(0)
    return written(chunks.select(*_others(chunks), n.alias("_n"), *(x.alias(f"_f{i}") for i, x in enumerate(f)), inside("path").alias("_path"), named.alias("_name")))


def _bm25(table: DataFrame) -> Column:
    """The score from the columns of a counted table; its corpus figures are computed here."""
    terms = [c for c in table.columns if c.startswith("_f")]
    docs, mean, *df = table.agg(F.count("*"), F.avg("_n"), *(F.count(F.when(F.col(c) > 0, 1)) for c in terms)).first()

    def part(c: str, d: int) -> Column:
        idf = F.log(F.lit((docs - d + 0.5) / (d + 0.5) + 1))
        f = F.col(c)
        return F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.lit(float(mean))))).otherwise(F.lit(0.0))

    return _sum([part(c, d) for c, d in zip(terms, df, strict=True)]) if docs and mean else F.lit(0.0)


def bm25(chunks: DataFrame, query: str) -> DataFrame:
    """chunks without content, with bm25 (profile P)."""
    table = counted(chunks, query)
    return table.select(*_others(chunks), _bm25(table).alias("bm25"))


def by_largest(rows: DataFrame, raw: Column, out: str) -> DataFrame:
    """rows with `out`: raw by its largest value, if that is over 0."""
    most = rows.agg(F.max(raw)).first()[0]
    return rows.withColumn(out, raw / F.lit(float(most)) if most and most > 0 else raw)


def keyword_rank_p(chunks: DataFrame, query: str) -> DataFrame:
    """chunks without content, with score: bm25 + 2 for each query term in the path + 3 for each in the name, by the largest."""
    table = counted(chunks, query)
    raw = _bm25(table) + 2.0 * F.col("_path") + 3.0 * F.col("_name")
    return by_largest(table, raw, "score").select(*_others(chunks), "score")


def keyword_rank_b(chunks: DataFrame, query: str, boost_stemmed: bool = False) -> DataFrame:
    """chunks without content, stored, with score: density score (profile B) of substring matches either way, exact bonuses, path penalties.

    Important terms count fivefold where they equal a stemmed term; with boost_stemmed they are stemmed before."""
    terms, strong = query_tokens_b(query), important_terms(query)
    if boost_stemmed:
        strong = strong | {stem_word(t) for t in strong}
    if not terms:
        return chunks.select(*_others(chunks)).withColumn("score", F.lit(0.0))
    distinct = sorted(set(terms))

    def matches(src: str) -> Column:
        """(tokens, then for each term how many tokens match and how many equal it)."""
        tokens = tokenize_b(F.coalesce(F.col(src), F.lit("")), stems=True)

        def like(bag: Column, t: str) -> Column:
            return F.size(F.filter(bag, lambda x: x.contains(t) | F.lit(t).contains(x)))

        def count(bag: Column) -> Column:
            return F.struct(F.size(bag).alias("n"), *(like(bag, t).alias(f"m{i}") for i, t in enumerate(distinct)), *(F.array_contains(bag, t).alias(f"e{i}") for i, t in enumerate(distinct)))

        # bound in a lambda, the tokens are made once for a row
        return F.transform(F.array(tokens), count)[0]

    rows = chunks.withColumns({"_c": matches("content"), "_p": matches("path"), "_n": matches("name")})
    density = F.least(F.lit(1.0), F.lit(200.0) / F.greatest(F.col("_c.n"), F.lit(1)))

    def part(t: str) -> Column:
        i = distinct.index(t)
        m = F.col(f"_c.m{i}")
        s = F.when(m > 0, (1 + F.log(m.cast("double"))) * (1 + density)).otherwise(F.lit(0.0)) + 2.0 * F.col(f"_p.m{i}") + 3.0 * F.col(f"_n.m{i}")
        for c, bonus in (("_c", 2.0), ("_p", 10.0), ("_n", 20.0)):
            s = s + F.when(F.col(f"{c}.e{i}"), F.lit(bonus)).otherwise(F.lit(0.0))
        return s * (5.0 if t in strong else 1.0)

    score = _sum([part(t) for t in terms])
    if len(terms) > 1:
        every = reduce(lambda a, b: a & b, (F.col(f"_c.m{i}") + F.col(f"_p.m{i}") + F.col(f"_n.m{i}") > 0 for i in range(len(distinct))))
        score = score * F.when(every, F.lit(1.5)).otherwise(F.lit(1.0))
    path = F.col("path")
    score = score * F.when(path.rlike(r"\.test\.|\.spec\.|__fixtures__|__tests__"), 0.5).otherwise(1.0)
    score = score * F.when(path.rlike("/codemods?/"), 0.3).otherwise(1.0)
    if not any("prepar" in t for t in terms):
        score = score * F.when(path.contains("prepare"), 0.7).otherwise(1.0)
    return written(rows.select(*_others(chunks), score.alias("score")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def embedding_rank(chunks: DataFrame, vectors: DataFrame, query_vector: list[float], key: str = "chunk_id") -> DataFrame:
    """chunks with emb: cosine with the query; 0 for chunks without a vector. vectors(key, vector: array<double>)."""
    q = F.array(*(F.lit(float(x)) for x in query_vector))
    sims = vectors.select(F.col(key), cosine(F.col("vector"), q).alias("emb"))
    return chunks.join(sims, key, "left").withColumn("emb", F.coalesce("emb", F.lit(0.0)))


def minmax(df: DataFrame, col: str, out: str) -> DataFrame:
    """To 0..1 over all rows; 0.5 if all are equal. Two passes over df, so it should be narrow and stored."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    if low is None or low == high:
        return df.withColumn(out, F.lit(0.5))
    return df.withColumn(out, (F.col(col) - F.lit(float(low))) / F.lit(float(high) - float(low)))


def combine_scores(importance: DataFrame, centrality: DataFrame, weight: float = 0.6) -> DataFrame:
    """(path, importance) and (path, centrality) to (path, combined); what is missing counts 0.5."""
    both = importance.join(centrality, "path", "full")
    return both.select("path", (F.coalesce("importance", F.lit(0.5)) * weight + F.coalesce("centrality", F.lit(0.5)) * (1 - weight)).alias("combined"))


def hybrid_p(scored: DataFrame, embeddings: bool) -> DataFrame:
    """scored(path, kw, emb, importance, centrality, ...): the profile's blend, documents at 0.6, by the largest; stored."""
    imp = 0.7 * F.col("importance") + 0.3 * F.col("centrality")
    raw = 0.4 * F.col("kw") + 0.4 * F.col("emb") + 0.2 * imp if embeddings else 0.8 * F.col("kw") + 0.2 * imp
    raw = raw * F.when(F.col("path").rlike(r"\.(md|mdx|txt|rst)$"), 0.6).otherwise(1.0)
    rows = written(scored.withColumn("_raw", raw))
    return by_largest(rows, F.col("_raw"), "score").drop("_raw")


def hybrid_b(scored: DataFrame) -> DataFrame:
    """scored(path, kw, emb, combined, language): 0.4 of the keyword score's min-max, 0.4 cosine, 0.2 importance (Markdown at 0.6)."""
    imp = F.col("combined") * F.when(F.col("language").isin("markdown", "mdx"), 0.6).otherwise(1.0)
    return minmax(written(scored), "kw", "_kw").withColumn("score", 0.4 * F.col("_kw") + 0.4 * F.col("emb") + 0.2 * imp).drop("_kw")


def top(scored: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the highest scores, ties by the key."""
    return scored.orderBy(F.desc("score"), key).limit(n)


def rerank(scored: DataFrame, judged: DataFrame, key: str, n: int = 50, own: float = 0.4) -> DataFrame:
    """The n rows by score blended with judged(key, relevance) (missing: 0.5); the others keep their score. Adds reranked."""
    first = top(scored, key, n).select(key, F.lit(True).alias("reranked")).join(judged, key, "left")
    j = scored.join(F.broadcast(first), key, "left").withColumn("reranked", F.coalesce("reranked", F.lit(False)))
    blend = own * F.col("score") + (1 - own) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("relevance", F.lit(0.5))))
    return j.withColumn("score", F.when(F.col("reranked"), blend).otherwise(F.col("score"))).drop("relevance")
