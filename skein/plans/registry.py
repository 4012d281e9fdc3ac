"""All queries over the given tables, by name, each with the SQL that computes the same from the same tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import fixed
from skein.functions import text as T
from skein.operators import cache, chunk, durable, graph, rank, render, select
from skein.plans import inputs
from skein.plans.engine import ContextEngine
from skein.plans.inputs import CODE_SQL, COSINE_SQL, DOCS_SQL, EDGES_SQL, IMPORTS_SQL, PATHS_SQL, sql_list

QUERY_P = "token password the_and example"
QUERY_B = "worker_tokens password .example losers disgusting"
BUDGET = 4_000

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _round(df: DataFrame, *cols: str) -> DataFrame:
    """These columns, the last to six digits."""
    return df.select(*cols[:-1], F.round(cols[-1], 6).alias(cols[-1]))


# Tokens


def _tok_p_sql(x: str) -> str:
    return f"""flatten(list_transform(regexp_extract_all(lower({x}), '[a-z][a-z0-9_]*'), lambda t:
      CASE WHEN len(regexp_extract_all(t, '[a-z]+')) > 1 THEN list_concat([t], regexp_extract_all(t, '[a-z]+')) ELSE [t] END))"""


def _stem_sql(w: str) -> str:
    cases = " ".join(f"WHEN suffix({w}, '{e}') AND length({w}) - {len(e)} + {len(n)} >= 3 THEN substr({w}, 1, length({w}) - {len(e)}) || '{n}'" for e, n in fixed.STEM_RULES)
    return f"CASE WHEN length({w}) < 4 THEN {w} {cases} ELSE {w} END"


def _tok_b_sql(x: str, stop: bool = False, stems: bool = True) -> str:
    spaced = f"regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_-]', ' ', 'g')"
    out = f"list_filter(regexp_split_to_array(lower({spaced}), '[\\s\\W]+'), lambda t: length(t) > 1)"
    if stop:
        out = f"list_filter({out}, lambda t: NOT list_contains({sql_list(fixed.STOPWORDS)}, t))"
    return f"list_transform({out}, lambda w: {_stem_sql('w')})" if stems else out


def _digest(tokens: Column) -> list[Column]:
    return [F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("digest")]


def _digest_sql(tokens: str) -> str:
    return f"SELECT doc_id, len({tokens})::BIGINT AS n_tokens, md5(array_to_string({tokens}, ' ')) AS digest FROM documents"


@query(_digest_sql(_tok_p_sql("text")))
def tokenize_p(s, d):
    return inputs.documents(s, d).select("doc_id", *_digest(T.tokenize_p(F.col("text"))))


@query(_digest_sql(_tok_b_sql("text", stop=True)))
def tokenize_b(s, d):
    return inputs.documents(s, d).select("doc_id", *_digest(T.tokenize_b(F.col("text"), stop=True, stems=True)))


@query(f"WITH w AS (SELECT DISTINCT unnest({_tok_b_sql('text', stems=False)}) AS word FROM documents) SELECT word, {_stem_sql('word')} AS stem FROM w")
def stem_b(s, d):
    words = inputs.documents(s, d).select(F.explode(T.tokenize_b(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


_ODD_SQL = "replace(replace(text, ' th', '_th'), 'e ', '2e_')"


@query(f"WITH t AS (SELECT doc_id, {_tok_p_sql(_ODD_SQL)} AS toks FROM documents) SELECT doc_id, len(toks)::BIGINT AS n_tokens, len(list_filter(toks, lambda t: t = 'the'))::BIGINT AS n_the FROM t")
def token_counts_p(s, d):
    """Counted without making tokens, over texts with many identifiers of several parts."""
    odd = F.replace(F.replace(F.col("text"), F.lit(" th"), F.lit("_th")), F.lit("e "), F.lit("2e_"))
    n, (the,) = T.counts_p(odd, ["the"])
    return inputs.documents(s, d).select("doc_id", n.cast("long").alias("n_tokens"), the.cast("long").alias("n_the"))


# Keyword scores


@query(f"WITH t AS (SELECT unnest(list_distinct({_tok_p_sql('text')})) AS term FROM documents) SELECT term, count(*) AS df FROM t GROUP BY term")
def doc_freqs(s, d):
    return rank.doc_frequencies(inputs.docs(s, d))


@query(f"SELECT count(*) AS n_docs, round(avg(len({_tok_p_sql('text')})), 6) AS avgdl FROM documents")
def corpus_stats(s, d):
    return _round(rank.corpus_stats(inputs.docs(s, d)), "n_docs", "avgdl")


def _bm25_sql() -> str:
    terms = sorted(set(T.query_tokens_p(QUERY_P)))
    counts = ", ".join(f"len(list_filter(toks, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(terms))
    found = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"CASE WHEN f{i} > 0 THEN ln((n_docs - d{i} + 0.5) / (d{i} + 0.5) + 1) * f{i} * 2.5 / (f{i} + 1.5 * (0.25 + 0.75 * n / avgdl)) ELSE 0 END" for i in range(len(terms)))
    return f"""{DOCS_SQL}, tk AS (SELECT *, {_tok_p_sql("content")} AS toks FROM docs),
    tf AS (SELECT *, len(toks) AS n, {counts} FROM tk),
    st AS (SELECT count(*)::DOUBLE AS n_docs, avg(n) AS avgdl, {found} FROM tf),
    bm AS (SELECT tf.*, {score} AS bm25 FROM tf, st)"""


def _keyword_p_sql() -> str:
    asked = sql_list(sorted(set(T.query_tokens_p(QUERY_P))))
    inside = lambda x: f"len(list_intersect(list_distinct({_tok_p_sql(x)}), {asked}))"
    return f"""{_bm25_sql()}, raw AS (SELECT *, bm25 + 2 * {inside("path")} + 3 * {inside("coalesce(name, '')")} AS r FROM bm),
    kp AS (SELECT *, CASE WHEN max(r) OVER () > 0 THEN r / max(r) OVER () ELSE r END AS score FROM raw)"""


def _keyword_b_sql() -> str:
    terms, strong = T.query_tokens_b(QUERY_B), T.important_terms(QUERY_B)
    hits = lambda c, t: f"len(list_filter({c}, lambda x: contains(x, '{t}') OR contains('{t}', x)))"
    density = "(1 + least(1.0::DOUBLE, 200.0::DOUBLE / greatest(len(c), 1)))"
    equal = lambda c, t, n: f"CASE WHEN list_contains({c}, '{t}') THEN {n} ELSE 0 END"

    def part(t: str) -> str:
        content = f"CASE WHEN {hits('c', t)} > 0 THEN (1 + ln({hits('c', t)}::DOUBLE)) * {density} ELSE 0 END"
        return f"{5 if t in strong else 1} * ({content} + 2 * {hits('p', t)} + 3 * {hits('n', t)} + {equal('c', t, 2)} + {equal('p', t, 10)} + {equal('n', t, 20)})"

    every = " AND ".join(f"({hits('c', t)} + {hits('p', t)} + {hits('n', t)} > 0)" for t in terms)
    return f"""{DOCS_SQL},
    tb AS (SELECT *, {_tok_b_sql("content")} AS c, {_tok_b_sql("path")} AS p, {_tok_b_sql("coalesce(name, '')")} AS n FROM docs),
    kb AS (SELECT *, ({" + ".join(map(part, terms))}) * CASE WHEN {every} THEN 1.5 ELSE 1 END
      * CASE WHEN contains(path, '.test.') OR contains(path, '.spec.') OR contains(path, '__fixtures__') OR contains(path, '__tests__') THEN 0.5 ELSE 1 END
      * CASE WHEN contains(path, '/codemod/') OR contains(path, '/codemods/') THEN 0.3 ELSE 1 END
      * CASE WHEN contains(path, 'prepare') THEN 0.7 ELSE 1 END AS score FROM tb)"""


@query(f"WITH {_bm25_sql()} SELECT doc_id, round(bm25::DOUBLE, 6) AS bm25 FROM bm")
def bm25(s, d):
    return _round(rank.bm25(inputs.docs(s, d), QUERY_P), "doc_id", "bm25")


@query(f"WITH {_keyword_p_sql()} SELECT doc_id, round(score::DOUBLE, 6) AS score FROM kp")
def keyword_rank_p(s, d):
    return _round(rank.keyword_rank_p(inputs.docs(s, d), QUERY_P), "doc_id", "score")


@query(f"WITH {_keyword_b_sql()} SELECT doc_id, round(score::DOUBLE, 6) AS score FROM kb")
def keyword_rank_b(s, d):
    return _round(rank.keyword_rank_b(inputs.docs(s, d), QUERY_B), "doc_id", "score")


@query(f"""WITH {_bm25_sql()} SELECT doc_id, round(CASE WHEN max(bm25) OVER () = min(bm25) OVER () THEN 0.5
  ELSE (bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()) END::DOUBLE, 6) AS score FROM bm""")
def minmax_scores(s, d):
    return _round(rank.minmax(rank.bm25(inputs.docs(s, d), QUERY_P), "bm25", "score"), "doc_id", "score")


# Selection under a budget


def _scored(s: SparkSession, d: str) -> DataFrame:
    rows = inputs.docs(s, d).withColumn("tokens", T.token_estimate(F.col("content")))
    # the count is of the content, so it goes into the table that the content is read for
    return rank.keyword_rank_p(rows, QUERY_P).withColumn("score", F.round("score", 6))


def _packed(s: SparkSession, d: str, choose) -> DataFrame:
    return select.packed(_scored(s, d), inputs.docs(s, d), ["path", "start_line"], choose)


def _greedy(s: SparkSession, d: str) -> DataFrame:
    return _packed(s, d, lambda r: select.greedy(r, BUDGET))


RANKED_SQL = "rk AS (SELECT *, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens, row_number() OVER (ORDER BY round(score, 6) DESC, path) AS rank FROM kp)"


def _fold_sql(fits: str, start: str = "0.0", extra: int = 0) -> str:
    """Over rows (rank, tokens): the total and the ranks taken. fits: whether a.total + x.total may be."""
    row = f"struct_pack(k := rank, t := tokens::DOUBLE + {extra})"
    first = f"struct_pack(total := {start}::DOUBLE, taken := []::BIGINT[])"
    took = "struct_pack(total := a.total + x.total, taken := list_concat(a.taken, x.taken))"
    return f"""list_reduce(list_transform(list({row} ORDER BY rank), lambda x: struct_pack(total := x.t, taken := [x.k])),
      lambda a, x: CASE WHEN {fits} THEN {took} ELSE a END, {first})"""


GREEDY_SQL = f"""WITH {_keyword_p_sql()}, {RANKED_SQL},
f AS (SELECT {_fold_sql(f"a.total + x.total <= {BUDGET}")} AS r FROM rk WHERE tokens <= {BUDGET}),
tk1 AS (SELECT unnest(r.taken) AS rank FROM f), sel AS (SELECT rk.* FROM rk JOIN tk1 USING (rank))"""


def entry(s: SparkSession, d: str) -> DataFrame:
    """Documents by keyword score, packed into the budget."""
    return pack_greedy(s, d)


@query(f"{GREEDY_SQL} SELECT rank, path, 1 AS start_line, round(score::DOUBLE, 6) AS score, tokens FROM sel")
def pack_greedy(s, d):
    return _greedy(s, d).select("rank", "path", "start_line", "score", "tokens")


@query(f"""WITH {_keyword_p_sql()}, {RANKED_SQL},
f AS (SELECT {_fold_sql("a.total + x.total <= 3800 AND a.total < 3724", extra=50)} AS r FROM rk WHERE tokens + 50 <= 3800),
t AS (SELECT unnest(r.taken) AS rank FROM f) SELECT rank, path, tokens FROM rk JOIN t USING (rank)""")
def pack_single_b(s, d):
    return _packed(s, d, lambda r: select.pack_single(r, BUDGET)).select("rank", "path", "tokens")


@query(f"""WITH {_keyword_p_sql()}, {RANKED_SQL},
e0 AS (SELECT a.path AS src, b.path AS dst FROM rk a JOIN rk b ON b.doc_id = a.doc_id + 3),
f1 AS (SELECT {_fold_sql(f"a.total + x.total <= {0.7 * BUDGET}")} AS r FROM rk WHERE tokens <= {0.7 * BUDGET}),
one AS (SELECT rk.* FROM rk JOIN (SELECT unnest(r.taken) AS rank FROM f1) USING (rank)),
near AS (SELECT dst AS path FROM e0 WHERE src IN (SELECT path FROM one) UNION SELECT src FROM e0 WHERE dst IN (SELECT path FROM one)),
f2 AS (SELECT {_fold_sql(f"a.total + x.total <= {BUDGET}", "max(spent)")} AS r FROM rk, (SELECT sum(tokens) AS spent FROM one)
  WHERE path IN (SELECT path FROM near) AND path NOT IN (SELECT path FROM one)),
two AS (SELECT rk.* FROM rk JOIN (SELECT unnest(r.taken) AS rank FROM f2) USING (rank))
SELECT rank, path, tokens, 1 AS pass FROM one UNION ALL SELECT rank, path, tokens, 2 FROM two""")
def pack_two_pass_p(s, d):
    """Each document as if it imported the one three numbers on."""
    docs = inputs.docs(s, d).select("doc_id", "path")
    edges = docs.join(docs.select((F.col("doc_id") - 3).alias("doc_id"), F.col("path").alias("dst")), "doc_id").select(F.col("path").alias("src"), "dst")
    return _packed(s, d, lambda r: select.pack_two_pass(r, BUDGET, edges)).select("rank", "path", "tokens", "pass")


@query(f"""{GREEDY_SQL} SELECT (SELECT count(*) FROM docs) AS files_scanned, count(DISTINCT path) AS files_included, count(*) AS chunks,
  CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens, CAST({BUDGET} AS BIGINT) AS budget FROM sel""")
def result_stats(s, d):
    return select.stats(inputs.docs(s, d), pack_greedy(s, d), BUDGET)


# Texts of the selection


def _text(df: DataFrame) -> DataFrame:
    return df.select(F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n_chars"))


def _text_sql(each: str, between: str, rows: str = "sel", order: str = "rank") -> str:
    whole = f"string_agg({each}, {between} ORDER BY {order})"
    return f"{GREEDY_SQL} SELECT sha256({whole}) AS digest, length({whole}) AS n_chars FROM {rows}"


_NL = "chr(10)"
_FENCED = f"'```' || language || {_NL} || content || {_NL} || '```'"
_NAMED = "CASE WHEN name <> '' THEN ' (file: ' || name || ')' ELSE '' END"


@query(_text_sql(f"'## ' || path || ':L1-' || end_line || {_NAMED} || {_NL} || {_NL} || {_FENCED}", f"{_NL} || {_NL} || '---' || {_NL} || {_NL}"))
def render_markdown_p(s, d):
    return _text(render.markdown_p(_greedy(s, d)))


@query(_text_sql(f"""'<file path="' || path || '"' || CASE WHEN name <> '' THEN ' name="' || name || '" type="file"' ELSE '' END
  || ' lines="1-' || end_line || '" language="' || language || '">' || {_NL} || content || {_NL} || '</file>'""", f"{_NL} || {_NL}"))
def render_xml_p(s, d):
    return _text(render.xml_p(_greedy(s, d)))


@query(f"""{GREEDY_SQL}, part AS (
  SELECT path, CASE WHEN len(string_split(content, chr(10))) = 1 AND part = 2 THEN 0 ELSE part END AS part, rank, name, language,
    CASE part WHEN 1 THEN 1 ELSE 1 + end_line END AS first, CASE part WHEN 1 THEN end_line ELSE end_line + 2 END AS last, content
  FROM sel, (VALUES (1), (2)) p(part)
), chunk AS (
  SELECT path, rank, first, '### ' || CASE WHEN first = last THEN 'Line ' || first ELSE 'Lines ' || first || '-' || last END || {_NAMED}
    || {_NL} || {_NL} || {_FENCED} || {_NL} AS t FROM part
), file AS (SELECT path, min(rank) AS rank, '## ' || path || {_NL} || {_NL} || string_agg(t, {_NL} ORDER BY first) AS t FROM chunk GROUP BY path)
SELECT sha256(string_agg(t, {_NL} ORDER BY rank)) AS digest, length(string_agg(t, {_NL} ORDER BY rank)) AS n_chars FROM file""")
def render_markdown_b(s, d):
    """Each chosen document as a file of two chunks, the later one ranked further down."""
    one = _greedy(s, d)
    two = one.withColumns({"start_line": F.col("end_line") + 1, "end_line": F.col("end_line") + 2, "rank": F.col("rank") + 1_000_000})
    return _text(render.markdown_b(one.unionByName(two)))


# Paths


def _paths_query(cols: str, rows: str = "paths") -> str:
    return f"WITH {PATHS_SQL} SELECT path, {cols} FROM {rows}"


_BASE_SQL = "string_split(path, '/')[-1]"


@query(_paths_query(f"{inputs.language_sql(fixed.LANGUAGES_P, inputs.EXT_P_SQL, 'NULL')} AS lang_p, {inputs.language_sql(fixed.LANGUAGES_B, inputs.EXT_B_SQL, chr(39) + 'text' + chr(39))} AS lang_b"))
def languages(s, d):
    return inputs.paths(s, d).select("path", T.language_p(F.col("path")).alias("lang_p"), T.language_b(F.col("path")).alias("lang_b"))


@query(_paths_query(f"""list_has_any(string_split(path, '/'), {sql_list(fixed.IGNORE_DIRS)}) OR list_contains({sql_list(fixed.IGNORE_FILES)}, {_BASE_SQL})
  OR list_contains({sql_list(fixed.BINARY_P)}, {inputs.EXT_P_SQL}) AS ignored"""))
def ignored_p(s, d):
    return inputs.paths(s, d).select("path", T.ignored_p(F.col("path")).alias("ignored"))


@query(_paths_query(r"""path LIKE 'src/%' OR path LIKE '%.py' OR regexp_full_match(path, '[a-d][^x-z].*') OR regexp_full_match(string_split(path, '/')[-1], '[a-d][^x-z].*') AS glob_p,
  regexp_full_match(path, 'src/[^/]*') OR regexp_full_match(path, '(.*/)?[^/]*\.py') OR regexp_full_match(path, '(lib|app)/.*[a-m][^/]*\.(ts|js)') AS glob_b"""))
def globs(s, d):
    p = F.col("path")
    both = T.matches_p(p, ["src/*", "*.py", "[a-d][!x-z]*"]), T.matches_b(p, ["src/*", "**/*.py", "{lib,app}/**[a-m]*.{ts,js}"])
    return inputs.paths(s, d).select("path", both[0].alias("glob_p"), both[1].alias("glob_b"))


@query("""WITH s AS (SELECT source AS path, string_agg(text, chr(10) ORDER BY doc_id) AS c FROM documents GROUP BY source)
SELECT path, strlen(c) <= 1048576 AND len(string_split(c, chr(10))) <= 20000 AS kept, len(string_split(c, chr(10)))::BIGINT AS n_lines FROM s""")
def size_limit(s, d):
    f = inputs.by_source(s, d)
    return f.select("path", T.within_limits(F.col("content"), "B").alias("kept"), F.size(F.split("content", "\n", -1)).cast("long").alias("n_lines"))


_ENDS_SQL = r"regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g')"


@query(f"""WITH t AS (SELECT doc_id, strlen(text) AS size, {_ENDS_SQL} AS t FROM (SELECT doc_id, replace(text, ' ', chr(13)) || repeat(chr(10), (doc_id % 3)::INT) AS text FROM documents))
SELECT doc_id, size, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) - CASE WHEN suffix(t, chr(10)) THEN 1 ELSE 0 END END::BIGINT AS n_lines FROM t""")
def count_lines_p(s, d):
    """Texts with a carriage return for each space, and up to two line feeds more."""
    text = F.concat(F.replace("text", F.lit(" "), F.lit(chr(13))), F.repeat(F.lit(chr(10)), (F.col("doc_id") % 3).cast("int")))
    rows = inputs.documents(s, d).select("doc_id", text.alias("text"))
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("size"), T.count_lines_p(F.col("text")).cast("long").alias("n_lines"))


def _importance_p_sql(rows: str) -> str:
    some = lambda xs: f"list_has_any(parts, {sql_list(xs)})"
    return f"""ip AS (SELECT path, string_split(lower(path), '/') AS parts, string_split(lower(path), '/')[-1] AS base FROM {rows}),
    imp AS (SELECT path, greatest(0, least(1, 0.5 + CASE WHEN list_contains({sql_list(fixed.ENTRY_P)}, base) THEN 0.3 ELSE 0 END
      + CASE WHEN regexp_matches(base, '^(main|index|app)') THEN 0.15 ELSE 0 END
      + CASE WHEN base = '__init__.py' AND len(parts) <= 3 THEN 0.1 ELSE 0 END + CASE WHEN {some(fixed.HIGH_DIRS_P)} THEN 0.1 ELSE 0 END
      - CASE WHEN {some(fixed.LOW_DIRS_P)} THEN 0.2 ELSE 0 END - greatest(len(parts) - 5, 0) * 0.1
      - CASE WHEN regexp_matches(base, '\\.(json|yaml|yml)$') AND base NOT IN ('package.json', 'tsconfig.json') THEN 0.1 ELSE 0 END))::DOUBLE AS importance FROM ip)"""


def _importance_b_sql(rows: str) -> str:
    some = lambda xs: f"list_has_any(dirs, {sql_list(xs)})"
    return f"""ib AS (
      SELECT path, string_split(path, '/')[:-2] AS dirs, {_BASE_SQL} AS base, greatest(len(string_split(path, '/')) - 1, 1) AS depth, {inputs.EXT_B_SQL} AS ext FROM {rows}
    ), imb AS (SELECT path, greatest(0, least(1, 0.5 + CASE WHEN list_contains({sql_list(fixed.ENTRY_B)}, base) THEN 0.3 ELSE 0 END
      + CASE WHEN {some(fixed.HIGH_DIRS_B)} THEN 0.1 ELSE 0 END - CASE WHEN {some(fixed.LOW_DIRS_B)} THEN 0.2 ELSE 0 END
      - CASE WHEN regexp_matches(path, '{"|".join(fixed.LOW_NAMES_B)}') THEN 0.15 ELSE 0 END - greatest(depth - 3, 0) * 0.05
      - CASE WHEN ext IN ('md', 'mdx') THEN 0.1 ELSE 0 END - CASE WHEN ext IN ('json', 'yaml', 'yml') THEN 0.05 ELSE 0 END))::DOUBLE AS importance FROM ib)"""


@query(f"WITH {PATHS_SQL}, {_importance_p_sql('paths')} SELECT path, round(importance, 6) AS importance FROM imp")
def importance_p(s, d):
    return _round(inputs.paths(s, d).withColumn("importance", T.importance_p(F.col("path"))), "path", "importance")


@query(f"WITH {PATHS_SQL}, {_importance_b_sql('paths')} SELECT path, round(importance, 6) AS importance FROM imb")
def importance_b(s, d):
    return _round(inputs.paths(s, d).withColumn("importance", T.importance_b(F.col("path"))), "path", "importance")


_CENTRAL_SQL = "CASE WHEN length(path) % 3 = 0 THEN 'x' || path ELSE path END AS path, (length(path) % 11) / 10.0::DOUBLE AS centrality"


@query(f"""WITH {PATHS_SQL}, {_importance_b_sql("paths")}, c AS (SELECT {_CENTRAL_SQL} FROM paths)
SELECT path, round((coalesce(importance, 0.5) * 0.6 + coalesce(centrality, 0.5) * 0.4)::DOUBLE, 6) AS combined FROM imb FULL JOIN c USING (path)""")
def combine_scores_b(s, d):
    """A third of the paths has no centrality, as many have nothing but one."""
    p = inputs.paths(s, d)
    n = F.length("path")
    central = p.select(F.when(n % 3 == 0, F.concat(F.lit("x"), "path")).otherwise(F.col("path")).alias("path"), ((n % 11) / 10.0).alias("centrality"))
    return _round(rank.combine_scores(p.withColumn("importance", T.importance_b(F.col("path"))), central), "path", "combined")


# Chunks


@query("""WITH src AS (SELECT source AS path, string_split(string_agg(text, chr(10) ORDER BY doc_id), chr(10)) AS lines FROM documents GROUP BY source),
cs AS (SELECT path, lines, unnest(generate_series(0, len(lines) - 1, 200)) AS s FROM src)
SELECT path, CAST(s + 1 AS INT) AS start_line, CAST(least(s + 200, len(lines)) AS INT) AS end_line, sha256(array_to_string(lines[s + 1 : s + 200], chr(10))) AS digest FROM cs""")
def chunk_sections(s, d):
    c = chunk.chunk_p(inputs.by_source(s, d))
    return c.select("path", "start_line", "end_line", F.sha2("content", 256).alias("digest"))


@query("""WITH src AS (SELECT source AS path, string_split(string_agg(text, chr(10) ORDER BY doc_id), chr(10)) AS lines FROM documents GROUP BY source),
cs AS (SELECT path, lines, unnest(generate_series(0, len(lines) - 1, 200)) AS s FROM src)
SELECT path, CAST(s + 1 AS INT) AS start_line, CAST(least(s + 200, len(lines)) AS INT) AS end_line, sha256(path || ':' || s) AS id,
  CAST(ceil(length(array_to_string(lines[s + 1 : s + 200], chr(10))) / 4.0) AS BIGINT) AS tokens FROM cs""")
def chunk_ids_b(s, d):
    return chunk.chunk_b(inputs.by_source(s, d)).select("path", "start_line", "end_line", "id", "tokens")


def _definitions_sql(patterns: dict, line: str, strict: bool = False) -> str:
    """(chunk_type, name) of the first pattern that fits a line, by language; null if none does."""
    esc = lambda p: p.replace("'", "''")
    of = lambda p, kind, group=1: f"WHEN regexp_matches({line}, '{esc(p)}') THEN struct_pack(kind := '{kind}', name := nullif(regexp_extract({line}, '{esc(p)}', {1 if strict else group}), ''))"
    return "CASE language " + " ".join(f"WHEN '{k}' THEN CASE {' '.join(of(*p) for p in ps)} END" for k, ps in patterns.items()) + " END"


def _code_sql(patterns: dict, line: str, strict: bool = False) -> str:
    """defs(path, first, next, chunk_type, name) over all files, next being the line of the definition after or the end."""
    return f"""WITH {CODE_SQL}, each AS (SELECT path, language, len(lines) AS n, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM code),
    found AS (SELECT path, n, i, {_definitions_sql(patterns, line, strict)} AS f FROM each),
    defs AS (SELECT path, n, i AS first, lead(i, 1, n) OVER (PARTITION BY path ORDER BY i) AS next, f.kind AS chunk_type, f.name AS name FROM found WHERE f IS NOT NULL)"""


def _chunks_p_sql(strict: bool) -> str:
    return f"""{_code_sql(fixed.DEFINITIONS_P, "regexp_replace(line, '^\\s+|\\s+$', '', 'g')", strict)},
    large AS (SELECT * FROM code WHERE len(lines) > 200),
    heads AS (SELECT path, min(first) AS first FROM defs GROUP BY path),
    spans AS (
      SELECT path, 0 AS first, len(lines) AS next, 'file' AS chunk_type, NULL AS name FROM code WHERE len(lines) <= 200
      UNION ALL SELECT path, first, next, chunk_type, name FROM defs WHERE path IN (SELECT path FROM large)
      UNION ALL SELECT path, 0, first, 'header', NULL FROM heads JOIN large USING (path) WHERE first > 0 AND regexp_matches(array_to_string(lines[1 : first], chr(10)), '\\S')
      UNION ALL SELECT path, s, least(s + 200, n), 'section', NULL FROM (SELECT path, len(lines) AS n, unnest(range(0, len(lines), 200)) AS s FROM large WHERE path NOT IN (SELECT path FROM heads))
    )
    SELECT path, CAST(first + 1 AS INT) AS start_line, CAST(next AS INT) AS end_line, chunk_type, name, md5(array_to_string(lines[first + 1 : next], chr(10))) AS digest FROM spans JOIN code USING (path)"""


CHUNKS_B_SQL = f"""{_code_sql(fixed.DEFINITIONS_B, "line")},
counted AS (SELECT path, count(*) AS k, min(first) AS head FROM defs GROUP BY path),
whole AS (SELECT defs.* FROM defs JOIN counted USING (path) WHERE next - first >= 10 OR k = 1),
spans AS (
  SELECT path, s AS first, least(s + 200, next) AS next, chunk_type, CASE WHEN s = first THEN name ELSE name || ' (continued)' END AS name
  FROM (SELECT *, unnest(range(first, next, 200)) AS s FROM whole)
  UNION ALL SELECT path, 0, head, 'section', 'imports/preamble' FROM counted WHERE head >= 10
  UNION ALL SELECT path, s, least(s + 200, n), 'section', NULL FROM (SELECT path, len(lines) AS n, unnest(range(0, len(lines), 200)) AS s FROM code WHERE path NOT IN (SELECT path FROM counted))
)
SELECT path, CAST(first + 1 AS INT) AS start_line, CAST(next AS INT) AS end_line, chunk_type, name, md5(array_to_string(lines[first + 1 : next], chr(10))) AS digest FROM spans JOIN code USING (path)"""


def _spans(chunks: DataFrame) -> DataFrame:
    return chunks.select("path", "start_line", "end_line", "chunk_type", "name", F.md5("content").alias("digest"))


@query(_chunks_p_sql(False))
def chunk_definitions_p(s, d):
    return _spans(chunk.chunk_p(inputs.code(s, d)))


@query(_chunks_p_sql(True))
def chunk_definitions_p_strict(s, d):
    return _spans(chunk.chunk_p(inputs.code(s, d), strict=True))


@query(CHUNKS_B_SQL)
def chunk_definitions_b(s, d):
    return _spans(chunk.chunk_b(inputs.code(s, d)))


# Graphs


def _quoted(p: str) -> str:
    return p.replace("'", "''")


def _imports_p_sql() -> str:
    cases = []
    for lang, ps in fixed.IMPORTS_P.items():
        one = []
        for p, g, dots in ps:
            relative = f"regexp_extract(line, '{_quoted(p)}', {dots}) <> ''" if dots else f"prefix(regexp_extract(line, '{_quoted(p)}', {g}), '.')" if lang in ("javascript", "typescript") else "false"
            up = f"length(regexp_extract(line, '{_quoted(p)}', {dots}))" if dots else "0"
            one.append(f"WHEN regexp_matches(line, '{_quoted(p)}') THEN struct_pack(module := regexp_extract(line, '{_quoted(p)}', {g}), rel := {relative}, up := {up})")
        cases.append(f"WHEN '{lang}' THEN CASE {' '.join(one)} END")
    return f"""{IMPORTS_SQL}, ln AS (
      SELECT path, language, i, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line
      FROM (SELECT path, language, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS i FROM files)
    ), im AS (SELECT path, language, i, m.module AS module, m.rel AS rel, m.up AS up FROM (SELECT *, CASE language {" ".join(cases)} END AS m FROM ln) WHERE m IS NOT NULL)"""


def _resolved_sql(bases: str, table: dict[str, list[str]], keys: str, tidy: bool) -> str:
    """edge(keys, dst): of the candidates the first that is a file. bases(keys, language, base)."""
    ends = "CASE language " + " ".join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in table.items()) + " ELSE [] END"
    path = "base || e"
    if tidy:  # a folder and the step back from it, and steps that stay
        path = r"regexp_replace(regexp_replace(regexp_replace(" + path + r", '//+', '/', 'g'), '(^|/)\./', '\1', 'g'), '[^/.]+/\.\./', '', 'g')"
    return f"""try AS (SELECT *, {path} AS dst FROM (SELECT *, unnest({ends}) AS e, unnest(range(len({ends}))) AS pos FROM ({bases}))),
    edge AS (SELECT {keys}, arg_min(dst, pos) AS dst FROM try WHERE dst IN (SELECT path FROM files) GROUP BY {keys})"""


_FOLDER_SQL = "regexp_extract(path, '^(.*/)?[^/]*$', 1)"


def _edges_p_sql(strict: bool) -> str:
    python = "replace(module, '.', '/')"
    other = "regexp_replace(module, '^\\./', '')" if strict else "module"
    above = "" if strict else "|| repeat('../', greatest(up - 1, 0)::INT) "
    base = f"CASE WHEN rel THEN {_FOLDER_SQL} {above}|| CASE WHEN language = 'python' THEN {python} ELSE {other} END ELSE {python} END"
    bases = f"SELECT path, i, language, {base} AS base FROM im WHERE language = 'python' OR rel"
    return f"WITH {_imports_p_sql()}, {_resolved_sql(bases, fixed.RESOLVE_P, 'path, i', not strict)} SELECT DISTINCT path AS src, dst FROM edge"


_MATCHES_B_SQL = "CASE language " + " ".join(f"WHEN '{k}' THEN flatten([{', '.join(chr(40) + 'regexp_extract_all(content, ' + chr(39) + '(?m)' + _quoted(p) + chr(39) + ', 1))' for p in ps)}])" for k, ps in fixed.IMPORTS_B.items()) + " ELSE [] END"
_IMPORTS_B_SQL = f"{IMPORTS_SQL}, im AS (SELECT path, language, unnest({_MATCHES_B_SQL}) AS module FROM files)"


def _edges_b_sql(strict: bool) -> str:
    plain = f"{_FOLDER_SQL} || module"
    dots = r"length(regexp_extract(module, '^(\.*)', 1))"
    python = f"CASE WHEN {dots} > 0 THEN {_FOLDER_SQL} || repeat('../', ({dots} - 1)::INT) ELSE '' END || replace(substr(module, {dots} + 1), '.', '/')"
    base = plain if strict else f"CASE WHEN language = 'python' THEN {python} ELSE {plain} END"
    which = "regexp_matches(module, '^[./]')" + ("" if strict else " OR language = 'python'")
    bases = f"SELECT path, module, language, count(*) AS k, {base} AS base FROM im WHERE {which} GROUP BY ALL"
    return f"WITH {_IMPORTS_B_SQL}, {_resolved_sql(bases, fixed.RESOLVE_B, 'path, module, k', True)} SELECT src, dst FROM (SELECT path AS src, dst, unnest(range(k)) FROM edge)"


@query(f"WITH {_imports_p_sql()} SELECT path, module, rel AS is_relative FROM im")
def imports_p(s, d):
    return graph.extract_imports_p(inputs.imports(s, d)).select("path", "module", "is_relative")


@query(f"WITH {_IMPORTS_B_SQL} SELECT path, module FROM im")
def imports_b(s, d):
    return graph.extract_imports_b(inputs.imports(s, d)).select("path", "module")


@query(_edges_p_sql(True))
def edges_p_strict(s, d):
    f = inputs.imports(s, d)
    return graph.resolve_p(graph.extract_imports_p(f), f)


@query(_edges_p_sql(False))
def edges_p(s, d):
    f = inputs.imports(s, d)
    return graph.resolve_p(graph.extract_imports_p(f), f, strict=False)


@query(_edges_b_sql(True))
def edges_b_strict(s, d):
    f = inputs.imports(s, d)
    return graph.resolve_b(graph.extract_imports_b(f), f)


@query(_edges_b_sql(False))
def edges_b(s, d):
    f = inputs.imports(s, d)
    return graph.resolve_b(graph.extract_imports_b(f), f, strict=False)


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def page_links(s, d):
    return graph.links(inputs.read(s, d, "pages"))


@query(f"""WITH {EDGES_SQL}, e AS (SELECT DISTINCT src, dst FROM edges), w AS (SELECT dst AS path, 2 AS w FROM e UNION ALL SELECT src, 1 FROM e),
g AS (SELECT path, sum(w) AS w FROM w GROUP BY path)
SELECT s_suppkey AS path, round(least(1.0::DOUBLE, coalesce(w, 0)::DOUBLE / (3 * (SELECT count(*) FROM supplier))), 6) AS centrality FROM supplier LEFT JOIN g ON path = s_suppkey""")
def centrality_p(s, d):
    return _round(graph.centrality_p(*inputs.supply_edges(s, d)), "path", "centrality")


def _pagerank_sql(rounds: int = 10) -> str:
    out = f"""WITH {EDGES_SQL}, deg AS (SELECT src, count(*) AS deg FROM edges GROUP BY src),
    flow AS (SELECT e.src, e.dst, count(*)::DOUBLE / any_value(deg) AS share FROM edges e JOIN deg USING (src) GROUP BY e.src, e.dst),
    r0 AS (SELECT s_suppkey AS path, 1.0::DOUBLE AS score FROM supplier)"""
    for i in range(rounds):
        got = f"(SELECT sum(score * share) FROM flow JOIN r{i} ON r{i}.path = flow.src WHERE flow.dst = s_suppkey)"
        out += f", r{i + 1} AS (SELECT s_suppkey AS path, 0.15::DOUBLE + 0.85::DOUBLE * coalesce({got}, 0) AS score FROM supplier)"
    return f"{out} SELECT path, round(score / (SELECT max(score) FROM r{rounds}), 6) AS centrality FROM r{rounds}"


@query(_pagerank_sql())
def pagerank_b(s, d):
    return _round(graph.pagerank_b(*inputs.supply_edges(s, d)), "path", "centrality")


@query(f"""WITH RECURSIVE {EDGES_SQL}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
r AS (SELECT 1::BIGINT AS path, 0 AS n UNION SELECT b.dst, r.n + 1 FROM r JOIN b ON b.src = r.path WHERE r.n < 2) SELECT DISTINCT path FROM r""")
def related_files(s, d):
    _, e = inputs.supply_edges(s, d)
    return graph.related(e, s.range(1).select(F.lit(1).cast("long").alias("path")), 2)


# Vectors and blends


@query(f"WITH {COSINE_SQL} SELECT doc_id, round(emb, 6) AS score FROM em ORDER BY 2 DESC, 1 LIMIT 20")
def cosine_topk(s, d):
    q = inputs.first_vector(s, d)
    e = inputs.embedded(s, d).withColumn("score", rank.cosine(F.col("vector"), F.array(*map(F.lit, q))))
    return _round(e, "doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(20)


def _blended(s: SparkSession, d: str, kw: DataFrame) -> DataFrame:
    """With cosines, importance and a centrality that varies from document to document."""
    r = rank.embedding_rank(kw.withColumnRenamed("score", "kw"), inputs.embedded(s, d), inputs.first_vector(s, d), "doc_id")
    return r.withColumn("centrality", (F.col("doc_id") % 7) / 6.0)


_HYBRID_SQL = f"""WITH {_keyword_p_sql()}, {COSINE_SQL}, {_importance_p_sql("docs")}, {_importance_b_sql("docs")},
h AS (SELECT kp.doc_id, kp.path, language, score, bm25, coalesce(emb, 0) AS emb, imp.importance AS p, imb.importance AS b, (kp.doc_id % 7) / 6.0::DOUBLE AS c
  FROM kp LEFT JOIN em USING (doc_id) JOIN imp USING (path) JOIN imb USING (path))"""
_NOTES_SQL = r"CASE WHEN regexp_matches(path, '\.(md|mdx|txt|rst)$') THEN 0.6 ELSE 1 END"


@query(f"""{_HYBRID_SQL}, x AS (SELECT doc_id, (0.4 * score + 0.4 * emb + 0.2 * (0.7 * p + 0.3 * c)) * {_NOTES_SQL} AS raw FROM h)
SELECT doc_id, round((CASE WHEN max(raw) OVER () > 0 THEN raw / max(raw) OVER () ELSE raw END)::DOUBLE, 6) AS score FROM x""")
def hybrid_p(s, d):
    r = _blended(s, d, rank.keyword_rank_p(inputs.docs(s, d), QUERY_P)).withColumn("importance", T.importance_p(F.col("path")))
    return _round(rank.hybrid_p(r, True), "doc_id", "score")


@query(f"""{_HYBRID_SQL}, x AS (SELECT doc_id, (0.8 * score + 0.2 * (0.7 * p + 0.3 * c)) * {_NOTES_SQL} AS raw FROM h)
SELECT doc_id, round((CASE WHEN max(raw) OVER () > 0 THEN raw / max(raw) OVER () ELSE raw END)::DOUBLE, 6) AS score FROM x""")
def hybrid_p_keywords(s, d):
    """Without vectors."""
    r = rank.keyword_rank_p(inputs.docs(s, d), QUERY_P).withColumnRenamed("score", "kw").withColumns({"emb": F.lit(0.0), "centrality": (F.col("doc_id") % 7) / 6.0})
    return _round(rank.hybrid_p(r.withColumn("importance", T.importance_p(F.col("path"))), False), "doc_id", "score")


@query(f"""{_HYBRID_SQL} SELECT doc_id, round((0.4 * (bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()) + 0.4 * emb
  + 0.2 * (0.6 * b + 0.4 * c) * CASE WHEN language IN ('markdown', 'mdx') THEN 0.6 ELSE 1 END)::DOUBLE, 6) AS score FROM h""")
def hybrid_b(s, d):
    r = _blended(s, d, rank.bm25(inputs.docs(s, d), QUERY_P).withColumnRenamed("bm25", "score"))
    return _round(rank.hybrid_b(r.withColumn("combined", 0.6 * T.importance_b(F.col("path")) + 0.4 * F.col("centrality"))), "doc_id", "score")


def _rerank_sql(n: int, own: float) -> str:
    return f"""WITH {_keyword_p_sql()}, k AS (SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rn FROM kp),
    j AS (SELECT doc_id, max(quality)::DOUBLE AS rel FROM labels GROUP BY doc_id)
    SELECT doc_id, rn <= {n} AS reranked, round(CASE WHEN rn <= {n} THEN {own} * score + {1 - own:g} * coalesce(rel, 0.5) ELSE score END, 6) AS score FROM k LEFT JOIN j USING (doc_id)"""


def _reranked(s: SparkSession, d: str, n: int, own: float) -> DataFrame:
    judged = inputs.read(s, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("relevance"))
    return _round(rank.rerank(_scored(s, d), judged, "doc_id", n, own), "doc_id", "reranked", "score")


@query(_rerank_sql(50, 0.4))
def rerank_p(s, d):
    return _reranked(s, d, 50, 0.4)


@query(_rerank_sql(20, 0.3))
def rerank_b(s, d):
    return _reranked(s, d, 20, 0.3)


# The cache: before, it held documents of even number, those of a number divisible by 6 with another text


def _cached(s: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 6 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    old = inputs.docs(s, d).where("doc_id % 2 = 0")
    return old.select("path", F.sha2(text, 256).alias("hash"), (F.col("doc_id") * 10_000).cast("double").alias("last_accessed"), F.col("doc_id").cast("double").alias("mtime"), (F.col("doc_id") % 5).alias("n_chunks"))


CACHED_SQL = f"""{DOCS_SQL}, ca AS (
  SELECT doc_id, path, sha256(CASE WHEN doc_id % 6 = 0 THEN content || 'x' ELSE content END) AS hash, (doc_id * 10000)::DOUBLE AS last_accessed, doc_id::DOUBLE AS mtime
  FROM docs WHERE doc_id % 2 = 0
)"""


@query(f"WITH {CACHED_SQL} SELECT d.path, sha256(content) AS hash FROM docs d JOIN ca ON ca.path = d.path AND ca.hash = sha256(content)")
def cache_hits(s, d):
    return cache.hits(inputs.docs(s, d), _cached(s, d)).select("path", "hash")


@query(f"WITH {CACHED_SQL} SELECT d.path, sha256(content) AS hash FROM docs d WHERE NOT EXISTS (SELECT 1 FROM ca WHERE ca.path = d.path AND ca.hash = sha256(content))")
def cache_misses(s, d):
    return cache.misses(inputs.docs(s, d), _cached(s, d)).select("path", "hash")


@query(f"WITH {CACHED_SQL} SELECT path, sha256(content) AS hash FROM docs")
def cache_upsert(s, d):
    zero = F.lit(0.0)
    new = cache.misses(inputs.docs(s, d), _cached(s, d)).select("path", "hash", zero.alias("last_accessed"), zero.alias("mtime"), F.lit(1).cast("long").alias("n_chunks"))
    return cache.upsert(_cached(s, d), new).select("path", "hash")


@query(f"WITH {CACHED_SQL} SELECT path FROM ca WHERE last_accessed >= 8e6 - 30 * 86400")
def cache_prune(s, d):
    return cache.prune(_cached(s, d), 8e6, 30).select("path")


@query(f"WITH {CACHED_SQL} SELECT d.path FROM docs d JOIN ca ON ca.path = d.path WHERE d.doc_id % 5 > 0 AND d.doc_id % 4 <> 0")
def cache_fresh_b(s, d):
    files = inputs.docs(s, d).select("path", (F.col("doc_id") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).cast("double").alias("mtime"))
    return cache.fresh(files, _cached(s, d)).select("path")


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN text || chr(10) || 'more' ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN 50 * 86400 ELSE 10 END AS t FROM documents)
SELECT 'f' || doc_id AS path, sha256(text) AS hash, t::DOUBLE AS last_accessed, CAST(ceil(len(string_split(text, chr(10))) / 200.0) AS BIGINT) AS n_chunks,
  CAST(strlen(text) AS BIGINT) AS size FROM r WHERE doc_id % 3 = 0""")
def cache_life(s, d):
    """All files at time 10, then a third of them 50 days later, some changed, then a clean-up: the cache's files."""
    store = cache.ChunkCache(s, f"{durable.folder(s)}/cache-{uuid.uuid4().hex}", 8)
    text = F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text"))
    files = inputs.read(s, d, "documents").select("doc_id", F.concat(F.lit("f"), "doc_id").alias("path"), F.col("text").alias("content"), F.lit(None).cast("string").alias("language"))
    sections = lambda f: chunk.chunk_b(f).drop("id", "tokens")
    store.refresh(files.drop("doc_id"), sections, 10)
    again = inputs.read(s, d, "documents").where("doc_id % 3 = 0").select(F.concat(F.lit("f"), "doc_id").alias("path"), text.alias("content"), F.lit(None).cast("string").alias("language"))
    store.refresh(again, sections, 50 * 86_400)
    store.prune(50 * 86_400)
    chunks = store.chunks().groupBy("path").agg(F.count("*").alias("n"))
    out = store.files().join(chunks, "path", "left")
    return out.select("path", "hash", "last_accessed", F.when(F.col("n") == F.col("n_chunks"), F.col("n")).alias("n_chunks"), "size")




# A source tree: the documents' files and two ignore files, written to the folder for intermediate tables

IGNORE_FILES = {"": ["*.xyz", "/tools/", "docs/**/README.*", "!docs/**/README.md", "lib/utils/*"], "models": ["index.*", "!index.ts", "[a-c]*.py"]}


def _tree(s: SparkSession, d: str) -> str:
    at = f"{durable.folder(s)}/tree-{uuid.uuid4().hex}".removeprefix("file://")
    if "://" in at:
        raise NotImplementedError("the tree is read with Python's own file functions, so the folder must be a mounted one")

    def put(rows) -> None:
        for r in rows:
            path = os.path.join(at, r["path"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8", newline="") as f:
                f.write(r["content"])

    inputs.docs(s, d).select("path", "content").foreachPartition(put)
    put([{"path": f"{folder}/.gitignore".removeprefix("/"), "content": "\n".join(lines)} for folder, lines in IGNORE_FILES.items()])
    return at


def _scanned(s: SparkSession, d: str, profile: str, **options) -> DataFrame:
    files = ContextEngine(s, profile).scan(_tree(s, d), **options)
    return files.select("path", "language", "size", F.md5("content").alias("digest"))


def _files_sql(language: str, content: str, kept: str) -> str:
    return f"WITH {DOCS_SQL}, f AS (SELECT path, content, {_BASE_SQL} AS base, string_split(path, '/') AS parts FROM docs) SELECT path, {language} AS language, CAST(strlen(content) AS BIGINT) AS size, md5({content}) AS digest FROM f WHERE {kept}"


_LANG_P_SQL = inputs.language_sql(fixed.LANGUAGES_P, inputs.EXT_P_SQL, "NULL")
_LANG_B_SQL = inputs.language_sql(fixed.LANGUAGES_B, inputs.EXT_B_SQL, "'text'")
_KEPT_P_SQL = f"NOT (list_has_any(parts, {sql_list(fixed.IGNORE_DIRS)}) OR list_contains({sql_list(fixed.IGNORE_FILES)}, base) OR list_contains({sql_list(fixed.BINARY_P)}, {inputs.EXT_P_SQL}))"
_UNIX_SQL = "replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_KEPT_B_SQL = rf"""NOT regexp_matches(path, '(^|/)\.') AND NOT list_has_any(parts, {sql_list(x for x in fixed.EXCLUDES_B if "*" not in x)}) AND NOT regexp_matches(base, '\.(min\.js|min\.css|map|lock)$')
  AND NOT list_contains({sql_list(fixed.BINARY_B)}, {inputs.EXT_B_SQL}) AND NOT suffix(base, '.xyz') AND NOT prefix(path, 'tools/') AND NOT prefix(path, 'lib/utils/')
  AND NOT (prefix(path, 'docs/') AND prefix(base, 'README.') AND base <> 'README.md') AND NOT (prefix(path, 'models/') AND ((prefix(base, 'index.') AND base <> 'index.ts') OR regexp_matches(base, '^[a-c].*\.py$')))"""


@query(_files_sql(_LANG_P_SQL, _UNIX_SQL, _KEPT_P_SQL))
def scan_p(s, d):
    return _scanned(s, d, "P")


@query(_files_sql(_LANG_P_SQL, _UNIX_SQL, f"{_KEPT_P_SQL} AND (prefix(path, 'src/') OR suffix(path, '.md') OR regexp_matches(path, '^[l-t]') OR regexp_matches(base, '^[l-t]')) AND NOT contains(path, 'test')"))
def scan_p_globs(s, d):
    return _scanned(s, d, "P", include=["src/*", "*.md", "[l-t]*"], exclude=["*test*"])


@query(_files_sql(_LANG_B_SQL, "content", _KEPT_B_SQL))
def scan_b(s, d):
    return _scanned(s, d, "B")


@query(_files_sql(_LANG_B_SQL, "content", f"{_KEPT_B_SQL} AND (regexp_full_match(path, 'src/[^/]*/[^/]*') OR regexp_full_match(path, '(.*/)?[^/]*\\.(ts|py)')) AND NOT list_contains(parts, 'server') AND NOT regexp_matches(base, '^main\\.')"))
def scan_b_globs(s, d):
    """User excludes are rules of an ignore file, includes are path globs."""
    return _scanned(s, d, "B", include=["src/*/*", "**/*.{ts,py}"], exclude=["server/", "main.*"])
