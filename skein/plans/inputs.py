"""Inputs of the registered queries, derived from the given tables, each as a DataFrame and as SQL: files with paths and code made
from documents, graphs from order lines. All of a table's rows take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import fixed
from skein.functions import text as T
from skein.operators.durable import spread

#: Folders and names that documents are given by their number: all that the path operators tell apart.
FOLDERS = """src src/core lib/utils tests docs/guide app/api/v1 node_modules/left packages/a/codemods web/__tests__ a/b/c/d/e .git/hooks vendor/x
dist examples scripts/prepare tools server models hooks x/__fixtures__ migrations build spec config/env documentation/samples e2e""".split()
NAMES = """main index app server cli README utils __init__ setup config a.test b.spec_test types.d Dockerfile data prepare lib mod package
pyproject Cargo go yarn LICENSE CHANGELOG""".split()
SUFFIXES = sorted({*fixed.LANGUAGES_P, *fixed.LANGUAGES_B, "png", "PDF", "lock", "xyz", "PY", "mod", "txt", "so"})

_LINE = chr(10)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents"))


def _pick(items: list[str], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in items)), (at % len(items) + 1).cast("int"))


def sql_list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _pick_sql(items: list[str], at: str) -> str:
    return f"{sql_list(items)}[CAST(({at}) % {len(items)} AS INT) + 1]"


def _name(i: Column) -> Column:
    return F.concat(_pick(NAMES, F.floor(i / 3)), F.lit("."), _pick(SUFFIXES, i + F.floor(i / 7)))


_NAME_SQL = f"{_pick_sql(NAMES, 'doc_id // 3')} || '.' || {_pick_sql(SUFFIXES, 'doc_id + doc_id // 7')}"


def paths(spark: SparkSession, d: str) -> DataFrame:
    """Distinct paths, one of each document: every fifth in no folder."""
    i = F.col("doc_id")
    folder = F.when(i % 5 == 0, F.lit("")).otherwise(F.concat(_pick(FOLDERS, i), F.lit("/")))
    return read(spark, d, "documents").select(F.concat(folder, _name(i)).alias("path")).distinct()


PATHS_SQL = f"paths AS (SELECT DISTINCT CASE WHEN doc_id % 5 = 0 THEN '' ELSE {_pick_sql(FOLDERS, 'doc_id')} || '/' END || {_NAME_SQL} AS path FROM documents)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    """A file of one chunk for each document; paths are unique, some chunks have no name and some one that queries ask for."""
    i = F.col("doc_id")
    path = F.concat_ws("/", _pick(FOLDERS, i), i.cast("string"), _name(i))
    name = F.when(i % 5 == 0, F.lit(None)).when(i % 7 == 0, F.lit("getPasswordToken")).otherwise(F.col("source"))
    t = documents(spark, d).select("doc_id", path.alias("path"), F.col("text").alias("content"), name.alias("name"), F.size(F.split("text", "\n", -1)).alias("end_line"))
    return t.select("*", T.language_b(F.col("path")).alias("language"), F.lit(1).alias("start_line"), F.lit("file").alias("chunk_type"))


def language_sql(table: dict[str, str], ext: str, other: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {ext} {cases} ELSE {other} END"


EXT_B_SQL = "lower(string_split(path, '.')[-1])"
EXT_P_SQL = r"lower(regexp_extract(string_split(path, '/')[-1], '^.+\.([^.]+)$', 1))"
DOCS_SQL = f"""docs0 AS (
  SELECT doc_id, {_pick_sql(FOLDERS, 'doc_id')} || '/' || doc_id || '/' || {_NAME_SQL} AS path, text AS content, len(string_split(text, chr(10))) AS end_line,
    CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'getPasswordToken' ELSE source END AS name
  FROM documents
), docs AS (SELECT *, {language_sql(fixed.LANGUAGES_B, EXT_B_SQL, "'text'")} AS language FROM docs0)"""


def by_source(spark: SparkSession, d: str) -> DataFrame:
    """A file for each source: its documents' texts one after another."""
    t = read(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("r"))
    return t.select(F.col("source").alias("path"), F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("content"), F.lit(None).cast("string").alias("language"))


#: A definition's line in each language, some that only one profile knows, some indented; {} is its name.
DEFINITIONS = {
    "python": ["def {}(x):", "class {}:", "async def {}(y):", "    def {}(self):", "{} = 1"],
    "javascript": ["function {}(a) {{", "export class {} {{", "export const {} = (a) => 1", "let {} = 2;", "  async function {}() {{", "export async function {}() {{"],
    "typescript": ["export interface {} {{", "type {} = string;", "export enum {} {{", "const {}: number = 1;", "export function {}() {{", "class {} {{"],
    "tsx": ["export function {}() {{", "const {}: X = 1", "interface {} {{", "type {} = Y"],
    "jsx": ["export function {}() {{", "const {} = 1", "class {} {{"],
    "go": ["func {}(a int) {{", "func (r *T) {}() {{", "type {} struct {{", "type {} interface {{", "    func {}() {{"],
    "rust": ["pub fn {}() {{", "struct {} {{", "pub enum {} {{", "trait {} {{", "impl<T> {} for X {{", "mod {} {{", "async fn {}() {{"],
    "ruby": ["def {}", "class {}", "module {}", "  def {}"],
    "php": ["public function {}() {{", "class {} {{", "interface {} {{", "trait {} {{", "   private function {}() {{", "function {}() {{"],
    "java": ["public class {} {{", "    public static void {}(int a) {{", "interface {} {{", "private enum {} {{", "return {}(1);", "protected final interface {} {{"],
    "kotlin": ["fun {}() {{", "suspend fun {}() {{", "data class {}(val a: Int)", "interface {} {{", "object {} {{", "enum class {} {{"],
    "scala": ["def {}(a: Int) = 1", "class {} {{", "trait {} {{", "object {} {{", "case class {}(a: Int)"],
    "swift": ["func {}() {{", "class {} {{", "struct {} {{", "protocol {} {{", "enum {} {{", "extension {} {{"],
    "csharp": ["public class {} {{", "internal static async Task {}(int a)", "  interface {} {{", "struct {} {{", "private enum {} {{"],
    "c": ["static int {}(int a) {{", "struct {} {{", "typedef struct {} {{", "enum {} {{", "int {}(void);"],
    "cpp": ["virtual int {}(int a) const {{", "class {} {{", "struct {} {{", "namespace {} {{", "enum class {} {{"],
    "text": ["class {}"],
}
EVERY = 23  # words of a document, each a line of code, from one definition to the next; every third is followed by another soon


def code(spark: SparkSession, d: str) -> DataFrame:
    """A file for each document in one of the languages: a line for each word, with definitions among them."""
    langs = list(DEFINITIONS)
    i = F.col("doc_id")

    def line(w: Column, k: Column) -> Column:
        at = F.floor(k / EVERY)
        template = F.element_at("templates", (at % F.size("templates") + 1).cast("int"))
        defined = F.concat(F.split_part(template, F.lit("{}"), F.lit(1)), F.concat(F.lit("n"), k.cast("string")), F.split_part(template, F.lit("{}"), F.lit(2)))
        starts = (k % EVERY == 11 + i % 7) | ((k % EVERY == 15) & (at % 3 == 0))
        return F.when(starts & (i % 11 != 0), defined).otherwise(F.concat(F.lit("    "), w))

    t = documents(spark, d).withColumn("language", _pick(langs, i)).withColumn("words", F.split(F.replace("text", F.lit(_LINE), F.lit(" ")), " ", -1))
    table = F.create_map(*(x for k, v in DEFINITIONS.items() for x in (F.lit(k), F.array(*(F.lit(s.replace("{{", "{")) for s in v)))))
    t = t.withColumn("templates", table[F.col("language")])
    return t.select(F.concat(F.lit("f"), i.cast("string")).alias("path"), F.array_join(F.transform("words", line), _LINE).alias("content"), "language")


_TEMPLATES_SQL = "CASE language " + " ".join(f"WHEN '{k}' THEN {sql_list(s.replace('{{', '{') for s in v)}" for k, v in DEFINITIONS.items()) + " END"
CODE_SQL = f"""code0 AS (SELECT doc_id, 'f' || doc_id AS path, {_pick_sql(list(DEFINITIONS), 'doc_id')} AS language, string_split(replace(text, chr(10), ' '), ' ') AS words FROM documents),
code1 AS (SELECT *, {_TEMPLATES_SQL} AS templates FROM code0),
code AS (
  SELECT path, language, list_transform(words, lambda w, p: CASE
    WHEN ((p - 1) % {EVERY} = 11 + doc_id % 7 OR ((p - 1) % {EVERY} = 15 AND ((p - 1) // {EVERY}) % 3 = 0)) AND doc_id % 11 <> 0
    THEN replace(templates[((p - 1) // {EVERY}) % len(templates) + 1], '{{}}', 'n' || (p - 1)) ELSE '    ' || w END) AS lines
  FROM code1
)"""


def imports(spark: SparkSession, d: str) -> DataFrame:
    """A file for each document with imports of others: in the same folder, in another one, of nothing that is there."""
    i = F.col("doc_id")
    lang = _pick(list(IMPORT_SUFFIXES), i)
    near, far, above = i + 35, i + 5, i + 10
    values = {"a": near, "b": far % 7, "c": far, "d": above % 7, "e": above}

    def filled(template: str) -> Column:
        parts = []
        for p in template.replace("}", "{").split("{"):
            parts.append(values[p].cast("string") if p in values and len(p) == 1 else F.lit(p))
        return F.concat(*parts)

    content = None
    for k, lines in IMPORT_LINES.items():
        text = F.concat_ws(_LINE, *(filled(x) for x in lines))
        content = F.when(lang == k, text) if content is None else content.when(lang == k, text)
    suffix = F.create_map(*(F.lit(x) for kv in IMPORT_SUFFIXES.items() for x in kv))[lang]
    path = F.concat(F.lit("pkg"), i % 7, F.lit("/m"), i, suffix)
    return read(spark, d, "documents").select(path.alias("path"), F.concat(content, F.lit(_LINE), F.col("text")).alias("content"), lang.alias("language"))


IMPORT_SUFFIXES = {"python": ".py", "javascript": ".js", "typescript": ".ts", "go": ".go", "rust": ".rs"}
#: {a}: a file of the folder, {b} and {c}: folder and file elsewhere, {d} and {e}: likewise.
IMPORT_LINES = {
    "python": ["from .m{a} import x", "import pkg{b}.m{c}", "from ..pkg{d}.m{e} import y", "import os", "    from . import z"],
    "javascript": ["import x from '../m{a}';", "import '../pkg{b}/m{c}';", "require('./m{a}')", "const y = require('./m{a}');", "import R from 'react';"],
    "typescript": ["import x from './m{a}';", "import y from '../pkg{d}/m{e}';", "const z = await import('./m{a}');", "import R from 'react';"],
    "go": ['import "fmt"', '"net/http"'],
    "rust": ["use crate::m{a};", "mod m{c};"],
}


def _filled_sql(template: str) -> str:
    values = {"a": "doc_id + 35", "b": "(doc_id + 5) % 7", "c": "doc_id + 5", "d": "(doc_id + 10) % 7", "e": "doc_id + 10"}
    parts = template.replace("'", "''").replace("}", "{").split("{")
    return " || ".join(f"({values[p]})" if p in values and len(p) == 1 else f"'{p}'" for p in parts)


IMPORTS_SQL = f"""imp0 AS (SELECT doc_id, text, {_pick_sql(list(IMPORT_SUFFIXES), 'doc_id')} AS language FROM documents),
files AS (
  SELECT 'pkg' || (doc_id % 7) || '/m' || doc_id || CASE language {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in IMPORT_SUFFIXES.items())} END AS path, language,
    CASE language {" ".join(f"WHEN '{k}' THEN {' || chr(10) || '.join(_filled_sql(x) for x in v)}" for k, v in IMPORT_LINES.items())} END || chr(10) || text AS content
  FROM imp0
)"""


def supply_edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as nodes; an edge from each line's supplier to that of the order's next line."""
    a = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    b = a.select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") - 1).alias("n"), F.col("l_suppkey").alias("dst"))
    e = a.join(b, (F.col("l_orderkey") == F.col("o")) & (F.col("l_linenumber") == F.col("n"))).select(F.col("l_suppkey").alias("src"), "dst")
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("path")), e


EDGES_SQL = """edges AS (
  SELECT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a
  JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
)"""


def embedded(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))


def first_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in embedded(spark, d).orderBy("doc_id").first()[1]]


COSINE_SQL = """qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1),
em AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], q) AS emb FROM embeddings, qv)"""
