"""Import graphs: extraction, resolution, neighbours and centrality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import fixed

from .durable import written


def extract_imports_p(files: DataFrame) -> DataFrame:
    """path, line_no, module, is_relative, dots (those before a relative name), language: the first pattern that fits each stripped line's start."""
    f = files.where(F.col("language").isin(*fixed.IMPORTS_P)).select("path", "language", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line"))
    f = f.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    found = None
    for lang, ps in fixed.IMPORTS_P.items():
        one = None
        for p, g, dots in ps:
            module = F.regexp_extract("line", p, g)
            relative = F.regexp_extract("line", p, dots) != "" if dots else module.startswith(".") & F.lit(lang in ("javascript", "typescript"))
            up = F.length(F.regexp_extract("line", p, dots)) if dots else F.lit(0)
            one = (F if one is None else one).when(F.col("line").rlike(p), F.struct(module.alias("module"), relative.alias("is_relative"), up.alias("dots")))
        found = (F if found is None else found).when(F.col("language") == lang, one)
    return f.withColumn("i", found).where("i is not null").select("path", "line_no", "i.module", "i.is_relative", "i.dots", "language")


def extract_imports_b(files: DataFrame) -> DataFrame:
    """path, module, language for every match of every pattern in the file."""
    found = None
    for lang, ps in fixed.IMPORTS_B.items():
        every = F.concat(*(F.regexp_extract_all("content", F.lit("(?m)" + p), F.lit(1)) for p in ps))
        found = (F if found is None else found).when(F.col("language") == lang, every)
    return files.select("path", "language", F.explode(found).alias("module")).select("path", "module", "language")


def normalize(path: Column) -> Column:
    """Without `.` parts, and with `..` parts worked off where there is something before them."""

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, part))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _resolved(tries: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """tries(keys..., pos, candidate): the first candidate that is a file."""
    paths = files.select(F.col("path").alias("candidate")).distinct()
    return tries.join(paths, "candidate").groupBy(*keys).agg(F.min_by("candidate", "pos").alias("dst"))


def _candidates(base: Column, table: dict[str, list[str]], clean) -> Column:
    out = None
    for lang, ends in table.items():
        out = (F if out is None else out).when(F.col("language") == lang, F.array(*(clean(F.concat(base, F.lit(e))) for e in ends)))
    return out


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def resolve_p(imports: DataFrame, files: DataFrame, strict: bool = True) -> DataFrame:
    """Edges (src, dst) as a set. Without strict, relative names are normalised, so `..` and several dots resolve too."""
    python, relative = F.col("language") == "python", F.col("is_relative")
    module = F.when(python, F.replace(F.col("module"), F.lit("."), F.lit("/"))).otherwise(F.col("module") if not strict else F.regexp_replace("module", r"^\./", ""))
    above = F.lit("") if strict else F.repeat(F.lit("../"), F.greatest(F.col("dots") - 1, F.lit(0)))
    use = imports.where(python | relative).withColumn("base", F.when(relative, F.concat(_folder(F.col("path")), above, module)).otherwise(module))
    clean = (lambda c: c) if strict else normalize
    tries = use.select("path", "line_no", F.posexplode(_candidates(F.col("base"), fixed.RESOLVE_P, clean)).alias("pos", "candidate"))
    return _resolved(tries, files, ["path", "line_no"]).select(F.col("path").alias("src"), "dst").distinct()


def resolve_b(imports: DataFrame, files: DataFrame, strict: bool = True) -> DataFrame:
    """Edges (src, dst) as a multiset: one for each import that resolves.

    Names with . or / at their start do, as paths. Without strict, Python's names are modules: dots in front are folders up,
    dots within are folders down; with strict none of them resolves, as no file is named so.
    """
    python = (F.col("language") == "python") & F.lit(not strict)
    use = imports.where(F.col("module").rlike(r"^[./]") | python).groupBy("path", "module", "language").agg(F.count("*").alias("n"))
    dots = F.regexp_extract("module", r"^(\.*)", 1)
    names = F.replace(F.substring(F.col("module"), F.length(dots) + 1, F.length("module")), F.lit("."), F.lit("/"))
    up = F.when(F.length(dots) > 0, F.concat(_folder(F.col("path")), F.repeat(F.lit("../"), F.length(dots) - 1))).otherwise(F.lit(""))
    base = F.when(python, F.concat(up, names)).otherwise(F.concat(_folder(F.col("path")), F.col("module")))
    tries = use.select("path", "module", "n", F.posexplode(_candidates(base, fixed.RESOLVE_B, normalize)).alias("pos", "candidate"))
    return _resolved(tries, files, ["path", "module", "n"]).select(F.col("path").alias("src"), "dst", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("src", "dst")


def related(edges: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """path: targets and what is within `depth` edges of them in either direction."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct()
    seen = targets.select("path").distinct()
    for _ in range(depth):
        seen = seen.union(both.join(seen, both.src == seen.path).select(F.col("dst").alias("path"))).distinct()
    return seen


def centrality_p(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """path, centrality: (2 in + out) / (3 nodes), at most 1; edges as a set."""
    e = edges.distinct()
    ends = e.select(F.col("dst").alias("path"), F.lit(2).alias("w")).union(e.select(F.col("src"), F.lit(1))).groupBy("path").agg(F.sum("w").alias("w"))
    n = nodes.agg(F.count("*").alias("_n"))
    score = F.least(F.lit(1.0), F.coalesce("w", F.lit(0)) / (F.col("_n") * 3))
    return nodes.join(ends, "path", "left").crossJoin(F.broadcast(n)).select("path", score.alias("centrality"))


def pagerank_b(nodes: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """path, centrality: synchronous PageRank from 1, no dangling mass, edges as a multiset, by the largest; stored.

    Flow is kept by source and nodes by path for all rounds, so a round has one shuffle, of sums by target."""
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    flow = edges.groupBy("src", "dst").agg(F.count("*").alias("k")).join(out, "src").select(F.col("src").alias("path"), "dst", (F.col("k") / F.col("deg")).alias("share"))
    flow, nodes = written(flow).repartition("path").persist(), written(nodes.select("path").distinct()).repartition("path").persist()
    ranks = nodes.withColumn("score", F.lit(1.0))
    for i in range(rounds):
        got = flow.join(ranks, "path").groupBy(F.col("dst").alias("path")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        ranks = nodes.join(got, "path", "left").select("path", ((1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        if i % 5 == 4 or i == rounds - 1:
            ranks = written(ranks)
    flow.unpersist()
    nodes.unpersist()
    most = ranks.agg(F.max("score")).first()[0] or 1.0
    return ranks.select("path", (F.col("score") / F.lit(float(most))).alias("centrality"))


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, href for every link in a page's HTML."""
    return pages.select("page_id", F.explode(F.regexp_extract_all(F.col(html), F.lit("href=\"([^\"]*)\""), F.lit(1))).alias("href"))

