"""Reply trees formatted as conversations (DataFrame functions only).

Paths from leaf to root come from self-joins that double the reach each time, so a tree of depth d takes log2(d)
joins. Branches are ranked by the mean score of their messages. Each kept path becomes one text: per turn
`<|im_start|>role LF text <|im_end|> LF`. Within texts each `<`, backslashes, `|` gets one more backslash, so a
text can't hold a control string and the step is undone exactly; roles are URL-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def leaf_paths(messages: DataFrame) -> DataFrame:
    """messages(tree, id, parent): (tree, leaf, node, up) for every message of each root-to-leaf path; up counts from the leaf.

    A parent that is null or not in the tree makes a root. Paths that run into a cycle have no root and are left out.
    """
    nodes = cut(messages.select("tree", "id", "parent").distinct())
    parents = nodes.select(F.col("tree").alias("t"), F.col("id").alias("p")).distinct()
    linked = nodes.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p"))).select("tree", "id", F.col("p").alias("to"))
    up = cut(linked.where("id <> to"))
    has_child = up.select(F.col("tree").alias("t"), F.col("to").alias("p")).distinct()
    leaves = nodes.join(has_child, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("p")), "left_anti").select("tree", "id").distinct()
    paths = leaves.select("tree", F.col("id").alias("leaf"), F.col("id").alias("node"), F.lit(0).cast("long").alias("up"))
    roots = nodes.join(up.select(F.col("tree").alias("t"), F.col("id").alias("i")), F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")), "left_anti").select(F.col("tree").alias("rt"), F.col("id").alias("root"))
    reach, most, left = 1, nodes.count(), up.count()
    while left and reach <= most:
        hop = up.select(F.col("tree").alias("t"), F.col("id").alias("i"), "to")
        on = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("i"))
        paths = cut(paths.union(paths.join(hop, on).select("tree", "leaf", F.col("to").alias("node"), F.col("up") + reach)))
        far = up.withColumnRenamed("to", "via").join(hop, F.col("tree").eqNullSafe(F.col("t")) & (F.col("via") == F.col("i")))
        up = cut(far.select("tree", "id", "to"))
        reach, left = reach * 2, up.count()
    whole = paths.join(roots, F.col("tree").eqNullSafe(F.col("rt")) & (F.col("node") == F.col("root")), "left_semi").select(F.col("tree").alias("t"), F.col("leaf").alias("l"))
    return paths.join(whole, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l"))).select("tree", "leaf", "node", "up")


def format_trees(messages: DataFrame, branches: int | None = 1, learn: str = "assistant") -> DataFrame:
    """messages(tree, id, parent, role, text, score): one row for each kept branch, with
    tree, leaf, branch (rank from 1 by mean score, then leaf), score, formatted and loss (spans of the texts of role
    `learn` in `formatted`: start from 0, length, in code points).

    A null text or role counts as empty, a null score as 0. (tree, id) is a key. An empty table gives no rows.
    """
    m = messages.select(F.col("tree").alias("mt"), F.col("id").alias("mi"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    at = leaf_paths(messages).join(m, F.col("tree").eqNullSafe(F.col("mt")) & (F.col("node") == F.col("mi")))
    if branches is not None:
        ranked = at.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"))
        ranked = ranked.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf"))).where(F.col("branch") <= branches)
        ranked = ranked.select(F.col("tree").alias("bt"), F.col("leaf").alias("bl"), "branch")
        at = at.join(ranked, F.col("tree").eqNullSafe(F.col("bt")) & (F.col("leaf") == F.col("bl")))
    else:
        at = at.withColumn("branch", F.lit(None).cast("int"))
    head = F.concat(F.lit(START), F.expr("url_encode(role)"), F.lit("\n"))
    at = at.withColumn("head", head).withColumn("body", escape(F.col("text")))
    at = at.withColumn("turn", F.concat("head", "body", F.lit(f"{END}\n")))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("from", F.coalesce(F.sum(F.length("turn").cast("long")).over(before), F.lit(0)) + F.length("head"))
    row = F.struct((-F.col("up")).alias("o"), "turn", (F.col("role") == learn).alias("learn"), F.col("from").alias("start"), F.length("body").cast("long").alias("length"))
    out = at.groupBy("tree", "leaf", "branch").agg(F.avg("score").alias("score"), F.array_sort(F.collect_list(row)).alias("rows"))
    loss = F.transform(F.filter("rows", lambda r: r["learn"]), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length")))
    return out.select("tree", "leaf", "branch", "score", F.concat_ws("", F.transform("rows", lambda r: r["turn"])).alias("formatted"), loss.alias("loss"))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - F.lit(len(END) + 1))
        return F.struct(F.url_decode(role).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), turn)


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.concat_ws("", F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))


def chains(rows: DataFrame, tree: str, turn: str) -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it by turn (ties by role, then text).

    Rows are sorted by ranges and numbered through, so a conversation of many rows is numbered by several tasks.
    """
    order = [F.col(c).asc_nulls_first() for c in ("tree", "turn", "role", "text")]
    sorted_rows = rows.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), "role", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    # the upper bits of the number are the range
    placed = cut(sorted_rows.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part"), "tree").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    # rows of the tree in the ranges before; a tree has a row for each range that it reaches into
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("tree").alias("t"), F.col("part").alias("p"), "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = placed.join(sizes, F.col("tree").eqNullSafe(F.col("t")) & (part == F.col("p")))
    numbered = numbered.select("tree", (F.col("at") - F.col("low") + F.col("before") + 1).alias("id"), "role", "text")
    return numbered.withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)).withColumn("score", F.lit(0.0))
