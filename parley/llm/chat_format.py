"""Reply trees to training conversations, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.llm.common import cut, table

# Fixed values of the template: each conversation is <s> and its turns; each turn is
# [INST]role[/INST]text</s>. ESC is put into control strings that occur in texts.
BOS, EOS, OPEN, CLOSE, ESC = "<s>", "</s>", "[INST]", "[/INST]", "␛"
CONTROL = r"(/?s>|/?INST\]|</?SYS>>)"


def escape(c: Column) -> Column:
    """Puts one ESC after the first character of each control string, ones that hold ESC already included."""
    return F.regexp_replace(c, rf"([<\[])({ESC}*){CONTROL}", f"$1{ESC}$2$3")


def unescape(c: Column) -> Column:
    """The inverse of escape."""
    return F.regexp_replace(c, rf"([<\[]){ESC}({ESC}*){CONTROL}", "$1$2$3")


def branches(nodes: DataFrame) -> DataFrame:
    """All root-to-leaf paths of reply trees: (tree, leaf, node, depth), depth 0 at the root.

    nodes: tree, node (unique in its tree), parent (null, or not in the tree: a root). Self-joins
    double the step each round: a path of n nodes takes log2(n) rounds. A branch that runs into
    a cycle has no root and gives no path. Rows without tree or node are left out.
    """
    own = nodes.select("tree", "node", "parent").where("tree is not null and node is not null")
    known = own.select("tree", F.col("node").alias("parent"), F.col("node").alias("up"))
    jump = cut(own.join(known, ["tree", "parent"], "left").select("tree", "node", "up"))
    roots = jump.where("up is null").select("tree", "node")
    inner = jump.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    size = own.groupBy("tree").agg(F.count("*").alias("n"))
    path = jump.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    step, jump = 1, jump.where("up is not null")
    while True:
        jump = cut(jump.join(size, "tree").where(F.col("n") > step).drop("n"))
        if jump.isEmpty():
            break
        more = path.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("back") + step).alias("back"))
        path = cut(path.union(more))
        on = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
        jump, step = jump.join(on, ["tree", "up"]).select("tree", "node", F.col("next").alias("up")), 2 * step
    top = path.join(roots, ["tree", "node"]).select("tree", "leaf", F.col("back").alias("deep"))
    return path.join(top, ["tree", "leaf"]).select("tree", "leaf", "node", (F.col("deep") - F.col("back")).alias("depth"))


def format_conversations(nodes: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """One formatted conversation for each chosen branch.

    nodes: tree, node, parent, role, text, score; other columns are ignored. Branches of a tree are
    ranked by the mean score of their nodes (null counts as 0), ties by leaf; per_tree
    takes the best so many, None all. Returns tree, leaf, branch_rank, n_turns, formatted,
    and loss: the spans (start, length in code points of formatted) of assistant texts, in order.
    Null role or text counts as empty. An empty table gives no rows.
    """
    nodes = nodes.select("tree", "node", "parent", "role", "text", "score")
    path = branches(nodes).join(nodes.drop("parent"), ["tree", "node"])
    turn = F.struct(
        "depth",
        F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("mask"),
        F.concat(F.lit(OPEN), escape(F.coalesce("role", F.lit(""))), F.lit(CLOSE)).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
    )
    whole = path.groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("branch_score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    if per_tree is not None:
        best = W.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
        whole = whole.withColumn("branch_rank", F.row_number().over(best)).where(F.col("branch_rank") <= per_tree)
    else:
        whole = whole.withColumn("branch_rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")))
    made = F.concat(F.lit(BOS), F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(EOS))), ""))
    # running position of each turn, then the spans of those under the mask
    long = lambda x: F.lit(x).cast("long")
    empty = F.array().cast("array<struct<start:bigint,length:bigint>>")
    at = F.aggregate(
        "turns",
        F.struct(long(len(BOS)).alias("at"), empty.alias("spans")),
        lambda acc, t: F.struct(
            (acc.at + F.length(t.head) + F.length(t.body) + len(EOS)).cast("long").alias("at"),
            F.when(t.mask, F.concat(acc.spans, F.array(F.struct((acc.at + F.length(t.head)).cast("long").alias("start"), F.length(t.body).cast("long").alias("length"))))).otherwise(acc.spans).alias("spans"),
        ),
    )
    return whole.select("tree", "leaf", "branch_rank", F.size("turns").cast("long").alias("n_turns"), made.alias("formatted"), at.spans.alias("loss"))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """Reads formatted back: adds turns, an array of (role, text), and loss_text, the text under the mask."""
    piece = F.slice(F.split(F.substring("formatted", len(BOS) + 1, 2147483647), EOS, -1), 1, F.col("n_turns").cast("int"))
    turns = F.transform(
        piece,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 2147483647), CLOSE, 1)).alias("role"),
            unescape(F.substring_index(p, CLOSE, -1)).alias("text"),
        ),
    )
    under = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int")))), "")
    return formatted.withColumns({"turns": turns, "loss_text": under})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all conversations, each a tree of one branch (a turn answers the turn before it), and conversation -1."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), odd.alias("text"))
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    nodes = rows.unionByName(extra).where("conv_id is not null").withColumnRenamed("conv_id", "tree").withColumn("node", F.row_number().over(order).cast("long"))
    nodes = nodes.select("tree", "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    back = parse_conversations(format_conversations(nodes))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = rf"regexp_replace(coalesce({{}}, ''), '([<\[])({ESC}*){CONTROL}', '\1{ESC}\2\3', 'g')"
SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(17 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
