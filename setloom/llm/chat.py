"""Chat formatting of reply trees.

Messages name their parent; iterative self-joins double each message's pointer to an
ancestor, so all root-to-leaf paths are listed after as many rounds as the depth has binary
digits. Branches of a tree are ranked by the summed score of their messages, and each chosen
path becomes one conversation: turns in markers, control strings inside texts escaped
reversibly, and the spans of the assistant's texts as the loss mask.

Defined results: a null text is empty; a null role is the empty role; a message whose parent
is missing or null is a root; messages on or below a cycle have no root and go; of messages
that repeat a key all stay and count as siblings of one parent only if their keys differ, so
keys should be unique within a tree (`linear_replies` numbers turns to make them so); an
empty table gives an empty table. One path is one string: its length is bounded by what a
string can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

# Template (fixed values). No control string can occur inside an escaped text.
OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
OPEN_OTHER, SAYS_OTHER, CLOSE_OTHER = "[ROLE]", "[SAYS]", "[/ROLE]"  # any other role stands before what it says
CONTROL = [*OPEN.values(), *CLOSE.values(), OPEN_OTHER, SAYS_OTHER, CLOSE_OTHER]


def escape(text: Column) -> Column:
    """Backslashes are doubled, and one goes behind the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_replies(messages: DataFrame, tree_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Plain conversations as reply trees: each turn answers the one before it.

    Columns tree, node, parent, role, text, score. Turns that repeat a number follow each
    other by role and text, null turns come first.
    """
    turns = Window.partitionBy(tree_col).orderBy(F.col(order_col).asc_nulls_first(), F.col(role_col).asc_nulls_first(), F.col(text_col).asc_nulls_first())
    node = F.row_number().over(turns).cast("long")
    return messages.select(F.col(tree_col).alias("tree"), node.alias("node"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def leaf_paths(messages: DataFrame) -> DataFrame:
    """Rows (tree, leaf, node, steps): each message on the path from a leaf up to its root, with its distance from the leaf."""
    base = stored(messages.select("tree", "node", "parent"), "replies")
    ids = base.select("tree", "node")
    up = base.join(ids.select(F.col("tree").alias("t"), F.col("node").alias("p")), F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")), "left").select("tree", "node", F.col("p").alias("up"))
    leaves = ids.join(base.select(F.col("tree").alias("t"), F.col("parent").alias("p")), F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    # Pointers to the ancestor 2^k steps up, until none is left or only cycles could have one.
    most = base.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    pointers = [stored(up.filter(F.col("up").isNotNull()), "ancestors")]
    while 2 ** (len(pointers) - 1) < most and not pointers[-1].isEmpty():
        a, b = pointers[-1].alias("a"), pointers[-1].alias("b")
        doubled = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.node"))).select("a.tree", "a.node", "b.up")
        pointers.append(stored(doubled, "ancestors"))
    endless = pointers[-1].select("tree", "node").distinct()
    paths = leaves.join(endless, (leaves["tree"].eqNullSafe(endless["tree"])) & (leaves["node"] == endless["node"]), "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("steps"))
    for k in reversed(range(len(pointers) - 1)):
        p = pointers[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        further = paths.join(p, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", F.col("up").alias("node"), (F.col("steps") + 2**k).alias("steps"))
        paths = stored(paths.unionByName(further), "paths")
    return paths


def _chosen_paths(steps: DataFrame, rows: DataFrame, branches: int | None) -> DataFrame:
    """The steps (tree, leaf, node, steps) of the chosen paths, with branch and path_score; ranked on identifiers, texts follow later."""
    scores = rows.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score")
    scored = steps.join(scores, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).groupBy("tree", "leaf").agg(F.sum("score").alias("path_score"))
    if branches == 1:
        best = F.struct(F.col("path_score"), -F.col("leaf"))
        scored = scored.groupBy("tree").agg(F.max_by(F.struct("leaf", "path_score"), best).alias("p")).select("tree", "p.*").withColumn("branch", F.lit(1))
    elif branches is not None:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), F.asc("leaf")))
        scored = scored.withColumn("branch", rank).filter(F.col("branch") <= branches)
    else:
        scored = scored.withColumn("branch", F.lit(None).cast("int"))
    scored = stored(scored.select(F.col("tree").alias("t"), F.col("leaf").alias("l"), "branch", "path_score"), "branches")
    return steps.join(scored, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l"))).select("tree", "leaf", "node", "steps", "branch", "path_score")


def format_replies(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """One row for each chosen path: tree, leaf, branch (rank), path_score, formatted, loss_spans.

    `branches` is how many best paths of each tree become conversations (None: all).
    `loss_spans` are the half-open ranges of `formatted`, in code points, that the
    assistant's texts take.
    """
    rows = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), text_of("text").alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"), "parent")
    steps = leaf_paths(rows)
    chosen = _chosen_paths(steps, rows, branches)
    m = rows.alias("m")
    on_path = chosen.alias("s").join(m, F.col("s.tree").eqNullSafe(F.col("m.tree")) & (F.col("s.node") == F.col("m.node")))
    role, text = F.col("m.role"), escape(F.col("m.text"))
    before, after = F.concat(F.lit(OPEN_OTHER), escape(role), F.lit(SAYS_OTHER)), F.lit(CLOSE_OTHER)
    for name in OPEN:
        before, after = F.when(role == name, F.lit(OPEN[name])).otherwise(before), F.when(role == name, F.lit(CLOSE[name])).otherwise(after)
    turns = on_path.select("s.tree", "s.leaf", "s.branch", "s.path_score", (-F.col("s.steps")).alias("at"), before.alias("before"), text.alias("text"), after.alias("after"), (role == "assistant").alias("loss"))
    paths = turns.groupBy("tree", "leaf", "branch", "path_score").agg(F.sort_array(F.collect_list(F.struct("at", "before", "text", "after", "loss"))).alias("turns"))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def grow(a: Column, t: Column) -> Column:
        first = a["n"] + F.length(t["before"])
        last = first + F.length(t["text"])
        span = F.array(F.struct(first.alias("start"), last.alias("end")))
        return F.struct((last + F.length(t["after"])).alias("n"), F.when(t["loss"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["before"], t["text"], t["after"])), "")
    return paths.select("tree", "leaf", "branch", "path_score", formatted.alias("formatted"), F.aggregate("turns", start, grow)["spans"].alias("loss_spans"))


def parse_formatted(formatted: Column) -> Column:
    """The turns that a formatted conversation holds: array of (role, text), unescaped."""
    ends = "|".join(f"\\Q{c}\\E" for c in [*CLOSE.values(), CLOSE_OTHER])
    pieces = F.filter(F.split(formatted, f"(?<={ends})"), lambda x: F.length(x) > 0)

    def turn(p: Column) -> Column:
        def inner(a: str, b: str) -> Column:
            return F.substring(p, F.lit(len(a) + 1), F.length(p) - len(a) - len(b))

        other = inner(OPEN_OTHER, CLOSE_OTHER)
        role, text = F.substring_index(other, SAYS_OTHER, 1), F.substring(other, F.instr(other, SAYS_OTHER) + len(SAYS_OTHER), F.length(other))
        for name in OPEN:
            here = F.startswith(p, F.lit(OPEN[name]))
            role, text = F.when(here, F.lit(name)).otherwise(role), F.when(here, inner(OPEN[name], CLOSE[name])).otherwise(text)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def conversation_digest(messages: DataFrame) -> DataFrame:
    """Format plain conversations and read back each: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    made = format_replies(linear_replies(messages), branches=1)
    read = made.select(F.col("tree").alias("conv_id"), parse_formatted(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def _sql_escape(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


#: DuckDB twin of conversation_digest over `conversations` and the extra conversation -1.
ORACLE_SQL = f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
marks AS (SELECT *, CASE role {" ".join(f"WHEN '{r}' THEN {len(OPEN[r] + CLOSE[r])}" for r in OPEN)}
  ELSE {len(OPEN_OTHER + SAYS_OTHER + CLOSE_OTHER)} + length({_sql_escape("role")}) END AS marks FROM m),
t AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length({_sql_escape("text")}) + marks)::BIGINT AS formatted_chars FROM marks GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM t
"""
