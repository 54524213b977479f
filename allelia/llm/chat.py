"""Chat formatting of reply trees, in DataFrame functions.

Messages point to the message they reply to. Self-joins that double the distance each round give every message its
ancestors at 1, 2, 4, ... steps and the summed score of its path, so the rounds follow the logarithm of the depth.
The best leaves of each tree are chosen by score, their ancestors are gathered by the same steps, and each path
becomes one conversation. Turns are marked by control strings; those inside texts are escaped reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import let, sums_before
from .common import discard, materialize, stored

BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
#: A backslash goes behind the first character of each of these inside a text; backslashes are doubled before.
CONTROL = r"(<)(/?s>)|(\[)(/?INST\])"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` as trees without branches: each turn replies to the one before it.

    Equal turn numbers follow in order of role and text; a null role or text is empty."""
    rows = turns.select("conv_id", F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return rows.select("conv_id", node.alias("node"), "role", "text").select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``messages(conv_id, node, parent, score, ...)`` → ``(conv_id, branch, leaf, step, node)``: the nodes of the best
    root-to-leaf paths of each conversation, step 0 the leaf.

    Paths rank by the mean score of their messages, then by the greater leaf; a conversation may have several roots.
    A parent that is not there makes a root. Messages on a cycle, or that reply to one, are on no path. A null score
    is 0; nodes must be unique within a conversation."""
    spark = messages.sparkSession
    base = messages.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = base.select("conv_id", F.col("node").alias("parent"), F.lit(True).alias("there"))
    linked = base.join(known, ["conv_id", "parent"], "left").select("conv_id", "node", F.when(F.col("there"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("size"))
    state, path = stored(linked, "replies")
    levels, paths_used = [], [path]
    done = state.where("up is null")
    for _ in range(state.count().bit_length() + 1):  # no path has more messages than there are
        active = state.where("up is not null")
        if active.isEmpty():
            break
        levels.append(active)
        # Only messages whose way up is not at its root yet are joined on; those at a root wait in ``done``.
        far = active.unionByName(done).select("conv_id", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("score").alias("_score"), F.col("size").alias("_size"))
        step = active.join(far, ["conv_id", "up"]).select("conv_id", "node", F.col("_up").alias("up"), (F.col("score") + F.col("_score")).alias("score"), (F.col("size") + F.col("_size")).alias("size"))
        # What is never done is on a cycle, or replies to one.
        state, path = stored(step, "replies")
        paths_used.append(path)
        done = done.unionByName(state.where("up is null"))
    whole = done
    replied = base.where("parent is not null").select("conv_id", F.col("parent").alias("node")).distinct()
    leaves = whole.join(replied, ["conv_id", "node"], "left_anti")
    rank = Window.partitionBy("conv_id").orderBy((F.col("score") / F.col("size")).desc(), F.col("node").desc())
    best = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    on = best.select("conv_id", "branch", F.col("node").alias("leaf"), F.lit(0).cast("long").alias("step"), "node")
    on, on_path = stored(on, "paths")
    for k, level in enumerate(levels):
        hop = on.join(level.select("conv_id", "node", "up"), ["conv_id", "node"])
        grown, grown_path = stored(on.unionByName(hop.select("conv_id", "branch", "leaf", (F.col("step") + (1 << k)).alias("step"), F.col("up").alias("node"))), "paths")
        discard(spark, on_path)
        on, on_path = grown, grown_path
    for p in paths_used:
        discard(spark, p)
    return on


def format_paths(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(conv_id, branch, formatted, loss)``: one text for each chosen path, and the spans that a model learns from, what
    assistants say: (start, end) in code points and (from, to) in bytes of UTF-8."""
    rows = chosen.join(messages.select("conv_id", "node", "role", "text"), ["conv_id", "node"])
    head = F.concat(F.lit(BOS + OPEN), escape(F.col("role")), F.lit(CLOSE))
    turn = F.struct((-F.col("step")).alias("at"), F.concat(head, escape(F.col("text")), F.lit(EOS)).alias("block"), head.alias("head"), (F.col("role") == LEARNED).alias("learned"))
    turns = rows.groupBy("conv_id", "branch").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    chars = lambda x: F.char_length(x).cast("long")
    bytes_ = lambda x: F.octet_length(x).cast("long")

    def spans(ts: Column) -> Column:
        before = lambda size: sums_before(F.transform(ts, lambda t: size(t["block"])))
        learned = F.filter(F.arrays_zip(ts.alias("turn"), before(chars).alias("start"), before(bytes_).alias("from")), lambda x: x["turn"]["learned"])
        ends = lambda x, at, size: ((x[at] + size(x["turn"]["head"])), (x[at] + size(x["turn"]["block"]) - len(EOS)))

        def span(x: Column) -> Column:
            (start, end), (from_, to) = ends(x, "start", chars), ends(x, "from", bytes_)
            return F.struct(start.alias("start"), end.alias("end"), from_.alias("from"), to.alias("to"))

        return F.transform(learned, span)

    return turns.select("conv_id", "branch", F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("formatted"), let(F.col("turns"), spans).alias("loss"))


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``messages(conv_id, node, parent, role, text, score)`` → :func:`format_paths` of the best ``branches`` paths of each conversation."""
    kept = materialize(messages.select("conv_id", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score"), "messages")
    return format_paths(kept, paths(kept, branches))


def read_back(formatted: DataFrame) -> DataFrame:
    """``format_paths`` output → ``(conv_id, branch, turns, learned)``: roles and texts parsed from the text alone, and
    the unescaped texts under the loss spans."""
    blocks = F.filter(F.split("formatted", EOS), lambda b: b != "")
    parse = lambda b: F.struct(
        unescape(F.substring_index(F.substring(b, len(BOS + OPEN) + 1, 1 << 30), CLOSE, 1)).alias("role"),
        unescape(F.substring(b, F.instr(b, CLOSE) + len(CLOSE), F.lit(1 << 30))).alias("text"))
    raw = F.col("formatted").cast("binary")
    under = lambda s: unescape(F.substring(raw, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")).cast("string"))
    return formatted.select("conv_id", "branch", "formatted", let(blocks, lambda bs: F.transform(bs, parse)).alias("turns"), F.transform("loss", under).alias("learned"))


def report(formatted: DataFrame) -> DataFrame:
    """Counts and digests of conversations, read back from their formatted texts."""
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    learned = F.concat_ws("", F.col("learned"))
    return read_back(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text, ...)`` → one formatted text for each conversation.

    Null texts and roles are empty; repeated rows are turns of their own; a null conv_id is one conversation; other
    columns are ignored; an empty table gives an empty result."""
    numbered = linear(turns.withColumn("conv_id", F.struct(F.col("conv_id").alias("id"))))
    return format_trees(numbered).withColumn("conv_id", F.col("conv_id.id"))
