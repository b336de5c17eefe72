"""Operator 5 (native): quotation linking of messages into reply-ordered conversations.

A line's quote level is the number of leading ``>`` marks. Runs of lines of one level are passages; their lines are
normalised (blanks collapsed, trimmed, lower case; empty ones left out). A passage is joined by hash to the equal runs of
unmarked lines in earlier messages of the conversation; the earliest message that has it is its original. Of a passage
that no message has as a whole, all runs of 1, 2, 4, ... lines are joined; the longest found (then the one of the latest
message) names its original. A message replies to the original of its last linked passage of level 1; following replies
upwards by doubling gives its thread (root) and depth. ``(conv_id, root_turn, turn)`` is the reply order: parents stand
before their replies, threads together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

MARK = r"^((?:[ \t]*>)+)[ \t]?"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARK, 1), r"[^>]", ""))


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds lines: (level, content, s = normalised content) per line of the text, and starts: where passages begin."""
    lines = F.split(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "\r\n", "\n"), "\n")
    out = messages.withColumn("lines", F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARK, "").alias("content"))))
    out = out.withColumn("lines", F.transform("lines", lambda x: F.struct(x["level"].alias("level"), x["content"].alias("content"), normal(x["content"]).alias("s"))))
    return out.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (F.get("lines", i)["level"] != F.get("lines", i - 1)["level"])))


def hashes(lines: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of each line that is not empty."""
    full = F.filter(lines, lambda x: x["s"] != "")
    return F.transform(full, lambda x: F.xxhash64(x["s"])), F.transform(full, lambda x: F.xxhash64(F.lit(1), x["s"]))


def run_key(a: str, b: str, at: Column, size: Column) -> list[Column]:
    """128-bit key of the run of ``size`` lines that starts with the ``at``-th (from 1)."""
    return [F.xxhash64(F.slice(a, at, size)).alias("key_a"), F.xxhash64(F.lit(1), F.slice(b, at, size)).alias("key_b")]


def runs(rows: DataFrame, a: str, b: str, *keep: str) -> DataFrame:
    """All runs of ``size`` lines (column ``size``) of the hashed lines: keep..., size, at, key_a, key_b."""
    rows = rows.where(F.col("size") <= F.size(a)).select(*keep, "size", a, b, F.explode(F.sequence(F.lit(1), F.size(a) - F.col("size") + 1)).alias("at"))
    return rows.select(*keep, "size", "at", *run_key(a, b, F.col("at"), F.col("size")))


RUN = ["conv_id", "size", "key_a", "key_b"]


def originals(base: DataFrame, asked: DataFrame) -> DataFrame:
    """conv_id, size, key_a, key_b, first: the earliest turn with each run of unmarked lines of the sizes asked for."""
    sizes = asked.groupBy("conv_id").agg(F.collect_set("size").alias("sizes"))  # at most as many as a message has lines
    rows = base.select("conv_id", "turn", "own_a", "own_b").join(sizes, "conv_id").select("conv_id", "turn", "own_a", "own_b", F.explode("sizes").alias("size"))
    return runs(rows, "own_a", "own_b", "conv_id", "turn").groupBy(*RUN).agg(F.min("turn").alias("first"))


def own_text(lines: Column) -> Column:
    return F.trim(F.regexp_replace(F.array_join(F.filter(lines, lambda x: x["level"] == 0)["content"], "\n"), r"\n{3,}", "\n\n"))


def quote_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, root_turn, depth, n_quoted, n_linked, text (without quotes).

    n_quoted: lines with a mark (blank ones not counted); n_linked: those whose original was found in an earlier turn.
    Null texts are empty messages; messages without quotes reply to nothing (their own root, depth 0). A null conv_id or
    turn links with nothing. Rows that repeat (conv_id, turn) are all kept and reply alike by their own quotes; what
    others quote from them is the same turn. An empty table gives no rows; other columns are not looked at.
    """
    base = parsed(messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text"))
    own_a, own_b = hashes(F.filter("lines", lambda x: x["level"] == 0))
    body = lambda st, k: F.slice("lines", st + 1, F.coalesce(F.get("starts", k + 1), F.size("lines")) - st)
    passages = F.transform("starts", lambda st, k: F.struct(st.alias("p"), F.get("lines", st)["level"].alias("level"),
                                                           *(h.alias(n) for n, h in zip("ab", hashes(body(st, k))))))
    passages = F.filter(passages, lambda x: (x["level"] > 0) & (F.size(x["a"]) > 0))
    base = C.stage(base.select("conv_id", "turn", "role", F.xxhash64("text", "role").alias("row"), own_text(F.col("lines")).alias("text"),
                               own_a.alias("own_a"), own_b.alias("own_b"), passages.alias("passages")), "messages")
    message = ["conv_id", "turn", "row"]
    known = base.where("conv_id is not null and turn is not null")
    quoted = (known.select(*message, F.explode("passages").alias("x")).select(*message, "x.*")
              .select(*message, "p", "level", "a", "b", F.size("a").alias("size"), *run_key("a", "b", F.lit(1), F.size("a"))))
    earlier = F.when(F.col("first") < F.col("turn"), F.col("first"))
    quoted = C.stage(quoted.join(originals(known, quoted), RUN, "left")
                     .select(*message, "p", "level", "size", earlier.alias("original"), *(F.when(earlier.isNull(), F.col(x)).alias(x) for x in "ab")), "quoted")
    rest = quoted.where("original is null")
    whole = quoted.where("original is not null").select(*message, "p", "level", "size", F.col("size").alias("linked"), "original")
    if rest.isEmpty():
        linked = whole
    else:
        pieces = rest.select(*message, "p", "a", "b", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int")),
                                                                       lambda x: x <= F.size("a"))).alias("size"))
        pieces = runs(pieces, "a", "b", *message, "p")
        pieces = pieces.join(originals(known, pieces), RUN).where("first < turn")
        found = (pieces.select(*message, "p", "size", "first", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("line"))
                 .groupBy(*message, "p").agg(F.count_distinct("line").cast("int").alias("linked"), F.max(F.struct("size", "first"))["first"].alias("original")))
        linked = whole.unionByName(rest.select(*message, "p", "level", "size").distinct().join(found, [*message, "p"], "left")
                                   .select(*message, "p", "level", "size", F.coalesce("linked", F.lit(0)).alias("linked"), "original"))
    add = lambda name: F.aggregate("all", F.lit(0), lambda s, x: s + x[name])
    per = linked.groupBy(*message).agg(F.collect_set(F.struct("p", "size", "linked")).alias("all"),  # rows may repeat
                                       F.max(F.when((F.col("level") == 1) & F.col("original").isNotNull(), F.struct("p", "original")))["original"].alias("reply_to"))
    per = per.select(*message, "reply_to", add("size").alias("n_quoted"), add("linked").alias("n_linked"))
    per = C.stage(per, "replies")
    ups = per.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("up")).where("up is not null")
    live = C.stage(ups.select("conv_id", "turn", "up", F.lit(1).cast("long").alias("steps")), "ups")
    for _ in range(64):  # doubling: a chain of n replies needs log2(n) rounds
        over = live.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        live = C.stage(live.join(over, ["conv_id", "up"], "left").select(
            "conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.col("next").isNotNull().alias("moved")), "ups")
        if live.where("moved").isEmpty():
            break
        live = live.drop("moved")
    out = base.select("conv_id", "turn", "role", "row", "text").join(per, ["conv_id", "turn", "row"], "left")
    out = out.join(live.select("conv_id", "turn", F.col("up").alias("root"), "steps"), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "reply_to", F.coalesce("root", "turn").alias("root_turn"),
                      F.coalesce("steps", F.lit(0)).cast("long").alias("depth"), F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
                      F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "text")


def as_mail(conversations: DataFrame) -> DataFrame:
    """The conversations as mail: each turn quotes the turn before (level 1) and the first line before that (level 2)."""
    base = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    first = F.element_at(F.split("text", "\n"), 1)
    one = base.select("conv_id", (F.col("turn") + 1).alias("turn"), F.concat(F.lit("> "), F.regexp_replace("text", "\n", "\n> ")).alias("q1"))
    two = base.select("conv_id", (F.col("turn") + 2).alias("turn"), F.concat(F.lit(">> "), first).alias("q2"))
    mail = base.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
    return mail.select("conv_id", "turn", "role", F.concat_ws("\n", "q2", "q1", "text").alias("text"))
