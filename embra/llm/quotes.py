"""Chat formatting by quotation linking.

Messages are split into lines with their quote level (">", ">>", "> >").  A
quoted line is normalised (white space, case) and hashed; the message that
first wrote a line with that hash, within the same scope, is its origin.  A
message replies to the message that most of its quoted text at the lowest
linked level comes from.  Replies are followed to their roots by pointer
doubling, and every message gets its place in a conversation in which no
message stands before the one it answers.  Quotes and attribution lines are
left out of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import dense_index
from .common import null_key, stage

# fixed patterns: quote marks before a line; the line that announces a quotation
MARKS = r"^(?:[ \t]?>)+"
ATTRIBUTION = r"^(?:On .* wrote|.* (?:wrote|schrieb|a écrit|escribió)) ?:\s*$"
LINE_ENDS = r"\r\n|\r|\n"


def quoted_lines(text: Column) -> Column:
    """Array of ``(level, body)``: every line of a text without its quote marks."""
    return F.transform(F.split(text, LINE_ENDS), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"),
        F.regexp_replace(x, MARKS + " ?", "").alias("body")))


def own_text(lines: Column) -> Column:
    """The unquoted lines, joined again; a line that announces the quotation below it
    goes, and so do empty lines at both ends."""
    following = F.concat(F.slice(lines, F.lit(2), F.size(lines)), F.array(F.struct(F.lit(0).alias("level"),
                                                                        F.lit("").alias("body"))))
    pairs = F.filter(F.arrays_zip(lines.alias("line"), following.alias("next")),
                     lambda p: (p["line"]["level"] == 0)
                     & ~((p["next"]["level"] > 0) & p["line"]["body"].rlike(ATTRIBUTION)))
    body = F.array_join(F.transform(pairs, lambda p: p["line"]["body"]), "\n")
    return F.regexp_replace(F.regexp_replace(body, r"^\s*\n", ""), r"\s+$", "")


def passage_key(body: Column) -> Column:
    """128-bit hash of a normalised line; null for lines without text."""
    clean = F.lower(F.trim(F.regexp_replace(body, r"\s+", " ")))
    return F.when(clean != "", F.md5(clean))


def link_quotes(messages: DataFrame, *, scope: str = "conv_id", order: str = "turn",
                text: str = "text") -> DataFrame:
    """``messages`` -> one row per message (scope, order): ``reply_to`` and ``thread`` (orders
    of the answered and of the first message), ``depth``, ``position`` in the thread,
    ``quote_levels`` (deepest), ``n_quoted`` and ``n_linked`` (quoted lines, and those with
    an origin) and ``own`` (the text without quotes).

    Defined cases: rows that share scope and order are one message with the smallest
    text (null before any other); a null scope is a scope of its own; messages with a
    null order are left out, as they have no place; a null text is empty; a message
    can only answer an earlier one, lines nobody wrote before are quotes without an
    origin; of equally quoted messages the earliest is answered; an empty table gives
    an empty result.  Other columns are not read.
    """
    m = messages.select(F.col(f"`{scope}`").alias("scope"), F.col(f"`{order}`").alias("at"),
                        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")) \
        .filter("at is not null").groupBy("scope", "at").agg(F.min("text").alias("text"))
    m = m.withColumn("sk", null_key(F.col("scope"))).withColumn("lines", quoted_lines(F.col("text")))
    m = stage(m.select("scope", "sk", "at", "lines"), "messages")

    line = m.select("sk", "at", F.explode("lines").alias("line")).select(
        "sk", "at", F.col("line.level").alias("level"), passage_key(F.col("line.body")).alias("hash"),
        F.length("line.body").alias("size")).filter("hash is not null")
    # one origin per (scope, hash): a line that everybody writes is one row here
    origin = line.filter("level = 0").groupBy("sk", "hash").agg(F.min("at").alias("origin"))
    quoted = line.filter("level > 0").join(origin, ["sk", "hash"], "left").withColumn(
        "origin", F.when(F.col("origin") < F.col("at"), F.col("origin")))
    counts = quoted.groupBy("sk", "at").agg(F.max("level").alias("quote_levels"), F.count(F.lit(1)).alias("n_quoted"),
                                            F.count("origin").alias("n_linked"))
    best = quoted.filter("origin is not null").groupBy("sk", "at", "level", "origin").agg(
        F.sum("size").alias("size")).groupBy("sk", "at").agg(F.min(F.struct(
            F.col("level"), (-F.col("size")).alias("less"), F.col("origin"))).alias("b"))
    links = counts.join(best, ["sk", "at"], "left").select(
        "sk", "at", "quote_levels", "n_quoted", "n_linked", F.col("b.origin").alias("reply_to"))
    out = stage(m.join(links, ["sk", "at"], "left").select(
        "scope", "sk", "at", "reply_to", F.coalesce("quote_levels", F.lit(0)).alias("quote_levels"),
        F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        own_text(F.col("lines")).alias("own")), "linked")
    roots = reply_roots(out.select("sk", "at", "reply_to"))
    placed = _positions(roots)
    return out.join(placed, ["sk", "at"]).select(
        F.col("scope"), F.col("at").alias("order"), "reply_to", "thread", "depth", "position",
        "quote_levels", "n_quoted", "n_linked", "own")


def reply_roots(replies: DataFrame) -> DataFrame:
    """``(sk, at, reply_to)`` -> ``(sk, at, thread, depth)``.  Every round doubles the distance
    that a message has looked up, so the rounds grow with the logarithm of the longest
    chain; a message that has found its root takes no part in later rounds.  Links
    lead to earlier messages only, so there is no circle."""
    # up: the farthest message known above this one; found: that one is a root
    known = stage(replies.select("sk", "at", F.coalesce("reply_to", "at").alias("up"),
                                 F.col("reply_to").isNotNull().cast("long").alias("depth"),
                                 F.col("reply_to").isNull().alias("found")), "replies")
    while True:
        open_ = known.filter("not found")
        if open_.isEmpty():
            return known.select("sk", "at", F.col("up").alias("thread"), "depth")
        top = known.select("sk", F.col("at").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"),
                           F.col("found").alias("ends"))
        moved = open_.drop("found").join(top, ["sk", "up"]).select(
            "sk", "at", F.col("far").alias("up"), (F.col("depth") + F.col("more")).alias("depth"),
            F.col("ends").alias("found"))
        known = stage(known.filter("found").unionByName(moved), "replies")


def _positions(roots: DataFrame) -> DataFrame:
    """0-based place in the thread by depth, then order.  A thread may hold any number of
    messages, so places are counted over range partitions, not in a window."""
    i = stage(dense_index(roots, [F.col("sk"), F.col("thread"), F.col("depth"), F.col("at")], "i"), "places")
    first = i.groupBy("sk", "thread").agg(F.min("i").alias("first"))
    return i.join(first, ["sk", "thread"]).select(
        "sk", "at", "thread", "depth", (F.col("i") - F.col("first")).alias("position"))


def as_quoted_mail(turns: DataFrame, *, scope: str = "conv_id", order: str = "turn",
                   text: str = "text", levels: int = 2) -> DataFrame:
    """Turns of chats as mails that quote what they answer: every message repeats the
    ``levels`` turns before it, marked with one ">" a level, above its own text."""
    t = turns.select(F.col(scope).alias("scope"), F.col(order).alias("at"),
                     F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .groupBy("scope", "at").agg(F.min("text").alias("text"))
    out = t.withColumn("head", F.lit(""))
    for k in range(1, levels + 1):
        mark = "> " * k
        earlier = t.select("scope", (F.col("at") + k).alias("at"), F.concat(
            F.lit(mark), F.regexp_replace("text", LINE_ENDS, "\n" + mark), F.lit("\n")).alias("q"))
        out = out.join(earlier, ["scope", "at"], "left").withColumn(
            "head", F.concat(F.coalesce("q", F.lit("")), "head")).drop("q")
    return out.select(F.col("scope").alias(scope), F.col("at").alias(order),
                      F.concat("head", "text").alias(text))
