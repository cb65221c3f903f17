"""Chat formatting by quotation linking, in DataFrame functions only.

A line's quote level is the number of '>' at its start (blanks between them don't matter). Successive lines of one level
form a passage; a line that announces a quotation ("... wrote:") right before a deeper passage goes with it. Passages
are normalised (lower case, runs of white space as one blank) and hashed with SHA-256, whole, by paragraph and by line; so
are the messages' own words. A quoted hash is joined to the message that wrote it first among those before the
quoting one: in the same conversation if there is one, else in any. Messages before it are those with a lesser
(conv_id, turn). The parent of a message is the original of its shallowest passage; whole passages count before
paragraphs, these before lines, and of equals the latest original counts. Roots come from pointer doubling on the links.

Result: each message without quotations, with its parent, and (root_conv, root_turn, conv_id, turn) as the order of
reply-ordered conversations: every message follows the one that it answers. The root is the first turn of the
conversation where the chain of a message's links ends, its own if it has no link. Conversations aren't gathered in one row or task, so one of any length is handled.

Passages of fewer than ``min_chars`` characters ("yes") link within their conversation only, longer ones anywhere. Null texts
are empty. Messages with a null conversation or turn are kept, without parent and root. Repeated rows get one result
each and share their links. Texts of any length are parsed whole. Empty tables give empty results; columns but the four named
are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import cut, sent_if_few

MARKS = r"^(?:[ \t]*>)+"
WROTE = r"(?i)\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"


def normal(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def parsed(lines: Column) -> Column:
    """Lines with their quote level and what stands behind the marks."""
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS + " ?", "").alias("body")))


def passages(messages: DataFrame) -> DataFrame:
    """messages with the columns ``own`` (text without quotations) and ``quoted`` (level and text of each passage). Texts
    without a quoted line aren't taken apart."""
    t = F.coalesce("text", F.lit(""))
    rows = messages.withColumn("_some", t.rlike(r"(?m)^[ \t]*>"))
    lines = parsed(F.split(t, r"\r\n|\n|\r"))
    rows = rows.withColumn("_lines", F.when(F.col("_some"), lines))
    announces = lambda x, i: (x["level"] == 0) & x["body"].rlike(WROTE) & (F.coalesce(F.get("_lines", i + 1)["level"], F.lit(0)) > 0)
    own = F.array_join(F.transform(F.filter("_lines", lambda x, i: (x["level"] == 0) & ~announces(x, i)), lambda x: x["body"]), "\n")
    own = F.when(F.col("_some"), own).otherwise(F.when(F.contains(t, F.lit("\r")), F.regexp_replace(t, "\r\n|\r", "\n")).otherwise(t))
    starts = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (i == 0) | (F.get("_lines", i)["level"] != F.get("_lines", i - 1)["level"]))
    rows = rows.withColumns({"own": F.btrim(own, F.lit(" \t\n\v\f\r")), "_starts": F.when(F.col("_some"), starts)})
    passage = lambda s, j: F.struct(F.get("_lines", s)["level"].alias("level"), F.array_join(F.transform(F.slice("_lines", s + 1, F.coalesce(F.get("_starts", j + 1), F.size("_lines")) - s), lambda x: x["body"]), "\n").alias("text"))
    return rows.withColumn("quoted", F.coalesce(F.filter(F.transform("_starts", passage), lambda x: x["level"] > 0), F.array().cast("array<struct<level:int,text:string>>"))).drop("_some", "_lines", "_starts")


def units(text: Column, min_chars: int) -> Column:
    """Hashes of a text whole (0), by paragraph (1) and by line (2), the first kind of equal ones, and whether they are long."""
    of_kind = lambda a, k: F.transform(a, lambda x: F.struct(normal(x).alias("t"), F.lit(k).alias("kind")))
    every = F.concat(of_kind(F.array(text), 0), of_kind(F.split(text, r"\n[ \t]*\n"), 1), of_kind(F.split(text, "\n"), 2))
    every = F.when(F.contains(text, F.lit("\n")), every).otherwise(of_kind(F.array(text), 0))
    return F.transform(F.filter(every, lambda x: x["t"] != ""), lambda x: F.struct(F.unhex(F.sha2(x["t"], 256)).alias("hash"), x["kind"].alias("kind"), (F.length(x["t"]) >= min_chars).alias("long")))


def link(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", min_chars: int = 20, most_rounds: int = 60) -> DataFrame:
    """(conv_id, turn, role, text without quotations, n_quoted, parent_conv, parent_turn, root_conv, root_turn)."""
    rows = conversations.select(*(F.col(a).alias(b) for a, b in ((conv_id, "conv_id"), (turn, "turn"), (role, "role"), (text, "text"))))
    rows = cut(passages(rows))
    known = rows.filter("conv_id is not null and turn is not null")
    me = F.struct("conv_id", "turn")
    quotes = known.filter(F.size("quoted") > 0).select(me.alias("me"), F.explode("quoted").alias("q")).select("me", F.col("q.level").alias("level"), F.explode(units(F.col("q.text"), min_chars)).alias("u"))
    quotes = cut(quotes.select("me", "level", "u.hash", "u.kind", "u.long").groupBy("me", "hash").agg(F.min(F.struct("level", "kind")).alias("how"), F.max("long").alias("long")))
    # only hashes that somebody quotes
    asked = cut(quotes.select("hash").distinct())
    wrote = known.select(me.alias("by"), F.explode(units(F.col("own"), min_chars)).alias("u")).select("by", "u.hash").join(sent_if_few(asked), "hash", "left_semi")
    here = wrote.groupBy("hash", F.col("by.conv_id").alias("conv")).agg(F.min("by").alias("by"))
    first = here.groupBy("hash").agg(F.min("by").alias("any"))
    found = quotes.withColumn("conv", F.col("me.conv_id")).join(here, ["hash", "conv"], "left").join(first, "hash", "left")
    found = found.withColumn("from", F.coalesce(F.when(F.col("by") < F.col("me"), F.col("by")), F.when(F.col("long") & (F.col("any") < F.col("me")), F.col("any")))).filter("from is not null")
    best = F.max_by("from", F.struct(-F.col("how.level"), -F.col("how.kind"), "from"))
    parents = cut(found.groupBy("me").agg(best.alias("parent"), F.count("*").alias("n")))
    # each round doubles how far along its chain of links a message sees
    starts = known.groupBy("conv_id").agg(F.min("turn").alias("start"))
    up = parents.select("me", F.col("parent").alias("top"))
    for _ in range(most_rounds):
        far = up.select(F.col("me").alias("top"), F.col("top").alias("further"))
        new = cut(up.join(far, "top", "left").select("me", F.coalesce("further", "top").alias("top"), F.col("further").isNotNull().alias("moved")))
        up = new.select("me", "top")
        if new.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"links didn't settle in {most_rounds} rounds")
    linked = cut(parents.join(up, "me").select(F.col("me.conv_id").alias("_c"), F.col("me.turn").alias("_t"), "parent", "top", "n"))
    out = rows.join(sent_if_few(linked), (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    out = out.withColumn("_conv", F.coalesce("top.conv_id", F.col("conv_id"))).join(starts.select(F.col("conv_id").alias("_conv"), "start"), "_conv", "left")
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    return out.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.size("quoted").cast("long").alias("n_quoted"),
        F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"),
        F.when(whole, F.col("_conv")).alias("root_conv"), F.when(whole, F.col("start")).alias("root_turn"),
    )


def ordered(linked: DataFrame) -> DataFrame:
    """Rows of :func:`link` in range partitions, each in reply order."""
    key = ["root_conv", "root_turn", "conv_id", "turn"]
    return linked.repartitionByRange(*key).sortWithinPartitions(*key)
