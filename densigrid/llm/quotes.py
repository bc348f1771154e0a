"""Conversations without quotes, by quotation linking, in DataFrame operations alone.

A line's quote level is the number of ``>`` at its start (blanks between them and up to three before them allowed).
Neighbouring lines of one level are a passage.  Passages are normalised (lower case, letters and digits parted by single
blanks) and hashed; a quoted passage is linked to the earliest message of its conversation, before its own, that holds
it: as a whole, as a passage of level 0, or else, line by line, to the message that holds most of its lines (of several,
the latest).  Without quoted lines and the line that announces a quote ("... wrote:"), what remains is a message's own text.

A message replies to the message that its least-quoted linked passage comes from (of several, the latest); without links
to the message of the turn before, and where there is none it starts a thread.  A reply is always later than what it
replies to, so (conv_id, turn) is a reply order.

Null texts are empty messages; passages without letters and digits are linked to nothing.  Repeated rows keep a row each;
a null conv_id or turn is linked to nothing.  Extra columns are left out.  Originals are aggregated to one turn for each passage of a
conversation before they are joined, so passages or openings shared by very many messages do not multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densigrid.llm.ship import let

_QUOTE = r"^[ \t]{0,3}>"
_MARKS = r"^((?:[ \t]{0,3}>)+)"
#: Words of attribution lines, in the languages that mail programs write them in most.
_ANNOUNCE = r"(?i)^.{0,200}\b(wrote|schrieb|a écrit|escribió)\s*:\s*$"

_PASSAGE = "struct<level:int,lines:array<string>>"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def passages(text: Column) -> Column:
    """array<struct<level, lines>> of a text, in order; time in proportion to its lines."""
    marks = lambda line: F.regexp_extract(line, _MARKS, 1)
    line = lambda x: F.struct(F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.regexp_replace(F.regexp_replace(x, _MARKS, ""), "^ ", "").alias("line"))

    def runs(lines: Column) -> Column:
        """Lines between the places where the level changes."""
        opens = lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"])
        run = lambda starts: lambda s, k: F.struct(F.get(lines, s)["level"].alias("level"), F.transform(F.slice(lines, s + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - s), lambda x: x["line"]).alias("lines"))
        return let(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), opens), lambda starts: F.transform(starts, run(starts)))

    quoted = let(F.transform(F.split(text, "\r?\n"), line), runs)
    plain = F.array(F.struct(F.lit(0).alias("level"), F.split(text, "\r?\n").alias("lines")))
    return F.when(text.rlike(f"(?m){_QUOTE}"), quoted).otherwise(plain).cast(f"array<{_PASSAGE}>")


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, message (its hash), passages and own_text of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = messages.select("conv_id", "turn", "role", F.xxhash64("role", text).alias("message"), passages(text).alias("passages"))
    # A line that announces a quote is the last of a passage that a quoted one follows.
    last = lambda p: F.element_at(p["lines"], -1)
    announced = lambda p, i: (F.coalesce(F.get("passages", i + 1)["level"], F.lit(0)) > 0) & last(p).rlike(_ANNOUNCE)
    own = lambda p, i: F.when(p["level"] == 0, F.when(announced(p, i), F.slice(p["lines"], 1, F.size(p["lines"]) - 1)).otherwise(p["lines"])).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("own_text", F.trim(F.regexp_replace(F.array_join(F.flatten(F.transform("passages", own)), "\n"), r"^\s+|\s+$", "")))


def quoted_links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, message, passage (its place), level, origin (turn of the linked message, or null) of quoted passages."""
    hashes = lambda texts: F.filter(F.transform(texts, lambda t: F.when(normal(t) != "", F.xxhash64(normal(t)))), lambda h: h.isNotNull())
    level0 = F.filter("passages", lambda p: p["level"] == 0)
    held = F.array_distinct(F.concat(hashes(F.array("own_text")), hashes(F.transform(level0, lambda p: F.array_join(p["lines"], "\n"))), hashes(F.flatten(F.transform(level0, lambda p: p["lines"])))))
    quotes = rows.select("conv_id", "turn", "message", F.posexplode("passages").alias("passage", "p")).where("p.level > 0").distinct()
    quotes = quotes.select("conv_id", "turn", "message", "passage", F.col("p.level").alias("level"), hashes(F.array(F.array_join("p.lines", "\n"))).alias("whole"), F.array_distinct(hashes(F.col("p.lines"))).alias("lines"))
    keys = ["conv_id", "turn", "message", "passage", "level"]
    asked = quotes.select(*keys, F.explode_outer(F.concat(F.transform("whole", lambda h: F.struct(h.alias("h"), F.lit(True).alias("is_whole"))), F.transform("lines", lambda h: F.struct(h.alias("h"), F.lit(False).alias("is_whole"))))).alias("q"))
    asked = asked.select(*keys, "q.h", "q.is_whole")
    # Whether a conversation quotes at all is asked first: originals of the others are not hashed.
    origins = rows.join(quotes.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", F.explode(held).alias("h"), F.col("turn").alias("origin")).groupBy("conv_id", "h").agg(F.min("origin").alias("origin"))
    met = asked.join(origins, ["conv_id", "h"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    votes = met.groupBy(*keys, "origin").agg(F.max("is_whole").alias("is_whole"), F.count("*").alias("n"))
    best = F.max(F.when(F.col("origin").isNotNull(), F.struct(F.col("is_whole"), F.col("n"), F.col("origin"))))
    return votes.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.origin").alias("origin"))


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own_text, parent_turn, n_quotes, n_linked, max_level of every message."""
    rows = parsed(messages)
    links = quoted_links(rows)
    nearest = F.max(F.when(F.col("origin").isNotNull(), F.struct((-F.col("level")).alias("near"), F.col("origin"))))
    by_message = links.groupBy("conv_id", "turn", "message").agg(nearest["origin"].alias("quoted_turn"), F.count("*").alias("n_quotes"), F.count("origin").alias("n_linked"), F.max("level").alias("max_level"))
    before = messages.select(F.col("conv_id").alias("__conv"), (F.col("turn") + 1).alias("__next")).distinct()
    told = by_message.select(*[F.col(c).alias(f"__{c}") if c in ("conv_id", "turn", "message") else c for c in by_message.columns])
    same = F.col("conv_id").eqNullSafe(F.col("__conv_id")) & F.col("turn").eqNullSafe(F.col("__turn")) & (F.col("message") == F.col("__message"))
    out = rows.join(told, same, "left").join(before, (F.col("conv_id") == F.col("__conv")) & (F.col("turn") == F.col("__next")), "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        "own_text",
        F.coalesce("quoted_turn", F.col("__next") - 1).alias("parent_turn"),
        F.coalesce("n_quotes", F.lit(0).cast("long")).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"),
        F.coalesce("max_level", F.lit(0)).alias("max_level"),
    )


#: Turns, and messages, that one part of a formatted conversation has at most.
PART = 64


def in_parts(messages: DataFrame) -> DataFrame:
    """The rows of ``linked`` with the part of the conversation that a message is in, and its position there from 1.

    (span, piece) names a part: spans are PART turns, pieces PART messages of a span, so no conversation or turn, however
    often it is repeated, is one row.  Messages of one turn are in order of role and text; all of them are kept.
    """
    span = Window.partitionBy("conv_id", "span").orderBy("turn", "role", "own_text", "parent_turn", "n_quotes", "n_linked", "max_level")
    rows = linked(messages).withColumn("span", F.floor(F.col("turn") / PART)).withColumn("place", F.row_number().over(span) - 1)
    return rows.withColumns({"piece": F.floor(F.col("place") / PART), "position": (F.col("place") % PART + 1).cast("int")}).drop("place")


def chat_of(collected: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(collected), lambda x: x["line"]), "")


def line() -> Column:
    return F.struct("position", F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("own_text"), F.lit("\n<|end|>\n")).alias("line"))


def formatted(messages: DataFrame) -> DataFrame:
    """conv_id, span, piece, chat: the conversations in reply order (a reply is always later than what it replies to)
    without quotes, in parts of bounded size."""
    return in_parts(messages).groupBy("conv_id", "span", "piece").agg(chat_of(F.collect_list(line())).alias("chat"))


def with_chats(messages: DataFrame) -> DataFrame:
    """The rows of ``in_parts`` with chat_sha256, of the part of the conversation that ``formatted`` builds."""
    part = Window.partitionBy("conv_id", "span", "piece")
    return in_parts(messages).withColumn("chat_sha256", F.sha2(chat_of(F.collect_list(line()).over(part)), 256))
