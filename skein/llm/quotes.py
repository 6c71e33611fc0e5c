"""Chat formatting by quotation linking, with DataFrame functions alone.

Lines that start with ``>`` marks quote; the number of marks is the level. Successive
lines of one level, unwrapped into one line, are a passage; blank lines part passages.
Of each passage, its units are the passage itself, its lines and its sentences, all
lower-cased and with single spaces. A quoted unit refers to the earliest turn of its
conversation that has it as a unit of its own text: units are hashed, hashes are
joined, and the units compared. A message answers the turn that most characters of its
lowest-level quoted units refer to (ties: the later turn). Messages come back without
quotes and without the attribution line above a quote, ordered by the root of their
thread, their depth and their turn, so that a message follows what it answers. Quotes
of part of a sentence meet nothing.

Only conversations that quote take part in the join; there, own units are reduced to one
row per conversation and unit before it, so a very common line is met once by each message
that quotes it. Messages are parsed once and stored. Roots and depths come from pointer
doubling, a join per round. The final sort spreads a conversation over tasks; no
conversation is gathered into a row.

Defined results: a null text is empty; a message of quotes alone has empty content;
a quote of nothing earlier leaves the message a root; a line that looks like an
attribution is text unless a quote follows it, with at most one blank line between; of
rows with equal conversation and turn the first by role (null first) and then by MD5 of
its text stands for replies, and all are returned with its place; null ids or turns make a
message a root; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.plans.scratch import discard, materialise

#: Line endings of attribution lines.
ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"
MARKS = r"^\s*(?:>\s?)+"
SENTENCE = r"[^.!?]+[.!?]*"
#: Characters that frame levels while lines are joined to passages; in texts they count as spaces.
_FRAME = "[\x01-\x04]"


def lines(text: Column) -> Column:
    """Array of ``(level, line)`` of a text, in order."""
    split = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), _FRAME, " "), "\r?\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"[^>]", ""))
    return F.transform(split, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("line")))


def without_attributions(parsed: Column) -> Column:
    """The lines but for those of level 0 that name the author of the quote below."""

    def stays(x: Column, i: Column) -> Column:
        below, next_below = F.get(parsed, i + 1), F.get(parsed, i + 2)
        blank = (below["level"] == 0) & below["line"].rlike(r"^\s*$")
        quote = (below["level"] > 0) | (blank & (next_below["level"] > 0))
        return ~((x["level"] == 0) & x["line"].rlike(ATTRIBUTION) & F.coalesce(quote, F.lit(False)))

    return F.filter(parsed, stays)


def fold(line: Column) -> Column:
    """Normal form under which a quoted unit meets its original."""
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def passages(kept: Column) -> Column:
    """Array of ``(level, passage)``: successive lines of one level as one line; blank lines part them."""
    # each line carries its level at both ends, so that the seam of two lines of one level can be told by itself
    level = lambda x: F.when(x["line"].rlike(r"^\s*$"), F.lit("b")).otherwise(x["level"].cast("string"))
    framed = F.transform(kept, lambda x: F.concat(F.lit("\x01"), level(x), F.lit("\x02"), x["line"], F.lit("\x03"), level(x), F.lit("\x04")))
    joined = F.regexp_replace(F.array_join(framed, "\n"), "\x03(\\d+)\x04\n\x01\\1\x02", " ")
    each = F.filter(F.split(joined, "\x04\n?"), lambda x: F.substring(x, 2, 1).between("0", "9"))
    return F.transform(each, lambda x: F.struct(F.regexp_extract(x, "^\x01(\\d+)\x02", 1).cast("int").alias("level"), F.regexp_extract(x, "(?s)\x02(.*)\x03", 1).alias("line")))


def units(kept: Column) -> Column:
    """Array of the distinct ``(level, unit)`` of a message: passages, lines and sentences in normal form."""
    whole = passages(kept)
    sentences = F.flatten(F.transform(whole, lambda x: F.transform(F.regexp_extract_all(x["line"], F.lit(SENTENCE), F.lit(0)), lambda t: F.struct(x["level"].alias("level"), t.alias("line")))))
    every = F.transform(F.concat(whole, F.transform(kept, lambda x: F.struct(x["level"].cast("int").alias("level"), x["line"].alias("line"))), sentences), lambda x: F.struct(x["level"].alias("level"), fold(x["line"]).alias("unit")))
    return F.array_distinct(F.filter(every, lambda x: x["unit"] != ""))


def own_text(kept: Column) -> Column:
    """The lines of level 0, joined and trimmed."""
    return F.regexp_replace(F.array_join(F.transform(F.filter(kept, lambda x: x["level"] == 0), lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")


def parents(parsed: DataFrame) -> DataFrame:
    """``(conv_id, turn, parent)`` of messages that quote an earlier turn; ``parsed`` has ``conv_id``, ``turn``, ``role``, ``mark`` and ``lines``."""
    placed = parsed.where("conv_id is not null and turn is not null")
    quoting = placed.where(F.exists("lines", lambda x: x["level"] > 0)).select("conv_id").distinct()
    held = materialise(placed.join(quoting, "conv_id", "left_semi"), "quoting")
    first = held.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).agg(F.min(F.struct("role", "mark")).alias("first"))
    met = (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")) & F.col("role").eqNullSafe(F.col("first.role")) & (F.col("mark") == F.col("first.mark"))
    each = held.join(first, met).select("conv_id", "turn", F.explode(units(F.col("lines"))).alias("u")).select("conv_id", "turn", "u.level", "u.unit")
    each = materialise(each.distinct().withColumn("h", F.xxhash64("unit")), "units")
    own = each.where("level = 0").groupBy("conv_id", "h", "unit").agg(F.min("turn").alias("origin"))
    own = own.select(F.col("conv_id").alias("of"), F.col("h").alias("oh"), F.col("unit").alias("own_unit"), "origin")
    quoted = each.where("level > 0").join(own, (F.col("conv_id") == F.col("of")) & (F.col("h") == F.col("oh")) & (F.col("unit") == F.col("own_unit")) & (F.col("origin") < F.col("turn")))
    votes = quoted.groupBy("conv_id", "turn", "level", "origin").agg(F.sum(F.length("unit")).alias("n"))
    best = F.max_by("origin", F.struct(-F.col("level"), F.col("n"), F.col("origin")))
    return votes.groupBy("conv_id", "turn").agg(best.alias("parent"))


def threads(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(conv_id, turn, parent, root, depth)`` by pointer doubling; a parent that answers nothing is a root."""
    at, held = links.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth")), None
    for _ in range(max_rounds):
        at, old = materialise(at, "threads"), held
        held = at
        if old is not None:
            discard(old)
        up = at.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"))
        met = (F.col("conv_id") == F.col("c")) & (F.col("root") == F.col("t"))
        if at.join(up, met, "left_semi").isEmpty():
            return at
        at = at.join(up, met, "left").select("conv_id", "turn", "parent", F.coalesce("up_root", "root").alias("root"), (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth"))
    raise RuntimeError(f"threads did not settle in {max_rounds} rounds")


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, root, depth, turn, parent, role, content)`` in reply order."""
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), lines(F.col(text_col)).alias("all_lines"))
    parsed = materialise(rows.withColumn("lines", without_attributions(F.col("all_lines"))).drop("all_lines"), "parsed")
    placed = threads(parents(parsed)).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "parent", "root", "depth")
    joined = parsed.join(placed, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    out = joined.select("conv_id", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"), "turn", "parent", "role", own_text(F.col("lines")).alias("content"))
    return out.orderBy("conv_id", "root", "depth", "turn", "role", "content")
