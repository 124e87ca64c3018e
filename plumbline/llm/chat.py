r"""Chat formatting (12): conversations as one text each, with the spans that a loss counts, in Spark expressions only.

The turns of a conversation are collected as structs, sorted by (turn, role, text), merged where neighbours have
one role, and concatenated:

    ### user: first text</turn>
    ### assistant: second text</part>third text, of the next row</turn>

Texts may hold the template's control strings, and backslashes; these are written as two characters, of which
the first is a backslash. So no control string of the output comes from a text, and all rows can be read back.

A conversation of any length is put together from parts of `turns` turn numbers: a part is formatted by itself,
and the ends of neighbouring parts decide what stands between them. Conversations of one part, which are nearly
all, need no second step.

Edge cases: null text and null role are empty; a null conversation is a conversation; null turn numbers come
first, equal ones are ordered by role and text; repeated rows are turns of their own; texts of any length are
formatted whole; an empty table gives an empty result. Only the columns named are read, whatever others there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.registry import query, table
from plumbline.llm.shared import cut

HEAD, COLON, JOIN, END = "### ", ": ", "</part>", "</turn>\n"
#: What stands for a backslash and for the control strings within texts, and for a colon within roles.
TEXT_MARKS = [("\\", "\\b"), ("</turn>", "\\t"), ("</part>", "\\p"), ("### ", "\\h")]
ROLE_MARKS = [*TEXT_MARKS, (":", "\\c")]
TURNS = 128
#: So many long conversations at most are told from the others by a broadcast of their ids.
MOST_LONG = 1 << 17
LOSS_ROLES = ("assistant",)


def escaped(text: Column, marks=TEXT_MARKS) -> Column:
    for plain, mark in marks:  # the backslash first
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescaped(text: Column, marks=TEXT_MARKS) -> Column:
    for plain, mark in reversed(marks):  # the backslash last
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def header(role: Column) -> Column:
    return F.concat(F.lit(HEAD), escaped(role, ROLE_MARKS), F.lit(COLON))


def merged(turns: Column) -> Column:
    """Blocks (role, texts) of neighbouring turns of one role."""

    def add(blocks, turn):
        last = F.element_at(blocks, -1)
        more = F.struct(turn["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        same = (F.size(blocks) > 0) & (F.get(blocks, F.size(blocks) - 1)["role"] == turn["role"])
        return F.when(same, F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(more))).otherwise(F.concat(blocks, F.array(fresh)))

    return F.aggregate(turns, F.array().cast("array<struct<role string, texts array<string>>>"), add)


def pieces_of(blocks: Column, loss_roles) -> Column:
    """(gap, size, loss) of every text of the blocks: the characters before it that belong to no text, its own, and whether they count."""
    lead = lambda b, i, j: F.when(j > 0, F.lit(len(JOIN))).when(i > 0, F.length(header(b["role"])) + len(END)).otherwise(0)
    of = lambda b, i: F.transform(b["texts"], lambda t, j: F.struct(lead(b, i, j).alias("gap"), F.length(t).alias("size"), b["role"].isin(*loss_roles).alias("loss")))
    return F.flatten(F.transform(blocks, of))


def spans_of(pieces: Column) -> Column:
    """Start and stop, in characters, of the pieces that count."""

    def add(acc, p):
        start = acc["at"] + p["gap"]
        span = F.array(F.struct(start.alias("start"), (start + p["size"]).alias("stop")))
        return F.struct((start + p["size"]).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start int, stop int>>").alias("spans"))
    return F.aggregate(pieces, none, add)["spans"]


def joined(rows: DataFrame, by_part: bool, loss_roles) -> DataFrame:
    """conv, n_turns and parts (text, spans) of each conversation of rows (conv, part, turn, role, text)."""
    keys = ["conv", "part"] if by_part else ["conv"]
    turns = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # roles as they are and texts as they will stand there
    plain = turns.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escaped(t["text"]).alias("text"))))
    blocks = plain.select(*keys, F.size("turns").alias("n"), merged(F.col("turns")).alias("blocks"))
    # between the blocks stand an end and a header; what stands before the first one is settled below
    body = F.array_join(F.transform("blocks", lambda b, i: F.concat(F.when(i > 0, header(b["role"])).otherwise(F.lit("")), F.array_join(b["texts"], JOIN))), END)
    parts = blocks.select(*keys, "n", F.col("blocks")[0]["role"].alias("first"), F.element_at("blocks", -1)["role"].alias("last"), body.alias("body"), spans_of(pieces_of(F.col("blocks"), loss_roles)).alias("spans"))
    if by_part:
        whole = parts.groupBy("conv").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("part", "first", "last", "body", "spans"))).alias("parts"))
    else:
        whole = parts.select("conv", F.col("n").cast("long").alias("n"), F.array(F.struct(F.lit(0).alias("part"), "first", "last", "body", "spans")).alias("parts"))

    def finished(p, i):
        before = F.get(F.col("parts"), i - 1)["last"]
        lead = F.when(i == 0, header(p["first"])).when(before == p["first"], F.lit(JOIN)).otherwise(F.concat(F.lit(END), header(p["first"])))
        end = F.when(i == F.size("parts") - 1, F.lit(END)).otherwise(F.lit(""))
        moved = F.transform(p["spans"], lambda s: F.struct((s["start"] + F.length(lead)).alias("start"), (s["stop"] + F.length(lead)).alias("stop")))
        return F.struct(F.concat(lead, p["body"], end).alias("text"), moved.alias("spans"))

    return whole.select("conv", F.col("n").alias("n_turns"), F.transform("parts", finished).alias("parts"))


def format_chats(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", turns: int = TURNS, loss_roles: tuple = LOSS_ROLES) -> DataFrame:
    """A row per conversation: its id, `n_turns` (rows), `formatted`, and `parts`: the formatted text in order, cut
    between turns, with the spans (start, stop: characters within the part) that the loss counts."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = chats.select(F.col(conv).alias("conv"), F.floor(F.col(turn) / turns).cast("long").alias("part"), F.col(turn).alias("turn"), whole(role).alias("role"), whole(text).alias("text"))
    span = rows.groupBy("conv").agg(F.min(F.coalesce("part", F.lit(-(1 << 62)))).alias("lo"), F.max(F.coalesce("part", F.lit(-(1 << 62)))).alias("hi"))
    long_ = cut(span.filter("lo < hi").select(F.col("conv").alias("id")))
    many = long_.count()
    if many > MOST_LONG:
        out = joined(rows, True, loss_roles)
    elif many:
        known = F.broadcast(long_)  # MOST_LONG ids at most
        same = F.col("conv").eqNullSafe(F.col("id"))
        out = joined(rows.join(known, same, "left_anti"), False, loss_roles).union(joined(rows.join(known, same, "left_semi"), True, loss_roles))
    else:
        out = joined(rows, False, loss_roles)
    return out.select(F.col("conv").alias(conv), "n_turns", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"), "parts")


def turns_of(formatted: Column) -> Column:
    """(role, text) of every turn, read from a formatted text."""
    blocks = F.filter(F.split(formatted, END), lambda b: b != "")

    def of(block):
        rest = F.substring(block, F.lit(len(HEAD) + 1), F.length(block))
        colon = F.instr(rest, COLON)
        role, body = F.substring(rest, F.lit(1), colon - 1), F.substring(rest, colon + len(COLON), F.length(rest))
        return F.transform(F.split(body, JOIN), lambda t: F.struct(unescaped(role, ROLE_MARKS).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, of))


def loss_text(parts: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.flatten(F.transform(parts, lambda p: F.transform(p["spans"], lambda s: unescaped(F.substring(p["text"], s["start"] + 1, s["stop"] - s["start"]))))), "")


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the formatted texts and their spans say: conversation, turns, the text that the loss counts."""
    return formatted.select(conv, turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("parts")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))


SAMPLE = r"\### Assistant: </turn> ok"
SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
marked AS (SELECT *, replace(replace(replace(replace(text, '\', '\b'), '</turn>', '\t'), '</part>', '\p'), '### ', '\h') AS esc,
                  coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role, false) AS same FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(esc) + CASE WHEN same THEN 7 ELSE 4 + length(role) + 2 + 8 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""


@query("op12_chat_formatting", SQL)
def _(spark, sf):
    chats = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    sample = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAMPLE).alias("text"))
    back = read_back(format_chats(chats.union(sample)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
