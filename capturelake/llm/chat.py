"""Chat formatting in Spark expressions only: collected turns are sorted, adjacent turns of a role merged, and all joined.

A conversation is a string of blocks, one for each stretch of turns of one role: an opening mark, the turns' texts with a
mark between them, a closing mark. A mark stands alone, a space or line feed away from any text, and never after a
backslash. Inside texts each control string gets a backslash before it (and before the backslashes that precede it), so
that no text looks like a mark and every text can be read back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.llm.text import quoted

ASSISTANT = "assistant"
#: Opening and closing marks of the roles that chat templates know.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", "\n[/INST]\n"), ASSISTANT: ("<s> ", "\n</s>\n")}
#: Any other role is named in its block; a null role has a mark of its own.
NAMED, NAME_END, NULL, END = "<<ROLE>>\n", "\n<</ROLE>>\n", "<<NULL>>\n", "\n<<END>>\n"
NEXT = "\n<<NEXT>>\n"
CONTROL = r"<s>|</s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>|<<NULL>>|<<END>>|<<NEXT>>"
OPENING = r"<s> |\[INST\] |<<SYS>>\n|<<ROLE>>\n|<<NULL>>\n"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, rf"(\\*)({CONTROL})", r"\\$1$2")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, rf"\\(\\*)({CONTROL})", "$1$2")


def _by_role(role: Column, mark: int, null: str, other: Column) -> Column:
    found = F.when(role.isNull(), null)
    for name, marks in MARKS.items():
        found = found.when(role == name, marks[mark])
    return found.otherwise(other)


def _piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _pieces(block: Column) -> Column:
    """A block's marks and texts in order, each with whether it counts for the loss."""
    role = F.get(block, 0)["role"]
    mark = lambda c: F.array(_piece(c, F.lit(False)))
    counts = F.coalesce(role == ASSISTANT, F.lit(False))

    def one(turn: Column, i: Column) -> Column:
        own = mark(F.lit(NEXT)), F.array(_piece(escaped(F.coalesce(turn["text"], F.lit(""))), counts))
        return F.when(i == 0, own[1]).otherwise(F.concat(*own))

    opening = _by_role(role, 0, NULL, F.concat(F.lit(NAMED), escaped(role), F.lit(NAME_END)))
    return F.concat(mark(opening), F.flatten(F.transform(block, one)), mark(_by_role(role, 1, END, F.lit(END))))


def _spans(pieces: Column) -> Column:
    """Code points from start to end (exclusive) of every piece that counts for the loss."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece["text"])
        span = F.array(F.struct(state["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(piece["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(pieces, start, step, lambda state: state["spans"])


def format_chats(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, cf_text, cf_loss): one row for each conversation, its text, and the spans of code points that count for the loss
    (one for each assistant turn).

    Turns go by number, then role, then text, nulls first; repeated rows are turns of their own. Adjacent turns of one role
    share a block, with a mark between their texts. A null text is empty; a null role has a block of its own kind, as have
    roles without a mark; rows with a null key are one conversation; other columns are not read. A conversation's turns
    meet in one row, as its text is one value: the longest one is what a task must hold. No rows give no rows.
    """
    named = turns.select(
        F.col(quoted(key)).alias("key"),
        F.struct(F.col(quoted(turn)).alias("turn"), F.col(quoted(role)).alias("role"), F.col(quoted(text)).alias("text")).alias("turn"),
    )
    chats = named.groupBy("key").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    differs = lambda i: (i == 1) | ~F.get("turns", i - 1)["role"].eqNullSafe(F.get("turns", i - 2)["role"])
    chats = chats.withColumn("starts", F.filter(F.sequence(F.lit(1), F.size("turns")), differs))
    after = lambda k: F.coalesce(F.get("starts", k + 1), F.size("turns") + 1)
    chats = chats.withColumn("blocks", F.transform("starts", lambda s, k: F.slice("turns", s, after(k) - s)))
    chats = chats.withColumn("pieces", F.flatten(F.transform("blocks", _pieces)))
    return chats.select(F.col("key").alias(key), F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("cf_text"), _spans(F.col("pieces")).alias("cf_loss"))


def _read_block(block: Column) -> Column:
    """The turns (role, text) of a block of formatted text."""
    name = F.substring_index(F.substring(block, len(NAMED) + 1, 2**31 - 1), NAME_END, 1)
    role = F.when(block.startswith(NULL), None)
    head = F.when(block.startswith(NULL), len(NULL))
    tail = F.when(block.startswith(NULL), len(END))
    for own, (opening, closing) in MARKS.items():
        role = role.when(block.startswith(opening), own)
        head = head.when(block.startswith(opening), len(opening))
        tail = tail.when(block.startswith(opening), len(closing))
    role = role.otherwise(unescaped(name))
    head = head.otherwise(F.length(name) + len(NAMED) + len(NAME_END))
    tail = tail.otherwise(len(END))
    body = F.substring(block, head + 1, F.length(block) - head - tail)
    return F.transform(F.split(body, NEXT), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))


def read_chats(chats: DataFrame) -> DataFrame:
    """``chats`` of ``format_chats`` with cf_turns (role, text: as they went in, null texts empty) and cf_targets (the texts
    under the loss mask), both read from cf_text."""
    blocks = F.split("cf_text", rf"(?<!\\)(?={OPENING})")
    targets = F.transform("cf_loss", lambda s: unescaped(F.substring("cf_text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return chats.withColumns({"cf_turns": F.flatten(F.transform(blocks, _read_block)), "cf_targets": targets})


def chat_digests(read: DataFrame, key: str = "conv_id") -> DataFrame:
    """The contract's columns, from what was read back; a null role counts as empty."""
    lines = F.transform("cf_turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n")))
    targets = F.array_join("cf_targets", "")
    return read.select(
        key, F.size("cf_turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(targets).cast("long").alias("loss_chars"), F.sha2(targets, 256).alias("loss_sha256"), F.length("cf_text").cast("long").alias("formatted_chars"),
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """The contract's rows: ``turns`` and conversation -1, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = [F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", ASSISTANT))]
    rows = turns.sparkSession.range(1).select(F.inline(F.array(*probe)))
    return reduce(DataFrame.unionByName, [turns.select("conv_id", "turn", "role", "text"), rows])


ORACLE = r"""
with turns as (
    select conv_id, turn, role, coalesce(text, '') as text from conversations
    union all select -1, t.turn, t.role, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) as t(turn, role)
), placed as (
    select *, row_number() over w > 1 and lag(role) over w is not distinct from role as joins, lead(1) over w is not null and lead(role) over w is not distinct from role as joined,
           len(regexp_extract_all(text, '<s>|</s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>|<<NULL>>|<<END>>|<<NEXT>>')) as added,
           length(role) + len(regexp_extract_all(role, '<s>|</s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>|<<NULL>>|<<END>>|<<NEXT>>')) as named
    from turns window w as (partition by conv_id order by turn nulls first, role nulls first, text)
)
select conv_id, count(*) as n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' order by turn nulls first, role nulls first, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length(text) + added
           + case when joins then 10 when role is null then 9 when role = 'system' then 8 when role = 'user' then 7 when role = 'assistant' then 4 else named + 20 end
           + case when joined then 0 when role = 'system' then 10 when role = 'assistant' then 6 else 9 end)::bigint as formatted_chars
from placed group by conv_id
"""
