"""Chat formatting: event logs folded into messages, then rendered with a loss mask.

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import narrow
from weftline.runtime import table

#: Control strings of the template. Every one begins with `<`, and `[` is escaped too,
#: so that control strings of other templates ([INST], </s>) stay inert in a text.
OPEN, CLOSE = "<|turn|>", "<|end|>"
#: (raw, escaped) in the order of escaping; the backslash goes first, and back last.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
#: A role stands before the first line break, so it escapes its own.
BREAK = ("\n", "\\n")


def escape(text: Column, role: bool = False) -> Column:
    """Reversible: afterwards no `<` and no `[` is left, and each backslash is
    followed by the letter that tells what it stands for."""
    for raw, coded in (*ESCAPES, *([BREAK] if role else [])):
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for raw, coded in reversed((*ESCAPES, *([BREAK] if role else []))):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def fold(events: DataFrame, conv: str = "conv_id", seq: str = "seq", kind: str = "kind", message: str = "msg_id", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, position, role, text): the messages that an event log comes to.

    Kinds: `message` begins a message (or says it anew), `delta` adds text to it,
    `edit` replaces its text, `regenerate` replaces its text (with further deltas to
    come) and drops every message that began after it and before the regeneration.
    A null kind is read as `message`, a null text as empty; other kinds add nothing.
    Events are taken by seq, ties by kind, role and text, so the result does not
    depend on the order of rows; repeated events count as often as they stand there.
    A message's role is the one its first event names. A null conversation is one of
    its own. No events give no messages; other columns are left out.

    All windows are dealt by conversation, hence one exchange; they sort, and spill,
    and a window reads its rows in order rather than gathering them."""
    e = narrow(events, conv=conv, seq=seq, kind=kind, msg=message, role=role, text=text)
    e = e.withColumns({"kind": F.coalesce("kind", F.lit("message")), "text": F.coalesce("text", F.lit("")), "role": F.coalesce("role", F.lit(""))})
    order = ["seq", "kind", "role", "text"]
    e = e.repartition("conv").withColumn("n", F.row_number().over(Window.partitionBy("conv").orderBy(*order)))
    own = Window.partitionBy("conv", "msg").orderBy("n")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    resets = F.col("kind").isin("message", "edit", "regenerate")
    e = e.withColumns(
        {
            "first": F.min("n").over(whole),
            "says": F.first("role").over(whole),
            "begun": F.max(F.when(resets, F.col("n"))).over(whole),
            "again": F.max(F.when(F.col("kind") == "regenerate", F.col("n"))).over(whole),
        }
    )
    parts = e.where("(begun is null or n >= begun) and (kind = 'delta' or n = begun)")
    said = parts.groupBy("conv", "msg", "first", "says", "again").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "").alias("text"))
    earlier = Window.partitionBy("conv").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    said = said.withColumn("dropped_before", F.max("again").over(earlier)).where("dropped_before is null or first > dropped_before")
    return said.select("conv", F.row_number().over(Window.partitionBy("conv").orderBy("first")).alias("position"), F.col("says").alias("role"), "text")


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, n_turns, formatted, loss_spans) from fold()'s messages.

    formatted holds, for each message, OPEN role line-break text CLOSE, with role and
    text escaped. loss_spans are (begin, length) in code points of formatted, from 0, and
    (at, bytes) the same in its UTF-8: the escaped text of each message whose role is
    trained, and nothing else. Null conversations are one, null roles and texts (which
    fold() does not make) leave a message out of formatted; messages of one position
    come in order of their text. No messages give no rows; other columns are left out.
    A conversation is one row of the result, so one row holds its text; nothing
    larger than one conversation is gathered."""
    m = narrow(messages, conv="conv", position="position", role="role", text="text").withColumns({"head": F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit("\n")), "body": escape(F.col("text"))})
    m = m.withColumn("turn", F.concat("head", "body", F.lit(CLOSE)))
    before = Window.partitionBy("conv").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    for name, size in (("begin", F.char_length), ("at", F.octet_length)):
        m = m.withColumn(name, (F.coalesce(F.sum(size("turn")).over(before), F.lit(0)) + size("head")).cast("long"))
    span = F.when(F.col("role").isin(*trained), F.struct("begin", F.char_length("body").alias("length"), "at", F.octet_length("body").alias("bytes")))
    rows = m.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("position", "turn", span.alias("span")))).alias("rows"))
    return rows.select(
        "conv",
        F.size("rows").cast("long").alias("n_turns"),
        F.array_join(F.transform("rows", lambda x: x["turn"]), "").alias("formatted"),
        F.filter(F.transform("rows", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: render()'s turns, read back from its output. Null gives
    null, an empty string no turns."""
    turns = F.filter(F.split(formatted, "<\\|end\\|>"), lambda x: x != "")
    inner = F.transform(turns, lambda x: F.substring(x, F.lit(len(OPEN) + 1), F.char_length(x)))
    cut = F.transform(inner, lambda x: F.struct(x.alias("all"), F.instr(x, F.lit("\n")).alias("at")))
    return F.transform(
        cut,
        lambda x: F.struct(
            unescape(F.substring(x["all"], F.lit(1), x["at"] - 1), role=True).alias("role"),
            unescape(F.substring(x["all"], x["at"] + 1, F.char_length(x["all"]))).alias("text"),
        ),
    )


def masked(formatted: Column, spans: Column) -> Column:
    """The unescaped text under a loss mask, in order, nothing between; null where either
    is null, empty where no span is. Cut by bytes, as a place in them is found at once,
    while code points are counted from the start."""
    raw = formatted.cast("binary")
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(raw, (s["at"] + 1).cast("int"), s["bytes"]).cast("string"))), "")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -1, formatted, and read back as digests."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    rows = rows.unionByName(extra)
    each = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    events = rows.repartition("conv_id").withColumns({"seq": F.row_number().over(each), "kind": F.lit("message")})
    done = render(fold(events.withColumn("msg_id", F.col("seq"))))
    read = done.select("conv", "formatted", parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = """
with told as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), coded as (
  select *, replace(replace(replace(text, '\\', '\\e'), '<', '\\l'), '[', '\\b') as body,
    replace(replace(replace(replace(role, '\\', '\\e'), '<', '\\l'), '[', '\\b'), chr(10), '\\n') as head from told
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(8 + length(head) + 1 + length(body) + 7) as bigint) as formatted_chars
from coded group by conv_id
"""
