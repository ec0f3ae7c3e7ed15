"""Chat formatting by event-sourced reconstruction; built-in expressions only.

Events (conv_id, seq, turn, op, role, text) are folded into final messages:

* ``delta`` appends text to its turn; the first event of a turn gives the role;
* ``edit`` replaces what its turn held before;
* ``regenerate`` starts its turn anew and voids all earlier events of later turns.

Final turns are rendered in a template of marked turns, ``<|im_start|>role``, line end, text,
``<|im_end|>``, line end. Control strings inside a text (``CONTROL``) get a backslash after their
first character, next to any backslashes that stand there already; so none remains, other text is
untouched, and removing one backslash restores the original. The rendering carries spans of
code points under the loss mask: the assistants' texts.

Turns of a conversation are ordered by (turn, seq); ties of events by (seq, op, role, text). A conversation's
rendering is one string, so its turns meet in one task; events are folded before, by
(conv_id, turn), and only whole messages are gathered.

Nulls: a null text or role is empty; a null conv_id is a conversation of its own; a null turn or
seq sorts first. Repeated rows are repeated turns; texts of any length, up to Spark's strings of 2 GB for a whole conversation. Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trunkline.llm.common import documents

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of this template and of others in use, first character and rest (fixed values).
CONTROL = r"(<|\[)(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])"
RESTORE = CONTROL.replace(r"(\\*)", r"\\(\\*)")
LOSS_ROLE = "assistant"
DELTA_CHARS = 512


def escaped(text: F.Column) -> F.Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: F.Column) -> F.Column:
    return F.regexp_replace(text, RESTORE, r"$1$2$3")


def escaped_role(role: F.Column) -> F.Column:
    """A role stands on the marker's line, so its line ends are escaped as well."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: F.Column) -> F.Column:
    parts = F.split(role, r"\\\\", -1)
    return unescaped(F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\"))


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, turn, item, role, text): final messages. ``item`` keeps repeated turns apart; null for a column that lacks it."""
    item = F.col("item") if "item" in events.columns else F.lit(0)
    ev = events.select("conv_id", "turn", item.alias("item"), "seq", "op", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # events of a turn are void if the same turn, or an earlier one, was regenerated after them
    anew = ev.where("op = 'regenerate'").groupBy("conv_id", "turn").agg(F.max("seq").alias("again"))
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    resets = anew.withColumn("again", F.max("again").over(upto)).select(F.col("conv_id").alias("rc"), F.col("turn").alias("rt"), "again")
    steps = resets.groupBy("rc").agg(F.array_sort(F.collect_list(F.struct("rt", "again"))).alias("steps"))  # regenerations of a conversation only
    live = ev.join(steps, ev.conv_id.eqNullSafe(steps.rc), "left")
    void_before = F.array_max(F.transform(F.filter("steps", lambda s: s["rt"] <= F.col("turn")), lambda s: s["again"]))
    live = live.where(F.col("steps").isNull() | F.coalesce(F.col("seq") >= void_before, F.lit(True)))
    group = live.groupBy("conv_id", "turn", "item").agg(
        F.array_sort(F.collect_list(F.struct("seq", "op", "role", "text"))).alias("log"),
        F.max(F.when(F.col("op").isin("edit", "regenerate"), F.col("seq"))).alias("base"),
    )
    kept = F.filter("log", lambda e: F.col("base").isNull() | (e["seq"] >= F.col("base")))
    return group.select("conv_id", "turn", "item", F.col("log")[0]["role"].alias("role"), F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"), F.col("log")[0]["seq"].alias("seq"))


def formatted(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): code points [start, end) under the loss mask; where a turn begins is a running sum of lengths."""
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    turns = messages.select("conv_id", "turn", "seq", "item", "role", "text", (F.col("role") == LOSS_ROLE).alias("loss"), head.alias("head"), escaped(F.col("text")).alias("body"))
    turns = turns.withColumn("size", (F.length("head") + F.length("body") + len(END) + 1).cast("long"))
    upto = Window.partitionBy("conv_id").orderBy("turn", "seq", "item", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum("size").over(upto) - F.col("size") + F.length("head")
    pieces = turns.withColumn("start", start).select("conv_id", F.struct("start", (F.col("start") + F.length("body")).alias("end"), "loss", F.concat("head", "body", F.lit(END + "\n")).alias("piece")).alias("p"))
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("parts"))  # starts differ, so they are the order
    spans = F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parsed(rendered: DataFrame) -> DataFrame:
    """Read renderings back: turns (role, text) and the texts under the loss mask, unescaped."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, F.lit(2**31 - 2))

    def turn(p):
        return F.struct(
            unescaped_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescaped(F.substr(p, F.instr(p, F.lit("\n")) + 1, F.length(p) - F.instr(p, F.lit("\n")) - len(END) - 1)).alias("text"),
        )

    spans = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return rendered.select("*", F.transform(F.when(F.length("formatted") > 0, pieces).otherwise(F.array().cast("array<string>")), turn).alias("turns"), F.array_join(spans, "").alias("loss_text"))


def conversation_events(rows: DataFrame, size: int = DELTA_CHARS) -> DataFrame:
    """Rows by turn as an event log: each row is streamed as deltas of ``size`` code points. Repeated turns stay apart."""
    item = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    some = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("")))
    return rows.select("conv_id", "turn", "role", "text").withColumn("item", item).select("conv_id", "turn", "item", "role", F.posexplode(some).alias("at", "text")).select(
        "conv_id", "turn", "item", F.col("at").cast("long").alias("seq"), F.lit("delta").alias("op"), "role", "text"
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, id AS turn, CASE id WHEN 0 THEN 'user' ELSE 'assistant' END AS role, '{text}' AS text FROM range(2)")
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = parsed(formatted(folded(conversation_events(rows))))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Of control strings only conversation -7's are expected in the data's texts; the SQL escapes by the same pattern.
_ESCAPE = r"regexp_replace({}, '(<|\[)(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\\\2\3', 'g')"
ORACLE = f"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length({_ESCAPE.format("text")}) + {len(START) + len(END) + 2})::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id
"""
