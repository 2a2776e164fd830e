"""Chat formatting with a grammar round trip, in built-in functions only.

A turn is an opening mark, a text and a closing mark. No control string is ever written inside a text: each one gets a
backslash behind its bracket (one more, if it has some there), which the parser takes away again. So nothing but the marks
can be read as marks, by this parser or any other. The formatted conversation is then reparsed with one regular expression
of all turn forms and compared with the source; ``exact`` says that it came back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import table

#: Marks of roles; other roles are named in their opening mark.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
OTHER = ("[ROLE ", "] ", " [/ROLE]")
TURN = r"(?s)<<SYS>>\n.*?\n<</SYS>>\n|\[INST\] .*? \[/INST\]|<s> .*? </s>|\[ROLE .*?\] .*? \[/ROLE\]"
#: A control string behind its bracket; none overlaps another.
_CONTROL = r"(<SYS>>|</SYS>>|s>|/s>|INST\]|/INST\]|ROLE|/ROLE\])"


def escape(c: Column) -> Column:
    """One backslash more behind the bracket of each control string; it can always be taken away again."""
    return F.regexp_replace(c, rf"([<\[])(\\*){_CONTROL}", r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])\\(\\*){_CONTROL}", "$1$2$3")


def escape_role(c: Column) -> Column:
    """As ``escape``, and so that what ends a role's name in its mark does not stand in it."""
    return F.regexp_replace(escape(c), r"\](\\*) ", r"]\\$1 ")


def unescape_role(c: Column) -> Column:
    return unescape(F.regexp_replace(c, r"\]\\(\\*) ", "]$1 "))


def render(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), escape_role(role), F.lit(OTHER[1]), escape(text), F.lit(OTHER[2]))
    for name, (a, b) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(a), escape(text), F.lit(b))).otherwise(out)
    return out


def _inner(turn: Column) -> Column:
    """(role, text, skip) of a rendered turn as written; skip is the length of its opening mark."""
    head = F.instr(turn, OTHER[1])
    make = lambda role, skip, tail: F.struct(role.alias("role"), F.substring(turn, skip + 1, F.length(turn) - skip - tail).alias("text"), skip.alias("skip"))
    out = make(F.substring(turn, F.lit(len(OTHER[0]) + 1), head - 1 - len(OTHER[0])), head + len(OTHER[1]) - 1, len(OTHER[2]))
    for name, (a, b) in MARKS.items():
        out = F.when(F.startswith(turn, F.lit(a)), make(F.lit(name), F.lit(len(a)), len(b))).otherwise(out)
    return out


def parse(formatted: Column) -> Column:
    """Array of (role, text, start, chars, raw): turns as they were, and where each written text stands, from 0."""
    turns = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    # where each turn begins: only these numbers are carried along
    begins = F.aggregate(turns, F.array(F.lit(0)), lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + F.length(t))))

    def one(t: Column, at: Column) -> Column:
        x = _inner(t)
        return F.struct(unescape_role(x["role"]).alias("role"), unescape(x["text"]).alias("text"), (at + x["skip"]).cast("int").alias("start"), F.length(x["text"]).cast("int").alias("chars"), t.alias("raw"))

    return F.transform(F.filter(F.arrays_zip(turns.alias("t"), begins.alias("at")), lambda z: z["t"].isNotNull()), lambda z: one(z["t"], z["at"]))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, turns, loss_spans, exact), a row a conversation.

    turns are read back from ``formatted``, and ``exact`` if they are the source's; loss_spans are (start, chars) of the assistant texts
    in it, from 0. Null roles and texts are empty; turns are ordered by number (null first), then role and text; rows that repeat are
    turns each; a row without a conversation id is a conversation of its own. Other columns are not used, whatever their
    names; an empty table gives an empty one. A conversation is one row, as the training example that it becomes.
    """
    r = rows.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("x"))
    r = r.select("conv", F.struct("x.*", render(F.col("x.role"), F.col("x.text")).alias("written")).alias("x"))
    c = r.where("conv IS NOT NULL").groupBy("conv").agg(F.array_sort(F.collect_list("x")).alias("t"))
    c = c.unionByName(r.where("conv IS NULL").select("conv", F.array("x").alias("t")))
    c = c.withColumn("formatted", F.array_join(F.transform("t", lambda x: x["written"]), "")).withColumn("turns", parse(F.col("formatted")))
    pair = "array<struct<role:string,text:string>>"
    same = F.transform("turns", lambda x: F.struct(x["role"], x["text"])).cast(pair) == F.transform("t", lambda x: F.struct(x["role"], x["text"])).cast(pair)
    whole = F.array_join(F.transform("turns", lambda x: x["raw"]), "") == F.col("formatted")
    spans = F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].alias("start"), x["chars"].alias("chars")))
    return c.select(F.col("conv").alias(conv), "formatted", "turns", spans.alias("loss_spans"), (same & whole).alias("exact"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), odd.alias("text"))
    out = format_chats(rows.unionByName(extra))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["chars"]))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "exact")


# the expected length counts escapes on the plain texts, by strings and not by this module's rule
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own,
 CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 16 + length(role) + length(role) - length(regexp_replace(role, '\](\\*) ', ']\1', 'g')) END AS marks FROM c),
e AS (SELECT *, CAST(list_sum(list_transform(['<<SYS>>', '<</SYS>>', '<s>', '</s>', '[INST]', '[/INST]', '[ROLE', '[/ROLE]'],
  lambda w: (length(x) - length(replace(x, w, ''))) // length(w))) AS BIGINT) AS escapes
 FROM (SELECT *, regexp_replace(t || CASE WHEN role IN ('system', 'user', 'assistant') THEN '' ELSE chr(10) || role END, '([<\[])\\+', '\1', 'g') AS x FROM k))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
 CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length(t) + marks + escapes) AS BIGINT) AS formatted_chars, true AS exact
FROM e GROUP BY conv_id, own
"""
