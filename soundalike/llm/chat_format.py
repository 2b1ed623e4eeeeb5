"""Preference formatting of conversations, in DataFrame operations only.

A pair is a chosen and a rejected conversation.  Their longest common prefix of turns (same role, same text)
is rendered once as the prompt; what follows on either side is rendered as that side's completion, with the
spans a loss should count: the texts and end marks of assistant turns.  Template values are parameters.

Defined results: turns are ordered by turn number (null last), then role, then text, so repeated turn numbers
have an order; null roles are ``user``, null texts are empty.  Rows without a conversation id belong to no
conversation and are left out.  A conversation without a partner has an empty other side and is not usable.
Identical conversations share everything and have empty completions.  ``usable`` is true when both
completions begin with an assistant turn.  Marks that occur in a role or text are broken up by a space after
their first character, so text cannot open or close a turn.  Texts of any length are rendered whole; empty
tables give no rows; extra columns are not read.

A conversation is rendered where its turns meet; the unit of work is one pair, as its result is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundalike.llm.common import need, query, table, text_of

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
TRAINED = "assistant"


def safe(text: Column) -> Column:
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + " " + mark[1:]))
    return text


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE + "\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END + "\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _spans(turns: Column) -> Column:
    """Spans of trained text as [start, end) in code points of the completion."""
    start = F.struct(F.lit(0).cast("long").alias("at"),
                     F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state, t):
        begin = state["at"] + F.char_length(_head(t))
        end = begin + F.char_length(t["text"]) + len(END)
        span = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + 1).cast("long").alias("at"), F.when(t["role"] == TRAINED, F.concat(
            state["spans"], span)).otherwise(state["spans"]).alias("spans"))
    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen boolean, turn, role, text) to one row per pair.

    pair_id, prompt, chosen, rejected, chosen_spans, rejected_spans, prefix_turns, chosen_turns,
    rejected_turns, usable.
    """
    need(turns, "pair_id", "chosen", "turn", "role", "text")
    item = F.struct(F.col("turn").isNull().alias("no_turn"), F.col("turn").alias("turn"),
                    safe(F.coalesce("role", F.lit("user"))).alias("role"), safe(text_of("text")).alias("text"))
    sides = turns.where("pair_id IS NOT NULL").groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("chosen"), item))).alias("a"),
        F.array_sort(F.collect_list(F.when(~F.col("chosen"), item))).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce(
        (x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    n = F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same))
    cut = sides.withColumn("n", n.cast("int"))
    cut = cut.withColumn("c", F.slice("a", F.col("n") + 1, F.greatest(F.size("a") - F.col("n"), F.lit(0)))) \
             .withColumn("r", F.slice("b", F.col("n") + 1, F.greatest(F.size("b") - F.col("n"), F.lit(0))))
    starts = [F.coalesce(F.get(x, F.lit(0))["role"] == TRAINED, F.lit(False)) for x in (F.col("c"), F.col("r"))]
    return cut.select(
        "pair_id", _rendered(F.slice("a", 1, F.col("n"))).alias("prompt"), _rendered(F.col("c")).alias("chosen"),
        _rendered(F.col("r")).alias("rejected"), _spans(F.col("c")).alias("chosen_spans"),
        _spans(F.col("r")).alias("rejected_spans"), F.col("n").cast("long").alias("prefix_turns"),
        F.size("a").cast("long").alias("chosen_turns"), F.size("b").cast("long").alias("rejected_turns"),
        (starts[0] & starts[1]).alias("usable"))


def spans_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs that share a context, one per conversation, as the tables hold no preferences.

    Chosen is a conversation up to its last assistant turn; rejected has the same context, then the last reply of
    its neighbour (2k of 2k + 1 and the other way round).  A conversation without an assistant turn is whole on
    both sides; without a reply of the neighbour the rejected side ends with the context.
    """
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").alias("pair_id"), "turn", F.coalesce("role", F.lit("user")).alias("role"),
        text_of("text").alias("text"))
    place = F.struct(F.col("turn").isNull().alias("no_turn"), "turn", "role", "text")
    last = turns.where(F.col("role") == TRAINED).groupBy("pair_id").agg(F.max(place).alias("last"))
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("last.text").alias("reply"))
    # One row per conversation: where its context ends, and the neighbour's reply.
    ends = last.join(other, "pair_id", "left")
    met = turns.withColumn("place", place).join(ends, "pair_id", "left")
    context = met.where(F.col("last").isNull() | (F.col("place") < F.col("last")))
    both = context.select("pair_id", F.explode(F.array(F.lit(True), F.lit(False))).alias("chosen"), "turn", "role", "text")
    end = F.explode(F.array(F.struct(F.lit(True).alias("chosen"), F.col("last.text").alias("text")),
                            F.struct(F.lit(False).alias("chosen"), F.col("reply").alias("text")))).alias("end")
    replies = ends.select("pair_id", F.col("last.turn").alias("turn"), end).where("end.text IS NOT NULL")
    return both.unionByName(replies.select("pair_id", "end.chosen", "turn", F.lit(TRAINED).alias("role"), "end.text"))


@query("op10_chat_format", """
WITH c AS (SELECT conv_id AS pair_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'user'), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT * FROM c WHERE role = 'assistant' QUALIFY pos = max(pos) OVER (PARTITION BY pair_id)),
s AS (SELECT c.pair_id, side, c.turn, c.role, c.text FROM c LEFT JOIN z USING (pair_id), (VALUES (true), (false)) v(side)
      WHERE z.pos IS NULL OR c.pos < z.pos
      UNION ALL SELECT pair_id, true, turn, role, text FROM z
      UNION ALL SELECT z.pair_id, false, z.turn, z.role, o.text FROM z JOIN z o ON o.pair_id = xor(z.pair_id, 1)),
t AS (SELECT pair_id, side, turn, replace(replace(role, '<|', '< |'), '|>', '| >') AS role,
             replace(replace(text, '<|', '< |'), '|>', '| >') AS text FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS LAST, role, text) AS pos FROM t),
q AS (SELECT pair_id, pos, max(CASE WHEN side THEN role END) AS ra, max(CASE WHEN side THEN text END) AS ta,
             max(CASE WHEN NOT side THEN role END) AS rb, max(CASE WHEN NOT side THEN text END) AS tb
      FROM p GROUP BY pair_id, pos),
n AS (SELECT pair_id, coalesce(min(CASE WHEN ra = rb AND ta = tb THEN NULL ELSE pos END) - 1, max(pos)) AS n
      FROM q GROUP BY pair_id),
x AS (SELECT p.*, n.n, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body
      FROM p JOIN n USING (pair_id)),
y AS (SELECT *, coalesce(sum(CASE WHEN pos > n THEN length(head) + length(body) END) OVER (
                 PARTITION BY pair_id, side ORDER BY pos), 0) AS upto FROM x)
SELECT pair_id,
  coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (WHERE side AND pos <= n), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (WHERE side AND pos > n), '') AS chosen,
  coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (WHERE NOT side AND pos > n), '') AS rejected,
  coalesce(string_agg((upto - length(body))::BIGINT || ':' || (upto - 1)::BIGINT, ',' ORDER BY pos)
           FILTER (WHERE side AND pos > n AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg((upto - length(body))::BIGINT || ':' || (upto - 1)::BIGINT, ',' ORDER BY pos)
           FILTER (WHERE NOT side AND pos > n AND role = 'assistant'), '') AS rejected_spans,
  any_value(n) AS prefix_turns, count(*) FILTER (WHERE side) AS chosen_turns,
  count(*) FILTER (WHERE NOT side) AS rejected_turns,
  coalesce(any_value(role) FILTER (WHERE side AND pos = n + 1) = 'assistant', false)
  AND coalesce(any_value(role) FILTER (WHERE NOT side AND pos = n + 1) = 'assistant', false) AS usable
FROM y GROUP BY pair_id""")
def op10(spark, sf_dir):
    pairs = format_pairs(reply_pairs(table(spark, sf_dir, "conversations")))
    return pairs.withColumn("chosen_spans", spans_text("chosen_spans")).withColumn(
        "rejected_spans", spans_text("rejected_spans"))
