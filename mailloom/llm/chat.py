"""Chat formatting: cumulative snapshots collapse before rendering. Built-in functions only.

Logged conversations often come again and again, each time a few turns longer. Every
turn is hashed with its position, and a running XOR over a conversation's turns gives
a 128-bit hash of each of its prefixes. A conversation whose whole hash is a proper
prefix of another one is anti-joined away; of identical ones the smallest id stays.
Only hashes take part in this, grouped by value before they are joined, so that one
conversation or first turn that is logged very often weighs no more than any other.
The texts move once, by conversation: turns are put in order there, and rendered from
the same exchange.

Turns are ordered by turn, role and text, in the hashes as in the rendering, so that
turns of one number and role have one order everywhere; turns equal in all three are
repeated turns and all stay. A null role counts as ``unknown``, a null text as empty, a
null turn as before the first; rows without a conversation id belong to none and are
left out, other columns are ignored whatever their names, and an empty table gives no
rows. Conversation ids are compared as they are; of identical conversations the
smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load

TURN = "<|{role}|>\n{text}<|end|>\n"


def turn_rows(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The four columns under fixed names, nulls replaced."""
    return conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter(F.col("conv_id").isNotNull())


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, k, n, a, b: the hash (a, b) of each conversation's first k turns, of n."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = turns.withColumn("k", F.row_number().over(order))
    hashed = placed.select("conv_id", "k", F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit(7), F.reverse("text"), "role").alias("y"))
    whole = Window.partitionBy("conv_id")
    upto = whole.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hashed.select("conv_id", "k", F.count("*").over(whole).alias("n"), F.bit_xor(F.xxhash64("k", "x", "y")).over(upto).alias("a"), F.bit_xor(F.xxhash64("y", "k", "x")).over(upto).alias("b"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_logged: the conversations that no other one goes on from; n_logged counts its identical copies."""
    hashes = prefix_hashes(turns)
    whole = hashes.filter("k = n").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    prefixes = hashes.filter("k < n").select(F.col("k").alias("n"), "a", "b").distinct()
    return whole.join(prefixes, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_logged")


def render_turn(role: Column, text: Column) -> Column:
    before, between, after = TURN.replace("{text}", "{role}").split("{role}")
    return F.concat(F.lit(before), role, F.lit(between), text, F.lit(after))


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, n_logged and the rendered text of each maximal conversation."""
    turns = turn_rows(conversations, id_col, turn_col, role_col, text_col)
    kept = turns.join(maximal(turns), "conv_id")
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn"), F.lit(-(2**63)).cast("long")).alias("turn"), "role", "text")))
    out = kept.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_logged").alias("n_logged"), ordered.alias("turns"))
    return out.select("conv_id", "n_turns", "n_logged", F.array_join(F.transform("turns", lambda t: render_turn(t["role"], t["text"])), "").alias("text"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(load(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT conv_id, row_number() OVER w AS k, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT conv_id, count(*) AS n, string_agg(line, '' ORDER BY k) AS whole FROM r GROUP BY conv_id),
p AS (SELECT r.conv_id, r.k, (SELECT string_agg(q.line, '' ORDER BY q.k) FROM r q WHERE q.conv_id = r.conv_id AND q.k <= r.k) AS prefix FROM r),
proper AS (SELECT DISTINCT p.k, p.prefix FROM p JOIN c ON p.conv_id = c.conv_id AND p.k < c.n)
SELECT min(c.conv_id) AS conv_id, c.n AS n_turns, count(*) AS n_logged, c.whole AS text
FROM c LEFT JOIN proper ON proper.k = c.n AND proper.prefix = c.whole
WHERE proper.k IS NULL GROUP BY c.n, c.whole
"""
