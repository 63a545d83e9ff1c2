"""Preference formatting.

Turns of a chosen and a rejected conversation are compared from the first on (role and text). The longest common turn
prefix is rendered once as the prompt; the rest of each side becomes a completion, given as segments of which only the
assistant's words and end mark count for the loss. A pair's turns meet in one group: they become one training row.

Defined results: turns are in the order of turn, then role and text, so ties and repeated rows have a fixed place and
repeated rows stay; a null text is empty, a null role is 'user', and a null turn comes first; pairs with a null id form
one pair; a side without turns gives an empty completion and no prompt; equal sides give empty completions; extra
columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The marks of the chat format.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
LAST = 1 << 62


def _head(turn):
    return F.concat(F.lit(BEGIN), turn["role"], F.lit("\n"))


def render(turns):
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def segments(turns):
    """array of (text, loss): a turn's head never counts, its body only if the assistant speaks."""
    return F.flatten(F.transform(turns, lambda t: F.array(F.struct(_head(t).alias("text"), F.lit(False).alias("loss")), F.struct(F.concat(t["text"], F.lit(END)).alias("text"), (t["role"] == "assistant").alias("loss")))))


def format_preferences(turns: DataFrame) -> DataFrame:
    """turns: pair_id, side ('chosen' or 'rejected'), turn, role, text. A row per pair."""
    one = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = turns.groupBy("pair_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == s, one))).alias(s) for s in ("chosen", "rejected")])
    both = F.least(F.size("chosen"), F.size("rejected"))
    differs = lambda i: (F.col("chosen")[i]["role"] != F.col("rejected")[i]["role"]) | (F.col("chosen")[i]["text"] != F.col("rejected")[i]["text"])
    first = F.array_min(F.filter(F.when(both > 0, F.sequence(F.lit(0), both - 1)), differs))
    cut = sides.withColumn("n_common", F.coalesce(first, both).cast("long"))
    rest = {s: F.slice(s, F.col("n_common").cast("int") + 1, F.size(s) + 1) for s in ("chosen", "rejected")}
    return cut.select(
        "pair_id", "n_common", F.size("chosen").cast("long").alias("n_chosen"), F.size("rejected").cast("long").alias("n_rejected"),
        render(F.slice("chosen", 1, F.col("n_common").cast("int"))).alias("prompt"),
        render(rest["chosen"]).alias("chosen"), render(rest["rejected"]).alias("rejected"),
        segments(rest["chosen"]).alias("chosen_segments"), segments(rest["rejected"]).alias("rejected_segments"),
    )


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: chosen is a conversation up to its last assistant turn; rejected is the same with
    that turn taken from the neighbour (the id that differs in the lowest bit). Without an assistant turn both are whole."""
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("last", last)
    end = F.col("last").isNotNull() & (F.col("turn") == F.col("last")) & (F.col("role") == "assistant")
    kept = F.col("last").isNull() | (F.col("turn") <= F.col("last"))
    shown = F.array(
        F.when(kept, F.struct(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn")),
        F.when(kept & ~end, F.struct(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn")),
        F.when(end, F.struct(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.lit("rejected").alias("side"), F.lit(LAST).alias("turn"))),
    )
    return rows.select(F.explode(F.array_compact(shown)).alias("x"), "role", "text").select("x.pair_id", "x.side", "x.turn", "role", "text")


def digests(pairs: DataFrame) -> DataFrame:
    """One row per pair that has a chosen side: lengths and digests of the rendered texts."""
    loss = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + F.when(s["loss"], F.length(s["text"])).otherwise(0))
    return pairs.where("n_chosen > 0").select(
        "pair_id", "n_common", "n_chosen", "n_rejected", F.md5("prompt").alias("prompt_md5"), F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"),
        loss(F.col("chosen_segments")).alias("chosen_loss_chars"), loss(F.col("rejected_segments")).alias("rejected_loss_chars"),
    )


SQL = f"""
WITH w AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text, role AS raw,
    max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations),
k AS (SELECT *, last IS NOT NULL AND turn = last AND raw = 'assistant' AS ends FROM w WHERE last IS NULL OR turn <= last),
s AS (SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM k
  UNION ALL SELECT conv_id, 'rejected', turn, role, text FROM k WHERE NOT ends
  UNION ALL SELECT xor(conv_id, 1), 'rejected', {LAST}, role, text FROM k WHERE ends),
g AS (SELECT pair_id, coalesce(list({{'role': role, 'text': text}} ORDER BY turn, role, text) FILTER (side = 'chosen'), []) AS c,
    coalesce(list({{'role': role, 'text': text}} ORDER BY turn, role, text) FILTER (side = 'rejected'), []) AS r FROM s GROUP BY pair_id),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])) - 1, least(len(c), len(r))) AS m FROM g WHERE len(c) > 0),
p AS (SELECT pair_id, m, c, r, list_filter(c, lambda x, i: i <= m) AS a, list_filter(c, lambda x, i: i > m) AS cc, list_filter(r, lambda x, i: i > m) AS rr FROM n)
SELECT pair_id, m AS n_common, len(c) AS n_chosen, len(r) AS n_rejected,
  md5(array_to_string(list_transform(a, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '')) AS prompt_md5,
  md5(array_to_string(list_transform(cc, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '')) AS chosen_md5,
  md5(array_to_string(list_transform(rr, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '')) AS rejected_md5,
  coalesce(list_sum(list_transform(cc, lambda x: CASE WHEN x.role = 'assistant' THEN length(x.text) + 11 ELSE 0 END)), 0)::BIGINT AS chosen_loss_chars,
  coalesce(list_sum(list_transform(rr, lambda x: CASE WHEN x.role = 'assistant' THEN length(x.text) + 11 ELSE 0 END)), 0)::BIGINT AS rejected_loss_chars
FROM p
"""
