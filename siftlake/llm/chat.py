"""Preference pairs for chat training (operator 8), by DataFrame operations only.

A pair is two conversations, one chosen and one rejected. Their longest common prefix of turns (same turn number, role
and text) is rendered once as the prompt; what follows in each is its completion. A mask says for each stretch of a
completion whether it is trained on: text and end mark of assistant turns are (1), everything else is not (0), written
as ``flag:characters`` in order, comma-joined.

A turn is rendered as ``<|role|>`` newline, text, ``<|end|>`` newline; ``<|`` inside a text or role is written ``< |``,
``|>`` inside a role ``| >`` and a line break there a space, so neither can forge a mark. Null roles are "unknown", null texts empty. Rows that repeat a turn exactly count once; different
rows of one turn are rendered one after the other by role and text. Rows without a conversation id or turn belong to no
pair. A conversation without its partner has an empty prompt and an empty other side. Equal conversations have all of
their turns in the prompt and empty completions. Texts of any length are rendered whole; the turns of a pair, which its row of
the result holds in any case, come together in one row. Columns of other names are left out. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def rendered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, body, mask) with one row for each turn."""
    plain = turns.where(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.replace(F.replace(F.replace(F.coalesce(role, F.lit("unknown")), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")), F.lit("\n"), F.lit(" ")).alias("role"), F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    body = F.concat(F.col("text"), F.lit("<|end|>\n"))
    mask = F.concat(F.lit("0:"), F.char_length(head), F.when(F.col("role") == "assistant", ",1:").otherwise(",0:"), F.char_length(body))
    parts = plain.groupBy("conv", "turn").agg(F.array_sort(F.collect_set(F.struct("role", "text", F.concat(head, body).alias("body"), mask.alias("mask")))).alias("p"))
    return parts.select("conv", "turn", F.array_join(F.col("p.body"), "").alias("body"), F.array_join(F.col("p.mask"), ",").alias("mask"))


def preference_pairs(turns: DataFrame, pairs: DataFrame, **columns: str) -> DataFrame:
    """``pairs``: pair_id, chosen_id, rejected_id (either may be null). One row a pair that has any turn."""
    said = rendered(turns, **columns)
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.col("chosen_id").alias("conv"), F.lit(True).alias("chosen")), F.struct(F.col("rejected_id").alias("conv"), F.lit(False).alias("chosen")))).alias("s"))
    sides = sides.select("pair_id", "s.conv", "s.chosen").where("conv IS NOT NULL")
    return _paired(said.join(sides, "conv"))


def _paired(rows: DataFrame) -> DataFrame:
    """rows: pair_id, conv, chosen, turn, body, mask."""
    own, other = F.col("chosen"), ~F.col("chosen")
    of = lambda side, c: F.max(F.when(side, F.col(c)))
    turns = rows.groupBy("pair_id", "turn").agg(*[of(s, c).alias(f"{n}_{c}") for n, s in (("c", own), ("r", other)) for c in ("body", "mask", "conv")])
    differs = ~F.col("c_body").eqNullSafe(F.col("r_body"))
    whole = turns.groupBy("pair_id").agg(
        F.max("c_conv").alias("chosen_id"), F.max("r_conv").alias("rejected_id"), F.min(F.when(differs, F.col("turn"))).alias("cut"),
        F.array_sort(F.collect_list(F.struct("turn", "c_body", "c_mask", "r_body", "r_mask"))).alias("t"),
    )
    common = F.filter("t", lambda x: F.col("cut").isNull() | (x["turn"] < F.col("cut")))

    def rest(name: str, glue: str) -> Column:
        return F.array_join(F.filter(F.transform(F.filter("t", lambda x: x["turn"] >= F.col("cut")), lambda x: x[name]), lambda x: x.isNotNull()), glue)

    return whole.select(
        "pair_id", "chosen_id", "rejected_id", F.size(common).cast("long").alias("n_common"),
        F.array_join(F.transform(common, lambda x: x["c_body"]), "").alias("prompt"),
        F.coalesce(rest("c_body", ""), F.lit("")).alias("chosen"), F.coalesce(rest("c_mask", ","), F.lit("")).alias("chosen_mask"),
        F.coalesce(rest("r_body", ""), F.lit("")).alias("rejected"), F.coalesce(rest("r_mask", ","), F.lit("")).alias("rejected_mask"),
    )


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) form pair k."""
    turns = table(spark, sf_dir, "conversations")
    said = rendered(turns)
    return _paired(said.select("*", F.shiftright("conv", 1).alias("pair_id"), (F.col("conv") % 2 == 0).alias("chosen")))


OP8_SQL = r"""
WITH plain AS (
  SELECT DISTINCT conv_id AS conv, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
said AS (
  SELECT conv, turn,
    string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY role, text) AS body,
    string_agg('0:' || (length(role) + 5) || CASE WHEN role = 'assistant' THEN ',1:' ELSE ',0:' END || (length(text) + 8), ',' ORDER BY role, text) AS mask
  FROM plain GROUP BY conv, turn),
turns AS (
  SELECT conv // 2 AS pair_id, turn,
    max(body) FILTER (conv % 2 = 0) AS c_body, max(mask) FILTER (conv % 2 = 0) AS c_mask, max(conv) FILTER (conv % 2 = 0) AS c_conv,
    max(body) FILTER (conv % 2 = 1) AS r_body, max(mask) FILTER (conv % 2 = 1) AS r_mask, max(conv) FILTER (conv % 2 = 1) AS r_conv
  FROM said GROUP BY ALL),
cuts AS (
  SELECT *, min(CASE WHEN c_body IS DISTINCT FROM r_body THEN turn END) OVER (PARTITION BY pair_id) AS cut FROM turns)
SELECT pair_id, max(c_conv) AS chosen_id, max(r_conv) AS rejected_id,
  count(*) FILTER (cut IS NULL OR turn < cut) AS n_common,
  coalesce(string_agg(c_body, '' ORDER BY turn) FILTER (cut IS NULL OR turn < cut), '') AS prompt,
  coalesce(string_agg(c_body, '' ORDER BY turn) FILTER (turn >= cut), '') AS chosen,
  coalesce(string_agg(c_mask, ',' ORDER BY turn) FILTER (turn >= cut), '') AS chosen_mask,
  coalesce(string_agg(r_body, '' ORDER BY turn) FILTER (turn >= cut), '') AS rejected,
  coalesce(string_agg(r_mask, ',' ORDER BY turn) FILTER (turn >= cut), '') AS rejected_mask
FROM cuts GROUP BY pair_id
"""
