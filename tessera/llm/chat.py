"""Chat formatting: a dialogue rendered once for every participant, with that speaker as the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template. A turn is OPEN, a role line, the text and CLOSE; OPEN and CLOSE can't occur within a text.
OPEN, CLOSE, END_OF_ROLE = "<|", "<|end|>\n", "|>\n"
SYSTEM = "system"


def _safe(text: Column) -> Column:
    """No text may open or close a turn."""
    return F.replace(text, F.lit(OPEN), F.lit("< |"))


def perspectives(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = SYSTEM
) -> DataFrame:
    """Render each conversation from the side of every participant.

    Participants are the speakers except `system`, whose turns are context in each rendering. The participant's turns
    open with assistant, other speakers' with user and their name; the mask trains on the participant's texts and the
    marks that close them. Turns go by turn number, then speaker, then text; repeated rows are repeated turns. There is
    one row for each participant of a conversation, whatever its length: as the dialogue is that row, a task holds the
    turns of one conversation, and they must fit a row (2 GB). Turns are shuffled once; participants are read off them.
    A row without a conversation id is a conversation of its own.

    Returns the conversation id, perspective, rendered, n_turns, n_chars, n_train_chars (long) and mask: runs of
    characters, u (untrained) or t (trained) with their lengths, comma-joined. A null speaker is named "unknown"; a null
    turn number comes first; a null text is empty. Conversations of system turns alone give no row. Other columns are
    left out. An empty table gives an empty one.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("__conv"),
        F.struct(
            F.col(f"`{turn_col}`").alias("n"),
            F.coalesce(F.col(f"`{speaker_col}`").cast("string"), F.lit("unknown")).alias("who"),
            F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("said"),
        ).alias("__turn"),
    )
    whole = rows.where("__conv IS NOT NULL").groupBy("__conv").agg(F.array_sort(F.collect_list("__turn")).alias("__turns"))
    each = whole.unionByName(rows.where("__conv IS NULL").select("__conv", F.array("__turn").alias("__turns")))
    people = F.filter(F.array_distinct(F.transform("__turns", lambda t: t["who"])), lambda who: who != system)
    each = each.select("__conv", "__turns", F.explode(people).alias("perspective"))
    me = F.col("perspective")

    def head(t: Column) -> Column:
        role = F.when(t["who"] == system, F.lit("system")).when(t["who"] == me, F.lit("assistant"))
        return F.concat(F.lit(OPEN), role.otherwise(F.concat(F.lit("user name="), _safe(t["who"]))), F.lit(END_OF_ROLE))

    spoken = F.transform(
        "__turns", lambda t: F.struct(head(t).alias("head"), F.concat(_safe(t["said"]), F.lit(CLOSE)).alias("body"), (t["who"] == me).alias("own"))
    )
    each = each.select("__conv", "perspective", spoken.alias("__parts"))
    text = F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"])), "")
    runs = F.transform(
        "__parts",
        lambda p: F.when(p["own"], F.concat(F.lit("u"), F.length(p["head"]), F.lit(",t"), F.length(p["body"]))).otherwise(
            F.concat(F.lit("u"), F.length(p["head"]) + F.length(p["body"]))
        ),
    )
    trained = F.aggregate("__parts", F.lit(0).cast("long"), lambda s, p: s + F.when(p["own"], F.length(p["body"])).otherwise(0))
    out = each.select(
        F.col("__conv").alias(conv_col),
        "perspective",
        text.alias("rendered"),
        F.size("__parts").cast("long").alias("n_turns"),
        trained.alias("n_train_chars"),
        F.array_join(runs, ",").alias("mask"),
    )
    return out.withColumn("n_chars", F.length("rendered").cast("long"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select(
        "conv_id", "perspective", "n_turns", "n_chars", "n_train_chars", "mask", F.sha2(F.encode("rendered", "UTF-8"), 256).alias("rendered_sha256")
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS said FROM conversations
), p AS (
  SELECT DISTINCT conv_id, who AS perspective FROM t WHERE who <> 'system'
), parts AS (
  SELECT p.conv_id, p.perspective, t.turn, t.who, t.said, t.who = p.perspective AS own,
    '<|' || CASE WHEN t.who = 'system' THEN 'system' WHEN t.who = p.perspective THEN 'assistant'
                 ELSE 'user name=' || replace(t.who, '<|', '< |') END || '|>' || chr(10) AS head,
    replace(t.said, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM p JOIN t ON p.conv_id = t.conv_id
)
SELECT conv_id, perspective, count(*) AS n_turns, sum(length(head) + length(body))::BIGINT AS n_chars,
  coalesce(sum(length(body)) FILTER (WHERE own), 0)::BIGINT AS n_train_chars,
  string_agg(CASE WHEN own THEN 'u' || length(head) || ',t' || length(body)
                  ELSE 'u' || (length(head) + length(body)) END, ',' ORDER BY turn, who, said) AS mask,
  sha256(string_agg(head || body, '' ORDER BY turn, who, said)) AS rendered_sha256
FROM parts GROUP BY conv_id, perspective
"""
