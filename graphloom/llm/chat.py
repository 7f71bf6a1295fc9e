"""Chat formatting by perspective rotation, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one output row; a longer dialogue goes on in the next chunk.
CHUNK = 64


def rotate_perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(conv, perspective, chunk, n_turns, rendered, mask, n_trained): each dialogue once for each of its speakers.

    The speaker's turns are rendered as the assistant's, other speakers' as those of users with their names; "system" is no speaker and keeps its part. mask lists the character ranges start-end of ``rendered`` that are trained on: the assistant's bodies with their end marks.
    Marks can't be forged: "<|" in a text or role and "|>" in a role get a backslash in the middle or in front, a line end in a role becomes a space.
    Turns are ordered by (turn, nulls first; role; text), so ties and repeated rows have a place; a null role is the speaker "unknown", a null text is empty, null conv ids form one dialogue. A dialogue of any length is cut into chunks of ``chunk`` turns, whose texts concatenated are the dialogue; one task never gathers more. A dialogue of system turns alone has no perspective; an empty table gives none.
    """
    base = turns.select(F.col(conv).alias("_c"), F.col(turn).alias("_t"), F.coalesce(F.col(role), F.lit("unknown")).alias("_r"), F.coalesce(F.col(text), F.lit("")).alias("_x")).withColumn("_b", F.coalesce(F.floor(F.col("_t") / chunk), F.lit(-(1 << 62))))
    before = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = base.groupBy("_c", "_b").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("_c").alias("_c2"), F.col("_b").alias("_b2"), "_start")
    rank = F.row_number().over(Window.partitionBy("_c", "_b").orderBy(F.col("_t").asc_nulls_first(), "_r", "_x")) - 1
    placed = base.withColumn("_k", rank).join(starts, F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_b") == F.col("_b2"))).withColumn("_k", F.col("_k") + F.col("_start")).select("_c", "_k", "_r", "_x")
    speakers = base.filter("_r <> 'system'").select(F.col("_c").alias("_c3"), F.col("_r").alias("_p")).distinct()
    plain = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("<\\|"))
    name = F.translate(F.replace(plain("_r"), F.lit("|>"), F.lit("\\|>")), "\n", " ")
    head = F.when(F.col("_r") == F.col("_p"), "<|assistant|>\n").when(F.col("_r") == "system", "<|system|>\n").otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    seen = placed.join(speakers, F.col("_c").eqNullSafe(F.col("_c3"))).withColumn("_chunk", F.floor(F.col("_k") / chunk)).withColumn("_head", head).withColumn("_body", F.concat(plain("_x"), F.lit("<|end|>\n")))
    own = Window.partitionBy("_c", "_p", "_chunk").orderBy("_k")
    seen = seen.withColumn("_to", F.sum(F.length("_head") + F.length("_body")).over(own)).withColumn("_from", F.col("_to") - F.length("_body"))
    trained = F.col("_r") == F.col("_p")
    parts = seen.groupBy("_c", "_p", "_chunk").agg(
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("_k", F.concat("_head", "_body").alias("s")))).alias("_s"),
        F.sort_array(F.collect_list(F.when(trained, F.struct("_k", F.concat_ws("-", "_from", "_to").alias("m"))))).alias("_m"),
        F.sum(F.when(trained, F.length("_body")).otherwise(0)).alias("n_trained"),
    )
    return parts.select(F.col("_c").alias(conv), F.col("_p").alias("perspective"), F.col("_chunk").cast("bigint").alias("chunk"), "n_turns", F.array_join("_s.s", "").alias("rendered"), F.array_join("_m.m", ",").alias("mask"), "n_trained")
