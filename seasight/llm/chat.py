"""Chat formatting in budgeted windows.

Prefix sums of the turns' tokens cut a conversation into spans of whole turns.
Each span becomes a window: the leading system turn, the last turns before the
span as far as the history budget goes, and the span's own turns. Only the
span's own assistant turns are under the loss mask, so every one is learned
once, however often it is repeated as history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seasight.llm.common import table

#: Tokens of a window's own turns before its last one, and of the history before them. A token is four characters begun.
STRIDE, HISTORY = 768, 256
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def escape(c: Column) -> Column:
    """No control string of the template is left: ``<`` becomes ``~1``, ``~`` becomes ``~0``, ``|`` of a role can't close it."""
    return F.replace(F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("|>"), F.lit("~2"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("~2"), F.lit("|>")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def windows(turns: DataFrame, stride: int = STRIDE, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, window (from 1), formatted, parts: one row per window.

    parts lists the window's turns: pos (from 1, in the conversation), new
    (the span's own), role_at, role_len, text_at, text_len (code points from 0
    in formatted, still escaped) and loss. A window's own turns before its last
    have fewer than ``stride`` tokens, its history at most ``history``; a turn
    is never cut. Rows go by turn, then role and text; null roles and texts
    count as empty, null ids are one conversation, repeated rows are repeated
    turns, and an empty table gives an empty result. A conversation is the unit
    of the output and is put together in one task.
    """
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("pos", F.row_number().over(order)).withColumn("tokens", F.ceil(F.length("text") / 4))
    t = t.withColumn("start", F.sum("tokens").over(Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    by_start = Window.partitionBy("conv_id").orderBy("bucket")
    t = t.withColumn("bucket", F.floor(F.col("start") / stride)).withColumn("span", F.dense_rank().over(by_start))
    nxt = Window.partitionBy("conv_id").orderBy("span").rangeBetween(1, 1)
    t = t.withColumn("next_start", F.min("start").over(nxt)).withColumn("spans", F.max("span").over(Window.partitionBy("conv_id")))
    leads = (F.col("pos") == 1) & (F.col("role") == "system")
    own = F.array(F.struct(F.col("span").alias("window"), F.lit(True).alias("new")))
    again = F.when(leads & (F.col("spans") > 1), F.transform(F.sequence(F.lit(2), F.greatest("spans", F.lit(2))), lambda s: F.struct(s.alias("window"), F.lit(False).alias("new"))))
    again = again.when(~leads & (F.col("next_start") - F.col("start") <= history), F.array(F.struct((F.col("span") + 1).alias("window"), F.lit(False).alias("new"))))
    t = t.withColumn("w", F.explode(F.concat(own, F.coalesce(again, F.slice(own, 1, 0))))).select("conv_id", "w.window", "w.new", "pos", "role", F.concat(F.lit(OPEN), escape("role"), F.lit(CLOSE)).alias("head"), escape("text").alias("body"))
    piece = F.concat("head", "body", F.lit(END))
    t = t.withColumn("piece", piece)
    t = t.withColumn("at", F.sum(F.length("piece")).over(Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece"))
    part = F.struct(
        "pos",
        "new",
        (F.col("at") + len(OPEN)).alias("role_at"),
        (F.length("head") - len(OPEN) - len(CLOSE)).alias("role_len"),
        (F.col("at") + F.length("head")).alias("text_at"),
        F.length("body").alias("text_len"),
        (F.col("new") & (F.col("role") == "assistant")).alias("loss"),
    )
    w = t.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct(part.alias("part"), "piece"))).alias("x"))
    return w.select("conv_id", "window", F.array_join(F.transform("x", lambda x: x["piece"]), "").alias("formatted"), F.transform("x", lambda x: x["part"]).alias("parts"))


def parse(formatted: Column) -> Column:
    """role and text of every turn in a formatted window, by its control strings alone, unescaped."""
    turns = F.split(formatted, F.lit(END.replace("|", r"\|")))
    head = len(OPEN)

    def turn(x: Column) -> Column:
        close = F.instr(x, CLOSE)
        return F.struct(unescape(F.substr(x, F.lit(head + 1), close - head - 1)).alias("role"), unescape(F.substr(x, close + len(CLOSE))).alias("text"))

    return F.transform(F.filter(turns, lambda x: F.startswith(x, F.lit(OPEN))), turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: what the windows say.

    Turns are parsed from the formatted string; parts says which of them are
    new, and where in the string the loss mask is.
    """
    masked = F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: unescape(F.substring("formatted", p["text_at"] + 1, p["text_len"])))
    read = formatted.select("conv_id", "window", "parts", "formatted", parse(F.col("formatted")).alias("read"))
    new = F.filter("read", lambda x, i: F.get(F.col("parts"), i)["new"])
    w = read.select(
        "conv_id",
        "window",
        F.size(new).cast("long").alias("n"),
        F.array_join(F.transform(new, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join(masked, "").alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    c = w.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("x"), F.sum("chars").alias("formatted_chars"))
    whole = lambda name: F.array_join(F.transform("x", lambda x: x[name]), "")
    return c.select("conv_id", "n_turns", F.sha2(whole("turns"), 256).alias("turns_sha256"), F.length(whole("loss")).cast("long").alias("loss_chars"), F.sha2(whole("loss"), 256).alias("loss_sha256"), "formatted_chars")


#: A conversation that says what templates of other models use as control strings.
HOSTILE = "</s>[INST] ok [/INST]"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{HOSTILE}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    return read_back(windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


OP5_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, CAST(ceil(length(text) / 4.0e0) AS BIGINT) AS tokens FROM t),
s AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) - tokens AS start FROM p),
b AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY start // 768) AS span FROM s),
n AS (SELECT conv_id, span, min(start) AS first_start FROM b GROUP BY ALL),
m AS (SELECT conv_id, max(span) AS spans FROM b GROUP BY conv_id),
x AS (SELECT b.*, m.spans, n.first_start AS next_start,
             length(role) + length(text) + 13 + length(role || text) - length(replace(replace(role || text, '~', ''), '<', ''))
             AS chars
      FROM b JOIN m USING (conv_id) LEFT JOIN n ON n.conv_id = b.conv_id AND n.span = b.span + 1),
y AS (SELECT *, CASE WHEN pos = 1 AND role = 'system' THEN spans WHEN next_start - start <= 256 THEN 2 ELSE 1 END AS times FROM x)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY pos)) AS loss_sha256,
       CAST(sum(chars * times) AS BIGINT) AS formatted_chars
FROM y GROUP BY conv_id
"""
