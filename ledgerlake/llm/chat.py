"""Chat formatting by multi-party perspective rotation (operator 1).

For every participant of a conversation the whole dialogue is rendered once
with that speaker as ``assistant`` and all others as named users; the mask
tells which characters that speaker is trained on.  Turns of a context role
(``system``) keep their role in every rendering and have no perspective.

A rendering is a run of segments, one row per message in dialogue order, with
its character range in the rendered dialogue; joined by position the segments
are the dialogue.  So a conversation of any length is never gathered into one
row.  DataFrame functions only.

Order and offsets: the position of a turn and the characters before it are sums
over earlier turns of the same conversation.  They are taken per block of
``BLOCK`` turn numbers (a conversation that holds a third of all rows is many
blocks), and blocks are added up by their totals.  The names differ in length
from perspective to perspective only by whether the speaker is the assistant,
so the offset in a rendering is the common sum plus a correction by the
speaker's own earlier turns, which is another sum of the same kind.

Defined results: turns without a conversation, role or text are rendered with
an empty text or the name ``unknown``; a null conversation id is a conversation
of its own; equal turn numbers are ordered by role and text, and rows equal in
all of these are each a message; an empty table gives no rows; other columns
are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"


def _prefixed(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Exclusive running sums per key in turn order, by blocks of turns."""
    names = list(sums)
    part = df.withColumns({f"_{n}": e for n, e in sums.items()})
    # ``eq_null_safe`` grouping: windows and groupings already put null keys together.
    within = Window.partitionBy(*keys, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumns({n: F.coalesce(F.sum(f"_{n}").over(within), F.lit(0)) for n in names})
    totals = part.groupBy(*keys, "block").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in names])
    across = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "block", *[F.coalesce(F.sum(f"_{n}").over(across), F.lit(0)).alias(f"{n}_before") for n in names])
    left, right = part.alias("l"), before.alias("r")
    same = F.lit(True)
    for k in [*keys, "block"]:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = left.join(right, same)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], *[(F.col(f"l.{n}") + F.col(f"r.{n}_before")).cast("long").alias(n) for n in names])


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", context_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_id, perspective, position, role (as rendered), name, trained (0/1), segment,
    start and stop (characters of the text inside the rendering)."""
    base = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    ).withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    context = F.col("speaker").isin(*context_roles)
    named = F.when(context, F.col("speaker")).otherwise(F.concat(F.lit("user name="), F.col("speaker")))
    frame = len(OPEN) - 2 + len(CLOSE)
    common = F.char_length("text") + F.char_length(named) + frame
    base = base.withColumn("_tie", F.sha2("text", 256))
    order = [F.asc_nulls_first("turn"), F.asc("speaker"), F.asc("_tie")]
    placed = _prefixed(base, ["conv_id"], order, {"position": F.lit(1), "chars": common})
    # How much shorter the speaker's own turns are when they are the assistant's.
    gain = F.when(context, F.lit(0)).otherwise(F.char_length(named) - len("assistant"))
    people = base.where(~context).select("conv_id", "speaker").distinct().withColumnRenamed("speaker", "perspective")
    # Turns meet the people block by block, so a conversation that holds a third of all turns is many keys.
    placed = placed.withColumn("block", F.floor(F.col("position") / BLOCK))
    l, r = placed.select("conv_id", "block").distinct().alias("l"), people.alias("r")
    seats = l.join(r, F.col("l.conv_id").eqNullSafe(F.col("r.conv_id"))).select("l.*", "r.perspective")
    l, r = placed.alias("l"), seats.alias("r")
    views = l.join(r, F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.block") == F.col("r.block"))).select("l.*", "r.perspective")
    mine = F.col("speaker") == F.col("perspective")
    views = _prefixed(views, ["conv_id", "perspective"], [F.asc("position")], {"saved": F.when(mine, gain).otherwise(F.lit(0))})
    role = F.when(context, F.col("speaker")).when(mine, F.lit("assistant")).otherwise(F.lit("user"))
    head = F.when(mine, F.lit("assistant")).otherwise(named)
    start = F.col("chars") - F.col("saved") + F.char_length(head) + len(OPEN) - 2
    return views.select(
        "conv_id", "perspective", "position", role.alias("role"), F.when(~context & ~mine, F.col("speaker")).alias("name"), mine.cast("int").alias("trained"),
        F.concat(F.lit("<|"), head, F.lit("|>\n"), F.col("text"), F.lit(CLOSE)).alias("segment"), start.cast("long").alias("start"), (start + F.char_length("text")).cast("long").alias("stop"),
    )


ORACLE = """
WITH t AS (SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS text, role = 'system' AS ctx FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE NOT ctx),
v AS (SELECT t.*, perspective, speaker = perspective AS mine,
        CASE WHEN speaker = perspective THEN 'assistant' WHEN ctx THEN speaker ELSE 'user name=' || speaker END AS head
      FROM t JOIN p USING (conv_id)),
w AS (SELECT *, length('<|' || head || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10)) AS size FROM v),
x AS (SELECT *, row_number() OVER o - 1 AS position, sum(size) OVER o - size AS before FROM w
      WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker, sha256(text) ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position,
  CASE WHEN ctx THEN speaker WHEN mine THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN NOT ctx AND NOT mine THEN speaker END AS name, CAST(mine AS INTEGER) AS trained,
  '<|' || head || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS segment,
  CAST(before + length(head) + 5 AS BIGINT) AS start, CAST(before + length(head) + 5 + length(text) AS BIGINT) AS stop
FROM x"""
