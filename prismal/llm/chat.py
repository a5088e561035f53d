"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and everyone else as a named user.  The rendering is
kept as one row per turn, so that a conversation of any length stays
distributed; the rows' texts in order, joined by nothing, are the rendering, and
each says where it starts and which characters are to be learned from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Speakers that give context and are never the assistant. Fixed values.
CONTEXT = ("system",)
#: Marks that begin and end a turn; inside texts they are written with blanks.
MARKS = r"<\|(im_start|im_end)\|>"
#: Blanks around names, as both regular expression dialects write them.
BLANK = r"[\s\x0B\x{85}\p{Z}]"
#: What a name writes otherwise, in this order; names that differ are written differently.
ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("<|im_start|>", "<\\|im_start|>"), ("<|im_end|>", "<\\|im_end|>"))
#: Turn numbers that one window covers; longer conversations are summed by such stretches first.
STRETCH = 512


def _stretch() -> Column:
    return F.floor(F.coalesce("turn", F.lit(-1)) / STRETCH)


def _starts(rows: DataFrame, key: list[str], size: Column) -> DataFrame:
    """Add ``start``, the sum of ``size`` over the earlier rows of ``key`` in turn order, and ``seq``.

    Sums run within stretches of turn numbers and over the stretches' totals,
    so no task holds a whole long conversation.
    """
    rows = rows.withColumn("_size", size).withColumn("_stretch", _stretch())
    totals = rows.groupBy(*key, "_stretch").agg(F.sum("_size").alias("_sum"), F.count("*").alias("_n"))
    before = W.partitionBy(*key).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*key, "_stretch", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_seq"))
    inside = W.partitionBy(*key, "_stretch").orderBy(F.col("turn").asc_nulls_first(), "speaker", "named", "body").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0))).withColumn("_k", F.count("*").over(inside))
    on = [rows[k].eqNullSafe(totals[k]) for k in (*key, "_stretch")]
    both = rows.join(totals, on)
    return both.select(*(rows[c] for c in rows.columns if c[0] != "_"), (F.col("_at") + F.col("_in")).alias("start"), (F.col("_seq") + F.col("_k")).alias("seq"))


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Render every conversation once for each participant.

    Returns a row per conversation, perspective and turn: ``conv_id``,
    ``perspective`` (the speaker shown as assistant), ``seq`` (place from 0),
    ``turn``, ``speaker``, ``role`` (assistant, user or system), ``segment``
    (rendered text), ``start`` (its first character in the whole rendering),
    ``mask_start`` and ``mask_end`` (characters of the rendering to learn from:
    text and end mark of the assistant's turns; else null) and ``mask``.

    Turns are ordered by number, then speaker, then text; equal rows stay as
    often as they come.  A null text is empty.  Blanks around a name, Unicode's
    included, do not count; names that differ otherwise are different speakers.  A null or
    blank speaker is shown as the user ``unknown`` and is no perspective; somebody of that
    name is one.  Names of context speakers count in any case.  Marks inside texts are written with
    blanks (``<| im_end |>``), marks, line ends and backslashes in names with
    backslashes, so no text forges a turn and no two speakers are shown alike.  Conversations without a participant (only
    context speakers) give no row; a null conversation id is a conversation of
    its own.  Other columns are ignored; an empty table gives an empty result.
    Turns of one conversation that share a number, or have none, are put in order by one task.
    """
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), MARKS, "<| $1 |>")
    name = shown = F.regexp_replace(F.coalesce(F.col(speaker_col), F.lit("")), rf"\A{BLANK}+|{BLANK}+\z", "")
    for mark, other in ESCAPES:
        shown = F.replace(shown, F.lit(mark), F.lit(other))
    said = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.when(name == "", "unknown").otherwise(shown).alias("speaker"), plain(F.col(text_col)).alias("body"), (name != "").alias("named"),
    ).withColumn("_stretch", _stretch())
    cast = said.filter(F.col("named") & ~F.lower("speaker").isin(*CONTEXT)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    # seats are dealt by stretch, so that no task gets all turns of a long conversation
    spans = said.select("conv_id", "_stretch").distinct()
    seats = spans.join(cast, spans["conv_id"].eqNullSafe(cast["conv_id"])).select(spans["*"], cast["perspective"])
    both = said.join(seats, said["conv_id"].eqNullSafe(seats["conv_id"]) & (said["_stretch"] == seats["_stretch"])).select(said["*"], seats["perspective"])
    role = F.when(F.lower("speaker").isin(*CONTEXT), "system").when(F.col("named") & (F.col("speaker") == F.col("perspective")), "assistant").otherwise("user")
    both = both.withColumn("role", role)
    head = F.concat(F.lit("<|im_start|>"), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(""), F.lit("\n"))
    segment = F.concat(head, F.col("body"), F.lit("<|im_end|>\n"))
    out = _starts(both, ["conv_id", "perspective"], F.length(segment))
    mine = F.col("role") == "assistant"
    return out.select(
        "conv_id", "perspective", "seq", "turn", "speaker", "role", segment.alias("segment"), "start",
        F.when(mine, F.col("start") + F.length(head)).alias("mask_start"),
        F.when(mine, F.col("start") + F.length(segment) - 1).alias("mask_end"), mine.cast("int").alias("mask"),
    )


def render_dialogues(rows: DataFrame) -> DataFrame:
    """Whole renderings, for conversations that fit a row: ``conv_id, perspective, n_turns, text, masks``.

    ``rows`` as ``rotate_perspectives`` gives them; ``masks`` lists (start, end)
    of the characters to learn from, in order.  A rendering is one value, so
    keep this to conversations of bounded length.
    """
    turn = F.struct("seq", "segment", "mask_start", "mask_end")
    each = rows.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")))
    return each.select("conv_id", "perspective", F.size("t").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("text"), spans.alias("masks"))


def perspectives_sql() -> str:
    """The rotation of table ``conversations`` as DuckDB SQL."""
    shown = "name"
    for mark, other in ESCAPES:
        mark = {"\n": "chr(10)", "\r": "chr(13)"}.get(mark, f"'{mark}'")
        shown = f"replace({shown}, {mark}, '{other}')"
    return f"""
WITH said AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN name = '' THEN 'unknown' ELSE {shown} END AS speaker, name <> '' AS named,
         regexp_replace(coalesce(text, ''), '{MARKS}', '<| \\1 |>', 'g') AS body
  FROM (SELECT *, regexp_replace(coalesce(role, ''), '\\A{BLANK}+|{BLANK}+\\z', '', 'g') AS name FROM conversations)),
parts AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE named AND lower(speaker) NOT IN ({", ".join(f"'{x}'" for x in CONTEXT)})),
both_ AS (
  SELECT s.*, p.perspective,
         CASE WHEN lower(s.speaker) IN ({", ".join(f"'{x}'" for x in CONTEXT)}) THEN 'system' WHEN s.named AND s.speaker = p.perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said s JOIN parts p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
headed AS (
  SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM both_),
placed AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS segment,
         row_number() OVER w - 1 AS seq,
         CAST(sum(length(head || body || '<|im_end|>' || chr(10))) OVER w AS BIGINT) - length(head || body || '<|im_end|>' || chr(10)) AS start
  FROM headed
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, named, body ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, speaker, role, segment, start,
       CASE WHEN role = 'assistant' THEN start + length(head) END AS mask_start,
       CASE WHEN role = 'assistant' THEN start + length(segment) - 1 END AS mask_end,
       CAST(role = 'assistant' AS INTEGER) AS mask
FROM placed"""
