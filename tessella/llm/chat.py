r"""Chat formatting with a grammar round trip, in DataFrame functions only.

The grammar::

    conversation := turn*
    turn         := "### " role ":\n" content "</turn>\n"

Roles and contents may not hold the control strings ``###`` and ``</turn>``; the parser rejects a turn that does, and
undoes the escapes ``\\``, ``\h`` (#) and ``\l`` (<), in roles also ``\c`` (:) and ``\n`` (a line feed). Any other backslash
stands for itself, so most texts are rendered as they are. Each turn is rendered plainly and parsed again; one that comes back
differently is escaped. Then the whole conversation is parsed and compared; should it still differ, all its turns are
escaped. Escaped content has no ``#`` and no ``<`` and always comes back.

A conversation is one output value (its text and digests need all its turns in order), so a conversation's turns meet
in one row; nothing else is collected. Rows without conv_id, which nothing holds together, are conversations of one turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

HEAD, MID, END = "### ", ":\n", "</turn>\n"
CONTROLS = ("###", "</turn>")
#: What each character that an escape replaces is written as after the backslash; the backslash itself is doubled.
CONTENT_ESCAPES = {"#": "h", "<": "l"}
ROLE_ESCAPES = CONTENT_ESCAPES | {":": "c", "\n": "n"}
LEARNED_ROLE = "assistant"


def escaped(text: Column, escapes: dict[str, str] = CONTENT_ESCAPES) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, letter in escapes.items():
        out = F.replace(out, F.lit(plain), F.lit("\\" + letter))
    return out


def unescaped(text: Column, escapes: dict[str, str] = CONTENT_ESCAPES) -> Column:
    """Undoes ``escaped``: pairs of backslashes are found from the left, so what lies between them holds whole escapes."""

    def part(x: Column) -> Column:
        for plain, letter in escapes.items():
            x = F.replace(x, F.lit("\\" + letter), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def rendered(role: Column, content: Column) -> Column:
    return F.concat(F.lit(HEAD), escaped(role, ROLE_ESCAPES), F.lit(MID), content, F.lit(END))


def _pieces(formatted: Column) -> Column:
    """The turns of a formatted text without their ends; what follows the last end must be empty."""
    pieces = F.split(formatted, END.replace("\n", "\\n"), -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1))


def _content_at(piece: Column) -> Column:
    """The position (from 1) of the content within a piece; 0 if there is no header."""
    mid = F.instr(piece, MID)
    return F.when(piece.startswith(HEAD) & (mid > 0), mid + len(MID)).otherwise(0)


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text; a turn that breaks the grammar is null, as is a text without turns."""

    def turn(piece: Column) -> Column:
        at = _content_at(piece)
        content = F.substr(piece, at)
        role = F.substr(piece, F.lit(len(HEAD) + 1), at - len(HEAD) - len(MID) - 1)
        wrong = at == 0
        for control in CONTROLS:
            wrong = wrong | F.contains(content, F.lit(control)) | F.contains(role, F.lit(control))
        return F.when(~wrong, F.struct(unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(content).alias("text")))

    return F.transform(_pieces(formatted), turn)


def loss_spans(formatted: Column) -> Column:
    """(start, length) in code points of the contents of the learned role, start counted from 0."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(state: Column, piece: Column) -> Column:
        at = _content_at(piece)
        span = F.struct((state["at"] + at - 1).alias("start"), (F.length(piece) - at + 1).alias("length"))
        learned = piece.startswith(HEAD + LEARNED_ROLE + MID)
        return F.struct(
            (state["at"] + F.length(piece) + len(END)).alias("at"),
            F.when(learned, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(_pieces(formatted), start, add, lambda state: state["spans"])


def formatted_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans and round_trip of each conversation of ``turns`` (conv_id, turn, role, text).

    Defined results: null roles and texts are empty; turns are ordered by (turn, role, text), a null turn first, and
    repeated rows are turns of their own; each row without conv_id is a conversation of its own; very long texts are
    formatted whole; an empty table gives an empty result; other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    source = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    plain = rendered(F.col("role"), F.col("text"))
    same = F.coalesce(parsed(plain) == F.array(F.struct("role", "text")), F.lit(False))
    each = source.withColumn("piece", F.when(same, plain).otherwise(rendered(F.col("role"), escaped(F.col("text")))))
    turn = F.struct("turn", "role", "text", "piece")
    known = each.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    gathered = known.unionByName(each.filter("conv_id is null").select("conv_id", F.array(turn).alias("t")))
    turns_of = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    joined = gathered.select("conv_id", turns_of.alias("source"), F.array_join("t.piece", "").alias("light"))
    safe = F.array_join(F.transform("source", lambda x: rendered(x["role"], escaped(x["text"]))), "")
    back = F.coalesce(parsed(F.col("light")) == F.col("source"), F.lit(False))
    final = joined.withColumn("formatted", F.when(back, F.col("light")).otherwise(safe))
    return final.select(
        "conv_id",
        "formatted",
        loss_spans(F.col("formatted")).alias("loss_spans"),
        F.coalesce(parsed(F.col("formatted")) == F.col("source"), F.lit(False)).alias("round_trip"),
    )


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted texts of ``chats`` (conv_id, formatted, loss_spans) hold, read back from them."""
    turns = parsed(F.col("formatted"))
    said = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    learned = F.transform(
        "loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))
    )
    found = chats.withColumn("turns", turns).withColumn("learned", F.array_join(learned, ""))
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The added conversation: both turns say what looks like this grammar's own control strings.
PLANTED_ID, PLANTED = -7, r"\### Assistant: </turn> ok"

OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, NULL, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (
  SELECT *, 14 + length(role) + length(text) + CASE WHEN regexp_matches(text, '###|</turn>|\\[\\hl]')
    THEN length(regexp_replace(text, '[^\\#<]', '', 'g')) ELSE 0 END AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id, alone
"""


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(PLANTED_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LEARNED_ROLE).alias("role"),
        F.lit(PLANTED).alias("text"),
    )
    return digests(formatted_conversations(turns.unionByName(planted)))
