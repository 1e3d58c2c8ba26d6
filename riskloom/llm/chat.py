"""Chat formatting: conversations as one text each, with a loss mask, and back.

A conversation's turns are collected as structs and sorted, neighbours of one
role are merged, and all is put together by array expressions alone:

    <turn>user<says>first text</turn>
    <turn>assistant<says>one text<next>another of the same role</turn>

A mark that a text or a role holds itself is escaped by a backslash after its
``<``, and one that is escaped already by one more, so that no mark ever comes
from a text and reading back gives every turn as it was, merged or not.

The loss mask is a list of runs, (skip, chars, loss), one per text: ``skip``
code points of marks since the last run, then ``chars`` that count or not.
Writing and reading take time in proportion to the text, whatever the number
of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import let

OPEN, SAYS, NEXT, CLOSE = "<turn>", "<says>", "<next>", "</turn>"
LEARNED = ("assistant",)
#: What follows ``<`` in a mark.
NAMES = "turn>|says>|next>|/turn>"
#: Ends a turn's line.
GAP = "\n"
#: All that stands between two texts.
BETWEEN = f"(?:{CLOSE}{GAP})?{OPEN}(?s:.*?){SAYS}|{NEXT}|{CLOSE}{GAP}"


def escaped(text: Column) -> Column:
    """``text`` with one more backslash in each mark, escaped or not."""
    return F.regexp_replace(text, rf"<(\\*)({NAMES})", r"<\\$1$2")


def unescaped(text: Column) -> Column:
    """The text that ``escaped`` made this of."""
    return F.regexp_replace(text, rf"<\\(\\*)({NAMES})", "<$1$2")


def collected(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, turns): the turns of each conversation, escaped, in order of turn, role and text."""
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = turns.select(F.col(key).alias("key"), one.alias("one"))
    gathered = rows.groupBy("key").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    plain = F.transform("turns", lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text")))
    return gathered.select("key", plain.alias("turns"))


def merged(turns: Column) -> Column:
    """array<(role, texts)>: neighbours of one role as one entry with all their texts."""
    last = F.size(turns) - 1
    begins = F.filter(
        F.sequence(F.lit(0), last), lambda k: (k == 0) | (F.get(turns, k)["role"] != F.get(turns, k - 1)["role"])
    )
    return let(
        begins,
        lambda starts: F.transform(
            starts,
            lambda start, nth: F.struct(
                F.get(turns, start)["role"].alias("role"),
                F.transform(
                    F.slice(turns, start + 1, F.coalesce(F.get(starts, nth + 1), last + 1) - start), lambda t: t["text"]
                ).alias("texts"),
            ),
        ),
    )


def format_chats(
    turns: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learned: tuple[str, ...] = LEARNED,
) -> DataFrame:
    """(key, formatted, loss) of every conversation; ``loss`` is array<(skip long, chars long, loss boolean)>.

    Turns stand in ascending order of ``turn``, null first; equal ones by role
    and text, and repeated rows stay repeated. A null role or text is empty. A
    conversation without key is one of its own. Only the texts of ``learned``
    roles are under the mask, not the marks around and between them. An empty
    table gives no rows. Other columns are not read.
    """
    rows = collected(turns, key, turn, role, text).select("key", merged(F.col("turns")).alias("merged"))
    written = F.transform(
        "merged",
        lambda m: F.concat(F.lit(OPEN), m["role"], F.lit(SAYS), F.array_join(m["texts"], NEXT), F.lit(CLOSE + GAP)),
    )

    def runs(m: Column, nth: Column) -> Column:
        lead = F.char_length(m["role"]) + F.when(nth == 0, len(OPEN + SAYS)).otherwise(len(CLOSE + GAP + OPEN + SAYS))
        return F.transform(
            m["texts"],
            lambda t, k: F.struct(
                F.when(k == 0, lead).otherwise(len(NEXT)).cast("long").alias("skip"),
                F.char_length(t).cast("long").alias("chars"),
                m["role"].isin(*learned).alias("loss"),
            ),
        )

    return rows.select(
        F.col("key").alias(key),
        F.array_join(written, "").alias("formatted"),
        F.flatten(F.transform("merged", runs)).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """array<(role, text)>: the turns of a formatted text, each as it was before it was merged and escaped."""
    pieces = F.filter(F.split(formatted, CLOSE + GAP), lambda p: p != "")

    def of(piece: Column) -> Column:
        return let(
            F.split(F.substring(piece, len(OPEN) + 1, (1 << 31) - 1), SAYS),
            lambda two: F.transform(
                F.split(F.get(two, F.lit(1)), NEXT),
                lambda t: F.struct(unescaped(F.get(two, F.lit(0))).alias("role"), unescaped(t).alias("text")),
            ),
        )

    return F.flatten(F.transform(pieces, of))


def learned_texts(formatted: Column, loss: Column) -> Column:
    """array<string>: what a formatted text has under its loss mask, unescaped.

    Each run of the mask is a text between marks, so the text is cut there and
    each piece stands beside its run. Null where mask and text do not agree.
    """
    cut = F.split(formatted, BETWEEN)
    pieces = let(cut, lambda p: F.slice(p, F.lit(2), F.size(p) - 2))
    return let(
        F.arrays_zip(pieces.alias("piece"), loss.alias("run")),
        lambda zipped: F.when(
            F.forall(zipped, lambda z: F.char_length(z["piece"]).eqNullSafe(z["run"]["chars"])),
            F.transform(F.filter(zipped, lambda z: z["run"]["loss"]), lambda z: unescaped(z["piece"])),
        ),
    )
