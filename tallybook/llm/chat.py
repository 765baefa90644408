"""Preference formatting: the turns that two conversations begin with once, then both completions with masks.

Of a chosen and a rejected conversation the longest common prefix of turns (same role and text) is rendered once as prompt.
What follows in each is rendered as its completion. Masks are the parts of a completion that are trained on, the texts of the
assistant with their end mark, as [start, end) in characters.

All of it is built-in expressions over one array of turns for each conversation; a conversation is a unit and has
to fit a task, as its rendered text does.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _turns(conversations: DataFrame, name: str) -> DataFrame:
    """conv_id and its turns in order: by turn (null last), then role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").isNull().alias("no"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    listed = conversations.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    slim = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return listed.select(F.col("conv_id").alias(f"{name}_id"), slim.alias(name))


def _rendered(turns: Column) -> Column:
    one = lambda x: F.concat(F.lit(START), x["role"], F.lit(MIDDLE), x["text"], F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def _masks(turns: Column) -> Column:
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(state, x):
        head = F.char_length(x["role"]) + len(START) + len(MIDDLE)
        start = state["at"] + head
        end = start + F.char_length(x["text"]) + len(END)
        mask = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(
            end.cast("long").alias("at"),
            F.when(x["role"] == TRAINED, F.concat(state["masks"], mask)).otherwise(state["masks"]).alias("masks"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("masks"))
    return F.aggregate(turns, zero, step, lambda s: s["masks"])


def _rest(turns: str, common: Column) -> Column:
    return F.slice(F.col(turns), common + 1, F.greatest(F.size(turns) - common, F.lit(0)))


def formatted(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each pair (chosen_id, rejected_id) of which both conversations are there.

    chosen_id, rejected_id, n_common (turns), prompt, chosen, rejected, chosen_masks, rejected_masks. ``conversations`` has conv_id,
    turn, role, text and any other columns. Null role and text count as empty, a null turn comes last, rows without conv_id belong
    to nothing, repeated rows are turns of their own. Two equal conversations have empty completions. No rows, no pairs.
    """
    both = (
        pairs.select("chosen_id", "rejected_id")
        .join(_turns(conversations, "chosen"), "chosen_id")
        .join(_turns(conversations, "rejected"), "rejected_id")
    )
    return _compared(both)


def _compared(both: DataFrame) -> DataFrame:
    """chosen_id, rejected_id and the rendered parts, of pairs of turn lists ``chosen`` and ``rejected``."""
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, False)
    common = F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")
    both = both.withColumn("n_common", common)
    n = F.col("n_common")
    return both.select(
        "chosen_id",
        "rejected_id",
        "n_common",
        _rendered(F.slice("chosen", F.lit(1), n)).alias("prompt"),
        _rendered(_rest("chosen", n)).alias("chosen"),
        _rendered(_rest("rejected", n)).alias("rejected"),
        _masks(_rest("chosen", n)).alias("chosen_masks"),
        _masks(_rest("rejected", n)).alias("rejected_masks"),
    )


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """Preferences made from plain conversations, formatted as by :func:`formatted`.

    Chosen is a conversation as it is; rejected are its turns before its last answer, then the last answer of the
    conversation with the next conv_id, which is ``rejected_id``. Conversations without an answer, or whose next one has
    none or is missing, give no pair. Equal answers give a pair with an empty rejected completion.
    """
    turns = _turns(conversations, "chosen")
    answered = F.transform("chosen", lambda x: x["role"] == TRAINED)
    before = F.size("chosen") - F.array_position(F.reverse(answered), True)
    led = turns.filter(F.exists("chosen", lambda x: x["role"] == TRAINED)).withColumn("before", before.cast("int"))
    answers = led.select(
        F.col("chosen_id").alias("rejected_id"), F.get("chosen", F.col("before")).alias("answer")
    )
    both = led.join(answers, F.col("rejected_id") == F.col("chosen_id") + 1)
    rejected = F.concat(F.slice("chosen", F.lit(1), F.col("before")), F.array("answer"))
    return _compared(both.select("chosen_id", "rejected_id", "chosen", rejected.alias("rejected")))


def neighbouring_pairs(conversations: DataFrame) -> DataFrame:
    """chosen_id 2i with rejected_id 2i + 1, for a table that lists the two answers one after the other."""
    even = conversations.filter(F.col("conv_id") % 2 == 0).select(F.col("conv_id").alias("chosen_id")).distinct()
    return even.withColumn("rejected_id", F.col("chosen_id") + 1)
