"""Chat formatting for preference training: a prompt rendered once, and two completions with their masks.

Turns are arrays of (role, text). The longest common prefix of the chosen and the rejected turns is the prompt; the
turns behind it are the completions. A mask lists runs of characters of its completion, in order: how many, and
whether they are trained on (the text and end mark of assistant turns) or not (headers, other roles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siren.llm.rows import written

BEGIN, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"
#: What a text may not begin a mark with, and what stands for it.
MARK, PLAIN = "<|im_", "< |im_"
TRAINED_ROLE = "assistant"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), turn["role"], F.lit(BREAK))


def _body(turn: Column) -> Column:
    return F.concat(F.replace(turn["text"], F.lit(MARK), F.lit(PLAIN)), F.lit(END))


def rendered(turns: Column) -> Column:
    """The turns as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t), F.lit(BREAK))), "")


def mask(turns: Column) -> Column:
    """Runs of characters of ``rendered(turns)``: array of (chars, trained)."""

    def run(text: Column, trained: Column) -> Column:
        return F.struct(F.length(text).cast("long").alias("chars"), trained.alias("trained"))

    def runs(t: Column) -> Column:
        trained = t["role"] == TRAINED_ROLE
        return F.array(run(_header(t), F.lit(False)), run(_body(t), trained), run(F.lit(BREAK), F.lit(False)))

    return F.flatten(F.transform(turns, runs))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replace the turns of each pair by ``prompt_turns``, ``prompt``, and completion and mask of either side.

    ``chosen`` and ``rejected`` are arrays of struct(role, text). NULL or empty arrays have no turns, a NULL role is
    ``user`` and a NULL text is empty. Equal conversations are all prompt, with empty completions. Rows are formatted
    one by one: repeated ones repeat, other columns stay.
    """

    def cleaned(name: str) -> Column:
        turns = F.coalesce(F.col(name), F.array().cast("array<struct<role:string,text:string>>"))
        return F.transform(
            turns,
            lambda t: F.struct(
                F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")
            ),
        )

    others = [F.col(c) for c in pairs.columns if c not in (chosen, rejected, "prompt_turns", "prompt")]
    sides = pairs.select(*others, cleaned(chosen).alias("_chosen"), cleaned(rejected).alias("_rejected"))
    same = F.zip_with("_chosen", "_rejected", lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(same, False)
    prompt_turns = F.when(differs == 0, F.size("_chosen")).otherwise(differs - 1).cast("int")
    sides = sides.withColumn("prompt_turns", prompt_turns)

    def rest(name: str) -> Column:
        return F.slice(name, F.col("prompt_turns") + 1, F.size(name))

    return sides.select(
        *others,
        "prompt_turns",
        rendered(F.slice("_chosen", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        rendered(rest("_chosen")).alias("chosen"),
        mask(rest("_chosen")).alias("chosen_mask"),
        rendered(rest("_rejected")).alias("rejected"),
        mask(rest("_rejected")).alias("rejected_mask"),
    )


#: About how many conversations are ranked together to find partners.
RANKED = 256


def _digits(column: str, first: int) -> Column:
    """Eight hex digits of an MD5 as a number."""
    return F.conv(F.substring(column, first, 8), 16, 10).cast("long")


def _ranked(talks: DataFrame) -> DataFrame:
    """Each answered conversation's successor in a circle: (conv_id, partner).

    Circles hold about ``RANKED`` conversations, so no rank goes through one task; ids alone are moved. One that is alone
    in its circle has no successor.
    """
    ids = talks.where("answers > 0").select("conv_id", "_md5")
    circles = max(ids.count() // RANKED, 1)
    ids = ids.withColumn("_circle", F.pmod(_digits("_md5", 1), F.lit(circles)))
    circle = Window.partitionBy("_circle")
    order = circle.orderBy("_md5", "conv_id")
    first = F.first("conv_id").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    partner = F.coalesce(F.lead("conv_id").over(order), first)
    found = ids.select("conv_id", partner.alias("partner"))
    return found.where(F.col("partner") != F.col("conv_id"))


def branched(turns: DataFrame) -> DataFrame:
    """Pairs from plain conversations, for tables without preference labels: one row per conversation.

    ``chosen`` is the whole conversation. ``rejected`` leaves it at one of its answers, picked by the MD5 of its id, and goes
    on as another conversation does from one of its own answers to its end, so the two may part at any answer, or later
    where the other goes on alike. The other is the next one in the order of the ids' MD5s (``_ranked``) and is real text
    too. Conversations without an answer or without another have no branch: both sides are equal. Turns without a
    conversation id belong to none. Turns are ordered by number, role and text; repeated ones repeat.
    """
    turn = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    grouped = turns.where(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias("conv_id"))
    talks = grouped.agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    plain = F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    talks = talks.select("conv_id", plain.alias("chosen"), F.md5(F.col("conv_id").cast("string")).alias("_md5"))
    places = F.filter(
        F.sequence(F.lit(1), F.size("chosen")),
        lambda k: F.coalesce(F.element_at("chosen", k)["role"] == TRAINED_ROLE, F.lit(False)),
    )
    talks = written(talks.withColumn("_places", places).withColumn("answers", F.size("_places")), "conversations")

    def picked(first: int) -> Column:
        """Where one of the answers is."""
        return F.element_at("_places", (F.pmod(_digits("_md5", first), F.col("answers")) + 1).cast("int"))

    answered = talks.where("answers > 0")
    tails = answered.select(F.col("conv_id").alias("partner"), F.slice("chosen", picked(17), F.size("chosen")).alias("_tail"))
    branches = _ranked(talks).join(tails, "partner").select("conv_id", "_tail")
    heads = talks.withColumn("_head", F.when(F.col("answers") > 0, F.slice("chosen", F.lit(1), picked(9) - 1)))
    rejected = F.coalesce(F.concat("_head", "_tail"), "chosen")
    return heads.join(branches, "conv_id", "left").select("conv_id", "chosen", rejected.alias("rejected"))
