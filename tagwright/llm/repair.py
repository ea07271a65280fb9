"""Conversation structure repair: the cheapest edits after which the roles of a conversation take turns.

A window over a conversation's rows says what is wrong with each (blank, said before, cut off). The sorted rows are then
folded by ``aggregate``: four states say what the repaired conversation ends with so far (nothing, a system turn, a user's,
an assistant's), and each holds the least (cost, audit) that leads there. Two audits of one state and cost are never one a
prefix of the other (what is longer has more insertions and costs more), so the least so far stays the least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3  # costs; the last of a row that stays although it is cut off
BLANKS = " \t\n\x0b\x0c\r"
STATE = "struct<cost:bigint,audit:string>"


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: ``turns`` as crc32(``conv_id:turn``) modulo 20 damages them.

    0 loses the row (copies 0), 1 empties its text, 2 takes its ``.!?``, 3 doubles it, 4 gives it to the user. A null is one
    blank, in the key, the role and the text; a null turn stays null in ``turn``.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def flagged(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """Each row's place in its conversation, its first fault, and whether it opens a new turn or follows its predecessor badly.

    Rows go by turn (null first), then role and text. Rows with ``copies`` 0 only name their conversation (``here`` is false).
    """
    n = F.greatest(F.coalesce(F.col(copies).cast("int"), F.lit(1)), F.lit(0)) if copies else F.lit(1)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), n.alias("_n"))
    rows = rows.withColumn("here", F.explode_outer(F.array_repeat(F.lit(True), F.col("_n").cast("int")))).withColumn("here", F.coalesce("here", F.lit(False))).drop("_n")
    # both windows and the gathering that follows are dealt by conv_id: rows move once
    order = Window.partitionBy("conv_id").orderBy(F.desc("here"), F.asc_nulls_first("turn"), "role", "text")
    initial = F.substring("role", 1, 1)
    rows = rows.select("*", initial.alias("initial"), F.row_number().over(order).alias("place"), F.lag(initial).over(order).alias("_before"), F.lag("turn").over(order).alias("_turn"))
    said = F.row_number().over(Window.partitionBy("conv_id", "here", "role", "text").orderBy("place")) > 1
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(end == "", "blank").when(said, "duplicate").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    illegal = F.col("_before").isNotNull() & ~F.concat("_before", "initial").isin("su", "ua", "au")
    return rows.select("conv_id", "turn", "role", "text", "here", "initial", "place", fault.alias("fault"), illegal.alias("illegal"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))).alias("new_turn"))


def _to(state: Column, cost: Column | int, mark: str, when: Column | None = None) -> Column:
    """``state`` after an edit; null where the state cannot be or the edit is not allowed."""
    ok = state.isNotNull() if when is None else state.isNotNull() & when
    return F.when(ok, F.struct((state["cost"] + cost).cast("bigint").alias("cost"), F.concat(state["audit"], F.lit(mark)).alias("audit")))


def _fold(state: Column, row: Column) -> Column:
    """The four states after a row, insertions behind it included."""
    nothing, system, user, assistant = (state[k] for k in "nsua")
    stays = ~row["fault"].isin("blank", "duplicate")
    extra = F.when(row["fault"] == "truncated", CUT_OFF).otherwise(0)
    is_ = lambda letter: stays & (row["initial"] == letter)
    before_user = (nothing, system, assistant)
    kept = F.struct(
        _to(nothing, DELETE, "D").alias("n"),
        F.least(_to(system, DELETE, "D"), _to(nothing, extra, "K", is_("s"))).alias("s"),
        F.least(_to(user, DELETE, "D"), *[_to(x, extra, "K", is_("u")) for x in before_user], *[_to(x, extra + REROLE, "R", stays) for x in before_user]).alias("u"),
        F.least(_to(assistant, DELETE, "D"), _to(user, extra, "K", is_("a")), _to(user, extra + REROLE, "R", stays)).alias("a"),
    )
    return F.element_at(F.transform(F.array(kept), _with_insertions), 1)  # names ``kept``, so that it is made once


def _with_insertions(s: Column) -> Column:
    more = [_to(s[k], INSERT, "I") for k in "nsa"], [_to(s[k], 2 * INSERT, "II") for k in "ns"]
    return F.struct(s["n"].alias("n"), s["s"].alias("s"), F.least(s["u"], *more[0]).alias("u"), F.least(s["a"], _to(s["u"], INSERT, "I"), *more[1]).alias("a"))


def _repaired(turns: Column, audit: Column) -> Column:
    """The rows that the edits leave: each row's insertions and edit are a piece of the audit; roles take turns from the first user on."""
    some = lambda n, kept, role, text: F.array_repeat(F.struct(kept.alias("kept"), role.alias("role"), text.alias("text")), n)

    def piece(p, k):
        row, edit = F.get(turns, k), F.substring(p, -1, 1)
        new = some(F.length(F.regexp_extract(p, "^I*", 0)), F.lit(False), F.lit(""), F.lit(""))
        return F.concat(new, some(F.when(edit.isin("K", "R"), 1).otherwise(0), edit == "K", row["role"], row["text"]))

    out = F.flatten(F.transform(F.regexp_extract_all(audit, F.lit("I*[DKR]|I+"), 0), piece))
    system = F.coalesce(F.get(out, F.lit(0))["kept"] & F.startswith(F.get(out, F.lit(0))["role"], F.lit("s")), F.lit(False)).cast("int")
    role = lambda x, k: F.when(x["kept"], x["role"]).when((k - system) % 2 == 0, "user").otherwise("assistant")
    return F.transform(out, lambda x, k: F.struct(role(x, k).alias("role"), x["text"].alias("text")))


def repair(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """Every conversation of ``turns`` (conv_id, turn, role, text) with its faults, the cheapest edits and the repaired turns.

    Edits, one letter each in ``audit``: Keep, Rerole (to user or assistant), Delete (blank rows and repeats must go), Insert (an
    empty turn). The roles' initials are then ``(s?(ua)+)?``; of edits of one cost the least audit counts. A row that is cut
    off (its last character that is no blank is none of ``.!?``) and stays adds to the cost.

    Columns: conv_id, gaps (turns that are missing between the least and the largest), blank, duplicate, truncated, illegal
    (rows whose initial doesn't follow the one before), cost, audit, repaired (array of role, text). A null role or text is
    empty here; rows of one turn go by role and text; null ids are one conversation; other columns are not read. ``copies``
    names a column that says how often a row stands; a conversation whose rows all stand 0 times has zeros and empty results.
    An empty table gives no rows. A conversation is one row of the result, so it must fit a task.
    """
    rows = flagged(turns, copies)
    here = F.col("here")
    count = lambda c: F.count_if(here & c)
    told = F.sort_array(F.collect_list(F.when(here, F.struct("place", "role", "text", "initial", "fault"))))
    span = F.max(F.when(here, F.col("turn"))) - F.min(F.when(here, F.col("turn"))) + 1 - count(F.col("new_turn"))
    faults = [count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    convs = rows.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"), *faults, count(F.col("illegal")).alias("illegal"), told.alias("_rows"))
    none = lambda k, cost, audit: F.struct(F.lit(cost).cast("bigint").alias("cost"), F.lit(audit).alias("audit")).cast(STATE).alias(k)
    start = F.struct(none("n", 0, ""), F.lit(None).cast(STATE).alias("s"), none("u", INSERT, "I"), none("a", 2 * INSERT, "II"))
    best = F.aggregate("_rows", start, _fold, lambda s: F.least(s["n"], s["a"]))
    return convs.withColumn("_best", best).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "_best.cost", "_best.audit", "_rows").select("*", _repaired(F.col("_rows"), F.col("audit")).alias("repaired")).drop("_rows")


def digest(repaired: str = "repaired") -> Column:
    """SHA-256 of the repaired turns as lines ``role:text``."""
    return F.sha2(F.array_join(F.transform(repaired, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n"), 256)
