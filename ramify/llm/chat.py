"""Chat formatting in budgeted windows of whole turns.

A turn is written ``<s>[role]\\n text </s>`` (without the spaces); inside role and text the
characters that control strings begin with are escaped: ``~`` as ``~0``, ``[`` as ``~1``, ``<`` as
``~2``, ``]`` as ``~3``. Escaping keeps every text readable back exactly and no text can hold a control string.

A turn's cost is its number of tokens as written: the column ``n_tokens`` where turns have one, else the number of
pieces counted here (PIECES: up to PIECE_LETTERS letters, else one character) and of the bytes beyond one that a character takes in UTF-8. This
stands in for a tokenizer, which plain expressions can't run: on sf0.1 it is 1.22 times a byte-level BPE's count, below it in 0.04% of the turns, by a tenth at most.

The turns other than the leading system turn are laid out by the prefix sums of their costs, and cells as long as the room
(the budget less the history's share and the system turn) divide that line. The turns that begin in a cell are a block if they fit
the room together; else the last of them, which passes the cell's end, is a block by itself.
A window is the system turn, as many of the HISTORY turns before the block as fit the history's share, and the block. Windows after the first
repeat the system turn and that history; what is repeated is masked, so each assistant text is under the loss mask once. A window keeps to the
budget unless one turn, or the system turn with one, is beyond it: turns are never cut.

Prefix sums have two levels, chunks of CHUNK turn numbers and their totals, and windows are put together by cell, which holds
as many turns as it has tokens at most. Turns with their places are written once. So no step gathers a conversation, however long, but ``read_back``, whose digests are of the
whole conversation as one string.

Edge cases: a null text or role is empty. Turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have one
order. A row with a null conv_id belongs to no conversation: it is one by itself, told apart by ``loose``, which is 0 for all others.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ramify.llm.common import Scratch, ship

BUDGET = 1024
HISTORY = 2
HISTORY_SHARE = 256
CHUNK = 1024
PIECE_LETTERS = 2
PIECES = rf"[A-Za-z]{{1,{PIECE_LETTERS}}}|[^A-Za-z\x20\x09-\x0D]"
LOSS_ROLE = "assistant"
_ESCAPES = (("~", "~0"), ("[", "~1"), ("<", "~2"), ("]", "~3"))
_OPEN, _MID, _CLOSE = "<s>[", "]\n", "</s>"
_KEY = ("conv_id", "loose")


def escape(x: Column) -> Column:
    for raw, code in _ESCAPES:
        x = F.replace(x, F.lit(raw), F.lit(code))
    return x


def unescape(x: Column) -> Column:
    for raw, code in reversed(_ESCAPES):
        x = F.replace(x, F.lit(code), F.lit(raw))
    return x


def pieces(s: Column) -> Column:
    """The tokens that a text counts for where no tokenizer has counted them."""
    return F.regexp_count(s, F.lit(PIECES)).cast("long") + F.octet_length(s) - F.length(s)


def written_turns(turns: DataFrame) -> DataFrame:
    """conv_id (0 for none), loose, chunk; turn, role, text as they order a conversation; cost."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turn, conv = F.col("turn").cast("long"), F.col("conv_id").cast("long")
    given = F.col("n_tokens").cast("long") if "n_tokens" in turns.columns else F.lit(None).cast("long")
    rows = turns.select(
        F.coalesce(conv, F.lit(0)).alias("conv_id"), F.when(conv.isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0)).alias("loose"),
        F.coalesce(F.floor(turn / CHUNK), F.lit(-(1 << 62))).alias("chunk"), turn.alias("turn"), role.alias("role"), text.alias("text"), given.alias("given"),
    )
    return rows.select(*_KEY, "chunk", "turn", "role", "text", F.greatest(F.lit(1), F.coalesce("given", pieces(_written()))).alias("cost"))


def _written() -> Column:
    return F.concat(F.lit(_OPEN), escape(F.col("role")), F.lit(_MID), escape(F.col("text")), F.lit(_CLOSE))


def placed_turns(turns: DataFrame, budget: int, history: int, history_share: int) -> DataFrame:
    """(conv_id, loose, i, s, cost, skip, loss, system, turns, room, before, ahead): each turn's number and place on the line of costs; s: as written.

    before is null for a system turn; ahead has the costs of up to history - 1 turns after the next one's beginning.
    """
    key = [*_KEY, "chunk"]
    order = Window.partitionBy(*key).orderBy("turn", "role", "text", "cost")
    near = F.collect_list("cost").over(order.rowsBetween(1, max(1, history - 1)))
    rows = written_turns(turns).select(
        *_KEY, "chunk", F.row_number().over(order).alias("rn"), F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        near.alias("near"), (F.col("role") == "system").alias("system"), "role", "text", "cost",
    )
    # one row of numbers per chunk
    totals = rows.groupBy(*key).agg(
        F.max("rn").alias("n"), F.max("run").alias("sum"), F.max(F.when(F.col("rn") == 1, F.struct("system", "cost", "near"))).alias("first"),
    )
    by_chunk = Window.partitionBy(*_KEY).orderBy("chunk")
    so_far = by_chunk.rowsBetween(Window.unboundedPreceding, 0)
    begin = F.first("first").over(so_far)
    after = F.flatten(F.collect_list(F.concat(F.array("first.cost"), F.col("first.near"))).over(by_chunk.rowsBetween(1, max(1, history - 1))))
    totals = totals.select(
        *key, (F.sum("n").over(so_far) - F.col("n")).alias("i0"), (F.sum("sum").over(so_far) - F.col("sum")).alias("c0"),
        F.when(begin["system"], begin["cost"]).otherwise(F.lit(0)).alias("system_cost"), begin["system"].alias("headed"), after.alias("after"),
        F.sum("n").over(Window.partitionBy(*_KEY)).alias("turns"),
    )
    joined = rows.join(totals, key)
    i = F.col("rn") - 1 + F.col("i0")
    system = F.col("headed") & (i == 0)
    before = F.col("c0") + F.col("run") - F.col("cost") - F.col("system_cost")
    return joined.select(
        *_KEY, i.alias("i"), _written().alias("s"), "cost", F.length(escape(F.col("role"))).alias("skip"), (F.col("role") == LOSS_ROLE).alias("loss"), system.alias("system"), "turns",
        F.greatest(F.lit(1), F.lit(budget - history_share) - F.col("system_cost")).alias("room"),  # a window holds a turn in any case
        F.when(~system, before).alias("before"), F.slice(F.concat("near", "after"), 1, max(1, history - 1)).alias("ahead"),
    )


def _cells(history: int) -> Column:
    """The cells that a turn is needed in: its own, and those that begin among the next turns, where it is history."""
    begins = F.col("before") + F.col("cost")
    out = [F.col("before"), begins]
    for k in range(history - 1):  # the beginning of the turn after next, and so on
        begins = begins + F.get("ahead", F.lit(k))
        out.append(begins)
    return F.array_distinct(F.array_compact(F.array(*(F.floor(x / F.col("room")) for x in out))))


def _blocks() -> Column:
    """The cell's own turns in one block, or in two, each with the turns before it."""
    last = F.element_at("own", -1)
    length = last["before"] + last["cost"] - F.col("own")[0]["before"]
    apart = (F.size("own") > 1) & (length > F.col("room"))
    n = F.size("own")
    one = F.struct((2 * F.col("cell")).alias("window"), F.slice("own", F.lit(1), F.when(apart, n - 1).otherwise(n)).alias("block"), F.col("past").alias("past"))
    two = F.struct((2 * F.col("cell") + 1).alias("window"), F.slice("own", n, 1).alias("block"), F.concat(F.col("past"), F.slice("own", F.lit(1), n - 1)).alias("past"))
    return F.when(apart, F.array(one, two)).otherwise(F.array(one))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_share: int = HISTORY_SHARE) -> DataFrame:
    """One row per window: conv_id, loose, window (ascending, 0 first), formatted, n_repeated (leading turns that repeat), loss_spans (start, length in formatted)."""
    ship(turns.sparkSession)
    # read three times: for the cells, and for system turns with others and alone
    placed = Scratch(turns.sparkSession).put(placed_turns(turns, budget, history, history_share), "placed")
    part = F.struct("i", (F.floor(F.col("before") / F.col("room")) == F.col("cell")).alias("own"), "before", "cost", "skip", "loss", "s")
    spread = placed.where("not system").withColumn("cell", F.explode(_cells(history)))
    cells = spread.groupBy(*_KEY, "cell").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.first("room").alias("room"))
    cells = cells.withColumn("own", F.filter("parts", lambda p: p["own"])).where(F.size("own") > 0).withColumn("past", F.filter("parts", lambda p: ~p["own"]))
    wins = cells.select(*_KEY, F.inline(_blocks()))

    # history that fits its share: from the latest turn backwards
    def fits(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x["cost"]
        ok = acc["open"] & (total <= history_share)
        return F.struct(F.when(ok, total).otherwise(acc["sum"]).alias("sum"), ok.alias("open"), F.when(ok, acc["n"] + 1).otherwise(acc["n"]).alias("n"))

    latest = F.reverse("past") if history > 0 else F.slice("past", 1, 0)
    n_back = F.aggregate(F.slice(latest, 1, max(1, history)), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(True).alias("open"), F.lit(0).alias("n")), fits, lambda a: a["n"])
    wins = wins.withColumn("n_back", n_back)
    back = F.slice("past", F.size("past") - F.col("n_back") + 1, F.col("n_back"))
    wins = wins.select(*_KEY, "window", "n_back", F.concat(back, "block").alias("parts"))

    heads = placed.where("system").withColumn("head", F.struct("i", F.lit(False).alias("own"), "before", "cost", "skip", "loss", "s"))
    alone = heads.where("turns = 1").select(*_KEY, F.lit(0).cast("long").alias("window"), F.array("head").alias("parts"), F.lit(0).alias("n_repeated"))
    wins = wins.join(heads.where("turns > 1").select(*_KEY, "head"), list(_KEY), "left")
    headed = F.col("head").isNotNull()
    n_repeated = F.col("n_back") + F.when(headed & (F.col("window") > 0), 1).otherwise(0)
    wins = wins.select(*_KEY, "window", F.when(headed, F.concat(F.array("head"), "parts")).otherwise(F.col("parts")).alias("parts"), n_repeated.alias("n_repeated"))
    wins = wins.unionByName(alone)

    def mask(acc: Column, x: Column) -> Column:
        begin = acc["at"] + len(_OPEN) + x["skip"] + len(_MID)
        span = F.struct(begin.alias("start"), (F.length(x["s"]) - len(_OPEN) - x["skip"] - len(_MID) - len(_CLOSE)).alias("length"))
        fresh = x["loss"] & (acc["i"] >= F.col("n_repeated"))
        return F.struct((acc["at"] + F.length(x["s"])).alias("at"), (acc["i"] + 1).alias("i"), F.when(fresh, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return wins.select(
        F.when(F.col("loose") == 0, F.col("conv_id")).alias("conv_id"), "loose", "window", F.array_join(F.transform("parts", lambda x: x["s"]), "").alias("formatted"),
        "n_repeated", F.aggregate("parts", begin, mask, lambda a: a["spans"]).alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from format_windows' rows alone; a row per conversation."""
    whole = F.split(F.col("formatted"), _CLOSE, -1)
    turns = F.slice(whole, F.col("n_repeated") + 1, F.greatest(F.size(whole) - 1 - F.col("n_repeated"), F.lit(0)))

    def parsed(x: Column) -> Column:
        role = F.substring_index(x, _MID, 1)
        text = F.substring(x, F.length(role) + len(_MID) + 1, F.length(x))
        return F.concat(unescape(F.substring(role, len(_OPEN) + 1, F.length(role))), F.lit("\n"), unescape(text), F.lit("\n"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    rows = windows.select(
        *_KEY, F.size(turns).cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"),
        F.struct("window", F.array_join(F.transform(turns, parsed), "").alias("turns"), loss.alias("loss")).alias("part"),
    )
    convs = rows.groupBy(*_KEY).agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("parts"))
    said, lost = F.array_join("parts.turns", ""), F.array_join("parts.loss", "")
    return convs.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"), "formatted_chars",
    )
