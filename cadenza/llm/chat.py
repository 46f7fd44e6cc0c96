"""Chat formatting in budgeted windows. Native: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# The template's marks. `past` turns are repeated context; `turn` turns are each written once.
BOS, TURN, PAST, END = "<|bos|>", "<|turn|>", "<|past|>", "<|end|>"
#: Starts of control strings, this template's and other common ones, inside which an escape is put.
CONTROL = r"(<(?=\||/?s>)|\[(?=/?INST\]))"


def escaped(text: Column) -> Column:
    """Reversible: `~` becomes `~0`, and a control string gets `~1` after its first character."""
    return F.regexp_replace(F.replace(text, F.lit("~"), F.lit("~0")), CONTROL, "$1~1")


def unescaped(text: Column) -> Column:
    for mark, plain in (("~2", "\n"), ("~1", ""), ("~0", "~")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def token_count(text: Column) -> Column:
    """An estimate from the code points and UTF-8 bytes: four signs of one byte are a token, and so is each sign of three
    (as of scripts written without blanks); one of two bytes lies between."""
    wide = (F.octet_length(text) - F.length(text)) / 2
    return F.ceil(wide + (F.length(text) - wide) / 4)


def _numbered(rows: DataFrame, bucket_turns: int) -> DataFrame:
    """Adds rank (from 0) and before, the tokens of the turns before, in each conversation's order, and its total.

    Ranks and sums are made inside buckets of bucket_turns turn numbers and shifted by the buckets before, so a
    huge conversation is spread over tasks; the results do not depend on bucket_turns.
    """
    rows = rows.withColumn("_b", F.coalesce(F.floor(F.col("turn") / bucket_turns), F.lit(-(2**62))))
    sums = rows.groupBy("conv_id", "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("tokens").alias("_t"))
    whole = Window.partitionBy("conv_id")
    line = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    past = sums.select(F.col("conv_id").alias("_c"), F.col("_b").alias("_k"), F.sum("_t").over(whole).alias("total"), *(F.coalesce(F.sum(c).over(line), F.lit(0)).alias(c) for c in ("_n", "_t")))
    inside = Window.partitionBy("conv_id", "_b").orderBy("turn", "role", "text")
    local = rows.withColumns({"_r": F.row_number().over(inside) - 1, "_s": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")})
    both = local.join(past, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_k")))
    return both.select(*[c for c in rows.columns if c != "_b"], "total", (F.col("_r") + F.col("_n")).alias("rank"), (F.col("_s") + F.col("_t")).alias("before"))


def _after(turns: DataFrame, size: int) -> DataFrame:
    """(conv_id, rank, next) of turns (conv_id, rank, before, tokens, room): the turn at which a window that begins with the
    turn is full, one further at least. That is how many turns end within the window's room, counted in stretches of `size`
    tokens and shifted by the stretches before."""
    ends = turns.select("conv_id", (F.col("before") + F.col("tokens")).alias("v"), F.lit(0).alias("ask"), F.lit(None).cast("long").alias("rank"))
    rows = ends.unionByName(turns.select("conv_id", (F.col("before") + F.col("room")).alias("v"), F.lit(1).alias("ask"), F.col("rank").cast("long").alias("rank"))).withColumn("_b", F.floor(F.col("v") / size))
    inside = Window.partitionBy("conv_id", "_b").orderBy("v", "ask").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("conv_id", "_b").agg(F.sum(1 - F.col("ask")).alias("_n"))
    past = F.coalesce(F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("_b").alias("_k"), past.alias("_past"))
    found = rows.withColumn("_own", F.sum(1 - F.col("ask")).over(inside)).where("ask = 1").join(sums, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_k")))
    return found.select("conv_id", "rank", F.greatest(F.col("rank") + 1, F.col("_own") + F.col("_past")).alias("next"))


def window_starts(turns: DataFrame, size: int) -> DataFrame:
    """(conv_id, rank) of the turns at which the windows of each conversation begin, filled greedily from the first turn on.

    Every turn knows the start after it; what is reached from the first turn by 1, 2, 4, ... such steps is found by
    joins, so that there are as many rounds as the number of windows has binary digits, however long a conversation is.
    """
    step = written(_after(turns, size))
    reached = step.where("rank = 0").select("conv_id", "rank")
    n = -1
    while True:
        further = reached.select(F.col("conv_id").alias("_c"), F.col("rank").alias("_r")).join(step, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("rank") == F.col("_r")))
        reached = written(reached.union(further.select("conv_id", "next")).distinct())
        now = reached.count()
        if now == n:
            break
        n = now
        then = step.select(F.col("conv_id").alias("_c"), F.col("rank").alias("_r"), F.col("next").alias("_next"))
        step = written(step.join(then, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("next") == F.col("_r"))).select("conv_id", "rank", F.col("_next").alias("next")))
    last = turns.groupBy("conv_id").agg(F.max("rank").alias("_last")).withColumnRenamed("conv_id", "_c")
    return reached.join(last, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("rank") <= F.col("_last"))).select("conv_id", "rank")


def _blocks(rows: DataFrame, size: int, budget: int, history_budget: int) -> DataFrame:
    """Adds block: about `size` tokens of a conversation, but whole windows only. A block is named after the multiple of size
    that its first window has passed; turns before that start belong to the block before."""
    rows = rows.withColumn("block", F.floor(F.col("before") / size))
    long = rows.where(F.col("total") > size)
    if long.isEmpty():
        return rows
    system = rows.where(F.col("role") == "system").groupBy("conv_id").agg(F.min_by("tokens", "rank").alias("_s")).withColumnRenamed("conv_id", "_c")
    room = F.greatest(F.lit(1).cast("long"), F.lit(budget - history_budget) - F.coalesce("_s", F.lit(0)))
    turns = written(long.join(system, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select("conv_id", "rank", "before", "tokens", "block", room.alias("room")))
    starts = window_starts(turns, size).select(F.col("conv_id").alias("_c"), F.col("rank").alias("_r"))
    begun = turns.join(starts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("rank") == F.col("_r"))).groupBy("conv_id", "block").agg(F.min("rank").alias("edge"))
    every = turns.select("conv_id", "block").distinct()
    edges = every.join(begun.select(F.col("conv_id").alias("_c"), F.col("block").alias("_k"), "edge"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_k")), "left")
    before = F.last(F.when(F.col("edge").isNotNull(), F.col("block")), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    edges = written(edges.select(F.col("conv_id").alias("_c"), F.col("block").alias("_k"), "edge", before.alias("earlier")))
    placed = rows.join(edges, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_k")), "left")
    block = F.when(F.col("_k").isNull() | (F.col("rank") >= F.col("edge")), F.col("block")).otherwise(F.col("earlier"))
    return written(placed.withColumn("block", block).drop("_c", "_k", "edge", "earlier"))


def format_chat(conversations: DataFrame, budget: int = 2048, history_turns: int = 2, history_budget: int = 256, tokens: Column | None = None, block_budgets: int = 64, bucket_turns: int = 512) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text): one row per window with its formatted text and loss mask.

    A turn's tokens are those of its text (the column `tokens` where the caller has exact counts, else
    token_count) and 4 for its marks. Prefix sums of them choose spans of whole turns that fit the budget, less
    what the system turn and the history reserve; a turn that is larger than that stands alone and marks its
    window `over_budget`. Of a conversation beyond block_budgets budgets all starts are found first (window_starts), so
    that one task formats a block of about so many tokens that consists of whole windows: windows are the same for any
    block_budgets. Each later window repeats the conversation's first
    system turn and up to history_turns turns before it (within history_budget), across blocks too, both as
    `past` turns outside the loss mask. So every turn is a target once: loss_spans holds [start, end) code point
    offsets of the assistant texts among the window's own turns.

    Turns are ordered by turn, role, text, whatever gaps their numbers have; null role and text are empty, null
    tokens are none; a null turn comes first; a null conv_id is a conversation of its own; repeated rows are
    repeated turns; an empty table gives no rows.
    """
    turn, text = F.col("turn").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    count = F.coalesce(tokens.cast("long"), F.lit(0)) if tokens is not None else token_count(text)
    rows = conversations.select("conv_id", turn.alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), (count + 4).alias("tokens"))
    size = block_budgets * budget
    placed = _blocks(written(_numbered(rows, bucket_turns)), size, budget, history_budget)
    head = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("~2"))
    item = F.struct("rank", "turn", "role", "tokens", head.alias("head"), escaped(F.col("text")).alias("body"))
    own = placed.select("conv_id", "block", F.lit("own").alias("part"), item.alias("item"))
    # the turns before each block but the first, found by their ranks; only long conversations have such blocks
    long = placed.where(F.col("total") > size)
    late = long.groupBy("conv_id", "block").agg(F.min("rank").alias("first")).where(F.col("first") > 0)
    ranks = F.sequence(F.greatest(F.lit(0).cast("long"), F.col("first") - history_turns), F.col("first") - 1) if history_turns else F.array().cast("array<long>")
    late = late.select(F.col("conv_id").alias("late_conv"), F.col("block").alias("late_block"), F.explode(ranks).alias("late_rank"))
    carried = long.join(late, F.col("conv_id").eqNullSafe(F.col("late_conv")) & (F.col("rank") == F.col("late_rank"))).select("conv_id", F.col("late_block").alias("block"), F.lit("carried").alias("part"), item.alias("item"))
    # the first system turn goes to every block
    first = placed.where(F.col("role") == "system").withColumn("item", item).groupBy("conv_id").agg(F.min_by("item", "rank").alias("item"), F.max("total").alias("total"))
    system = first.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("total") / size))).alias("block"), F.lit("system").alias("part"), "item")
    parts = own.unionByName(carried).unionByName(system).groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("part", "item"))).alias("parts"))
    of = lambda name: F.transform(F.filter("parts", lambda x: x.part == name), lambda x: x.item)
    df = parts.withColumns({"items": of("own"), "carried": of("carried"), "sys": F.get(of("system"), F.lit(0))}).drop("parts").where(F.size("items") > 0)
    df = df.withColumns({"sys_rank": F.col("sys.rank"), "sys_text": F.concat(F.lit(PAST + "system\n"), F.col("sys.body"), F.lit(END)), "sys_tokens": F.coalesce("sys.tokens", F.lit(0))}).drop("sys")
    df = df.withColumn("room", F.greatest(F.lit(1).cast("long"), F.lit(budget - history_budget) - F.col("sys_tokens")))
    origin = F.get("items", F.lit(0)).rank
    df = df.withColumn("origin", origin)

    def step(a: Column, x: Column) -> Column:
        new = (F.size(a.starts) == 0) | (a.used + x.tokens > F.col("room"))
        return F.struct(
            F.when(new, x.tokens).otherwise(a.used + x.tokens).alias("used"),
            F.when(new, F.concat(a.starts, F.array((x.rank - F.col("origin")).cast("int")))).otherwise(a.starts).alias("starts"),
        )

    nothing = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("starts"))
    df = df.withColumn("starts", F.aggregate("items", nothing, step, lambda a: a.starts))
    # start (from 0) and end of each window, then its own and its repeated turns
    df = df.select("*", F.posexplode("starts").alias("window", "start"))
    end = F.coalesce(F.get("starts", F.col("window") + 1), F.size("items"))
    df = df.withColumn("n_own", end - F.col("start")).drop("starts")
    line = F.concat("carried", F.slice("items", 1, F.col("start")))
    back = F.slice(line, F.greatest(F.lit(1), F.size(line) - history_turns + 1), F.lit(history_turns))
    df = df.withColumns({"own": F.slice("items", F.col("start") + 1, F.col("n_own")), "back": F.filter(back, lambda x: x.role != "system")})
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x.tokens)
    df = df.withColumn("back", F.filter("back", lambda x, i: total(F.slice("back", i + 1, F.size("back") - i)) <= history_budget))
    has_system = F.exists("own", lambda x: x.rank.eqNullSafe(F.col("sys_rank")))
    piece = lambda mark, x: F.concat(F.lit(mark), x.head, F.lit("\n"), x.body, F.lit(END))
    before = F.concat(F.lit(BOS), F.when(has_system, "").otherwise(F.coalesce("sys_text", F.lit(""))), F.array_join(F.transform("back", lambda x: piece(PAST, x)), ""))
    extra = F.when(has_system, 0).otherwise(F.col("sys_tokens"))
    df = df.withColumns({"before": before, "n_tokens": extra + total("back") + total("own")}).drop("items", "carried", "back")

    def target(a: Column, x: Column) -> Column:
        stop = a.at + F.length(piece(TURN, x))
        span = F.struct((stop - len(END) - F.length(x.body)).alias("start"), (stop - len(END)).alias("end"))
        return F.struct(stop.alias("at"), F.when(x.role == "assistant", F.concat(a.spans, F.array(span))).otherwise(a.spans).alias("spans"))

    start = F.struct(F.length("before").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return df.select(
        "conv_id", "block", "window",
        F.get("own", F.lit(0)).turn.alias("first_turn"),
        F.element_at("own", -1).turn.alias("last_turn"),
        "n_own",
        F.concat("before", F.array_join(F.transform("own", lambda x: piece(TURN, x)), "")).alias("formatted"),
        F.aggregate("own", start, target, lambda a: a.spans).alias("loss_spans"),
        "n_tokens",
        (F.col("n_tokens") > budget).alias("over_budget"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) of a window's own turns, read back from its formatted text."""
    pieces = F.split(formatted, r"<\|turn\|>")
    bodies = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.substring_index(p, END, 1))

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        return F.struct(unescaped(head).alias("role"), unescaped(F.substring(p, F.length(head) + 2, F.length(p))).alias("text"))

    return F.transform(bodies, turn)


def read_targets(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescaped(F.substring(formatted, s.start + 1, s.end - s.start)))
