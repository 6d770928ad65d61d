"""Chat formatting in budgeted windows, by DataFrame functions only.

A turn is  <|turn|> role <|text|> text <|end|>  without the blanks.  Inside roles and texts each
control string (these three, and those common elsewhere) gets a backslash after its first character,
and each backslash is doubled first, so that nothing in a text reads as a mark and every text comes
back as it was.

The turns of a conversation are dealt to windows in order (words + 1 count as a turn's tokens).  Prefix
sums of tokens are cut at multiples of a capacity: turns that lie between two cuts share a window, and
a turn across a cut has its own.  The capacity is the budget less the system turn, if the conversation
starts with one of at most half the budget, and less a quarter for history.  A later window starts with
the system turn, and with the last of ``history`` turns before its own, as far as its budget holds
them: history is shortened first.  So a window exceeds the budget only where its one new turn does.
Loss is on the texts of assistant turns where they are new; repeated ones are masked, so that each is
learned once.

Cases: turns with equal numbers go by role and text; a null turn number comes first; null roles and
texts are empty.  A null conv_id is a conversation.  Repeated rows are turns.  An empty table gives
no rows.  Extra columns are ignored.  A turn stays whole, whatever its length.  A window is one row;
a conversation is rows of one window partition, which Spark can spill, until ``read_back`` makes one
row of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings that are escaped inside texts; the first covers the marks.
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


#: A turn as it is repeated.
SHAPE = "role: string, tokens: bigint, shown: string, before: int, length: int"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    for c in reversed(CONTROLS):
        text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, budget: int = 2048, history: int = 2) -> DataFrame:
    """A row for each window: conv_id, window, text, n_repeated (turns at its start that earlier
    windows have as new), n_turns, loss_spans (array of struct(start, length), in characters from 0)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (words + 1).cast("long").alias("tokens"))
    rows = rows.withColumns({"shown": F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT), escape(F.col("text")), F.lit(END)), "before": F.char_length(escape(F.col("role"))) + len(TURN) + len(TEXT), "length": F.char_length(escape(F.col("text")))})
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # pos from 1; upto: tokens so far; chars: characters so far; system: tokens of the system turn, 0 if none
    rows = rows.withColumns({"pos": F.row_number().over(order), "upto": F.sum("tokens").over(run), "chars": F.sum(F.char_length("shown")).over(run), "system": F.first(F.when(F.col("role") == "system", F.col("tokens")).otherwise(0)).over(run)})
    small = F.when(2 * F.col("system") <= budget, F.col("system")).otherwise(0)
    reserve = budget // 4 if history else 0
    capacity = F.greatest(F.lit(1), F.when(2 * F.col("system") <= budget, budget - F.col("system") - reserve).otherwise(budget - reserve)).cast("long")
    own = F.when(F.col("pos") == 1, F.col("tokens") - small).otherwise(F.col("tokens"))
    end = F.col("upto") - small
    first, last = F.floor((end - own) / capacity), F.floor(F.greatest(end - 1, end - own) / capacity)
    rows = rows.withColumn("cut", 2 * first + F.when(first == last, 0).otherwise(1))
    rows = rows.withColumn("opens", F.when((F.col("pos") == 1) | (F.lag("cut").over(order) != F.col("cut")), 1).otherwise(0))
    shape = F.struct("role", "tokens", "shown", "before", "length")
    # what a window that opens here may repeat: the system turn, and the turns before it, the last first
    past = [F.when(F.lag("pos", k).over(order) > F.when(F.col("system") > 0, 1).otherwise(0), F.lag(shape, k).over(order)) for k in range(1, history + 1)]
    may = F.when((F.col("opens") == 1) & (F.col("pos") > 1), F.struct(F.when(F.col("system") > 0, F.first(shape).over(run)).alias("sys"), F.array(*past, F.lit(None).cast(f"struct<{SHAPE}>")).alias("past")))
    rows = rows.withColumns({"window": (F.sum("opens").over(run) - 1).cast("int"), "may": may})
    each = rows.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("pos", (F.col("chars") - F.char_length("shown")).alias("at"), *(F.col(c) for c in ("role", "tokens", "shown", "before", "length"))))).alias("own"), F.sum("tokens").alias("n"), F.min_by("may", "pos").alias("may")
    )
    left = F.lit(budget) - F.col("n")
    each = each.withColumn("sys", F.when((F.col("may.sys").isNotNull()) & (F.col("may.sys.tokens") <= left), F.array("may.sys")).otherwise(F.array().cast(f"array<struct<{SHAPE}>>")))
    left = left - F.when(F.size("sys") > 0, F.col("may.sys.tokens")).otherwise(0)
    fits, so_far, some = F.lit(0), F.lit(0), F.lit(True)
    for k in range(history):
        so_far = so_far + F.get("may.past", F.lit(k))["tokens"]
        some = some & F.coalesce(so_far <= left, F.lit(False))
        fits = fits + some.cast("int")
    each = each.withColumn("fits", F.when(F.col("may").isNotNull(), fits).otherwise(0))
    old = F.when(F.col("fits") > 0, F.reverse(F.slice("may.past", F.lit(1), F.col("fits")))).otherwise(F.array().cast(f"array<struct<{SHAPE}>>"))
    each = each.withColumn("again", F.concat("sys", old))
    ahead = F.aggregate("again", F.lit(0), lambda acc, x: acc + F.char_length(x["shown"]))
    learned = F.filter("own", lambda x: x["role"] == "assistant")
    spans = F.transform(learned, lambda x: F.struct((F.col("ahead") + x["at"] - F.col("own")[0]["at"] + x["before"]).cast("int").alias("start"), x["length"].alias("length")))
    shown = F.array_join(F.concat(F.col("again.shown"), F.col("own.shown")), "")
    return each.withColumn("ahead", ahead).select("conv_id", "window", shown.alias("text"), F.size("again").alias("n_repeated"), (F.size("again") + F.size("own")).alias("n_turns"), spans.alias("loss_spans"))


def parse_window(text: Column) -> Column:
    """The turns of a formatted window, as array of struct(role, text)."""
    parts = F.split(text, r"<\|end\|>")
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.struct(unescape(F.substring_index(F.substr(x, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"), unescape(F.substring_index(x, TEXT, -1)).alias("text")))


def read_back(windows: DataFrame) -> DataFrame:
    """From formatted windows alone: conv_id, its turns in order without repeats, the text under the
    loss mask, and formatted_chars, the characters of all its windows."""
    new = F.slice(parse_window(F.col("text")), F.col("n_repeated") + 1, F.col("n_turns"))
    learned = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("text", s["start"] + 1, s["length"]))), "")
    each = windows.select("conv_id", F.struct("window", new.alias("turns"), learned.alias("loss"), F.char_length("text").alias("chars")).alias("w"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    return whole.select("conv_id", F.flatten("w.turns").alias("turns"), F.array_join("w.loss", "").alias("loss"), F.aggregate("w.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("formatted_chars"))


PLANTED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    chats = chats.unionByName(spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string"))
    found = read_back(format_chats(chats))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
