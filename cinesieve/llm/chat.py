r"""Chat formatting in budgeted windows.

A conversation's turns are numbered and their tokens summed up in one window over the conversation. The prefix sums cut it
into blocks of BLOCK times the room of a window, turn-aligned; inside a block, whose size is bounded, spans are filled one
after another: a turn opens a span where the prefix sum at its end is more than the room beyond the span's start. So there
is at most one short span a block, and no span is over the room but a single turn that is so itself. Each span becomes one
formatted window: the system turn, up to `history` turns before the span as far as they fit, and the span. Repeated turns
are marked [CTX] and are outside the loss mask; fresh assistant turns are inside.

A turn costs the tokens that a column states, or else the UTF-8 bytes of its formatted form: a byte-level tokenizer never
makes more tokens than bytes, so budgets hold for any of them.

Template: <s>[INST]role[/INST]text</s>, with [CTX] for [INST] in repeated turns. Inside roles and texts a backslash is put
into each control string after its opening, before any backslashes there; undoing it takes one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinesieve.llm.shared import col

FRESH, REPEAT, MIDDLE, STOP = "<s>[INST]", "<s>[CTX]", "[/INST]", "</s>"
_CONTROL = r"(</?|\[/?){}(\\*)(s>|INST\]|CTX\])"
BUDGET, HISTORY, HISTORY_BUDGET, BLOCK = 4096, 2, 1024, 16


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL.format(""), r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL.format(r"\\"), "$1$2$3")


def formatted_turn(role: Column, body: Column, fresh: bool) -> Column:
    """A turn of escaped role and text."""
    return F.concat(F.lit(FRESH if fresh else REPEAT), role, F.lit(MIDDLE), body, F.lit(STOP))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_budget: int = HISTORY_BUDGET, tokens_col: str | None = None) -> DataFrame:
    """One row a window: conv_id, window (from 1), formatted, loss_spans (array of start, stop in code points), n_tokens, n_fresh.

    turns: conv_id, turn, role, text, and tokens_col (long, over 0) if it is named; other columns are not read. Null roles
    and texts are empty; turns are ordered by turn, role, text, nulls first, so ties and repeated rows have a fixed order.
    A leading system turn is repeated in every window unless it takes over half of budget - history_budget, when it is a
    turn like others. A turn that doesn't fit beside the system turn has a window of its own without history, so that no
    window is over budget unless its one fresh turn and the system turn are; a very long text stays whole. Null conv_ids
    form one conversation. No rows give no windows.
    """
    if not 0 <= history_budget < budget:
        raise ValueError("history_budget is less than budget")
    most = budget - history_budget
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), *([col(tokens_col).cast("long").alias("tok")] if tokens_col else []))
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    if not tokens_col:
        rows = rows.withColumn("tok", F.octet_length(formatted_turn(escape(F.col("role")), escape(F.col("text")), True)).cast("long"))
    rows = rows.withColumn("idx", F.row_number().over(w))
    rows = rows.withColumn("is_sys", (F.col("idx") == 1) & (F.col("role") == "system") & (F.col("tok") <= most // 2))
    rows = rows.withColumns({
        "sys": F.first(F.when(F.col("is_sys"), F.struct("tok", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("body")))).over(so_far),
        "stop": F.sum(F.when(F.col("is_sys"), F.lit(0)).otherwise(F.col("tok"))).over(so_far),
    })
    rows = rows.withColumn("start", F.when(F.col("is_sys"), F.col("stop")).otherwise(F.col("stop") - F.col("tok")))
    rows = rows.withColumn("room", F.lit(most) - F.coalesce("sys.tok", F.lit(0)))
    rows = rows.withColumn("block", F.floor(F.col("start") / (BLOCK * F.col("room"))))
    own = [(F.col("role") == "assistant").alias("loss"), escape(F.col("role")).alias("role"), escape(F.col("text")).alias("body")]
    turn = F.struct("idx", "start", "stop", "tok", "is_sys", *own)
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.any_value("room").alias("room"), F.any_value("sys").alias("sys"))

    def last_of(a: Column, n: int) -> Column:
        return F.slice(a, F.greatest(F.lit(1), F.size(a) - n + 1), F.lit(n))

    by_block = W.partitionBy("conv_id").orderBy("block")
    blocks = blocks.withColumn("tail", last_of(F.col("turns"), history))
    nothing = F.slice(F.col("tail"), 1, 0)
    blocks = blocks.withColumn("before", F.concat(nothing, *[F.coalesce(F.lag("tail", h).over(by_block), nothing) for h in range(history, 0, -1)]))

    def opened(all_turns: Column) -> Column:
        """idx of the turns that open a span."""
        first = all_turns[0]

        def step(acc: Column, t: Column) -> Column:
            new = (t["stop"] - acc["at"] > F.col("room")) & (t["idx"] > first["idx"])
            return F.struct(F.when(new, t["start"]).otherwise(acc["at"]).alias("at"), F.when(new, F.concat(acc["opens"], F.array(t["idx"]))).otherwise(acc["opens"]).alias("opens"))

        return F.aggregate(all_turns, F.struct(first["start"].alias("at"), F.array(first["idx"]).alias("opens")), step, lambda acc: acc["opens"])

    blocks = blocks.withColumn("opens", opened(F.col("turns")))
    place = F.col("open") - F.col("turns")[0]["idx"] + 1
    spans_ = blocks.select("*", F.posexplode("opens").alias("nth", "open"))
    spans_ = spans_.withColumn("span", F.slice("turns", place, F.coalesce(F.get("opens", F.col("nth") + 1), F.col("turns")[0]["idx"] + F.size("turns")) - F.col("open")))
    spans_ = spans_.withColumn("past", last_of(F.concat("before", F.slice("turns", F.greatest(F.lit(1), place - history), F.least(F.lit(history), place - 1))), history))
    spans_ = spans_.withColumns({"at": F.col("span")[0]["start"], "span_tok": F.element_at("span", -1)["stop"] - F.col("span")[0]["start"]})
    repeats = F.col("sys").isNotNull() & (F.col("open") > 1)
    left = F.least(F.lit(history_budget), F.lit(budget) - F.col("span_tok") - F.coalesce("sys.tok", F.lit(0)))
    spans_ = spans_.withColumn("past", F.filter("past", lambda t: ~t["is_sys"] & (F.col("at") - t["start"] <= left)))

    def part(t: Column, fresh: bool) -> Column:
        s = formatted_turn(t["role"], t["body"], fresh)
        head = F.length(t["role"]) + len(FRESH if fresh else REPEAT) + len(MIDDLE)
        return F.struct(s.alias("s"), head.alias("head"), F.length(t["body"]).alias("body"), (t["loss"] if fresh else F.lit(False)).alias("loss"))

    parts = F.concat(F.when(repeats, F.array(part(F.col("sys").withField("loss", F.lit(False)), False))).otherwise(F.slice(F.transform("span", lambda t: part(t, False)), 1, 0)), F.transform("past", lambda t: part(t, False)), F.transform("span", lambda t: part(t, True)))

    def masked(ps: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            start = acc["at"] + p["head"]
            span = F.array(F.struct(start.alias("start"), (start + p["body"]).alias("stop")))
            return F.struct((acc["at"] + F.length(p["s"])).alias("at"), F.when(p["loss"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(ps, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out")), step, lambda a: a["out"])

    total = lambda ts: F.aggregate(ts, F.lit(0).cast("long"), lambda a, t: a + t["tok"])
    made = spans_.select(
        "conv_id", "open", parts.alias("ps"), (total(F.col("past")) + total(F.col("span")) + F.when(repeats, F.col("sys.tok")).otherwise(0)).alias("n_tokens"), F.size("span").alias("n_fresh")
    )
    numbered = made.withColumn("window", F.row_number().over(W.partitionBy("conv_id").orderBy("open")))
    return numbered.select("conv_id", "window", F.array_join(F.transform("ps", lambda p: p["s"]), "").alias("formatted"), masked(F.col("ps")).alias("loss_spans"), "n_tokens", "n_fresh")


def read_back(formatted_windows: DataFrame) -> DataFrame:
    """Per window, from the formatted string and its mask alone: turns (role, text of the fresh turns, in order) and loss (unescaped texts)."""

    def parsed(part: Column) -> Column:
        body = F.substr(part, F.lit(len(FRESH) + 1))
        role = F.substring_index(body, MIDDLE, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(body, F.length(role) + len(MIDDLE) + 1)).alias("text"))

    fresh = F.filter(F.split("formatted", STOP, -1), lambda p: F.startswith(p, F.lit(FRESH)))
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"])))
    return formatted_windows.select("conv_id", "window", F.transform(fresh, parsed).alias("turns"), masked.alias("loss"), F.length("formatted").alias("formatted_chars"))


def digests(windows_read: DataFrame) -> DataFrame:
    """One row a conversation, of what read_back gave: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    by_window = windows_read.select(
        "conv_id",
        "formatted_chars",
        F.struct(
            "window",
            F.size("turns").cast("long").alias("n"),
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("loss", "").alias("loss"),
        ).alias("w"),
    )
    grouped = by_window.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"), F.sum("formatted_chars").cast("long").alias("formatted_chars"), F.count("*").alias("n_windows"))
    loss = F.array_join(F.transform("ws", lambda x: x["loss"]), "")
    return grouped.select(
        "conv_id",
        F.aggregate("ws", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_turns"),
        F.sha2(F.array_join(F.transform("ws", lambda x: x["turns"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


