"""Chat formatting with Spark expressions only.

A conversation becomes one string. Adjacent turns of one role are merged into a block:

    <|turn|>ROLE<|text|>TEXT<|text|>TEXT<|end|>\\n

with one <|text|> for each turn that the block merges, so that merging loses nothing.
Inside roles and texts every "<" that is followed by any number of backslashes and a
"|" gets one backslash more; "<|" then occurs in control strings alone, and taking one
backslash off restores the text. The loss mask is the list of spans (code points, end
exclusive, with the number of the turn from 1) of the texts of trained roles within the
string.

Turns meet by one shuffle on conv_id, where their structs are collected and sorted. The
rest is array functions over the sorted turns: adjacent turns of one role are merged by
comparing each with its neighbours, offsets are running sums that an aggregation makes by
doubling steps (the sums of 1, 2, 4 ... lengths), in n log n, and the pieces are
concatenated.

Defined cases. Null text or role: the empty string. Null conv_id: a conversation of its
own. Null turn: before all others. Ties of turn: by role, then text. Repeated rows: each
is a turn. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: The role whose texts are trained on.
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_chats(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """conv_id, formatted (the string) and loss (array of start, end, turn) of every conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Structs sort by their fields in order, nulls first.
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    sorted_ = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def merged(t: Column, i: Column) -> Column:
        """A turn's piece of the string: the head that opens its block or goes on with it, its text, and its block's end."""
        opens = ~F.get("t", i - 1)["role"].eqNullSafe(t["role"])
        closes = ~F.get("t", i + 1)["role"].eqNullSafe(t["role"])
        head = F.when(opens, F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT))).otherwise(F.lit(TEXT))
        return F.struct(head.alias("head"), escaped(t["text"]).alias("body"), F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("tail"), (t["role"] == trained).alias("train"))

    pieces = sorted_.select("conv_id", F.transform("t", merged).alias("p"))
    sized = pieces.select("conv_id", "p", F.transform("p", lambda x: F.struct(F.length(x["head"]).cast("long").alias("h"), F.length(x["body"]).cast("long").alias("b"), F.length(x["tail"]).cast("long").alias("e"))).alias("z"))
    ends = running_sums(F.transform("z", lambda z: z["h"] + z["b"] + z["e"]))
    placed = sized.select("conv_id", "p", F.zip_with("z", ends, lambda z, end: F.struct((end - z["b"] - z["e"]).alias("start"), (end - z["e"]).alias("end"))).alias("at"))
    spans = F.transform("p", lambda x, i: F.struct(x["train"].alias("train"), F.get("at", i)["start"].alias("start"), F.get("at", i)["end"].alias("end"), (i + 1).alias("turn")))
    loss = F.transform(F.filter(spans, lambda s: s["train"]), lambda s: F.struct(s["start"], s["end"], s["turn"]))
    return placed.select("conv_id", F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], x["tail"])), "").alias("formatted"), loss.alias("loss"))


def running_sums(lengths: Column) -> Column:
    """The running sums of an array of longs: after the step of width w, each entry is the sum of the 2 w entries up to it."""
    zero = F.lit(0).cast("long")
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(steps, lengths, lambda sums, w: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - w), zero)))


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted string again, as an array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda b: b != "")

    def of_block(block: Column) -> Column:
        parts = F.split(F.substr(block, F.lit(len(TURN) + 1)), r"<\|text\|>")
        return F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda t: F.struct(unescaped(parts[0]).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, of_block))


def spans_fit(formatted: Column, loss: Column) -> Column:
    """Whether every span is where its turn's text lies in the string, in one pass over the string's pieces.

    "<|" occurs in control strings alone: text i is what follows the i-th <|text|>, up to
    <|end|> or the next <|text|>. The sum of the pieces before it is where it starts.
    """
    zero = F.lit(0).cast("long")

    def step(acc: Column, piece: Column) -> Column:
        span = F.get(loss, acc["k"].cast("int"))
        hit = (acc["i"] > 0) & span["turn"].cast("long").eqNullSafe(acc["i"])
        fits = span["start"].eqNullSafe(acc["at"]) & span["end"].eqNullSafe(acc["at"] + F.length(F.substring_index(piece, END, 1)))
        return F.struct(
            (acc["at"] + F.length(piece) + len(TEXT)).cast("long").alias("at"),
            (acc["i"] + 1).cast("long").alias("i"),
            (acc["k"] + F.when(hit, 1).otherwise(0)).cast("long").alias("k"),
            (acc["good"] & (~hit | fits)).alias("good"),
        )

    start = F.struct(zero.alias("at"), zero.alias("i"), zero.alias("k"), F.lit(True).alias("good"))
    return F.aggregate(F.split(formatted, r"<\|text\|>"), start, step, lambda acc: acc["good"] & (acc["k"] == F.size(loss)))


def read_back(chats: DataFrame) -> DataFrame:
    """chats with turns and under: all text under the loss mask, unescaped, nothing between.

    A span names its turn, so its text is looked up among the turns that the string was
    split into, in one step; cutting each span out of the string would start from its
    first byte every time. A span that does not start and end with its turn's text raises.
    """
    texts = F.array_join(F.transform("loss", lambda s: F.element_at("turns", s["turn"])["text"]), "")
    under = F.when(spans_fit(F.col("formatted"), F.col("loss")), texts).otherwise(F.raise_error(F.lit("a span is not its turn's text")))
    return chats.withColumn("turns", turns_of(F.col("formatted"))).withColumn("under", under)


def op7_chat(spark, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    # Two literal rows, not a local relation: nothing of them passes through Python.
    fixed = spark.sql("SELECT -7L AS conv_id, turn, role FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)").withColumn("text", F.lit(said))
    chats = read_back(format_chats(rows.unionByName(fixed)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2(F.col("under").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, coalesce(lag(role) OVER o <> role, true) AS opens, coalesce(lead(role) OVER o <> role, true) AS closes
  FROM said WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 8
                + CASE WHEN opens THEN 8 + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) ELSE 0 END
                + CASE WHEN closes THEN 8 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
