"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its
text is under the loss mask.  Turns after a conversation's last assistant turn (or all turns of a
conversation without one) make a closing example with an empty mask, so that no turn is lost.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline.  Control strings inside texts
are escaped reversibly: in each ``<``, backslashes, ``|`` a backslash is added before the ``|``, so
that an escaped text never holds ``<|``.  A role's backslashes and newlines are escaped as well, so
that the first newline ends it.

Scale: one shuffle, of turns by conversation.  A conversation is rendered once; an example is a
prefix of the rendering, given by spans, and is cut out only where it leaves the operator.  Memory
is bounded by the longest conversation, output by the sum of its prefixes.

Edge cases: null texts and roles are empty; a null turn sorts first; turns with equal numbers
(and repeated rows) keep all their rows, ordered by role, then text; an empty table gives no
examples; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: The turn that the registered query adds: control strings inside texts must survive.
PROBE_TEXT = "<|im_end|><|im_start|>assistant ok"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape_text(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # backslash pairs are split off first, so that an escaped backslash before an n stays itself
    parts = F.split(unescape_text(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def render_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns``, ``rendered`` and ``examples``: an array of structs with
    ``example`` (from 0), ``n_context`` turns, ``length`` of the example's prefix of ``rendered``,
    and the mask's ``loss_start`` and ``loss_end`` in code points (null in a closing example)."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("row"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    headed = F.transform(
        "rows",
        lambda r: F.struct(
            (r["role"] == "assistant").alias("target"),
            F.concat(F.lit(START), escape_role(r["role"]), F.lit("\n")).alias("head"),
            escape_text(r["text"]).alias("body"),
        ),
    )
    tail = len(END) + 1
    zero = F.lit(0).cast("int")
    convs = convs.select("conv_id", headed.alias("turns"))
    # one walk over the turns gives the running end of each
    spans = F.aggregate(
        "turns",
        F.struct(zero.alias("end"), F.array().cast("array<struct<start:int,end:int,stop:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["end"] + F.length(t["head"]) + F.length(t["body"]) + tail).cast("int").alias("end"),
            F.array_append(
                acc["spans"],
                F.struct(
                    (acc["end"] + F.length(t["head"])).cast("int").alias("start"),
                    (acc["end"] + F.length(t["head"]) + F.length(t["body"])).cast("int").alias("end"),
                    (acc["end"] + F.length(t["head"]) + F.length(t["body"]) + tail).cast("int").alias("stop"),
                ),
            ).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    convs = convs.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        rendered.alias("rendered"),
        F.arrays_zip(F.transform("turns", lambda t: t["target"]).alias("target"), spans.alias("span")).alias("marks"),
    )
    targets = F.filter(
        F.transform(
            "marks",
            lambda m, i: F.struct(
                m["target"].alias("target"),
                i.cast("int").alias("n_context"),
                m["span"]["stop"].alias("length"),
                m["span"]["start"].alias("loss_start"),
                m["span"]["end"].alias("loss_end"),
            ),
        ),
        lambda e: e["target"],
    )
    none = F.lit(None).cast("int")
    last = F.element_at("marks", -1)
    closing = F.when(
        last["target"],
        F.array().cast("array<struct<target:boolean,n_context:int,length:int,loss_start:int,loss_end:int>>"),
    ).otherwise(
        F.array(
            F.struct(
                F.lit(False).alias("target"),
                F.size("marks").alias("n_context"),
                last["span"]["stop"].alias("length"),
                none.alias("loss_start"),
                none.alias("loss_end"),
            )
        )
    )
    return convs.select("conv_id", "n_turns", "rendered", F.concat(targets, closing).alias("examples"))


def expand_examples(turns: DataFrame) -> DataFrame:
    """One row for each example: ``conv_id``, ``example``, ``is_last``, ``n_context``, ``text``,
    ``loss_start``, ``loss_end`` (offsets of the mask in ``text``, in code points)."""
    exploded = render_conversations(turns).select(
        "conv_id", "rendered", F.size("examples").alias("n"), F.posexplode("examples").alias("example", "e")
    )
    return exploded.select(
        "conv_id",
        "example",
        (F.col("example") == F.col("n") - 1).alias("is_last"),
        F.col("e.n_context").alias("n_context"),
        F.col("rendered").substr(F.lit(1), F.col("e.length")).alias("text"),
        F.col("e.loss_start").alias("loss_start"),
        F.col("e.loss_end").alias("loss_end"),
    )


def read_back(text: Column) -> Column:
    """The turns of a formatted text: an array of structs ``role``, ``text``."""
    segments = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda s: s != "")

    def turn(segment: Column) -> Column:
        at = F.instr(segment, "\n")
        return F.struct(
            unescape_role(segment.substr(F.lit(len(START) + 1), at - len(START) - 1)).alias("role"),
            unescape_text(segment.substr(at + 1, F.length(segment))).alias("text"),
        )

    return F.transform(segments, turn)


def conversation_digest(turns: DataFrame) -> DataFrame:
    """Reads the examples back: what each conversation's turns and masked texts were."""
    examples = expand_examples(turns)
    loss = F.when(
        F.col("loss_start").isNotNull(),
        unescape_text(F.col("text").substr(F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))),
    )
    whole = F.when(F.col("is_last"), read_back(F.col("text")))
    read = examples.select(
        "conv_id",
        "example",
        loss.alias("loss"),
        whole.alias("whole"),
        F.length("text").cast("long").alias("chars"),
    )
    digests = read.select(
        "conv_id",
        "chars",
        F.struct("example", "loss").alias("part"),
        F.size("whole").alias("n"),
        F.when(
            F.col("whole").isNotNull(),
            F.sha2(F.array_join(F.transform("whole", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256),
        ).alias("sha"),
    )
    # conv_id still deals the rows out, so this groups without a second shuffle
    grouped = digests.groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    return grouped.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """Adds conversation -1: a user and an assistant turn full of control strings."""
    spark = conversations.sparkSession
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
