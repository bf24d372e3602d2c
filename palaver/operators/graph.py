"""Reply threads over messages (``message_id``, ``reply_to_id``, ``created_at``).

Both directions are walked level by level, for many roots at once.  The messages are written once, in buckets of what a step
looks up (the parent downwards, the message upwards), so a level shuffles its frontier and never the messages.  Each level
is written to the shared folder, so neither the number of rows nor the depth is bounded by one plan; a walk ends
where a level is empty.  What is returned is one table; levels and buckets are deleted once it is there.  Cycles end at the
depth bound and, as bag semantics ask, may repeat rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import bucketed, discard, stored


def _walk(messages: DataFrame, roots: DataFrame, depth: int, down: bool) -> DataFrame:
    view = messages.select("message_id", "reply_to_id", "created_at")
    start = view.join(roots.select(F.col("message_id").alias("root_id")).distinct(), F.col("message_id") == F.col("root_id"))
    start = start.select("root_id", "message_id", "reply_to_id", "created_at", F.lit(0).alias("depth"))
    if depth <= 0:
        return start.filter("false")
    looked_up, has = ("reply_to_id", "message_id") if down else ("message_id", "reply_to_id")
    with bucketed(view.filter(F.col(looked_up).isNotNull()), looked_up) as adjacent:
        levels = [stored(start, "walk")]
        for k in range(1, depth + 1):
            found = levels[-1].alias("t").join(adjacent.alias("m"), F.col(f"m.{looked_up}") == F.col(f"t.{has}"))
            levels.append(stored(found.select("t.root_id", "m.message_id", "m.reply_to_id", "m.created_at", F.lit(k).alias("depth")), "walk"))
            if levels[-1].isEmpty():
                break
    every = levels[0]
    for level in levels[1:]:
        every = every.unionAll(level)
    out = stored(every, "walked")
    for level in levels:
        discard(messages.sparkSession, level.stored_at)
    return out


def thread_descendants(messages: DataFrame, roots: DataFrame, *, max_depth: int) -> DataFrame:
    """Replies below each root, depth 0 being the root itself; none for a depth of 0 or less."""
    return _walk(messages, roots, max_depth, True)


def reply_ancestors(messages: DataFrame, roots: DataFrame, *, max_depth: int) -> DataFrame:
    """What each root replies to, upwards."""
    return _walk(messages, roots, max_depth, False)


def expand_conversation(messages: DataFrame, roots: DataFrame, *, radius: int) -> DataFrame:
    """Each root's surroundings with their ``role``: center, ancestor or descendant."""
    down = thread_descendants(messages, roots, max_depth=radius)
    up = reply_ancestors(messages, roots, max_depth=radius).filter("depth > 0")
    role = F.when(F.col("depth") == 0, "center").otherwise("descendant")
    return down.withColumn("role", role).unionByName(up.withColumn("role", F.lit("ancestor")))


def conversation_context(messages: DataFrame, read: DataFrame, roots: DataFrame, *, radius: int = 3) -> DataFrame:
    """The surroundings with each message's author and text; one without a row is a placeholder."""
    nodes = expand_conversation(messages, roots, radius=radius)
    rows = read.select("message_id", "channel_id", "author_id", "plain_text")
    return nodes.join(rows, "message_id", "left").withColumns(
        {"channel_id": F.coalesce("channel_id", F.lit(0)), "author_id": F.coalesce("author_id", F.lit(0)), "plain_text": F.coalesce("plain_text", F.lit(""))}
    )
