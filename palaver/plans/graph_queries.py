"""Queries on reply threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import Tables, query

_DOWN = """, t AS (SELECT message_id AS root_id, message_id, reply_to_id, created_at, 0 AS depth FROM messages WHERE {roots}
  UNION ALL SELECT t.root_id, m.message_id, m.reply_to_id, m.created_at, t.depth + 1 FROM t JOIN messages m ON m.reply_to_id = t.message_id WHERE t.depth < {depth})"""
_UP = _DOWN.replace("m.reply_to_id = t.message_id", "m.message_id = t.reply_to_id").replace(", t AS", ", u AS").replace("FROM t JOIN", "FROM u t JOIN")


def _recursive(sql: str) -> str:
    from . import views

    return views.cte("messages").replace("WITH ", "WITH RECURSIVE ", 1) + sql


def _register(name: str, sql: str):
    return query(name, (), _recursive(sql))


@_register("thread_descendants", _DOWN.format(roots="turn = 0", depth=2) + " SELECT root_id, message_id, reply_to_id, created_at, depth FROM t")
def _(t: Tables):
    return G.thread_descendants(t.messages, t.messages.filter("turn = 0"), max_depth=2)


@_register("reply_ancestors", _UP.format(roots="turn >= 5", depth=10) + " SELECT root_id, message_id, reply_to_id, created_at, depth FROM u")
def _(t: Tables):
    return G.reply_ancestors(t.messages, t.messages.filter("turn >= 5"), max_depth=10)


_EXPAND = (
    _DOWN.format(roots="turn = 1", depth=3) + _UP.format(roots="turn = 1", depth=3)
    + ", e AS (SELECT root_id, message_id, depth, CASE WHEN depth = 0 THEN 'center' ELSE 'descendant' END AS role FROM t UNION ALL SELECT root_id, message_id, depth, 'ancestor' FROM u WHERE depth > 0)"
)


@_register("expand_conversation", _EXPAND + " SELECT root_id, message_id, depth, role FROM e")
def _(t: Tables):
    return G.expand_conversation(t.messages, t.messages.filter("turn = 1"), radius=3).select("root_id", "message_id", "depth", "role")


@_register(
    "conversation_context",
    _EXPAND + " SELECT root_id, e.message_id, depth, role, coalesce(r.channel_id, 0) AS channel_id, coalesce(r.author_id, 0) AS author_id, coalesce(r.plain_text, '') AS plain_text"
    " FROM e LEFT JOIN (SELECT * FROM messages WHERE turn <> 3) r ON r.message_id = e.message_id",
)
def _(t: Tables):
    found = G.conversation_context(t.messages, t.messages.filter(F.col("turn") != 3), t.messages.filter("turn = 1"), radius=3)
    return found.drop("reply_to_id", "created_at")
