"""Queries on message bodies: tokens, references, plain text and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import html_escape
from ..operators import dims, render, tokens as K
from .registry import Tables, query

M = ("messages",)

#: A body with every kind of token, made from a message's own numbers.
_RICH = (
    "concat('**bold ', CAST(turn AS STRING), '** <@&', CAST(conv_id AS STRING), '> @here <:wave_', CAST(turn AS STRING), ':', CAST(message_id AS STRING), "
    "'> <t:', CAST(1700000000 + turn AS STRING), ':R> [site ', CAST(turn AS STRING), '](https://a.example.com/', CAST(conv_id AS STRING), ') ❤️\U0001f44d\U0001f3fd @everyone ', "
    "'```py\n<@1> x = ', CAST(turn AS STRING), '\n```', '\n> quoted ', CAST(conv_id AS STRING), '\n~~gone~~ a*b')"
)


#: A body whose markers enclose tokens, stand within each other, or have no partner.
_MARKED = (
    "concat('**hey <@', CAST(conv_id AS STRING), '>** ||<#', CAST(turn AS STRING), '> spoiler|| **a `x*y` b** ~~[*site*](https://a.example.com/p_q_r)~~ _❤️_ ', "
    "'***all __of _', CAST(turn AS STRING), '_ it__*** **open <@1> *one* \n> *quoted\nline* ** <t:1700000000:R>\n>>> __deep\nend__ <@&7>')"
)


def _marked(t: Tables):
    return t.messages.selectExpr("message_id", "conv_id", "turn", f"{_MARKED} AS content")


def _rich(t: Tables):
    return t.messages.selectExpr("message_id", "conv_id", "turn", f"{_RICH} AS content")


@query(
    "extract_tokens", M,
    """SELECT message_id, 'user;channel;' || CASE WHEN turn % 3 = 0 THEN 'icode' ELSE 'url' END AS kinds, 1 + conv_id % 7 AS first_ref, 3 AS n_tokens FROM messages
    UNION ALL SELECT message_id, 'role;here;custom_emoji;timestamp;link;emoji;emoji;everyone;code', conv_id, 9 FROM messages""",
)
def _(t: Tables):
    both = t.messages.select("message_id", "content").unionAll(_rich(t).select("message_id", "content"))
    k = K.with_tokens(both)
    return k.select(
        "message_id",
        F.array_join(F.transform("tokens", lambda x: x["kind"]), ";").alias("kinds"),
        F.col("tokens")[0]["ref_id"].alias("first_ref"),
        F.size("tokens").alias("n_tokens"),
    )


@query("code_spans", M, "SELECT message_id, CASE WHEN k = 0 THEN 'x = <@1>' ELSE '<@1> x = ' || CAST(turn AS STRING) END AS code, CASE WHEN k = 1 THEN 'py' END AS language FROM messages, (SELECT unnest([0, 1]) AS k) WHERE k = 1 OR turn % 3 = 0")
def _(t: Tables):
    both = t.messages.select("message_id", "content").unionAll(_rich(t).select("message_id", "content"))
    k = K.with_tokens(both).select("message_id", F.explode("tokens").alias("k")).filter("k.kind in ('code', 'icode')")
    return k.select("message_id", K.code_content(F.col("k.raw")).alias("code"), K.code_language(F.col("k.raw")).alias("language"))


@query("quote_spans", M, "SELECT message_id, 'quoted ' || CAST(conv_id AS STRING) AS quoted FROM messages UNION ALL SELECT message_id, 'deep' || chr(10) || '> more' FROM messages")
def _(t: Tables):
    deep = F.concat("content", F.lit("\n>>> deep\n> more"))
    return _rich(t).select("message_id", F.explode(K.quote_lines(deep)).alias("quoted"))


@query(
    "strip_format", M,
    "SELECT message_id, 'bold ' || CAST(turn AS STRING) || ' both under gone a*b ' || CAST(conv_id AS STRING) || ' hid' AS stripped FROM messages UNION ALL "
    "SELECT message_id, 'in out * ' || CAST(turn AS STRING) || ' a _b c **x ~~' FROM messages",
)
def _(t: Tables):
    text = F.concat(F.lit("**bold "), F.col("turn").cast("string"), F.lit("** ***both*** __under__ ~~gone~~ a*b "), F.col("conv_id").cast("string"), F.lit(" ||hid||"))
    odd = F.concat(F.lit("**__~~||*in*||~~ out__** ***** "), F.col("turn").cast("string"), F.lit(" *a _b* c **x ~~"))
    return t.messages.select("message_id", K.strip_format(text).alias("stripped")).unionAll(t.messages.select("message_id", K.strip_format(odd)))


@query("emoji_counts", M, "SELECT emoji, CAST(n * (SELECT count(*) FROM messages) AS BIGINT) AS n FROM (VALUES ('❤️', 1), ('\U0001f44d\U0001f3fd', 1)) v(emoji, n)")
def _(t: Tables):
    k = K.with_tokens(_rich(t)).select(F.explode("tokens").alias("k")).filter("k.kind = 'emoji'")
    return k.groupBy(F.col("k.name").alias("emoji")).agg(F.count("*").alias("n"))


@query("reference_rows", M, "SELECT message_id, 0 AS ordinal, 0 AS kind, 1 + conv_id % 7 AS target_id FROM messages UNION ALL SELECT message_id, 1, 10, channel_id FROM messages")
def _(t: Tables):
    return K.reference_rows(K.with_tokens(t.messages))


@query("distinct_refs", M, "SELECT DISTINCT 'channel' AS kind, channel_id AS ref_id FROM messages UNION SELECT DISTINCT 'user', 1 + conv_id % 7 FROM messages")
def _(t: Tables):
    k = K.with_tokens(t.messages).select(F.explode("tokens").alias("k")).filter("k.kind in ('user', 'role', 'channel')")
    return k.select("k.kind", "k.ref_id").distinct()


_FLAT = (
    "trim('bold ' || CAST(turn AS STRING) || ' @' || CAST(conv_id AS STRING) || ' @here :wave_' || CAST(turn AS STRING) || ': ' || "
    "strftime(make_timestamp((1700000000 + turn) * 1000000), '%Y-%m-%dT%H:%M:%SZ') || ' site ' || CAST(turn AS STRING) || ' (https://a.example.com/' || CAST(conv_id AS STRING) || ') "
    "❤️\U0001f44d\U0001f3fd @everyone ' || chr(10) || '<@1> x = ' || CAST(turn AS STRING) || chr(10) || chr(10) || '> quoted ' || CAST(conv_id AS STRING) || chr(10) || 'gone a*b')"
)


_FLAT_MARKED = (
    "'hey @' || CAST(conv_id AS STRING) || ' #' || CAST(turn AS STRING) || ' spoiler a x*y b site (https://a.example.com/p_q_r) ❤️ all of ' || CAST(turn AS STRING) || "
    "' it open @1 one ' || chr(10) || '> *quoted' || chr(10) || 'line*  2023-11-14T22:13:20Z' || chr(10) || '> deep' || chr(10) || 'end @7'"
)


@query("flatten_text", M, f"SELECT message_id, {_FLAT} AS flat FROM messages UNION ALL SELECT message_id, {_FLAT_MARKED} FROM messages")
def _(t: Tables):
    both = _rich(t).select("message_id", "content").unionAll(_marked(t).select("message_id", "content"))
    return both.select("message_id", K.flatten(F.col("content")).alias("flat"))


_USERS, _ROLES = "c_custkey AS user_id", "CAST(n_nationkey AS BIGINT) AS role_id"


@query(
    "render_plain", ("messages", "channels"),
    """SELECT m.message_id, '@' || CAST(1 + m.conv_id % 7 AS STRING) || ' ' || m.conv_id || ' #' || coalesce(c.name, '<unknown channel>') || ' end' AS body FROM messages m LEFT JOIN channels c ON c.channel_id = m.channel_id
    UNION ALL SELECT m.message_id, 'hey @' || coalesce(u.c_name, CAST(m.conv_id AS STRING)) || ' #' || coalesce(c.name, '<unknown channel>') || ' spoiler a x*y b site (https://a.example.com/p_q_r) ❤️ all of ' || CAST(turn AS STRING) ||
      ' it open @' || (SELECT c_name FROM customer WHERE c_custkey = 1) || ' one ' || chr(10) || '> *quoted' || chr(10) || 'line*  2023-11-14' || chr(10) || '> deep' || chr(10) || '> end @' || (SELECT n_name FROM nation WHERE n_nationkey = 7)
    FROM messages m LEFT JOIN channels c ON c.channel_id = m.turn LEFT JOIN customer u ON u.c_custkey = m.conv_id""",
)
def _(t: Tables):
    short = t.messages.withColumn("content", F.expr("concat('<@', 1 + conv_id % 7, '> ', conv_id, ' <#', channel_id, '> end')"))
    users, roles = t.customer.selectExpr(_USERS, "c_name AS name"), t.nation.selectExpr(_ROLES, "n_name AS name")
    plain = render.render(short, t.channels, fmt="plain").select("message_id", "body")
    return plain.unionAll(render.render(_marked(t), t.channels, users=users, roles=roles, fmt="plain").select("message_id", "body"))


@query(
    "render_markdown", ("messages", "channels"),
    """SELECT m.message_id, CASE WHEN m.reply_to_id IS NOT NULL THEN '> ↪ replying to @' || CASE WHEN turn % 3 = 0 THEN 'unknown' ELSE coalesce(r.c_name, CAST(m.author_id AS STRING)) END || chr(10) ELSE '' END ||
      '**@' || coalesce(u.c_name, CAST(1 + m.conv_id % 7 AS STRING)) || '** `x` #' || coalesce(c.name, '<unknown channel>') || ' [a](https://e.example.com) https://e.example.com ```py' || chr(10) || 'y' || chr(10) || '```' ||
      CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || '---' || chr(10) || '[' || CASE WHEN turn % 4 = 0 THEN 'https://cdn.example.com/' ELSE 'f' END || CAST(turn AS STRING) || '](https://cdn.example.com/' || CAST(turn AS STRING) || ')' || chr(10) ELSE '' END ||
      CASE WHEN turn % 3 = 1 THEN chr(10) || chr(10) || '---' || chr(10) || '**T' || CAST(conv_id AS STRING) || '**' || chr(10) || 'https://e.example.com/' || CAST(turn AS STRING) || chr(10) || 'only text' || chr(10) ELSE '' END AS body
    FROM messages m LEFT JOIN channels c ON c.channel_id = m.channel_id LEFT JOIN customer u ON u.c_custkey = 1 + m.conv_id % 7 LEFT JOIN customer r ON r.c_custkey = m.author_id""",
)
def _(t: Tables):
    body = "concat('**<@', 1 + conv_id % 7, '>** `x` <#', channel_id, '> [a](https://e.example.com) [](https://e.example.com) ```py\ny\n```')"
    url = "concat('https://cdn.example.com/', turn)"
    embeds = "array(named_struct('title', concat('T', conv_id), 'description', '', 'url', concat('https://e.example.com/', turn)), named_struct('title', CAST(NULL AS STRING), 'description', 'only text', 'url', ''))"
    short = t.messages.selectExpr(
        "message_id", "channel_id", "reply_to_id", "CASE WHEN turn % 3 <> 0 THEN author_id END AS reply_author_id", f"{body} AS content",
        f"CASE WHEN turn % 2 = 0 THEN array(named_struct('filename', CASE WHEN turn % 4 <> 0 THEN concat('f', turn) END, 'url', {url})) END AS attachments",
        f"CASE WHEN turn % 3 = 1 THEN {embeds} END AS embeds",
    )
    users = t.customer.selectExpr(_USERS, "c_name AS name")
    return render.render(short, t.channels, users=users, fmt="markdown").select("message_id", "body")
