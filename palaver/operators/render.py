"""Message bodies with their references named, as plain text, markdown or HTML.

Tokens are exploded, joined once with the dimensions' names and put back in order; text between
tokens is carried along, so the body is rebuilt without reading the message again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import html_escape
from . import tokens as K

FORMATS = ("plain", "markdown", "html")


def _names(channels: DataFrame, users: DataFrame | None, roles: DataFrame | None) -> DataFrame:
    """``kind``, ``ref_id`` and ``name`` of all that may be referred to; empty names count as missing."""
    out = None
    for kind, own in (("channel", channels), ("user", users), ("role", roles)):
        if own is not None:
            part = own.filter("name <> ''").select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("ref_id"), "name")
            out = part if out is None else out.unionByName(part)
    # a name for each id, whatever the dimensions repeat (roles may, from guild to guild)
    return out.groupBy("kind", "ref_id").agg(F.min("name").alias("name"))


def _token_text(token: Column, label: Column, fmt: str) -> Column:
    kind, raw = token["kind"], token["raw"]
    code = K.code_content(raw)
    display = K.strip_format(token["name"]) if fmt == "plain" else token["name"]
    shown = (kind == "link") & (display != "") & (display != token["url"])
    at = F.timestamp_seconds(F.regexp_extract(raw, r"<t:(-?\d+)", 1).cast("long"))
    if fmt == "html":
        link = F.concat(F.lit('<a href="'), html_escape(token["url"]), F.lit('">'), html_escape(F.when(shown, display).otherwise(token["url"])), F.lit("</a>"))
        own = F.when(kind.isin("code", "icode"), F.concat(F.lit("<code>"), html_escape(code), F.lit("</code>"))).when(kind.isin("link", "url"), link)
        return F.coalesce(html_escape(label), own, html_escape(raw), F.lit(""))
    day = F.when(kind == "timestamp", F.date_format(at, "yyyy-MM-dd"))
    if fmt == "plain":
        own = F.when(kind == "code", F.concat(F.lit("\n"), code, F.lit("\n"))).when(kind == "icode", code)
        own = own.when(shown, F.concat(display, F.lit(" ("), token["url"], F.lit(")")))
    else:
        own = F.when(kind == "code", F.concat(F.lit("```"), F.coalesce(K.code_language(raw), F.lit("")), F.lit("\n"), code, F.lit("\n```")))
    return F.coalesce(label, own, F.when((kind == "link") & ~shown, token["url"]), day, raw, F.lit(""))


def render(messages: DataFrame, channels: DataFrame, *, users: DataFrame | None = None, roles: DataFrame | None = None, fmt: str = "plain") -> DataFrame:
    """Adds ``body``.  Needs ``message_id`` and ``content``.

    References are named by ``channels`` (``channel_id``, ``name``), ``users`` and ``roles``; an unknown channel says so, unknown
    users and roles are their ids.  Markdown and HTML also use, where they are there, ``reply_author_id`` beside ``reply_to_id`` (a first
    line on replies; without it the message replied to is named) and ``links`` (``label``, ``url``), ``attachments`` (``filename``,
    ``url``) and ``embeds`` (``title``, ``description``, ``url``), all arrays, for the trailer.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    between = K.plain_gaps(F.col("content"), every_line=True) if fmt == "plain" else K.gaps(F.col("content"))
    body = messages.select("message_id", K.tokens(F.col("content")).alias("tokens"), between.alias("gaps"))
    parts = F.zip_with("gaps", "tokens", lambda g, t: F.struct(g.alias("gap"), t.alias("token")))
    each = body.select("message_id", F.posexplode(parts).alias("ord", "p"))
    token = F.col("p.token")
    each = each.withColumns({"kind": token["kind"], "ref_id": token["ref_id"]}).join(_names(channels, users, roles), ["kind", "ref_id"], "left")
    known = F.coalesce("name", token["ref_id"].cast("string"))
    label = (
        F.when(token["kind"] == "channel", F.concat(F.lit("#"), F.coalesce("name", F.lit("<unknown channel>"))))
        .when(token["kind"].isin("user", "role"), F.concat(F.lit("@"), known))
        .when(token["kind"] == "custom_emoji", F.concat(F.lit(":"), token["name"], F.lit(":")))
    )
    gap = html_escape(F.col("p.gap")) if fmt == "html" else F.col("p.gap")
    text = F.concat(gap, _token_text(token, label, fmt))
    joined = each.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("ord", text.alias("text")))).alias("texts"))
    out = messages.join(joined.select("message_id", F.array_join("texts.text", "").alias("body")), "message_id")
    if fmt == "plain":
        return out
    return _trailer(_reply(out, users, fmt), fmt)


def _reply(out: DataFrame, users: DataFrame | None, fmt: str) -> DataFrame:
    if "reply_to_id" not in out.columns:
        return out
    name = F.col("reply_to_id").cast("string")
    if "reply_author_id" in out.columns:
        name = F.coalesce(F.col("reply_author_id").cast("string"), F.lit("unknown"))
        if users is not None:
            named = users.filter("name <> ''").groupBy(F.col("user_id").alias("reply_author_id")).agg(F.min("name").alias("__replied"))
            out = out.join(named, "reply_author_id", "left")
            name = F.coalesce("__replied", name)
    if fmt == "html":
        line = F.concat(F.lit('<div class="reply-context">↪ replying to @'), html_escape(name), F.lit("</div>\n"))
    else:
        line = F.concat(F.lit("> ↪ replying to @"), name, F.lit("\n"))
    prefix = F.when(F.col("reply_to_id").isNotNull(), line).otherwise("")
    return out.withColumn("body", F.concat(prefix, "body")).drop("__replied")


def _trailer(out: DataFrame, fmt: str) -> DataFrame:
    """Attachments and links, then embeds, each under a rule of its own."""

    def part(lines: Column) -> Column:
        text = F.array_join(lines, "")
        whole = F.concat(F.lit('\n<div class="trailer">'), text, F.lit("</div>")) if fmt == "html" else F.concat(F.lit("\n\n---\n"), text)
        return F.when(F.size(lines) > 0, whole).otherwise("")

    def link(label: Column, url: Column) -> Column:
        if fmt == "html":
            return F.concat(F.lit('<a href="'), html_escape(url), F.lit('">'), html_escape(label), F.lit("</a>"))
        return F.concat(F.lit("["), label, F.lit("]("), url, F.lit(")\n"))

    def embed(e: Column) -> Column:
        def line(name: str, mark: str, tag: str) -> Column:
            text = html_escape(e[name]) if fmt == "html" else e[name]
            around = (f'<div class="embed-{tag}">', "</div>") if fmt == "html" else (mark, mark + "\n")
            return F.when(e[name] != "", F.concat(F.lit(around[0]), text, F.lit(around[1]))).otherwise("")

        return F.concat(line("title", "**", "title"), line("description", "", "description"), line("url", "", "url"))

    none = F.array().cast("array<string>")
    files = []
    if "attachments" in out.columns:
        files.append(F.transform("attachments", lambda a: link(F.coalesce(a["filename"], a["url"]), a["url"])))
    if "links" in out.columns:
        files.append(F.transform("links", lambda x: link(x["label"], x["url"])))
    parts = [part(F.concat(*[F.coalesce(x, none) for x in files]))] if files else []
    if "embeds" in out.columns:
        parts.append(part(F.coalesce(F.transform("embeds", embed), none)))
    return out.withColumn("body", F.concat("body", *parts)) if parts else out
