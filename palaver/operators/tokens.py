"""Message bodies as flat token arrays.

A body is an ordered array of tokens: one ordered alternation finds the leftmost token, the first
alternative that matches wins, and code is opaque.  The text between tokens are the gaps.
Nesting of formats and quotes is not rebuilt: what readers need is order, existence and text.  Format
markers are paired over the whole body, with a stand-in for each token, so a pair may enclose tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import reference_kind

# The token patterns of chat messages, in their order of priority.
FENCE = r"```[\s\S]*?```"
INLINE_CODE = r"`[^`\n]+`"
ROLE = r"<@&\d+>"
USER = r"<@!?\d+>"
CHANNEL = r"<#\d+>"
CUSTOM_EMOJI = r"<a?:[A-Za-z0-9_~-]+:\d+>"
TIMESTAMP = r"<t:-?\d+(?::[tTdDfFR])?>"
EVERYONE, HERE = "@everyone", "@here"
LINK = r"\[[^\]]*\]\(https?://[^)]+\)"
URL = r"https?://[^\s<>\"')\]]+"
# The blocks that count as emoji, as code points.
EMOJI_CHAR = (
    r"[\x{1F300}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2700}-\x{27BF}\x{2600}-\x{26FF}\x{1F100}-\x{1F1FF}\x{1F000}-\x{1F02F}"
    r"\x{2B50}\x{2B55}\x{231B}\x{23F0}\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{2934}\x{2935}]"
)
EMOJI = EMOJI_CHAR + r"\x{FE0F}?[\x{1F3FB}-\x{1F3FF}]?(?:\x{200D}" + EMOJI_CHAR + r"\x{FE0F}?)*"
TOKEN = "|".join((FENCE, INLINE_CODE, ROLE, USER, CHANNEL, CUSTOM_EMOJI, TIMESTAMP, EVERYONE, HERE, LINK, URL, EMOJI))

#: Timestamp styles by letter; without one, a short date and time.
TIMESTAMP_STYLES = {
    "t": "short_time", "T": "long_time", "d": "short_date", "D": "long_date",
    "f": "short_date_time", "F": "long_date_time", "R": "relative",
}


def raw_tokens(content: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(TOKEN), F.lit(0))


def gaps(content: Column) -> Column:
    """The text before, between and after tokens: one more than there are tokens."""
    return F.split(F.coalesce(content, F.lit("")), TOKEN, -1)


def token_kind(raw: Column) -> Column:
    return (
        F.when(raw.startswith("```"), "code")
        .when(raw.startswith("`"), "icode")
        .when(raw.startswith("<@&"), "role")
        .when(raw.startswith("<@"), "user")
        .when(raw.startswith("<#"), "channel")
        .when(raw.startswith("<t:"), "timestamp")
        .when(raw.startswith("<"), "custom_emoji")
        .when(raw == EVERYONE, "everyone")
        .when(raw == HERE, "here")
        .when(raw.startswith("["), "link")
        .when(raw.startswith("http"), "url")
        .otherwise("emoji")
    )


def code_content(raw: Column) -> Column:
    """What a code token holds: a fence's text after its language line, or an inline span's."""
    inner = F.regexp_replace(raw, "^```|```$", "")
    body = F.regexp_replace(F.regexp_replace(inner, r"^[A-Za-z0-9+#.-]*\n", ""), r"\n+$", "")
    return F.when(raw.startswith("```"), body).when(raw.startswith("`"), F.regexp_replace(raw, "^`|`$", ""))


def code_language(raw: Column) -> Column:
    return F.when(raw.startswith("```"), F.nullif(F.regexp_extract(raw, r"^```([A-Za-z0-9+#.-]*)\n", 1), F.lit("")))


def tokens(content: Column) -> Column:
    """``ord``, ``kind``, ``raw``, ``ref_id``, ``name``, ``url``, ``style`` of every token, in order."""

    def describe(raw: Column, at: Column) -> Column:
        kind = token_kind(raw)
        style = F.create_map(*[F.lit(x) for pair in TIMESTAMP_STYLES.items() for x in pair])[F.regexp_extract(raw, r":([tTdDfFR])>$", 1)]
        return F.struct(
            at.cast("int").alias("ord"),
            kind.alias("kind"),
            raw.alias("raw"),
            F.when(kind.isin("user", "role", "channel", "custom_emoji"), F.regexp_extract(raw, r"(\d+)>$", 1).cast("long")).alias("ref_id"),
            F.when(kind == "custom_emoji", F.regexp_extract(raw, r":([A-Za-z0-9_~-]+):", 1))
            .when(kind == "link", F.regexp_extract(raw, r"^\[([^\]]*)\]", 1))
            .when(kind == "emoji", raw)
            .alias("name"),
            F.when(kind == "link", F.regexp_extract(raw, r"\((https?://[^)]+)\)$", 1)).when(kind == "url", raw).alias("url"),
            F.when(kind == "timestamp", F.coalesce(style, F.lit("short_date_time"))).alias("style"),
        )

    return F.transform(raw_tokens(content), describe)


def with_tokens(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("tokens", tokens(F.col(content)))


def has_code(body: Column) -> Column:
    return F.exists(body, lambda t: t["kind"].isin("code", "icode"))


def reference_rows(messages: DataFrame) -> DataFrame:
    """(message, kind, target, ordinal): mentions and channel references, dense from 0."""
    kinds = ("user", "role", "channel", "everyone", "here")
    picked = messages.select("message_id", F.posexplode(F.filter("tokens", lambda t: t["kind"].isin(*kinds))).alias("ordinal", "t"))
    return picked.select("message_id", reference_kind(F.col("t.kind")).alias("kind"), F.col("t.ref_id").alias("target_id"), "ordinal")


def quote_lines(content: Column) -> Column:
    """Quoted lines (``> ``), without their mark; ``>>> `` quotes to the end of the text."""
    text = F.coalesce(content, F.lit(""))
    block = F.regexp_extract(text, r"(?s)(?:^|\n)>>> (.*)", 1)
    lines = F.regexp_extract_all(F.regexp_replace(text, r"(?s)(?:^|\n)>>> .*", ""), F.lit(r"(?m)^> (.*)$"), F.lit(1))
    return F.when(block != "", F.concat(lines, F.array(block))).otherwise(lines)


#: Format markers, in the order in which they are tried.
MARKERS = (r"\*\*\*", r"\*\*", r"\*", "__", "_", "~~", r"\|\|")
#: Stand-ins while markers are paired: a token, the bounds of a pair that was found, a quoted line and a quote to the end.
#: They are noncharacters of Unicode; a body's own become U+FFFD.
_TOKEN, _OPEN, _CLOSE, _LINE, _BLOCK = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3", "\ufdd4"
_INNER = f"[^{_OPEN}{_CLOSE}]"
_SPAN = "|".join((f"({_BLOCK})({_INNER}+)", f"({_LINE})([^\n{_OPEN}{_CLOSE}]+)", *(f"{m}({_INNER}+?){m}" for m in MARKERS)))
_INSIDE = "$1$3" + _OPEN + "".join(f"${k}" for k in (2, 4, *range(5, 5 + len(MARKERS)))) + _CLOSE
#: A pair's inside holds no marker of its own kind, so pairs lie within each other no deeper than there are kinds, with two quotes.
_DEPTH = len(MARKERS) + 2


def _masked(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _TOKEN + _OPEN + _CLOSE + _LINE + _BLOCK, "\ufffd" * 5)


def _unmarked(text: Column) -> Column:
    """Text without its paired markers: the leftmost one that has a partner first, then what is inside by itself."""
    pairs = F.reduce(F.sequence(F.lit(1), F.lit(_DEPTH)), text, lambda x, _: F.regexp_replace(x, _SPAN, _INSIDE))
    return F.when(text.rlike(r"[*_~|]"), F.regexp_replace(pairs, f"[{_OPEN}{_CLOSE}]", "")).otherwise(text)


def strip_format(text: Column) -> Column:
    """Text without its paired markers; unpaired markers stay, and a pair has something inside."""
    return _unmarked(_masked(text))


def plain_gaps(content: Column, *, every_line: bool = False) -> Column:
    """The gaps without markers that are paired over the whole body, tokens standing in between.

    A quoted line is a text of its own, and so is all that a ``>>> `` quotes, whose mark becomes ``> ``, at each of its lines if asked for.
    """
    body = F.array_join(F.transform(gaps(content), _masked), _TOKEN)
    body = F.regexp_replace(F.regexp_replace(body, "(?<![^\n])>>> ", _BLOCK), "(?<![^\n])> ", _LINE)
    body = _unmarked(body)
    if every_line:
        at = F.instr(body, _BLOCK)
        quoted = F.replace(F.substr(body, at), F.lit("\n"), F.lit("\n> "))
        body = F.when(at > 0, F.concat(F.substr(body, F.lit(1), at - 1), quoted)).otherwise(body)
    return F.split(F.regexp_replace(body, f"[{_LINE}{_BLOCK}]", "> "), _TOKEN, -1)


def flatten(content: Column, names: Column | None = None) -> Column:
    """Plain text of a body: markers dropped, references by name (else id), code by its content.

    ``names`` maps ``kind:id`` to a name.
    """
    found, between = tokens(content), plain_gaps(content)

    def text_of(t: Column) -> Column:
        key = F.concat_ws(":", t["kind"], t["ref_id"].cast("string"))
        known = F.element_at(names, key) if names is not None else F.lit(None).cast("string")
        label = F.coalesce(known, t["ref_id"].cast("string"))
        return (
            F.when(t["kind"].isin("user", "role"), F.concat(F.lit("@"), label))
            .when(t["kind"] == "channel", F.concat(F.lit("#"), label))
            .when(t["kind"] == "custom_emoji", F.concat(F.lit(":"), t["name"], F.lit(":")))
            .when(t["kind"] == "code", F.concat(F.lit("\n"), code_content(t["raw"]), F.lit("\n")))
            .when(t["kind"] == "icode", code_content(t["raw"]))
            .when((t["kind"] == "link") & (t["name"] != ""), F.concat(strip_format(t["name"]), F.lit(" ("), t["url"], F.lit(")")))
            .when(t["kind"] == "link", t["url"])
            .when(
                t["kind"] == "timestamp",
                F.date_format(F.timestamp_seconds(F.regexp_extract(t["raw"], r"<t:(-?\d+)", 1).cast("long")), "yyyy-MM-dd'T'HH:mm:ssXXX"),
            )
            .otherwise(t["raw"])
        )

    parts = F.zip_with(
        between,
        F.transform(found, text_of),
        lambda gap, token: F.concat(gap, F.coalesce(token, F.lit(""))),
    )
    return F.btrim(F.array_join(parts, ""), F.lit(" \t\r\n"))
