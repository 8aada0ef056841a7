"""Raw chat protocol lines to message rows; the same projection serves batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = r"^(?:@(\S*) +)?(?::(\S*) +)?PRIVMSG +(\S+)(?: +:(.*)|.*)$"


def unescape(value: Column) -> Column:
    r"""Tag values: \s space, \: semicolon, \r, \n and a doubled backslash, in one left-to-right reading."""
    hidden = F.replace(value, F.lit("\\\\"), F.lit("\u0001"))
    for code, char in (("\\s", " "), ("\\:", ";"), ("\\r", "\r"), ("\\n", "\n")):
        hidden = F.replace(hidden, F.lit(code), F.lit(char))
    return F.replace(hidden, F.lit("\u0001"), F.lit("\\"))


def _emotes(text: Column, raw: Column) -> Column:
    """Names cut out of the text by their character ranges; the emote id when a range is unusable."""
    groups = F.filter(F.split(raw, "/"), lambda g: g.contains(":"))

    def names(g: Column) -> Column:
        ident = F.split_part(g, F.lit(":"), F.lit(1))
        ranges = F.filter(F.split(F.regexp_replace(g, "^[^:]*:", ""), ","), lambda r: r.contains("-"))

        def cut(r: Column) -> Column:
            lo = F.split_part(r, F.lit("-"), F.lit(1)).try_cast("int")
            hi = F.regexp_replace(r, "^[^-]*-", "").try_cast("int")
            ok = (lo >= 0) & (hi >= lo) & (hi < F.char_length(text))
            return F.when(F.coalesce(ok, F.lit(False)), F.substring(text, lo + 1, hi - lo + 1)).otherwise(ident)

        return F.transform(ranges, cut)

    return F.when(raw != "", F.array_distinct(F.flatten(F.transform(groups, names)))).otherwise(F.array().cast("array<string>"))


def parse_chat_log(lines: DataFrame, session_id: str, fallback_channel: str = "", column: str = "value", received: Column | None = None) -> DataFrame:
    """Message rows of the ``PRIVMSG`` lines; every other line is dropped."""
    raw = lines.where(F.col(column).rlike(LINE))

    def group(i: int) -> Column:
        return F.regexp_extract(F.col(column), LINE, i)

    parsed = raw.select(
        F.split(group(1), ";").alias("tags"), group(2).alias("prefix"), group(3).alias("target"), group(4).alias("text"),
        (received if received is not None else F.current_timestamp()).alias("_now"),
    )

    def tag(name: str) -> Column:
        """Value of a tag; the last one counts where a key is repeated."""
        given = F.filter("tags", lambda t: t.startswith(f"{name}=") | (t == name))
        return unescape(F.regexp_replace(F.coalesce(F.try_element_at(given, F.lit(-1)), F.lit("")), "^[^=]*=?", ""))

    channel = F.regexp_replace(F.lower(F.trim("target")), "^#", "")
    login = tag("login")
    user = F.when(login != "", login).otherwise(F.split_part(F.col("prefix"), F.lit("!"), F.lit(1)))
    shown = unescape(tag("display-name"))
    sent = tag("tmi-sent-ts").try_cast("long")
    ts = F.coalesce(F.timestamp_millis(sent), F.col("_now"))
    badges = F.filter(F.transform(F.split(tag("badges"), ","), lambda b: F.split_part(b, F.lit("/"), F.lit(1))), lambda b: b != "")
    ch = F.when(channel == "", fallback_channel).otherwise(channel)
    fallback_id = F.concat_ws("-", ch, user, (F.unix_micros(ts) * 1000).cast("string"))
    mod = (tag("mod") == "1") | (tag("user-type") == "mod") | F.exists(badges, lambda b: b.isin("moderator", "broadcaster"))
    return parsed.select(
        F.lit(session_id).alias("session_id"),
        ch.alias("channel_id"),
        F.when(tag("id") != "", tag("id")).otherwise(fallback_id).alias("message_id"),
        ts.alias("timestamp"),
        user.alias("username"),
        F.when(shown != "", shown).otherwise(user).alias("display_name"),
        "text",
        _emotes(F.col("text"), tag("emotes")).alias("emotes"),
        badges.alias("badges"),
        F.lit("other").alias("language"),
        mod.alias("is_mod"),
        F.lower(user).contains("bot").alias("is_bot_likely"),
    )
