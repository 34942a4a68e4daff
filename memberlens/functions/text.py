"""Message text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the message gateway: limits, marks, headings and patterns.
MAX_SUMMARY_UNITS = 2900
ELLIPSIS = "…"
BULLET = "• "
PLAIN_BULLET = "- "
ACTIONS_HEADING = "Recommended Next Actions"
BLANK = (
    r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
    r"\x{3000}\x{FEFF}]"
)
LINE_START = r"(?m)^(?<!\x{85})"
MENTION = rf"^{BLANK}*<@[^>]+>{BLANK}*"
LIST_MARK = rf"{LINE_START}({BLANK}*)[-*]{BLANK}+"
ADDRESS = r"<@[^>]+>"
OUTER_BLANK = rf"^{BLANK}+|{BLANK}+\z"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
FILLER = "\uffff"


def strip_mention(text: Column) -> Column:
    """Drop a leading mention and the blank space around the rest."""
    return F.regexp_replace(F.regexp_replace(text, MENTION, ""), OUTER_BLANK, "")


def real_newlines(text: Column) -> Column:
    r"""Turn the two characters ``\n`` into a line break."""
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


def bullets(text: Column) -> Column:
    """Turn ``-`` and ``*`` at the start of a line into bullets."""
    return F.regexp_replace(text, LIST_MARK, "$1" + BULLET)


def cap_summary(text: Column, limit: int = MAX_SUMMARY_UNITS) -> Column:
    """At most ``limit`` UTF-16 units, an ellipsis being the last one when shortened.

    Spark counts characters; those beyond the basic plane take two units, so each gets a filler
    behind it while the text is measured and cut. A character that does not fit whole is left out.
    Characters behind the first ``limit`` cannot change where the cut falls, so only those are
    padded; whether the text is too long is decided on all of it.
    """
    padded = F.regexp_replace(F.substring(text, 1, limit), f"({ASTRAL})", "$1" + FILLER)
    cut = F.regexp_replace(F.substring(padded, 1, limit - 1), rf"{ASTRAL}\z", "")
    shortened = F.concat(F.replace(cut, F.lit(FILLER), F.lit("")), F.lit(ELLIPSIS))
    # a text has at least as many units as characters and at most as many as UTF-8 bytes
    return (
        F.when(F.octet_length(text) <= limit, text)
        .when((F.length(text) > limit) | (F.length(padded) > limit), shortened)
        .otherwise(text)
    )


def summary_section(summary: Column) -> Column:
    """The rendered answer: real line breaks, bullets, then the cap."""
    return cap_summary(bullets(real_newlines(summary)))


def _listed(actions: Column, mark: str) -> Column:
    lines = F.transform(actions, lambda action: F.concat(F.lit(mark), real_newlines(action)))
    return F.array_join(lines, "\n")


def actions_section(actions: Column) -> Column:
    """The action list below its heading; NULL when there are no actions."""
    text = F.concat(F.lit(f"*{ACTIONS_HEADING}*\n"), _listed(actions, BULLET))
    return F.when(F.size(actions) > 0, text)


def fallback_text(summary: Column, actions: Column) -> Column:
    """Plain text for notifications: the whole summary, then the actions if any."""
    plain = real_newlines(summary)
    listed = F.concat(plain, F.lit(f"\n\n{ACTIONS_HEADING}\n"), _listed(actions, PLAIN_BULLET))
    return F.when(F.size(actions) > 0, listed).otherwise(plain)


def thread_key(channel: Column, thread_ts: Column, ts: Column) -> Column:
    """``channel:root``, the root being the thread's first message or the message itself."""
    return F.concat(channel, F.lit(":"), F.coalesce(thread_ts, ts))


def is_direct_message(subtype: Column, channel_type: Column, text: Column) -> Column:
    """Plain direct messages with text; bot posts, edits and channel messages are not."""
    return subtype.isNull() & (channel_type == "im") & (F.coalesce(text, F.lit("")) != "")


def is_mention(subtype: Column, channel_type: Column, text: Column) -> Column:
    """Plain messages outside direct messages that address somebody."""
    direct = F.coalesce(channel_type == "im", F.lit(False))
    return subtype.isNull() & ~direct & text.rlike(ADDRESS)
