"""Cleaning of message text: Column builders on built-in functions.

Python's regular expressions treat only ``\\n`` as a line end and know Unicode
classes; Java's do so under ``(?d)`` and ``(?U)``. Every pattern here says which it wants.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers and patterns that decide what is HTML, a bounce, system text or the start of a quoted thread.
HTML_MARKERS = ("<html", "<body", "<div", "<table", "<span", "<p ", "<br", "<!doctype")
BOUNCE_SUBJECTS = (
    r"Returned\s+mail\s*:",
    r"Delivery\s+(?:Status\s+Notification|Failure|failed|Error)",
    r"Undeliverable\s*:",
    r"Undelivered\s+Mail",
    r"Message\s+status\s*[-–]",
    r"DELIVERY\s+FAILURE",
    r"Mail\s+delivery\s+failed",
    r"NDR\s*:",
    r"Auto(?:matic)?\s*Reply\s*:",
    r"Out\s+of\s+(?:the\s+)?Office",
)
SYSTEM_BODIES = (
    r"The\s+original\s+message\s+is\s+encrypted\s+using\s+Lotus\s+Notes",
    r"This\s+(?:message|email)\s+(?:was|is)\s+automatically\s+generated",
    r"This\s+is\s+an\s+automatically\s+generated\s+(?:Delivery|email|message)",
    r"Encrypted\s+messages?\s+cannot\s+be\s+migrated",
    r"This\s+(?:message|email)\s+was\s+sent\s+by\s+the\s+Microsoft\s+Exchange",
    r"^mv\s+\d{5}\.[a-f0-9]{32}\s+\d{5}\.[a-f0-9]{32}",
)
THREAD_STARTS = (
    r"(?i:-{3,}\s*Forwarded by\b)",
    r"(?i:-{3,}\s*Original\s+Message(?:\s+Follows)?\s*-*)",
    r"(?i:-{3,}\s*(?:Begin|Start)\s+(?:of\s+)?Forwarded\s+Message\s*-*)",
    r"(?i:-{2,}\s*Forwarded\s+(?:Message|mail|by)\b)",
    r"(?ms:^On\s+.{10,250}?\s+wrote\s*:\s*$)",
    r"(?m:^\s*>+\s)",
    r"_{5,}",
    r"(?i:\n\s*From\s*:\s*\S+@\S+)",
    r"(?i:\n\s*From\s*:\s*[A-Z][a-zA-Z\s,]+\n\s*(?:Sent|To|Subject)\s*:)",
    r"(?i:transcript of session follows)",
    r"(?i:\n\s*To\s*:\s*[^\n]+\n\s*(?:cc|subject|from)\s*:)",
    r"(?i:Original\s+Message\s+Excluded\s*:)",
    r"(?i:(?:Possibly\s+)?Truncated\s+original\s+message\s+follows)",
    r"(?i:-{3,}\s*Inline\s+attachment\s+follows\s*-{3,})",
    r"(?i:Original\s+Message\s+Follows\s*:)",
    r"(?im:^Forwarded(?:-by|_by|\s+by)\s*:)",
    r"(?m:^\S[^\n]{0,120}\s+wrote\s+on\s+\d{1,2}/\d{1,2})",
    r"(?i:-{3,}\s*The following addresses\s+had\s+(?:delivery|permanent|fatal))",
    r"(?i:\*{3,}\s*ATTENTION\s*\*{3,})",
)
MIN_BODY = 50


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column, unicode: bool = True) -> Column:
    """Without white space at either end; ``trim`` takes blanks only."""
    return F.regexp_replace(c, ("(?U)" if unicode else "") + r"\A\s+|\s+\z", "")


def is_html(c: Column) -> Column:
    low = F.lower(c)
    test = c.contains("</")
    for marker in HTML_MARKERS:
        test = test | low.contains(marker)
    return test


def is_bounce(subject: Column) -> Column:
    return text(subject).rlike("(?id)" + "|".join(BOUNCE_SUBJECTS))


def is_system_body(body: Column) -> Column:
    return text(body).rlike("(?idm)" + "|".join(SYSTEM_BODIES))


def long_enough(body: Column, least: int = MIN_BODY) -> Column:
    return F.length(text(body)) >= least


def _may_quote(x: Column, unicode: bool) -> Column:
    """A cheap test that every text passes in which a quoted thread starts: some sign or word of each pattern."""
    words = ("(?iU)" if unicode else "(?i)") + r"transcript|original|forwarded|(?:from|to)\s*:"
    return x.contains("--") | x.contains(">") | x.contains("_____") | x.contains("***") | x.contains("wrote") | x.rlike(words)


def slice_thread(body: Column, unicode: bool = True) -> Column:
    """What stands above the earliest start of a quoted thread, stripped; all of it without one."""
    pattern = ("(?dU)" if unicode else "(?d)") + "|".join(THREAD_STARTS)
    above = lambda x: F.when(_may_quote(x, unicode), F.split(x, pattern, 2)[0]).otherwise(x)
    return strip(F.element_at(F.transform(F.array(text(body)), above), 1), unicode)


def normalise_space(c: Column, unicode: bool = True) -> Column:
    """No trailing white space in any line, at most one blank line in a row, stripped."""
    lines = F.regexp_replace(c, r"\r\n|[\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]", "\n")
    bare = F.regexp_replace(lines, "(?dm" + ("U" if unicode else "") + r")[^\S\n]+$", "")
    return strip(F.regexp_replace(bare, r"\n{3,}", "\n\n"), unicode)


def strip_from_line(c: Column) -> Column:
    """Without an mbox envelope line at the start."""
    return F.regexp_replace(c, r"\AFrom [^\n]*\n", "")


def one_line(c: Column) -> Column:
    """Header text: white space runs are one blank."""
    return strip(F.regexp_replace(text(c), r"(?U)\s+", " "))


def classifier_text(subject: Column, body: Column, unicode: bool = True) -> Column:
    return F.concat(F.lit("Subject: "), strip(text(subject), unicode), F.lit(". Body: "), strip(text(body), unicode))


def preview(c: Column, most: int = 300) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)
