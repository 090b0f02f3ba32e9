"""Templates of messages: what varies is masked, ASCII word boundaries."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = "[0-9A-Za-z_]"
# Masks in order, and what stands in their place. A tilde is a word boundary.
MASKS = [
    (r"~[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}~", "<uuid>"),
    (r"~0[xX][0-9a-fA-F]+~", "<hex>"),
    (r"~[0-9a-fA-F]{12,}~", "<hex>"),
    (r"~[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(:[0-9]{2,5})?~", "<ip>"),
    (r"~[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:]{5,8}(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?~", "<ts>"),
    (r"(?i)~[0-9]+(\.[0-9]+)?[ \t\n\r\f\x0B]*(ms|s|sec|seconds?|min|minutes?|h|hours?|kb|mb|gb|tb|kib|mib|gib|bytes?|%)~", "<num>$2"),
    (r"~[0-9]+(\.[0-9]+)?~", "<num>"),
    (r'"[^"]*"', "<str>"),
    (r"'[^']*'", "<str>"),
    (r"[^ \t\n\r\f\x0B]*[0-9][^ \t\n\r\f\x0B]*", "<id>"),
]
#: Without any digit, only these can match.
_NO_DIGIT = {1, 2, 7, 8}


_EITHER = f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"


def bounded(pattern: str) -> str:
    """Word boundaries that are ASCII: Java's own follow Unicode."""
    return pattern.replace("~", _EITHER)


def java(pattern: str) -> str:
    """A mask with its tildes as ASCII word boundaries. Beside what surely is a word character one look is enough."""
    head = re.sub(r"^(\(\?i\))?~(?=[\[0-9])", lambda m: (m[1] or "") + f"(?<!{_W})", pattern)
    return bounded(head if head.endswith("%)~") else re.sub(r"~$", f"(?!{_W})", head))


def re2(pattern: str) -> str:
    return pattern.replace("~", r"\b")


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def template(message: Column) -> Column:
    """Masked, white space collapsed, lower case. A message without digits skips the masks that need one."""
    full = plain = strip(message)
    for i, (pattern, to) in enumerate(MASKS):
        full = F.regexp_replace(full, java(pattern), to)
        if i in _NO_DIGIT:
            plain = F.regexp_replace(plain, java(pattern), to)
    done = F.when(message.rlike("[0-9]"), full).otherwise(plain)
    return F.lower(F.regexp_replace(done, r"\s+", " "))


def shape(message: Column) -> Column:
    """The message with all digits alike: messages of one shape have one template, since masks don't tell digits apart.

    A zero stays where it may begin a hexadecimal number.
    """
    text = strip(message)
    return F.when(text.rlike("0[xX]"), F.translate(text, "23456789", "11111111")).otherwise(F.translate(text, "023456789", "111111111"))


def template_id(template_: Column) -> Column:
    return F.substring(F.sha1(template_), 1, 12)
