"""E-mail fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark import fixed
from foliospark.functions.base import all_groups, col, flags, strip_space

# A run of local-part characters that no "@" follows is read once, not once per character: a match
# may start at the head of a run or where the match before it ended.
_RUN = fixed.ADDRESS_CHARS
ADDRESS = rf"(?:\G|(?<![{_RUN}]))[{_RUN}]++@{fixed.ADDRESS_DOMAIN}"


def email_header(text: Column | str, name: str) -> Column:
    """Value of the first line that starts with ``name:``."""
    pattern = flags(rf"^{name}:\s*(.+)", "im")
    value = col(text)
    return F.when(value.rlike(pattern), strip_space(F.regexp_extract(value, pattern, 1)))


def email_addresses(text: Column | str) -> Column:
    """All addresses in order, repeats kept."""
    return all_groups(col(text), ADDRESS)


def email_fields(text: Column | str) -> Column:
    return F.struct(
        email_header(text, "From").alias("sender"),
        email_header(text, "To").alias("recipient"),
        email_header(text, "Date").alias("date"),
        email_header(text, "Subject").alias("subject"),
        email_addresses(text).alias("addresses"),
    )
