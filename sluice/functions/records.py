"""Expressions over records: URLs, validation, styles, JSON, templates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A browser's idea of an address: something, one @, a host of labels. Labels repeat
#: possessively, as a group that could give back would recurse, once for each label.
EMAIL = r"\A[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*+\z"


def query_value(url: Column, name: str) -> Column:
    """The first value of a URL's parameter, decoded; null where there is none."""
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))


def query_flag(url: Column, name: str, value: str = "true") -> Column:
    return F.coalesce(query_value(url, name) == value, F.lit(False))


def filled_in(x: Column) -> Column:
    """Required fields refuse the empty text and accept white space."""
    return F.coalesce(x != "", F.lit(False))


def is_email(x: Column) -> Column:
    return F.coalesce(x.rlike(EMAIL), F.lit(False))


def is_valid_submission(name: str = "name", email: str = "email", message: str = "message") -> Column:
    return filled_in(F.col(name)) & is_email(F.col(email)) & filled_in(F.col(message))


def passes_honeypot(field: str) -> Column:
    return F.coalesce(F.col(field), F.lit("")) == ""


def link_style(path: Column, href: Column, scrolled: Column) -> Column:
    """current for the page at hand, else by whether the page is scrolled."""
    return F.when(path == href, "current").when(scrolled, "on_light").otherwise("on_dark")


def with_class(classes: Column, name: str, wanted: Column) -> Column:
    """A class list with name if wanted, without it if not; adding twice changes nothing."""
    bare = F.array_remove(classes, name)
    return F.when(wanted, F.when(F.array_contains(classes, name), classes).otherwise(F.array_append(classes, F.lit(name)))).otherwise(bare)


def or_default(x: Column, default: Column) -> Column:
    """x unless it is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), default)


def to_record_json(fields: Mapping[str, Column]) -> Column:
    """JSON of a record, with its nulls."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def bar_opacity(i: Column) -> Column:
    return F.when(i < 6, 0.6 + i * 0.06).otherwise(1.0)


def bar_colour(i: Column) -> Column:
    return F.when(i >= 6, "accent").otherwise("plain")
