"""Registered queries: name -> (callable over given tables, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lucerna.plans import corpus

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return add


# ---- SQL text shared by the oracles --------------------------------------------------------

M = f"m AS ({corpus.mutated_sql('pages')}), ok AS (SELECT * FROM m WHERE html IS NOT NULL)"


def unescape(s: str) -> str:
    s = f"replace(replace({s}, '&copy;', '©'), '&middot;', '·')"
    return f"regexp_replace(regexp_replace({s}, '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


def squash(s: str) -> str:
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def inner_text(s: str) -> str:
    return squash(unescape(f"regexp_replace({s}, '<[^>]*>', '', 'g')"))


INLINE = "a|b|span|font|label|button|select|input|img|marquee|iframe|video|audio"


def body_text(html: str) -> str:
    b = f"regexp_extract({html}, '(?s)<body>(.*)$', 1)"
    b = f"regexp_replace({b}, '</?({INLINE})( [^>]*)?>', '', 'g')"
    return squash(unescape(f"regexp_replace({b}, '<[^>]*>', ' ', 'g')"))


def attr(src: str, name: str) -> str:
    return f"regexp_extract({src}, ' {name}=\"([^\"]*)\"', 1)"


def tags(pattern: str, cols: str = "page_id", source: str = "ok") -> str:
    """One row per opening tag that matches, its source in ``t``."""
    return f"SELECT {cols}, unnest(regexp_extract_all(html, '{pattern}')) AS t FROM {source}"


def load_all() -> dict[str, tuple[Query, str | None]]:
    from lucerna.plans import queries_ops, queries_pages, queries_rules, queries_site  # noqa: F401

    return REGISTRY
