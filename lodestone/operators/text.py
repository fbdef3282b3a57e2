"""Text search: white-space tokens, lower case, a score of exact token matches."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, functions as F, types as T

from ..functions.errors import EngineError, bad_value
from ..functions.values import Typed, kind_of, quoted, root

WILDCARD = "$**"


def extract(spec: dict) -> tuple[str | None, dict]:
    """The search string of a top-level $text, and the rest of the filter."""
    if "$text" not in spec:
        return None, spec
    search = spec["$text"]
    if not isinstance(search, dict) or not isinstance(search.get("$search"), str):
        raise bad_value("$text needs a $search string")
    return search["$search"], {k: v for k, v in spec.items() if k != "$text"}


_WHITE = " \\t\\n\\r"


def _leaves(value: Typed) -> list[Column]:
    """Arrays of all strings at or below a value."""
    column, kind = value
    if kind_of(kind) == "string":
        return [F.array(column)]
    if isinstance(kind, T.StructType):
        return [leaf for f in kind.fields for leaf in _leaves(Typed(column.getField(f.name), f.dataType))]
    if isinstance(kind, T.ArrayType):
        element = kind.elementType
        if kind_of(element) == "string":
            return [column]
        count = len(_leaves(Typed(F.lit(None).cast(element), element)))
        return [F.flatten(F.transform(column, _leaf(element, k))) for k in range(count)]
    return []


def _leaf(element: T.DataType, k: int):
    def pick(x: Column) -> Column:
        return F.coalesce(_leaves(Typed(x, element))[k], F.array().cast("array<string>"))

    return pick


def score(schema: T.StructType, fields: list[str] | None, search: str) -> Column:
    """Occurrences of the search's terms in the indexed fields; a term given twice counts twice."""
    if not fields:
        raise EngineError("IndexNotFound", "text index required for $text query")
    terms = Counter(t for t in search.lower().replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if t)
    total = F.lit(0)
    if not terms:
        return total
    if WILDCARD in fields:
        # Blanks between the strings of an array keep their tokens apart.
        counted = [F.array_join(leaf, " ") for f in schema.fields if not f.name.startswith("__") for leaf in _leaves(Typed(quoted(f.name), f.dataType))]
    else:
        counted = [x.column for x in (root(schema, f) for f in fields) if kind_of(x.type) == "string"]
    for whole in counted:
        low = F.lower(whole)
        for term, times in terms.items():
            quoted_term = term.replace("\\E", "\\E\\\\E\\Q")
            # A term is counted where it stands between white space; texts without it are not searched by pattern.
            alone = F.regexp_count(low, F.lit(f"(?<![^{_WHITE}])\\Q{quoted_term}\\E(?![^{_WHITE}])"))
            total = total + F.when(F.contains(low, F.lit(term)), times * alone).otherwise(0)
    return total
