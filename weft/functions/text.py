"""Text and number operators of the query language, and the text score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_OPS = ("equals", "notEquals", "contains", "startsWith", "endsWith")
NUMBER_OPS = ("equals", "notEquals", "greaterThan", "greaterThanOrEqual", "lessThan", "lessThanOrEqual")


def operator(name: str, known: tuple[str, ...]) -> str:
    """The canonical spelling of an operator name, whose case does not matter."""
    for k in known:
        if k.lower() == (name or "").lower():
            return k
    raise ValueError(f"Unsupported operator '{name}'.")


def contains_loosely(text: Column, part: Column) -> Column:
    """Case and accents do not matter."""
    return F.contains(F.collate(text, "UNICODE_CI_AI"), F.collate(part, "UNICODE_CI_AI"))


def text_op(text: Column, name: str, value: str) -> Column:
    op, low, v = operator(name, TEXT_OPS), F.upper(text), F.upper(F.lit(value))
    if op == "equals":
        return low == v
    if op == "notEquals":
        return low != v
    if op == "contains":
        return contains_loosely(text, F.lit(value))
    return F.startswith(low, v) if op == "startsWith" else F.endswith(low, v)


def number_op(number: Column, name: str, value: int) -> Column:
    op = operator(name, NUMBER_OPS)
    v = F.lit(value)
    return {
        "equals": number == v, "notEquals": number != v, "greaterThan": number > v, "greaterThanOrEqual": number >= v,
        "lessThan": number < v, "lessThanOrEqual": number <= v
    }[op]


def name_score(name: str) -> float:
    return {"equals": 1.0, "contains": 0.85}.get(operator(name, TEXT_OPS), 0.4)


def attribute_op(attrs: Column, key: str, name: str, value: str | None) -> Column:
    """Keys match whatever their case; an absent key satisfies nothing, ``notEquals`` included."""
    found = lookup(attrs, key)
    if name.lower() == "exists":
        return found.isNotNull()
    return F.coalesce(text_op(found, name, value or ""), F.lit(False))


def lookup(attrs: Column, key: str) -> Column:
    low = F.transform_keys(attrs, lambda k, _: F.lower(k))
    return F.try_element_at(low, F.lit(key.lower()))


def text_score(name: Column, attrs: Column, value: str) -> Column:
    """1 the name, .85 inside the name, .65 inside a value, .5 all terms somewhere, else 0."""
    value = value.strip()
    v = F.lit(value)
    values = F.map_values(attrs)
    everything = F.concat_ws(" ", name, F.array_join(F.transform(F.map_entries(attrs), lambda e: F.concat_ws(" ", e["key"], e["value"])), " "))
    terms = [t for t in value.split(" ") if len(t) > 1]
    every_term = F.lit(False)
    if terms:
        every_term = F.lit(True)
        for t in terms:
            every_term = every_term & contains_loosely(everything, F.lit(t))
    return (
        F.when(F.upper(name) == F.upper(v), 1.0).when(contains_loosely(name, v), 0.85)
        .when(F.coalesce(F.exists(values, lambda x: contains_loosely(x, v)), F.lit(False)), 0.65).when(every_term, 0.5).otherwise(0.0)
    )


def distinct_ignoring_case(items: Column) -> Column:
    """First spellings, in order."""
    return F.aggregate(
        items, F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )


def path_score(distance: Column) -> Column:
    return F.when(distance <= 0, F.lit(1.0)).otherwise(F.try_divide(F.lit(0.7), distance))


def descendant_score(levels: Column) -> Column:
    return F.lit(0.75) + F.try_divide(F.lit(0.25), levels)


def final_score(score: Column) -> Column:
    """At least one; four places, halves to even."""
    return F.bround(F.greatest(F.lit(1.0), score), 4)
