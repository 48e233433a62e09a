"""Strict JSON payload parsing with the two repair rules used by ingestion and by analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Entity replacements, in the order they are applied.
ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'")]

STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def decode_entities(text: Column) -> Column:
    """Undo HTML entities; rows without an ampersand skip the replacement chain."""
    decoded = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)
    return F.when(text.contains("&"), decoded).otherwise(text)


JSON_BLANKS = " \t\r\n"


def json_object(text: Column) -> Column:
    """``map<string,string>`` when the whole text is one JSON object, else null.

    Text without the outer braces is not handed to the parser. Wrapping the text in an array makes Spark's
    lenient reader reject trailing text.
    """
    bare = F.trim(text, F.lit(JSON_BLANKS))
    rows = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", STRICT_JSON)
    # The array around the rows names them once: size and entry would each parse the text.
    only = F.get(F.transform(F.array(rows), lambda r: F.when(F.size(r) == 1, F.get(r, 0))), 0)
    return F.when(bare.startswith("{") & bare.endswith("}"), only)


def _single_value(text: Column) -> Column:
    """True when the whole text is exactly one JSON value of any type."""
    return F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT_JSON)) == 1


def json_array_text(text: Column) -> Column:
    """True when the whole text is one JSON array."""
    return F.trim(text).startswith("[") & _single_value(text)


def _starts_inside(text: Column) -> Column:
    """True when an opening brace in front can make an object of the text: a key or the closing brace comes first."""
    first = F.substring(F.ltrim(text, F.lit(JSON_BLANKS)), 1, 1)
    return first.isin('"', "}", "")


def ingest_payload(text: Column, is_text: Column) -> Column:
    """Ingestion rule: the decoded text, then with an opening brace, then with both braces.

    A payload that arrived as a JSON object (``is_text`` false) is taken as it is.
    """
    decoded = decode_entities(text)
    repaired = F.coalesce(
        json_object(decoded),
        F.when(_starts_inside(decoded), F.coalesce(
            json_object(F.concat(F.lit("{"), decoded)), json_object(F.concat(F.lit("{"), decoded, F.lit("}")))
        )),
    )
    return F.when(F.coalesce(is_text, F.lit(True)), repaired).otherwise(json_object(text))


def analytics_payload(text: Column) -> Column:
    """Analytics rule: decoded, as is, then with an opening (and if needed a closing) brace.

    A JSON array is accepted and has no fields (empty map).
    """
    decoded = decode_entities(text)
    opened = F.concat(F.lit("{"), decoded)
    closed = F.when(opened.endswith("}"), opened).otherwise(F.concat(opened, F.lit("}")))
    no_fields = F.from_json(F.lit("{}"), "map<string,string>")
    return F.coalesce(
        json_object(decoded),
        F.when(json_array_text(decoded), no_fields),
        json_object(text),
        F.when(json_array_text(text), no_fields),
        F.when(_starts_inside(decoded), json_object(closed)),
    )


def lower_keys(payload: Column) -> Column:
    """Keys in lower case, in document order."""
    return F.transform(F.map_keys(payload), F.lower)


def field_ignoring_case(payload: Column, keys: Column, body: Column, body_keys: Column, name: str) -> Column:
    """First payload entry whose key matches ignoring case; the body is used only when the key is absent.

    ``keys`` and ``body_keys`` come from ``lower_keys``, computed once per row.
    """
    at, body_at = F.array_position(keys, name), F.array_position(body_keys, name)
    own = F.get(F.map_values(payload), (at - 1).cast("int"))
    return F.when(at > 0, own).otherwise(F.get(F.map_values(body), (body_at - 1).cast("int")))


def field_exact(payload: Column, body: Column, name: str) -> Column:
    """Case-sensitive lookup; a null payload value falls back to the body."""
    return F.coalesce(F.try_element_at(payload, F.lit(name)), F.try_element_at(body, F.lit(name)))


def has_key(keys: Column, names: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, names))), F.lit(False))


def json_type(text: Column) -> Column:
    """Type name of a payload text: object (also array and null), number, boolean, string or undefined."""
    first = F.substring(F.ltrim(text, F.lit(JSON_BLANKS)), 1, 1)
    kind = F.when(first.isin("{", "[", "n"), "object").when(first.isin("t", "f"), "boolean").when(first.rlike("[-0-9]"), "number")
    # Only text that can start a JSON value is parsed.
    return F.when(text.isNull(), "undefined").when(kind.isNotNull() & _single_value(text), kind).otherwise("string")
