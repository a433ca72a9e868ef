"""From raw records to text: three closed record schemas, and readers that go by the keys present."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


def monolingual(json: Column) -> Column:
    return json_text(json, "$.text")


def json_text(json: Column, path: str) -> Column:
    """A JSON string's value; null where the value is missing, null or not a string."""
    v = F.try_variant_get(F.try_parse_json(json), path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(F.try_parse_json(json), path, "string"))


def parallel(first: Column, second: Column) -> Column:
    """Both sides stripped and joined by a space; without a first side null, without a second the first alone."""
    a, b = T.strip(first), T.strip(second)
    return F.when(a == "", None).when(b == "", a).otherwise(F.concat_ws(" ", a, b))


def last_message(messages: Column, role: str) -> Column:
    """The last message of a role, stripped; empty if there is none."""
    said = F.filter(messages, lambda m: m["role"] == role)
    return F.when(F.size(said) > 0, T.strip(F.element_at(said, -1)["content"])).otherwise("")


def instruct(messages: Column) -> Column:
    """The last user and the last assistant message in the instruction template; null if one is empty."""
    user, assistant = last_message(messages, "user"), last_message(messages, "assistant")
    return F.when((user != "") & (assistant != ""), F.concat(F.lit("[INST] "), user, F.lit(" [/INST] "), assistant))


def instruct_parts(clean: Column) -> tuple[Column, Column]:
    """Instruction and output of a cleaned template, split at the first end mark."""
    parts = F.split(clean, r"\[/INST\]", 2)
    head = T.strip(F.replace(F.element_at(parts, 1), F.lit("[INST]"), F.lit("")))
    return head, F.when(F.size(parts) > 1, T.strip(F.try_element_at(parts, F.lit(2)))).otherwise("")


SCHEMAS = {"monolingual": monolingual, "parallel": parallel, "instruct": instruct}


def extractor(schema: str):
    if schema not in SCHEMAS:
        raise ValueError(f"unknown schema {schema!r}; one of {sorted(SCHEMAS)}")
    return SCHEMAS[schema]


def has_key(json: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def _field(json: Column, key: str) -> Column:
    return json_text(json, f"$.{key}")


def tokenizer_text(json: Column) -> Column:
    """text, else the first side alone, else instruction and output; stripped, null unless longer than 10.  A chosen key without a string gives null."""
    chosen = F.when(has_key(json, "text"), _field(json, "text")).when(has_key(json, "hi"), _field(json, "hi")).when(has_key(json, "instruction"), F.concat(_field(json, "instruction"), F.lit(" "), F.when(has_key(json, "output"), _field(json, "output")).otherwise("")))
    stripped = T.strip(chosen)
    return F.when(F.length(stripped) > 10, stripped)


def training_text(json: Column) -> Column:
    """text, else both sides, else the instruction template; null unless longer than 20."""
    second = F.when(has_key(json, "en"), _field(json, "en")).otherwise("")
    sides = F.when(second == "", _field(json, "hi")).otherwise(T.strip(F.concat(_field(json, "hi"), F.lit(" "), second)))
    template = F.concat(F.lit("[INST] "), _field(json, "instruction"), F.lit(" [/INST] "), F.when(has_key(json, "output"), _field(json, "output")).otherwise(""))
    chosen = F.when(has_key(json, "text"), _field(json, "text")).when(has_key(json, "hi"), sides).when(has_key(json, "instruction"), template)
    return F.when(F.length(chosen) > 20, chosen)


def evaluation_text(json: Column) -> Column:
    """The first non-empty of text and the first side; null unless longer than 20."""
    chosen = F.coalesce(F.nullif(_field(json, "text"), F.lit("")), F.nullif(_field(json, "hi"), F.lit("")), F.lit(""))
    return F.when(F.length(chosen) > 20, chosen)
