"""Prompt tables: one row of chat messages for each document."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import trim_all
from folioforge.operators.schema import template

SYSTEM = "You turn a document about a person into one JSON object that follows the given schema, and answer with nothing else."
RULES = (
    "Answer with one JSON object and no other text.",
    "Use only what the document says.",
    "Leave out no key of the schema; use an empty string, 0 or an empty list for what is missing.",
    "Keep the entries of lists in the order of the document.",
    "Keep dates as they are written.",
)
# Fixed value: the line that ends a prompt.
CLOSING = "Return ONLY valid JSON."


def instruction_block(rules: tuple[str, ...] = RULES) -> str:
    """What all prompts share: numbered rules and the schema."""
    numbered = "\n".join(f"{i}. {r}" for i, r in enumerate(rules, 1))
    return f"RULES\n\n{numbered}\n\nJSON SCHEMA\n\n{json.dumps(template(), indent=4, ensure_ascii=False)}\n\nRESUME\n\n"


def build_prompts(docs: DataFrame, rules: tuple[str, ...] = RULES, system: str = SYSTEM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, messages): a system and a user message for each document that has text."""
    body = F.concat(F.lit(instruction_block(rules)), trim_all(F.col(text)), F.lit(f"\n\n{CLOSING}"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return with_text(docs, text).select(key, F.array(message("system", F.lit(system)), message("user", body)).alias("messages"))


def with_text(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.filter(trim_all(F.coalesce(F.col(text), F.lit(""))) != "")


def reject_empty(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, reason) of the documents that get no prompt."""
    return docs.filter(trim_all(F.coalesce(F.col(text), F.lit(""))) == "").select(key, F.lit("empty text").alias("reason"))
