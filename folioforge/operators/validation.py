"""Strict parsing, repair and quarantine of semi-structured model responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.plan import computed_once, let
from folioforge.functions.text import WHITE_SPACE, trim_all
from folioforge.operators import schema
from folioforge.operators.degrees import enrich_profiles
from folioforge.sources.batches import Batches

# Phrases that are taken off the start of a response, in this order.
PREFIXES = ["Here is the JSON:", "Here is your JSON:", "Here is the extracted JSON:", "The extracted information is:", "Output:", "Answer:"]
MAX_ATTEMPTS = 3


def _trimmed(text: Column) -> Column:
    """:func:`trim_all`, which looks at every character, of the texts that have white space at an end."""
    blank = lambda c: F.contains(F.lit(WHITE_SPACE), c)
    return let(text, lambda t: F.when(blank(F.left(t, F.lit(1))) | blank(F.right(t, F.lit(1))), trim_all(t)).otherwise(t))


def _without_fences(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?i)\A```json|\A```", "")
    return trim_all(F.regexp_replace(trim_all(text), r"```\z", ""))


def strip_fences(text: Column) -> Column:
    """Without a code fence at the start and at the end of the whole text."""
    return let(_trimmed(text), lambda t: F.when(F.contains(t, F.lit("```")), _without_fences(t)).otherwise(t))


def strip_prefixes(text: Column) -> Column:
    """Without the known phrases at the start, each tested once, in order."""

    def strip(t: Column, phrase: Column) -> Column:
        return F.when(F.lower(F.left(t, F.length(phrase))) == F.lower(phrase), trim_all(F.substr(t, F.length(phrase) + 1))).otherwise(t)

    first = "".join(sorted({c for p in PREFIXES for c in (p[0].lower(), p[0].upper())}))
    stripped = lambda t: F.aggregate(F.array(*[F.lit(p) for p in PREFIXES]), t, strip)
    return let(text, lambda t: F.when(F.contains(F.lit(first), F.left(t, F.lit(1))), stripped(t)).otherwise(t))


def _slice(text: Column) -> Column:
    before, behind = F.length(F.substring_index(text, "{", 1)), F.length(F.substring_index(text, "}", -1))
    both = F.contains(text, F.lit("{")) & F.contains(text, F.lit("}"))
    part = F.substr(text, before + 1, F.greatest(F.length(text) - behind - before, F.lit(0)))
    whole = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))
    return F.when(whole, text).otherwise(_trimmed(F.when(both, part).otherwise(text)))


def slice_object(text: Column) -> Column:
    """From the first opening to the last closing brace; as it is if one is missing, empty if they are reversed."""
    return let(text, _slice)


def clean_response(text: Column) -> Column:
    """The JSON part of a response. What starts and ends with a brace is that already: no step changes it."""
    bare = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))
    return F.when(bare, text).otherwise(slice_object(strip_prefixes(strip_fences(F.coalesce(text, F.lit(""))))))


def parse_strict(text: Column) -> Column:
    """The variant if the whole text is one JSON value, else null.

    The parser ignores what follows a value. So the text is parsed as the first of two items of a list, the
    second of which is a hash of the text: only if it comes out again was the text read to its end.
    """
    mark = F.hex(F.xxhash64(text))
    given = F.when(text != "", F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))  # a failed attempt costs more than this test
    both = lambda x: F.try_variant_get(x, "$[2]", "variant").isNull() & (F.try_variant_get(x, "$[1]", "string") == mark)
    return let(F.try_parse_json(given), lambda x: F.when(both(x), F.try_variant_get(x, "$[0]", "variant")))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("MISSING"))


def string_at(value: Column, path: str) -> Column:
    """A trimmed string; null and missing become empty, booleans True or False."""
    is_truth = lambda: _kind(F.try_variant_get(value, path, "variant")) == "BOOLEAN"
    text = F.coalesce(F.trim(F.try_variant_get(value, path, "string")), F.lit(""))
    return let(text, lambda t: F.when(t.isin("true", "false") & is_truth(), F.initcap(t)).otherwise(t))


def int_at(value: Column, path: str) -> Column:
    """A whole number, cut towards zero; what is not one becomes 0."""
    return F.coalesce(F.try_variant_get(value, path, "bigint"), F.lit(0).cast("bigint"))


def float_at(value: Column, path: str, default: float = 0.0) -> Column:
    """A number, or ``default`` where there is none."""
    return F.coalesce(F.try_variant_get(value, path, "double"), F.lit(default))


def bool_at(value: Column, path: str) -> Column:
    """Whether there is something: false, 0, an empty string, list or record, null and what is missing count as nothing."""
    kind = _kind(F.try_variant_get(value, path, "variant"))
    text = F.try_variant_get(value, path, "string")
    some = F.when(kind.isin("MISSING", "VOID"), False).when(kind == "STRING", text != "").when(kind == "BOOLEAN", F.try_variant_get(value, path, "boolean"))
    some = some.when(F.startswith(kind, F.lit("ARRAY")), text != "[]").when(F.startswith(kind, F.lit("OBJECT")), text != "{}")
    return some.otherwise(F.coalesce(F.try_variant_get(value, path, "double") != 0, F.lit(True)))


def _record(value: Column, names: list[str], at: str = "$") -> Column:
    return F.struct(*[string_at(value, f"{at}.{n}").alias(n) for n in names])


def records_at(value: Column, key: str, names: list[str]) -> Column:
    """The records of a list: a missing list is one blank record, what is no list is empty, what is no record is left out."""
    member = F.try_variant_get(value, f"$.{key}", "variant")
    items = F.filter(F.try_variant_get(value, f"$.{key}", "array<variant>"), lambda e: F.startswith(_kind(e), F.lit("OBJECT")))
    blank = F.array(F.struct(*[F.lit("").alias(n) for n in names]))
    return F.when(member.isNull(), blank).otherwise(F.coalesce(F.transform(items, lambda e: _record(e, names)), F.slice(blank, 1, 0)))


def repaired(value: Column) -> dict[str, Column]:
    """The sections of a profile with exactly the schema's keys from any JSON value; only known paths are read, so unknown keys drop out."""
    return {
        "personal_information": _record(value, schema.PERSONAL, "$.personal_information"),
        "education": records_at(value, "education", schema.EDUCATION),
        "experience": records_at(value, "experience", schema.EXPERIENCE),
        "publication_summary": F.struct(*[int_at(value, f"$.publication_summary.{n}").alias(n) for n in schema.PUBLICATIONS]),
    }


def repair(value: Column) -> Column:
    """:func:`repaired` as one struct."""
    return F.struct(*[c.alias(n) for n, c in repaired(value).items()])


def parse_responses(responses: DataFrame, response: str = "response") -> DataFrame:
    """Add ``cleaned``, ``value`` (the JSON value as a variant, parsed once; null where not valid) and ``valid``.

    Of repeated keys in an object the last one counts, as the session setting
    ``spark.sql.variant.allowDuplicateKeys``, which this sets, says. NaN is not accepted.
    """
    responses.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    cleaned = computed_once(responses, {"cleaned": clean_response(F.col(response))})
    return computed_once(cleaned, {"value": parse_strict(F.col("cleaned"))}).withColumn("valid", F.col("value").isNotNull())


PROFILE = ["personal_information", "education", "experience", "publication_summary"]


def repair_parsed(parsed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` and those of an enriched profile (null where ``value`` is) of parsed responses, stored or not."""
    rows = computed_once(parsed, {"_p": F.when(F.col("value").isNotNull(), repair(F.col("value")))})
    return enrich_profiles(rows.select(*keep, *[F.col(f"_p.{n}").alias(n) for n in PROFILE]))


def validate_responses(responses: DataFrame, response: str = "response") -> DataFrame:
    """Add ``cleaned``, ``valid`` and the columns of an enriched profile (null where not valid); see :func:`parse_responses`."""
    return repair_parsed(parse_responses(responses, response), [*responses.columns, "cleaned", "valid"])


def store_parsed(parsed: DataFrame, path: str, batch: str) -> None:
    """Keep parsed responses as a table of variants, by batches: one of the same key is replaced."""
    Batches(parsed.sparkSession, path).publish(batch, lambda to: parsed.write.parquet(to))


def read_parsed(spark: SparkSession, path: str, keys: str = "doc_id bigint, attempt int") -> DataFrame:
    """What :func:`store_parsed` keeps; paths of values that are asked for are read from the files as columns."""
    return Batches(spark, path).read(f"{keys}, response string, cleaned string, value variant, valid boolean")


def resolve_parsed(parsed: DataFrame, key: str = "doc_id", most: int = MAX_ATTEMPTS) -> DataFrame:
    """:func:`resolve_attempts` of parsed responses: the attempt is chosen on numbers, and only its value is repaired."""
    rows = parsed.filter(F.col("attempt") <= most)
    good = F.when(F.col("valid"), F.col("attempt"))
    chosen = rows.groupBy(key).agg(F.min(good).alias("_good"), F.max("attempt").alias("_tried"))
    values = rows.filter("valid").select(F.col(key).alias("_key"), F.col("attempt").alias("_attempt"), "value")
    found = chosen.join(values, (F.col(key) == F.col("_key")) & (F.col("_good") == F.col("_attempt")), "left")
    status = F.when(F.col("_good").isNotNull(), "success").otherwise("failed")
    found = found.withColumns({"status": status, "attempts": F.coalesce("_good", "_tried")})
    return repair_parsed(found, [key, "status", "attempts"])


def profiles_of(validated: DataFrame) -> DataFrame:
    return validated.filter("valid")


def quarantine(validated: DataFrame, key: str = "doc_id", response: str = "response") -> DataFrame:
    """(name, response) of the invalid responses, named after their document."""
    return validated.filter("not valid").select(F.concat(F.col(key).cast("string"), F.lit("_raw")).alias("name"), response)


def resolve_attempts(validated: DataFrame, key: str = "doc_id", most: int = MAX_ATTEMPTS) -> DataFrame:
    """One row per document: its first valid attempt among the first ``most``, else status failed.

    Attempts beyond ``most`` are not looked at; documents that have no others are left out.
    """
    validated = validated.filter(F.col("attempt") <= most)
    names = [f for f in ("personal_information", "education", "experience", "publication_summary", "normalized_highest_degree")]
    first = F.min_by(F.when(F.col("valid"), F.struct("attempt", *names)), F.when(F.col("valid"), F.col("attempt"))).alias("_first")
    rows = validated.groupBy(key).agg(first, F.max("attempt").alias("_tried"))
    status = F.when(F.col("_first").isNotNull(), "success").otherwise("failed").alias("status")
    return rows.select(key, status, F.coalesce("_first.attempt", "_tried").alias("attempts"), *[F.col(f"_first.{n}").alias(n) for n in names])


def chosen_attempts(responses: DataFrame, key: str = "doc_id", response: str = "response", most: int = MAX_ATTEMPTS) -> DataFrame:
    """(key, status, attempts, chosen): one row per document, with the JSON text of its first valid attempt among the first ``most``."""
    responses.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rows = responses.filter(F.col("attempt") <= most).select(key, "attempt", response)
    rows = computed_once(rows, {"_text": clean_response(F.col(response))})
    rows = computed_once(rows, {"_valid": parse_strict(F.col("_text")).isNotNull()})
    good = F.when(F.col("_valid"), F.col("attempt"))
    found = rows.groupBy(key).agg(F.min_by("_text", good).alias("chosen"), F.min(good).alias("_good"), F.max("attempt").alias("_tried"))
    status = F.when(F.col("_good").isNotNull(), "success").otherwise("failed").alias("status")
    return found.select(key, status, F.coalesce("_good", "_tried").alias("attempts"), F.when(F.col("_good").isNotNull(), F.col("chosen")).alias("chosen"))


def first_valid_profiles(responses: DataFrame, key: str = "doc_id", response: str = "response", most: int = MAX_ATTEMPTS) -> DataFrame:
    """(key, status, attempts, sections of a profile): the chosen attempts repaired, without degrees' names.

    Each section is a column by itself, so those that nobody asks for are not made.
    """
    parsed = computed_once(chosen_attempts(responses, key, response, most), {"_v": parse_strict(F.col("chosen"))})
    profile = [F.when(F.col("_v").isNotNull(), c).alias(n) for n, c in repaired(F.col("_v")).items()]
    return parsed.select(key, "status", "attempts", *profile)


def resolve_responses(responses: DataFrame, key: str = "doc_id", response: str = "response", most: int = MAX_ATTEMPTS) -> DataFrame:
    """:func:`resolve_attempts` from raw responses: the attempt is chosen first, and only the chosen response is repaired."""
    return enrich_profiles(first_valid_profiles(responses, key, response, most))


def attempt_summary(resolved: DataFrame) -> DataFrame:
    return resolved.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.max("attempts"), F.lit(0)).alias("most_attempts"),
        F.coalesce(F.sum("attempts"), F.lit(0)).cast("bigint").alias("all_attempts"),
    )
