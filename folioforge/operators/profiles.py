"""Flat profiles, timelines, search predicates, facets, distributions and key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import degrees as dg
from folioforge.functions import text as tx


def _given(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _or(*values: Column) -> Column:
    """The first value that is neither null nor empty, else the last one."""
    return F.coalesce(*[_given(v) for v in values[:-1]], values[-1])


def flatten_profiles(profiles: DataFrame, key: str = "cand_id") -> DataFrame:
    """One wide row per profile; missing fields fall back on others, then on blanks."""
    p = lambda n: F.col(f"personal_information.{n}")
    first = lambda section, n: F.get(F.col(section), F.lit(0))[n]
    blank = F.lit("")
    stated = tx.experience_text(p("total_experience"), F.col("experience"))
    entries = F.transform(
        F.coalesce("education", F.array().cast(profiles.schema["education"].dataType)),
        lambda e: e.withField("normalized_degree", F.coalesce(_given(e["normalized_degree"]), dg.normalize_degree(e["degree"]))),
    )
    highest = F.coalesce(_given(F.col("normalized_highest_degree")), dg.highest_degree_stored(F.col("education")))
    rows = profiles.withColumn("education", entries)
    return rows.select(
        F.col(key).alias("id"),
        _or(p("full_name"), F.col(key)).alias("full_name"),
        _or(p("current_designation"), first("experience", "designation"), F.lit("Faculty Member")).alias("designation"),
        highest.alias("highest_degree"),
        F.coalesce(first("education", "degree"), blank).alias("raw_highest_degree"),
        dg.canonical_degrees(F.col("education")).alias("all_degrees"),
        _or(first("education", "institution"), first("education", "board_university"), blank).alias("institution"),
        F.coalesce(first("education", "institution"), blank).alias("university"),
        stated.alias("experience_text"),
        tx.experience_years(stated).alias("experience_years"),
        *[F.coalesce(p(n), blank).alias(n) for n in ("email", "phone", "address", "gender", "date_of_birth", "linkedin", "google_scholar", "researchgate")],
        "education",
        "experience",
        "publication_summary",
        tx.source_path(F.col(key)).alias("source_path"),
    )


def count_of(name: str) -> Column:
    return F.coalesce(F.col(f"publication_summary.{name}"), F.lit(0))


# Placeholders of empty timelines and roles, and the wording of the summary.
NO_EDUCATION, NO_EXPERIENCE, ROLE = "No education details extracted", "No experience details extracted", "Faculty Role"
SUMMARY = (
    "%s is an %s with approximately %d years of academic and professional experience. Highest qualification: %s. "
    "Research record includes %d journal papers, %d conference publications, and %d patents."
)


def education_timeline(flat: DataFrame) -> DataFrame:
    """One row per entry in order; a profile without entries has one placeholder row."""
    rows = flat.select("id", F.posexplode_outer("education").alias("pos", "e"))
    name = F.col("e.normalized_degree")
    raw = F.trim(F.coalesce("e.degree", F.lit("")))
    title = F.when(F.col("e").isNull(), NO_EDUCATION).otherwise(name)
    place = F.when(F.col("e").isNotNull(), tx.value_or(_or(F.col("e.institution"), F.col("e.board_university"))))
    return rows.select("id", F.coalesce("pos", F.lit(0)).alias("pos"), title.alias("title"), F.when(raw != name, raw).otherwise("").alias("raw_degree"), place.alias("place"), F.when(F.col("e").isNotNull(), tx.value_or(F.col("e.year"))).alias("year"))


def experience_timeline(flat: DataFrame) -> DataFrame:
    """One row per role in order; a profile without roles has one placeholder row."""
    rows = flat.select("id", F.posexplode_outer("experience").alias("pos", "e"))
    has = {f.name for f in flat.schema["experience"].dataType.elementType.fields}
    places = [F.col(f"e.{n}") for n in ("organization", "institution", "company") if n in has]
    end = F.coalesce("e.end_date", F.lit("")) if "end_date" in has else F.lit("")
    period = F.concat(tx.value_or(F.col("e.start_date")), F.when(end != "", F.concat(F.lit(" - "), end)).otherwise(""))
    there = F.col("e").isNotNull()
    return rows.select(
        "id",
        F.coalesce("pos", F.lit(0)).alias("pos"),
        F.when(there, tx.value_or(F.col("e.designation"), ROLE)).otherwise(NO_EXPERIENCE).alias("title"),
        F.when(there, tx.value_or(_or(*places, F.lit("")))).alias("place"),
        F.when(there, period).alias("period"),
    )


def skills(raw: DataFrame, key: str = "id", column: str = "raw") -> DataFrame:
    """(id, skills): distinct items of four optional arrays of a variant column, strings or records with a name."""
    items = []
    for name in ("skills", "technical_skills", "key_skills", "core_skills"):
        found = F.try_variant_get(F.col(column), f"$.{name}", "array<variant>")
        kind = lambda e: F.coalesce(F.schema_of_variant(e), F.lit(""))
        text = F.transform(found, lambda e: F.when(kind(e) == "STRING", F.try_variant_get(e, "$", "string")).when(F.startswith(kind(e), F.lit("OBJECT")), F.try_variant_get(e, "$.name", "string")))
        items.append(F.coalesce(text, F.array().cast("array<string>")))
    given = F.filter(F.concat(*items), lambda s: F.coalesce(s, F.lit("")) != "")
    return raw.select(key, F.array_distinct(F.transform(given, lambda s: F.trim(s))).alias("skills"))


def profile_summary(flat: DataFrame) -> DataFrame:
    """(id, summary): one paragraph about each profile."""
    years = tx.experience_years(F.when(F.col("experience_text").rlike(r"^\d+ roles$"), F.lit("")).otherwise(F.col("experience_text")))
    text = F.format_string(
        SUMMARY,
        tx.value_or(F.col("full_name"), "This faculty member"), "designation", years, "highest_degree",
        count_of("journal_publications"), count_of("conference_publications"), count_of("patents"),
    )
    return flat.select("id", text.alias("summary"))


def profile_statistics(profiles: DataFrame, key: str = "cand_id") -> DataFrame:
    """Years and counts of one profile each; here years come from the stated experience only."""
    years = tx.experience_years(F.coalesce("personal_information.total_experience", F.lit("")))
    return profiles.select(F.col(key).alias("id"), years.alias("years"), *[count_of(n).alias(n) for n in ("journal_publications", "conference_publications", "patents")])


def lookup_profile(profiles: DataFrame, identifier: str, key: str = "cand_id") -> DataFrame:
    return profiles.filter(F.col(key) == identifier)


def directory_rows(flat: DataFrame) -> DataFrame:
    """The list view: what a card shows."""
    return flat.select(
        "id",
        tx.initials(F.coalesce(_given(F.col("full_name")), F.lit("Faculty"))).alias("initials"),
        _or(F.col("full_name"), F.lit("Faculty")).alias("name"),
        _or(F.col("email"), F.col("id")).alias("contact"),
        _or(F.col("designation"), F.lit("Faculty Member")).alias("designation"),
        _or(F.col("institution"), F.col("university"), F.lit("University")).alias("institute"),
        "highest_degree",
        F.coalesce("experience_years", F.lit(0)).alias("years"),
        tx.paper_count(count_of("journal_publications"), count_of("conference_publications")).alias("papers"),
    )


def searched_text() -> Column:
    """What a search looks through: name, designation, university and degrees, joined by spaces."""
    blank = F.lit("")
    single = [F.coalesce(F.col(c), blank) for c in ("full_name", "designation", "university", "highest_degree", "raw_highest_degree")]
    raw = F.transform("education", lambda e: F.coalesce(e["degree"], blank))
    return F.array_join(F.concat(F.array(*single), "all_degrees", raw), " ")


def matches_text(search: str) -> Column:
    """A case-insensitive substring of :func:`searched_text`."""
    return F.contains(F.lower(searched_text()), F.lit(search.strip().lower()))


def matches_degree(degree: str) -> Column:
    of_top = F.exists(F.array("highest_degree"), lambda top: (top == degree) | (dg.normalize_degree(top) == degree))
    return of_top | F.array_contains("all_degrees", degree)


def contains_text(column: str, part: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(part.lower()))


def matches_experience(bucket: str) -> Column | None:
    """Years in a bucket; an unknown bucket is no condition."""
    return tx.experience_range(F.col("experience_years")) == bucket if bucket in EXPERIENCE_BUCKETS else None


def filter_profiles(flat: DataFrame, search: str = "", degree: str = "", institution: str = "", designation: str = "", experience: str = "", journal: bool = False, conference: bool = False, patent: bool = False) -> DataFrame:
    """The profiles that meet all criteria; blank criteria are no conditions. Cheap ones come first."""
    conditions = []
    for wanted, name in ((journal, "journal_publications"), (conference, "conference_publications"), (patent, "patents")):
        if wanted:
            conditions.append(count_of(name) > 0)
    if institution:
        conditions.append(contains_text("institution", institution))
    if designation:
        conditions.append(contains_text("designation", designation))
    if experience:
        conditions.append(matches_experience(experience))
    if degree:
        conditions.append(matches_degree(degree))
    if search.strip():
        conditions.append(matches_text(search))
    for condition in conditions:
        if condition is not None:
            flat = flat.filter(condition)
    return flat


def result_count(flat: DataFrame) -> DataFrame:
    return flat.agg(F.count(F.lit(1)).alias("results"))


EXPERIENCE_BUCKETS = ("0-2", "2-5", "5-10", "10+")


def _has(column: str, part: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(part))


def kpis(flat: DataFrame) -> DataFrame:
    """Ten key figures; the three designations overlap."""
    total = lambda n: F.coalesce(F.sum(count_of(n)), F.lit(0))
    return flat.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if((F.col("highest_degree") == "Ph.D.") | F.array_contains("all_degrees", "Ph.D.")).alias("phd"),
        *[F.count_if(_has("designation", n)).alias(n) for n in ("assistant", "associate", "professor")],
        F.coalesce(F.round(F.avg(F.coalesce("experience_years", F.lit(0))), 1), F.lit(0.0)).alias("average_years"),
        total("journal_publications").alias("journal"),
        total("conference_publications").alias("conference"),
        total("patents").alias("patents"),
        F.count_distinct(_given(F.col("university"))).alias("universities"),
    )


def degree_distribution(flat: DataFrame) -> DataFrame:
    """Profiles per highest degree, most first, equals by name."""
    counts = flat.groupBy(_or(F.col("highest_degree"), F.lit("Other")).alias("degree")).agg(F.count(F.lit(1)).alias("profiles"))
    return counts.orderBy(F.desc("profiles"), "degree")


def designation_class() -> Column:
    """Each profile is in one class, the first that fits."""
    rules = [("assistant", "Assistant Professor"), ("associate", "Associate Professor"), ("professor", "Professor"), ("postdoc", "Researcher"), ("research", "Researcher")]
    out = F.when(_has("designation", rules[0][0]), rules[0][1])
    for part, name in rules[1:]:
        out = out.when(_has("designation", part), name)
    return out.otherwise("Other")


def designation_distribution(flat: DataFrame) -> DataFrame:
    return flat.groupBy(designation_class().alias("designation")).agg(F.count(F.lit(1)).alias("profiles"))


def experience_histogram(flat: DataFrame) -> DataFrame:
    """Profiles per bucket of years, empty buckets included: four conditional counts over one scan."""
    bucket = tx.experience_range(F.col("experience_years"))
    one = flat.agg(*[F.count_if(bucket == b).alias(b) for b in EXPERIENCE_BUCKETS])
    return one.unpivot([], list(EXPERIENCE_BUCKETS), "bucket", "profiles")


def research_totals(flat: DataFrame) -> DataFrame:
    """(label, value): totals of journals, conferences and patents."""
    names = {"Journals": "journal_publications", "Conferences": "conference_publications", "Patents": "patents"}
    one = flat.agg(*[F.coalesce(F.sum(count_of(n)), F.lit(0)).alias(k) for k, n in names.items()])
    return one.unpivot([], list(names), "label", "value")


def facet_degrees(flat: DataFrame) -> DataFrame:
    """Distinct degrees but for Other, highest rank first, equals by name."""
    every = flat.select(F.explode(F.concat(F.array("highest_degree"), "all_degrees")).alias("degree")).filter("degree <> '' and degree <> 'Other'").distinct()
    return every.withColumn("rank", dg.degree_rank(F.col("degree"))).orderBy(F.desc("rank"), "degree")


def facet_values(flat: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column that are not blank, sorted."""
    return flat.select(F.col(column).alias("value")).filter("value <> ''").distinct().orderBy("value")


def facet_experience(flat: DataFrame) -> DataFrame:
    """The buckets of years, in order, with the number of profiles in each."""
    place = F.array_position(F.array(*[F.lit(b) for b in EXPERIENCE_BUCKETS]), F.col("bucket"))
    return experience_histogram(flat).withColumn("place", place.cast("int"))


def group_means(rows: DataFrame, by: str) -> DataFrame:
    """Means of all numeric columns per group; nulls are left out of them."""
    numeric = [n for n, t in rows.dtypes if n != by and (t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal"))]
    return rows.groupBy(by).agg(*[F.avg(n).alias(n) for n in numeric])
