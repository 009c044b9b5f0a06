"""Academic degrees: canonical names by ordered rules, and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.plan import let

# The rules in order, the first that holds wins. Each has a name, strings of which one
# is contained, strings that equal the whole, a pattern, and strings that must not be contained.
RULES: list[tuple[str, list[str], list[str], str | None, list[str]]] = [
    ("Post Doctoral", ["post doc", "postdoc", "post-doc", "post doctoral"], [], None, []),
    ("Ph.D.", ["ph.d", "phd", "doctor of philosophy", "doctorate", "dr. of philosophy", "ph. d"], [], None, []),
    ("M.Tech", ["m.tech", "mtech", "m. tech", "master of technology", "masters in technology"], [], None, []),
    ("B.Tech", ["b.tech", "btech", "b. tech", "bachelor of technology"], [], None, []),
    ("MBA", ["mba", "m.b.a", "master of business administration"], [], None, []),
    ("M.E.", ["master of engineering", "m.e"], ["me"], r"\bm\.?e\.?\b", ["mech", "media"]),
    ("B.E.", ["bachelor of engineering", "b.e"], ["be"], r"\bb\.?e\.?\b", []),
    ("MCA", ["mca", "m.c.a", "master of computer application", "masters in computer application", "msc cs", "master of computer science"], [], None, []),
    ("BCA", ["bca", "b.c.a", "bachelor of computer application"], [], None, []),
    ("M.Sc.", ["m.sc", "msc", "m. sc", "m sc", "master of science", "masters of science", "master in science"], [], None, []),
    ("B.Sc.", ["b.sc", "bsc", "b. sc", "b sc", "bachelor of science", "bachelor in science"], [], None, []),
    ("M.Phil.", ["m.phil", "mphil", "master of philosophy"], [], None, []),
    ("M.S.", [], [], r"\bm\.?s\.?\b", []),
    ("M.A.", ["m.a", "master of arts", "master in arts", "master of social work", "msw"], [], None, []),
    ("B.A.", ["b.a", "ba(h)", "bachelor of arts"], [], None, []),
    ("B.Ed", ["b.ed", "bachelor of education"], [], None, []),
    ("Diploma", ["diploma"], [], None, []),
    ("Higher Secondary (12th)", ["12th", "10+2", "hsc", "h.s.c", "higher secondary", "senior secondary", "intermediate", "pre degree", "w.b.c.h.s.e", "a levels"], [], None, []),
    ("Secondary (10th)", ["10th", "ssc", "s.s.c", "secondary", "high school", "madhyamik", "matric", "metric", "sslc", "w.b.b.s.e"], [], None, []),
]
# The rank of each name.
RANKS = {
    "Post Doctoral": 90, "Ph.D.": 80, "M.Tech": 70, "M.E.": 70, "M.Sc.": 70, "MCA": 70, "MBA": 70, "M.A.": 70, "M.Phil.": 70, "M.S.": 70,
    "B.Tech": 60, "B.E.": 60, "B.Sc.": 60, "BCA": 60, "B.A.": 60, "B.Ed": 60, "Diploma": 50, "Higher Secondary (12th)": 40, "Secondary (10th)": 30, "Other": 10,
}
OTHER, LEAST_RANK = "Other", 10


def normalize_degree(raw: Column) -> Column:
    """The canonical name of a degree; Other if it is missing or no rule holds."""
    return let(F.lower(F.trim(raw)), lambda s: F.when(F.coalesce(s, F.lit("")) == "", OTHER).otherwise(_named(s)))


def _named(s: Column) -> Column:
    out = None
    for name, contained, equal, pattern, without in RULES:
        tests = [F.contains(s, F.lit(x)) for x in contained] + [s == x for x in equal]
        if pattern:
            tests.append(F.regexp_like(s, F.lit(pattern)))
        test = tests[0]
        for t in tests[1:]:
            test = test | t
        for x in without:
            test = test & ~F.contains(s, F.lit(x))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(OTHER)


def degree_rank(name: Column) -> Column:
    """The rank of a canonical degree; unknown names rank lowest."""
    ranks = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, name), F.lit(LEAST_RANK))


def best_degree(names: Column) -> Column:
    """The canonical name of the highest rank, the first one of equals; Other if there is none."""
    start = F.struct(F.lit(0).alias("rank"), F.lit(OTHER).alias("name"))
    step = lambda best, name: F.when(degree_rank(name) > best["rank"], F.struct(degree_rank(name).alias("rank"), name.alias("name"))).otherwise(best)
    return F.aggregate(F.coalesce(names, F.array().cast("array<string>")), start, step)["name"]


def highest_degree(education: Column) -> Column:
    """The highest canonical degree of an education array, from the raw degrees."""
    return best_degree(F.transform(education, lambda e: normalize_degree(e["degree"])))


def highest_degree_stored(education: Column) -> Column:
    """The same, taking a stored normalized_degree where there is one, also if it is not canonical."""
    return best_degree(F.transform(education, lambda e: F.coalesce(F.nullif(e["normalized_degree"], F.lit("")), normalize_degree(e["degree"]))))


def canonical_degrees(education: Column) -> Column:
    """Distinct canonical degrees but for Other, in the order of their first entry."""
    stored = F.transform(education, lambda e: F.coalesce(F.nullif(e["normalized_degree"], F.lit("")), normalize_degree(e["degree"])))
    return F.array_distinct(F.filter(F.coalesce(stored, F.array().cast("array<string>")), lambda d: (d != "") & (d != OTHER)))
