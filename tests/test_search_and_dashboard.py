"""The search index against a scan, the dashboard from one pass, and ratios of many pairs at once."""

import random

import pytest

from folioforge.functions import similarity as sim
from folioforge.operators import dashboard, record_eval
from folioforge.operators import profiles as pr
from folioforge.operators.search import SEGMENT_ROWS, SearchIndex

FLAT = (
    "id string, full_name string, designation string, university string, institution string, highest_degree string, raw_highest_degree string, all_degrees array<string>, "
    "education array<struct<degree: string>>, experience_years bigint, publication_summary struct<journal_publications: bigint, conference_publications: bigint, patents: bigint>"
)


def flat_rows(n=60, seed=4):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [
        (f"p{i:03}", pick("Ada Ä", "bob", "", None, "Ωmega x"), pick("Professor", "Assistant Professor", "Research Fellow", None, ""), pick("Uni A", "uni b", None, ""), pick("I1", "I2", "", None),
         pick("Ph.D.", "M.Tech", "Other", ""), pick("phd", None), pick(["Ph.D."], ["M.Tech", "Ph.D."], []), pick([], [("m.tech",), (None,)]), pick(0, 3, 7, 30, None), pick((1, 2, 3), (None, 0, 5), None))
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def flat(spark):
    return spark.createDataFrame(flat_rows(), FLAT).cache()


def test_index_finds_what_a_scan_finds(spark, flat, tmp_path, monkeypatch):
    monkeypatch.setattr("folioforge.operators.search.SEGMENT_ROWS", 8)
    index = SearchIndex(spark, str(tmp_path / "i"))
    assert index.search("x").count() == 0
    index.add(flat.filter("id < 'p030'"), "a")
    index.add(flat.filter("id >= 'p030'"), "b")
    index.add(flat.filter("id >= 'p030'"), "b")  # again
    ids = lambda df: sorted(r.id for r in df.collect())
    for text in ("", " ", "a", "ä", "ph", "PHD", "professor", "Ph.D. M.Tech", "uni", "ωmega", "nowhere", "assistant professor uni b", "%", "_"):
        assert ids(index.search(text)) == ids(pr.filter_profiles(flat, search=text)), text
    assert SEGMENT_ROWS == 8192


def test_a_search_reads_the_folders_of_its_grams(spark, flat, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"))
    index.add(flat, "a")
    some, every = index.candidates("phd").inputFiles(), index._postings(None).inputFiles()
    assert len(some) == 1 and len(every) > 10


def test_charts_from_one_pass(spark, flat):
    table = dashboard.facets(flat)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(dashboard.degree_distribution(table)) == rows(pr.degree_distribution(flat))
    assert rows(dashboard.designation_distribution(table)) == rows(pr.designation_distribution(flat))
    assert rows(dashboard.experience_histogram(table)) == rows(pr.experience_histogram(flat))
    assert rows(dashboard.research_totals(table)) == rows(pr.research_totals(flat))
    assert rows(dashboard.facet_degrees(table)) == rows(pr.facet_degrees(flat))
    for c in ("institution", "designation", "university"):
        assert rows(dashboard.facet_values(table, c)) == rows(pr.facet_values(flat, c))
    assert rows(dashboard.facet_experience(table)) == rows(pr.facet_experience(flat))
    none = dashboard.facets(flat.filter("false"))
    assert none.count() == 0 and [r.profiles for r in dashboard.experience_histogram(none).collect()] == [0] * 4


def test_one_scan_for_all_charts(spark, capsys, tmp_path):
    spark.createDataFrame(flat_rows(), FLAT).write.parquet(f"{tmp_path}/flat")
    dashboard.facets(spark.read.parquet(f"{tmp_path}/flat")).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


@pytest.mark.parametrize("letters, longest", [("ab", 12), ("abcdefgh ", 64), ("aé\U0001f600x", 70)])
def test_ratios_of_many_pairs(letters, longest):
    rng = random.Random(letters)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, longest, rng.randint(0, longest)])))
    pairs = [(word(), word()) for _ in range(1500)] + [("a" * 64, "a" * 64), ("a" * 63 + "b", "b" + "a" * 63), ("", "")]

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0

    want = [plain(*p) for p in pairs]
    assert sim.ratios(pairs) == want
    for least in (0.5, 0.9):
        assert all(g == w or (g == -1 and w < least) for g, w in zip(sim.ratios(pairs, least), want, strict=True))
    assert sim.ratios([]) == []


def test_bounds_spare_comparisons(monkeypatch):
    compared = []
    lanes = sim._lcs_lanes
    monkeypatch.setattr(sim, "_lcs_lanes", lambda codes, sizes, left, right: compared.append(len(left)) or lanes(codes, sizes, left, right))
    truth, found = ["harvard msc", "b", "long institution of technology phd"], ["harvard msc", "zzz", "qq"]
    rows = [(truth, found)] * 50
    assert record_eval._matches(rows, 0.5) == [[(0, 0, 1.0)]] * 50
    assert sum(compared) < 6  # of 450 pairs, 9 of which differ


def test_entries_match_as_before(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["", "ab", "abc", "abd", "b c", "xyz " * 20])
    for _ in range(200):
        truth, found = [[word() for _ in range(rng.randint(0, 4))] for _ in range(2)]
        scored = sorted((-(sim.ratio(a, b) if a and b else float(a == b)), i, j) for i, a in enumerate(truth) for j, b in enumerate(found))
        want, left, right = [], set(), set()
        for s, i, j in scored:
            if -s >= 0.5 and i not in left and j not in right:
                want.append((i, j, -s))
                left.add(i)
                right.add(j)
        assert record_eval._matches([(truth, found)], 0.5) == [want]
