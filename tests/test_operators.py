"""Hand-computed values, invariants and edge cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from citeloom import catalog
from citeloom.functions import stats
from citeloom.functions import text as T
from citeloom.operators import countries, dedup, descriptive, networks, organise, primitives, screening, series
from citeloom.sources import exports
from citeloom.sources.schema import conform
from citeloom.streaming import ingest


def one(df):
    return df.collect()[0]


def values(spark, *x):
    return spark.createDataFrame([(v,) for v in x], "x long")


def gini_of(spark, *x):
    return one(primitives.concentration(values(spark, *x), [], "x"))["gini"]


def test_gini(spark):
    assert gini_of(spark, 10, 10, 10, 10) == pytest.approx(0)
    assert gini_of(spark, 0, 0, 0, 100) == pytest.approx(0.75)
    assert gini_of(spark, 1, 3) == pytest.approx(0.25)
    assert gini_of(spark, 7) == 0
    assert one(primitives.concentration(values(spark, 1).where("false"), [], "x"))["n"] is None


def test_lorenz_starts_at_the_origin(spark):
    points = {(r["population"], r["share"]) for r in primitives.lorenz(values(spark, 10, 10, 10, 10), "x").collect()}
    assert points == {(0.0, 0.0), (1.0, 1.0)}


@pytest.mark.parametrize(("cited", "h", "g"), [([10, 8, 5, 4, 3], 4, 5), ([0, 0], 0, 0), ([100], 1, 1), ([3, 3, 3], 3, 3), ([25, 8, 5, 3, 3], 3, 5)])
def test_h_and_g(spark, cited, h, g):
    row = one(primitives.citation_indices(values(spark, *cited), [], "x"))
    assert (row["h_index"], row["g_index"]) == (h, g)


def test_bradford_fixture(spark):
    venues = spark.createDataFrame([(f"v{i}", n) for i, n in enumerate([10, 8, 6, 4, 3, 2, 2, 1, 1])], "source string, n long")
    zoned = primitives.bradford(venues, "source", "n")
    zones = {r["source"]: r["zone"] for r in zoned.collect()}
    assert [s for s, z in zones.items() if z == 1] == ["v0"]
    assert sorted(s for s, z in zones.items() if z == 2) == ["v1", "v2"]
    assert sum(r["sources"] for r in primitives.bradford_zones(zoned, "n").collect()) == 9


def test_single_and_multi_country_papers_add_up(spark):
    pairs = spark.createDataFrame([(1, "CHINA"), (1, "UNITED STATES"), (2, "CHINA"), (3, "UNITED STATES"), (4, "CHINA"), (4, "BRAZIL")], "doc long, country string")
    records = spark.createDataFrame([(i, 2018 + i, i * 2) for i in range(1, 5)], "doc long, year int, citations long")
    rows = descriptive.country_table(pairs, records).collect()
    assert all(r["scp"] + r["mcp"] == r["articles"] for r in rows)
    assert {r["country"]: r["mcp_ratio"] for r in rows}["CHINA"] == pytest.approx(2 / 3)
    links = countries.collaboration(pairs).collect()
    assert {(r["a"], r["b"]): r["weight"] for r in links} == {("CHINA", "UNITED STATES"): 1, ("BRAZIL", "CHINA"): 1}


def test_title_keys_are_of_whole_texts(spark, tmp_path):
    opening = "A shared opening, " * 20
    spark.createDataFrame([(1, opening + "then École"), (2, opening + "then R&D"), (3, None), (4, " -- ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    keys = {r["doc_id"]: r["title_key"] for r in catalog.QUERIES["title_keys"](spark, str(tmp_path)).collect()}
    start = "a shared opening " * 20
    assert keys == {1: start + "then ecole", 2: start + "then r and d", 3: None, 4: None}


def test_normalisers(spark):
    row = one(
        spark.range(1).select(
            T.doi_key(F.lit("https://doi.org/10.1000/ABC. ")).alias("doi"),
            T.title_key(F.lit("Étude &amp; Part 2: A-B")).alias("title"),
            T.country(F.lit("U.S.A.")).alias("us"),
            T.country(F.lit("Europe")).alias("none"),
            T.split_values(F.lit("a; b;;a ")).alias("many"),
            T.orcid_is_valid(F.lit("0000-0002-1825-0097")).alias("good"),
            T.orcid_is_valid(F.lit("0000-0002-1825-0098")).alias("bad"),
            T.author_name(F.lit("Smith, John A.")).alias("a1"),
            T.author_name(F.lit("John A Smith")).alias("a2"),
            T.author_name(F.lit("Smith JA")).alias("a3"),
            T.affiliation_countries(F.lit("Univ X, Boston, USA; Univ Y, Beijing, Peoples R China; Z, USA")).alias("c1"),
            T.title_similarity(F.lit("part 1"), F.lit("part 2")).alias("near"),
            T.emails(F.lit("Mail A.b@x.org, a.b@x.org!")).alias("mail"),
            T.language(F.lit("the cat is in the house and the dog is with that man")).alias("en"),
            T.keyword_phrase(F.lit("state_of-the ART")).alias("kw"),
            T.keyword_key(F.lit("Optimisation models")).alias("key"),
            T.abstract_from_index(F.create_map(F.lit("world"), F.array(F.lit(1)), F.lit("hello"), F.array(F.lit(0), F.lit(2)))).alias("abs"),
        )
    ).asDict()
    assert row["doi"] == "10.1000/abc" and row["title"] == "etude and part 2 a b"
    assert row["us"] == "UNITED STATES" and row["none"] is None and row["many"] == ["a", "b"]
    assert row["good"] and not row["bad"]
    assert row["a1"] == row["a2"] == row["a3"] == "Smith, JA"
    assert row["c1"] == ["UNITED STATES", "CHINA"] and row["near"] < 0.9
    assert row["mail"] == ["a.b@x.org"] and row["en"] == "en"
    assert row["kw"] == "State of the Art" and row["key"] == "optimization model" and row["abs"] == "hello world hello"


def records_of(spark, rows):
    return conform(spark.createDataFrame(rows))


def test_duplicates_merge_by_field_rules(spark):
    one_, two = (
        {"title": "A study", "authors": ["Smith J"], "year": 2020, "source": "J One", "citations": 5, "doi": "10.1/x", "abstract": "short", "source_db": "SCOPUS"},
        {"title": "A study of", "authors": ["Smith J", "Brown A"], "year": 2020, "source": "J Wos", "citations": 12, "doi": "https://doi.org/10.1/X", "abstract": "longer text", "source_db": "WOS"},
    )
    raw = records_of(spark, [one_, two, {**one_, "doi": "10.1/z", "title": "Other", "citations": 1, "source_db": "WOS"}])
    merged = dedup.deduplicate(raw).collect()
    assert len(merged) == 2
    row = next(r for r in merged if r["doi_key"] == "10.1/x")
    assert sorted(row["authors"]) == ["Brown A", "Smith J"] and row["citations"] == 12
    assert row["abstract"] == "longer text" and row["source"] == "J Wos" and row["n_merged"] == 2
    assert row["merged_by"] == "doi_exact" and "source" in row["conflicts"]


def test_titles_merge_without_doi_only(spark):
    base = {"title": "Deep learning for cats", "authors": ["A"], "year": 2020, "source": "S", "citations": 1, "doi": "", "source_db": "WOS"}
    raw = records_of(spark, [base, {**base, "title": "Deep Learning for Cats!"}, {**base, "doi": "10.2/a"}, {**base, "title": "Deep learning for cat"}])
    assert dedup.deduplicate(raw).count() == 3
    # "...cats" and "...cat": Jaccard 3/5 and edit similarity 21/22 give 0.777
    assert dedup.deduplicate(raw, fuzzy=0.8).count() == 2
    assert dedup.deduplicate(raw, fuzzy=0.75).count() == 1
    assert one(dedup.summary(raw, dedup.deduplicate(raw)))["removed"] == 1


LEDGER = [
    (1, "screening", "r1", "include", None, False), (1, "screening", "r2", "include", None, False), (2, "screening", "r1", "exclude", "topic", False), (2, "screening", "r2", "exclude", "topic", False),
    (3, "screening", "r1", "include", None, False), (3, "screening", "r2", "exclude", "method", False), (3, "screening", "chair", "include", None, True), (1, "eligibility", "r1", "exclude", "data", False), (3, "eligibility", "r1", "include", None, False),
]


def test_screening_fixture(spark):
    ledger = spark.createDataFrame(LEDGER, "doc long, stage string, reviewer string, decision string, reason string, is_final boolean")
    agreed = screening.consensus(screening.standardise(ledger))
    found = {(r["doc"], r["stage"]): r["decision"] for r in agreed.collect()}
    assert found == {(1, "screening"): "include", (2, "screening"): "exclude", (3, "screening"): "include", (1, "eligibility"): "exclude", (3, "eligibility"): "include"}
    flow = one(screening.prisma(agreed, spark.range(5)))
    assert (flow["screened"], flow["screening_excluded"], flow["assessed"], flow["eligibility_excluded"], flow["included"], flow["monotone"]) == (3, 1, 2, 1, 1, True)
    pair = next(r for r in screening.cohens_kappa(ledger).collect() if r["stage"] == "screening" and (r["reviewer_a"], r["reviewer_b"]) == ("r1", "r2"))
    assert pair["n"] == 3 and pair["kappa"] == pytest.approx(0.4)


def test_csv_export_without_repeated_headers(spark, tmp_path):
    head = "Authors,Title,Year,Source title,Cited by,DOI,Affiliations\n"
    (tmp_path / "a.csv").write_text(head + '"A B;C D","T ""one""\nmore",2020,J,3,10.1/a,"U, Boston, USA"\n' + head)
    (tmp_path / "b.csv").write_text(head + "E F,T two,bad,J,,10.1/b,\n")
    rows = {r["doi"]: r for r in exports.read_csv(spark, f"{tmp_path}/*.csv", "scopus").collect()}
    assert set(rows) == {"10.1/a", "10.1/b"}
    assert rows["10.1/a"]["title"] == 'T "one"\nmore' and rows["10.1/a"]["countries"] == ["UNITED STATES"]
    assert rows["10.1/b"]["year"] is None and rows["10.1/b"]["citations"] == 0


def test_bibtex(spark, tmp_path):
    (tmp_path / "x.bib").write_text('@article{k1,\n author = {Smith, J. and Brown, A.},\n title = {The {DNA} of it},\n year = 2019,\n note = {Cited by: 7},\n journal = "J One",\n}\n@comment{no}\n@book{k2, title={Two}, year={2001}}\n')
    rows = {r["title"]: r for r in exports.read_bibtex(spark, f"{tmp_path}/x.bib").collect()}
    assert set(rows) == {"The DNA of it", "Two"}
    first = rows["The DNA of it"]
    assert first["authors"] == ["Smith, J.", "Brown, A."] and first["citations"] == 7 and first["year"] == 2019 and first["source"] == "J One"


def test_api_mapping(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"id":"W1","title":"T","publication_year":2021,"cited_by_count":4,"authorships":[{"author":{"display_name":"A"},"institutions":[{"display_name":"U"}],"countries":["BR"]}],"concepts":[{"display_name":"C1","score":0.9},{"display_name":"C2","score":0.1}],"abstract_inverted_index":{"b":[1],"a":[0]}}\n')
    row = one(exports.read_json(spark, f"{tmp_path}/w.json", "openalex"))
    assert row["abstract"] == "a b" and row["index_keywords"] == ["C1"] and row["authors"] == ["A"] and row["citations"] == 4


def test_organised_tables(spark):
    raw = records_of(spark, [{"title": "T", "authors": ["A", "B", "A"], "year": 2020, "source": "S", "citations": 3, "doi": "10.1/a", "keywords": ["X", "x "], "index_keywords": ["y"], "affiliations": ["Univ X, Boston, USA"], "countries": ["USA"], "references": ["Smith J, 2015, A long reference, doi 10.5/abc"], "source_db": "WOS"}])
    tables = organise.organise(dedup.deduplicate(raw))
    assert tables["author_documents"].count() == 2 and tables["keywords"].count() == 2
    assert one(tables["references"])["year"] == 2015 and one(tables["affiliations"])["sector"] == "Academic"
    assert one(tables["documents"])["status"] == "ready" and one(organise.quality(dedup.deduplicate(raw), 2024))["invalid_year"] == 0


def line_series(spark, y):
    return spark.createDataFrame([("s", 2000 + i, v) for i, v in enumerate(y)], "g string, year int, articles long")


def test_trend_tests(spark):
    up = line_series(spark, list(range(10)))
    row = one(series.mann_kendall(up, ["g"]))
    assert row["s"] == 45 and row["sen_slope"] == 1
    assert one(series.with_p_values(series.mann_kendall(up, ["g"])))["p_value"] < 0.001
    shift = line_series(spark, [1, 1, 1, 1, 1, 9, 9, 9, 9, 9])
    assert one(series.pettitt(shift, ["g"]))["year"] == one(series.mean_shift(shift, ["g"]))["year"] == 2004
    assert all(r["consensus"] for r in series.change_consensus(shift, ["g"]).collect())


def test_curves_find_their_own_family(spark):
    logistic = line_series(spark, [round(1000 / (1 + math.exp(-0.6 * (t - 10)))) for t in range(21)])
    best = min(series.fit_curves(logistic, ["g"]).collect(), key=lambda r: r["rank"])
    assert best["model"] == "logistic" and best["r2"] > 0.999
    assert all(0 <= r["r2"] <= 1 for r in series.fit_curves(logistic, ["g"]).collect())


def test_spectrum_finds_the_period(spark):
    wave = line_series(spark, [round(100 + 50 * math.sin(2 * math.pi * t / 5)) for t in range(20)])
    best = max(series.spectrum(wave, ["g"]).collect(), key=lambda r: r["power"])
    assert best["period"] == 5


def test_bursts(spark):
    rows = series.bursts(line_series(spark, [5, 5, 5, 5, 50, 50, 5, 5, 5, 5]), ["g"]).collect()
    assert [(r["start"], r["end"]) for r in rows] == [(2004, 2005)]


def test_graph_measures(spark):
    path = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 1), (1, 3, 1), (7, 8, 1)], "a long, b long, weight long")
    assert {r["node"]: r["component"] for r in networks.components(path).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}
    assert {r["node"]: r["triangles"] for r in networks.triangles(path).collect()} == {1: 1, 2: 1, 3: 1}
    nodes = networks.degrees(path).select("node")
    assert {r["node"]: r["betweenness"] for r in networks.betweenness(path, nodes).collect()} == {1: 0, 2: 0, 3: 2, 4: 0, 7: 0, 8: 0}
    assert {r["node"]: r["closeness"] for r in networks.closeness(path, nodes).collect()}[3] == 1
    ranks = networks.pagerank(path.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    assert one(ranks.agg(F.sum("rank").alias("s")))["s"] == pytest.approx(1)


def test_communities_and_modularity(spark):
    clique = [(a, b, 1) for g in (0, 10) for a in range(g, g + 4) for b in range(a + 1, g + 4)] + [(3, 10, 1)]
    edges = spark.createDataFrame(clique, "a long, b long, weight long")
    found = networks.communities(edges)
    groups = {}
    for r in found.collect():
        groups.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3], [10, 11, 12, 13]]
    assert one(networks.modularity(edges, found, "community"))["modularity"] == pytest.approx(2 * (6 / 13 - 0.25))


def test_many_tests_corrected(spark):
    tests = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p_value double")
    rows = {r["p_value"]: r for r in stats.benjamini_hochberg(tests).collect()}
    assert rows[0.01]["p_bh"] == pytest.approx(0.03) and rows[0.03]["p_bh"] == pytest.approx(0.04)
    assert rows[0.01]["p_holm"] == pytest.approx(0.03) and rows[0.03]["p_holm"] == pytest.approx(0.06) and rows[0.04]["p_holm"] == pytest.approx(0.06)
    assert rows[None]["p_bh"] is None


def test_distribution_functions(spark):
    row = one(spark.range(1).select(stats.normal_two_sided(F.lit(1.959964)).alias("z"), stats.chi_square_tail(F.lit(18.307), F.lit(10.0)).alias("c")))
    assert row["z"] == pytest.approx(0.05, abs=1e-5) and row["c"] == pytest.approx(0.05, abs=1e-3)


def test_bootstrap_covers_the_mean(spark):
    row = one(stats.bootstrap_mean(values(spark, *range(100)), "x", rounds=200))
    assert row["low"] < 49.5 < row["high"] and row["estimate"] == pytest.approx(49.5)


def test_stream_drops_repeats(spark, tmp_path):
    rows = [("10.1/a", "2024-01-01 00:00:00"), ("10.1/A", "2024-01-01 00:01:00"), (None, "2024-01-01 00:02:00"), (None, "2024-01-01 00:03:00")]
    spark.createDataFrame(rows, "doi string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doi string, ts timestamp").parquet(f"{tmp_path}/in")
    ingest.append_to(ingest.first_seen(stream, "ts"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_topics(spark):
    from citeloom.operators import topics

    words = spark.createDataFrame([(d, w) for d in range(20) for w in (("alpha", "beta", "gamma") if d % 2 else ("delta", "epsilon", "zeta"))], "doc long, keyword string")
    records = spark.createDataFrame([(d, 2000 + d // 5) for d in range(20)], "doc long, year int")
    listed, weights = topics.lda(words, topics=2, terms=3)
    assert listed.count() == 6 and one(weights.groupBy("doc").agg(F.sum("weight").alias("s")).agg(F.min("s").alias("s")))["s"] == pytest.approx(1)
    vocabulary = topics.yearly_vocabulary(words, records)
    assert all(r["retention"] == 1 for r in topics.retention(vocabulary).where("year > 2000").collect())
    assert topics.topic_trends(vocabulary).count() == 6 and topics.coherence(listed, words).count() == 2 and topics.topic_prevalence(weights, records).count() == 8


def test_hypotheses_and_claims(spark):
    from citeloom.operators import hypotheses

    up = line_series(spark, list(range(0, 40, 2)))
    rows = {r["id"]: r for r in hypotheses.growth(up, ["g"]).collect()}
    assert rows["monotone_trend"]["supported"] and rows["linear_growth"]["statistic"] == pytest.approx(1)
    assert {r["strength"] for r in hypotheses.claims(hypotheses.growth(up, ["g"])).where("id = 'monotone_trend'").collect()} == {"strong"}


def test_run_from_files_to_tables(spark, tmp_path):
    from citeloom.plans.run import Settings, run

    head = "Authors,Title,Year,Source title,Cited by,DOI,Affiliations,Author Keywords,Index Keywords,Document Type,References\n"
    rows = [f'"A{i % 3} B;C{i % 2} D",Title number {i} of it,{2010 + i % 6},J{i % 2},{i},10.1/a{i},"U, Boston, USA; V, Paris, France",alpha; w{i % 4},,Article,' for i in range(18)]
    (tmp_path / "a.csv").write_text(head + "\n".join(rows) + "\n" + rows[0] + "\n")
    settings = Settings(sources=[{"format": "csv", "paths": f"{tmp_path}/a.csv", "kind": "scopus"}], modules=("documents", "description", "growth", "institutions", "countries", "hypotheses"))
    assert Settings.from_json(settings.to_json()) == settings
    manifest = run(spark, settings, f"{tmp_path}/out")
    assert one(spark.read.parquet(f"{tmp_path}/out/merge_summary"))["removed"] == 1
    assert one(spark.read.parquet(f"{tmp_path}/out/overview"))["documents"] == 18
    assert spark.read.parquet(f"{tmp_path}/out/corpus_hypotheses").count() == 10 and "country_summary" in manifest["tables"]
    with pytest.raises(ValueError):
        Settings(modules=("nothing",)).check()
