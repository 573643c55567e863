"""Matching against all pairs, ranks and bootstraps against numpy, files with different headers, repeated rows, networks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom import catalog
from citeloom.functions import stats
from citeloom.operators import adjust, dedup, matching, networks, primitives
from citeloom.plans import storage
from citeloom.plans.roles import Roles
from citeloom.sources import exports
from citeloom.streaming import ingest

FOLDER = "/root/testdata/sf0.001"


def one(df):
    return df.collect()[0]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("least", [0.7, 0.85])
def test_edit_join_loses_no_pair(spark, least):
    rng = np.random.default_rng(3)
    words = {"aning", "aningth", "abcde", "xabcdey", "li", "lee", "wu", "hahahaha", "hahahaho", "hahaha", "aaaaaaa", "aaaaaa", "bbbbb", "bbbb", "abababab", "babababa"}
    while len(words) < 260:
        base = "".join(rng.choice(list("aeioulnrst"), rng.integers(2, 12)))
        words.add(base)
        for _ in range(3):
            k = int(rng.integers(0, len(base)))
            words.add(base[:k] + str(rng.choice(list("xyab", ))) + base[k + int(rng.integers(0, 2)) :])
    words = sorted(words)
    expected = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if 1 - edits(a, b) / max(len(a), len(b)) >= least - 1e-12}
    frame = spark.createDataFrame([(w, w) for w in words] + [("blank", " "), ("none", None)], "id string, value string")
    found = {(r["a"], r["b"]) for r in matching.similar_by_edits(frame, least).collect()}
    assert found == expected and len(expected) > 30


def test_word_join_loses_no_pair(spark):
    rng = np.random.default_rng(4)
    sets = [(k, [f"w{x}" for x in rng.integers(0, 14, rng.integers(0, 9))]) for k in range(80)]
    found = {(r["a"], r["b"]) for r in matching.similar_by_words(spark.createDataFrame(sets, "id long, words array<string>"), 0.5).collect()}
    expected = {(a, b) for a, x in sets for b, y in sets if a < b and x and y and len(set(x) & set(y)) >= 0.5 * len(set(x) | set(y))}
    assert found == expected


def test_names_meet_their_forms(spark):
    names = ["Garcia, Ana", "García, A.", "Ana Garcia", "Garcea, A", "Smith, J", "Smith, John B", "Jones, J", None, " "]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    canonical = {r["value"]: r["canonical"] for r in matching.disambiguate_authors(frame, "name").collect()}
    assert canonical["García, A."] == canonical["Ana Garcia"] == canonical["Garcia, Ana"] == canonical["Garcea, A"] and canonical["Smith, J"] != canonical["Jones, J"]
    left = spark.createDataFrame([("Garcia, Ana", None), ("Wong, K", "0000-0002-1825-0097")], "name string, orcid string")
    right = spark.createDataFrame([("García, A.", None), ("Wang, Kim", "https://orcid.org/0000-0002-1825-0097"), ("Other, X", None)], "name string, orcid string")
    matched = {(r["a"], r["b"]): (r["score"], r["how"]) for r in matching.match_authors(left, right).collect()}
    assert matched == {("Garcia, Ana", "García, A."): (0.95, "name"), ("Wong, K", "Wang, Kim"): (1.0, "orcid")}


def test_journals_and_institutions_have_one_name(spark):
    journals = spark.createDataFrame([("Journal of Testing",), ("J of Testing",), ("The Journal of Testing",), ("Review of Tests",)], "j string")
    found = {r["value"]: r["canonical"] for r in matching.disambiguate_journals(journals, "j").collect()}
    assert len({found[x] for x in ("Journal of Testing", "J of Testing", "The Journal of Testing")}) == 1 and found["Review of Tests"] == "Review of Tests"
    places = spark.createDataFrame([(1, "Univ. of Testing"), (2, "University of Testing"), (3, "Testing Inst"), (3, None)], "doc long, i string")
    lookup = {r["canonical"]: (r["papers"], r["variants"]) for r in matching.institution_lookup(places, "i").collect()}
    assert lookup == {"Univ. of Testing": (2, 2), "Testing Inst": (1, 1)}


def test_titles_by_terms_and_words(spark):
    rows = [(1, "A study of deep networks for text"), (2, "Study of deep networks for texts"), (3, "Deep networks: a study of text"), (4, "Bees in gardens"), (5, None), (6, "!!")]
    found = {(r["a"], r["b"]): r["jaccard"] for r in matching.duplicate_titles(spark.createDataFrame(rows, "id long, title string"), 0.8).collect()}
    assert set(found) == {(1, 3)} and found[1, 3] == pytest.approx(6 / 7)


def test_adjusted_records(spark):
    rows = [(1, 2000, 10), (2, 2010, 10), (3, None, None), (4, 2010, 500)] + [(10 + k, 2005, k) for k in range(8)]
    frame = spark.createDataFrame(rows, "doc long, year int, citations long")
    assert {r["doc"] for r in adjust.remove_citation_outliers(frame).collect()} == {r[0] for r in rows} - {4}
    assert {r["year"] for r in adjust.impute_years(frame).where("doc = 3").collect()} == {2005} == {r["year"] for r in adjust.impute_years(frame, "mode").where("doc = 3").collect()}
    assert adjust.merged_spec({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"c": 4}, "e": 5}) == {"a": {"b": 1, "c": 4}, "d": 3, "e": 5}
    for bad in (lambda: adjust.normalise_citations(frame, "x"), lambda: adjust.remove_citation_outliers(frame, "x"), lambda: adjust.impute_years(frame, "x")):
        with pytest.raises(ValueError):
            bad()


def test_constant_series_are_met_exactly(spark):
    rows = [("flat", 1, 5.0), ("flat", 2, 5.0), ("rise", 1, 1.0), ("rise", 2, 3.0), ("rise", 3, 4.0), ("once", 1, 2.0)]
    found = {r["g"]: r for r in primitives.trend(spark.createDataFrame(rows, "g string, x int, y double"), ["g"], "x", "y").collect()}
    assert found["flat"]["r2"] == 1 and found["flat"]["slope"] == 0 and found["once"]["r2"] is None
    assert found["rise"]["r2"] == pytest.approx(np.corrcoef([1, 2, 3], [1, 3, 4])[0, 1] ** 2)


@pytest.mark.parametrize(("x", "df", "p"), [(3.841458820694124, 1, 0.05), (6.634896601021213, 1, 0.01), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05), (0.0, 4, 1.0), (67.50480654954123, 50, 0.05), (31.0, 2, math.exp(-15.5))])
def test_chi_square_tail(spark, x, df, p):
    assert one(spark.range(1).select(stats.chi_square_tail(F.lit(x), F.lit(float(df))).alias("p")))["p"] == pytest.approx(p, rel=1e-4)


def test_bootstrap_intervals_are_as_wide_as_resampling(spark):
    x, rng = np.arange(40), np.random.default_rng(0)
    frame = spark.createDataFrame([(int(v),) for v in x], "x long")
    draws = rng.choice(x, (4000, 40))
    for made, drawn in ((stats.bootstrap_mean(frame, "x", 800), draws.mean(axis=1)), (stats.bootstrap_median(frame, "x", 800), np.median(draws, axis=1))):
        row, (low, high) = one(made), np.quantile(drawn, [0.025, 0.975])
        assert abs(row["low"] - low) < 1.2 and abs(row["high"] - high) < 1.2 and row["estimate"] == 19.5
    share = one(stats.bootstrap_proportion(frame, F.col("x") < 10, 400))
    assert share["low"] < share["estimate"] == 0.25 < share["high"] and share["high"] - share["low"] < 0.4
    gini = one(stats.bootstrap_gini(frame, "x", 200))
    assert gini["low"] < gini["estimate"] < gini["high"] and gini["estimate"] == pytest.approx(float(2 * (x * np.arange(1, 41)).sum() / (40 * x.sum()) - 41 / 40))
    often = spark.createDataFrame([(k % 2,) for k in range(600)], "x long")
    wide = one(stats.bootstrap_mean(often, "x", 800))
    assert wide["high"] - wide["low"] == pytest.approx(2 * 1.96 * 0.5 / math.sqrt(600), rel=0.2)


def test_ranks_weigh_the_histogram(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b), bool(c)) for a, b, c in zip(rng.integers(0, 6, 200), rng.integers(0, 5, 200), rng.random(200) < 0.4, strict=True)]
    frame = spark.createDataFrame([*rows, (None, 1, True)], "x long, y long, g boolean")

    def ranks(v):
        return np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])

    x, y, g = (np.array(c) for c in zip(*rows, strict=True))
    assert one(stats.spearman(frame, "x", "y"))["rho"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    tested = one(stats.rank_sum(frame, "x", F.col("g")))
    assert tested["u"] == pytest.approx(ranks(x)[g].sum() - g.sum() * (g.sum() + 1) / 2) and tested["n1"] == g.sum()
    n, r = len(x), ranks(x)
    h = (12 / (n * (n + 1)) * sum(r[y == k].sum() ** 2 / (y == k).sum() for k in set(y)) - 3 * (n + 1)) / (1 - sum(c**3 - c for c in np.bincount(x)) / (n**3 - n))
    assert one(stats.kruskal(frame, "x", "y"))["h"] == pytest.approx(h)


def test_pairs_of_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(primitives, "PAIR_BLOCK", 4)
    frame = spark.createDataFrame([("g", k) for k in range(23)] + [("h", k) for k in range(3)], "g string, k long")
    found = {(r["a"], r["b"]): r["weight"] for r in primitives.pair_counts(frame, "g", "k", blocked=True).collect()}
    assert found == {(a, b): 1 + (b < 3) for a in range(23) for b in range(a + 1, 23)}


def test_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Authors,Title,Year\n"A B;C D",First one,2001\n')
    (tmp_path / "b.csv").write_text('Year,Authors,Title,Cited by\n2002,"E F","Second, one",7\n')
    (tmp_path / "c.csv").write_text('Authors,Title,Year\nG H,Third one,2003\n')
    rows = {r["title"]: r for r in exports.read_csv(spark, f"{tmp_path}/*.csv", "scopus").collect()}
    assert {t: (r["year"], r["authors"], r["citations"], r["source_file"]) for t, r in rows.items()} == {"First one": (2001, ["A B", "C D"], 0, "a.csv"), "Second, one": (2002, ["E F"], 7, "b.csv"), "Third one": (2003, ["G H"], 0, "c.csv")}


def test_repeated_rows_without_keys_stay_apart(spark):
    from citeloom.sources.schema import conform

    rows = conform(spark.createDataFrame([("x",), ("x",), ("y",)], "abstract string"))
    merged = dedup.deduplicate(rows)
    assert merged.count() == 3 and merged.select("doc").distinct().count() == 3


def test_union_fields_keep_the_order_of_sources(spark):
    from citeloom.sources.schema import conform

    rows = [("10.1/a", "One title", ["B", "A"], "SCOPUS", 3), ("10.1/A", "One title!", ["A", "C"], "WOS", 5), ("10.1/b", "Two", None, "WOS", 1)]
    merged = dedup.deduplicate(conform(spark.createDataFrame(rows, "doi string, title string, authors array<string>, source_db string, citations long")))
    found = {r["doi_key"]: r for r in merged.collect()}
    assert found["10.1/a"]["authors"] == ["A", "C", "B"] and found["10.1/a"]["citations"] == 5 and found["10.1/a"]["sources"] == ["SCOPUS", "WOS"] and found["10.1/a"]["n_merged"] == 2
    assert found["10.1/b"]["authors"] == [] and found["10.1/b"]["merged_by"] is None


def test_rows_without_identifier_all_pass(spark, tmp_path):
    rows = [("10.1/a", "2024-01-01 00:00:00"), (None, "2024-01-01 00:02:00"), (None, "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "doi string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doi string, ts timestamp").parquet(f"{tmp_path}/in")
    ingest.append_to(ingest.first_seen(stream, "ts"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def chain(spark, n):
    return spark.createDataFrame([(f"n{k:02d}", f"n{k + 1:02d}", 1) for k in range(n)], "a string, b string, weight long")


def test_paths_of_any_length(spark):
    edges = chain(spark, 14)
    ends = spark.createDataFrame([("n00",)], "node string")
    assert one(networks.closeness(edges, ends)) == ("n00", 14, 7.5, pytest.approx(14 / 105))
    every = networks.degrees(edges).select("node")
    middle = {r["node"]: r["betweenness"] for r in networks.betweenness(edges, every).collect()}
    assert middle == {f"n{k:02d}": pytest.approx(k * (14 - k)) for k in range(15)}
    assert {r["component"] for r in networks.components(edges).collect()} == {"n00"}


def test_iterations_converge(spark):
    rng = np.random.default_rng(2)
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 12, (40, 2)) if a != b} | {(k, k + 1) for k in range(11)})
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", 1 + (a + b) % 3) for a, b in pairs], "a string, b string, weight long")
    matrix = np.zeros((12, 12))
    for a, b in pairs:
        matrix[a, b] = matrix[b, a] = 1 + (a + b) % 3
    leading = np.abs(np.linalg.eigh(matrix)[1][:, -1])
    scores = {r["node"]: r["score"] for r in networks.eigenvector(edges).collect()}
    assert [scores[f"n{k}"] for k in range(12)] == pytest.approx(list(leading / leading.max()), abs=1e-6)
    ranks = {r["node"]: r["rank"] for r in networks.pagerank(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))).collect()}
    out = {a: [b for x, b in pairs if x == a] for a in range(12)}
    rank = np.full(12, 1 / 12)
    for _ in range(300):
        sent = np.zeros(12)
        for a, b in out.items():
            for x in b:
                sent[x] += rank[a] / len(b)
        rank = 0.15 / 12 + 0.85 * (sent + sum(rank[a] for a in out if not out[a]) / 12)
    assert [ranks[f"n{k}"] for k in range(12)] == pytest.approx(list(rank), abs=1e-8)


def test_communities_are_stable(spark):
    """Each node's label has the greatest summed weight around it, its own strongest edge counted for itself."""
    rng = np.random.default_rng(7)
    pairs = {(a, b) for a in range(24) for b in range(a + 1, 24) if (a // 8 == b // 8 and rng.random() < 0.7) or rng.random() < 0.04}
    edges = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", 1) for a, b in sorted(pairs)], "a string, b string, weight long")
    label = {r["node"]: r["community"] for r in networks.communities(edges).collect()}
    around = {}
    for a, b in pairs:
        around.setdefault(f"n{a:02d}", []).append(f"n{b:02d}")
        around.setdefault(f"n{b:02d}", []).append(f"n{a:02d}")
    for node, others in around.items():
        votes = {label[node]: 1}
        for other in others:
            votes[label[other]] = votes.get(label[other], 0) + 1
        assert label[node] == min(k for k, v in votes.items() if v == max(votes.values()))


def test_intermediate_folder_must_be_shared(spark, monkeypatch):
    class Far:
        conf = type("c", (), {"get": staticmethod(lambda *a: None)})()
        sparkContext = type("s", (), {"master": "spark://x", "getConf": staticmethod(lambda: type("c", (), {"get": staticmethod(lambda *a: None)})())})()

    with pytest.raises(ValueError):
        storage.shared_dir(Far())


def test_queries_without_sql(spark):
    """The learned and iterative queries over the driver's tables, by what must hold of their results."""
    roles = Roles(spark, FOLDER)
    run = {name: catalog.QUERIES[name](spark, FOLDER).collect() for name in (set(catalog.QUERIES) - set(catalog.ORACLE_SQL)) | {"keyword_eigenvector", "brand_pagerank"}}
    words = {r["keyword"] for r in roles.keywords().select("keyword").distinct().collect()}
    assert {r["node"] for r in run["keyword_communities"]} == words == {r["node"] for r in run["keyword_eigenvector"]}
    assert max(r["score"] for r in run["keyword_eigenvector"]) == 1 and sum(r["rank"] for r in run["brand_pagerank"]) == pytest.approx(1, abs=1e-4)
    assert sum(r["size"] for r in run["keyword_thematic_map"]) == len(words) and {r["quadrant"] for r in run["keyword_thematic_map"]} <= {"motor", "basic", "niche", "emerging"}
    (mean,) = run["citations_bootstrap"]
    true = one(roles.records().agg(F.avg("citations").alias("m"), F.stddev_samp("citations").alias("s"), F.count("*").alias("n")))
    assert mean["estimate"] == pytest.approx(true["m"], abs=1e-5) and mean["high"] - mean["low"] == pytest.approx(2 * 1.96 * true["s"] / math.sqrt(true["n"]), rel=0.2)
    assert all(r["start"] <= r["end"] and r["strength"] > 1 for r in run["keyword_bursts"])
    best = {}
    for r in run["series_curves"]:
        best.setdefault(r["doc_type"], []).append(r)
    assert all(sum(r["weight"] for r in rows if r["weight"] is not None) == pytest.approx(1, abs=1e-4) and min(rows, key=lambda r: r["rank"])["aic"] == min(r["aic"] for r in rows if r["aic"] is not None) for rows in best.values())
    assert {r["source"] for r in run["source_clusters"]} == {r["source"] for r in roles.records().where("source is not null").select("source").distinct().collect()} and len({r["cluster"] for r in run["source_clusters"]}) <= 3


def test_landed_profiles_and_ledgers(spark, tmp_path):
    import json

    (tmp_path / "orcid.json").write_text(json.dumps({"orcid-identifier": {"path": "0000-0002-1825-0097"}, "person": {"name": {"given-names": {"value": "Ana"}, "family-name": {"value": "García"}}}, "activities-summary": {"works": {"group": [{"x": 1}, {"x": 2}]}}}))
    assert one(exports.orcid_profiles(spark.read.json(f"{tmp_path}/orcid.json"))) == ("0000-0002-1825-0097", "Ana García", 2)
    (tmp_path / "ror.json").write_text(json.dumps({"id": "https://ror.org/05gq02987", "name": "A University", "country": {"country_name": "Spain"}, "addresses": [{"city": "Vigo"}]}))
    assert one(exports.ror_organisations(spark.read.json(f"{tmp_path}/ror.json"))) == ("05gq02987", "A University", "SPAIN", "Vigo")
    (tmp_path / "ledger.csv").write_text("Document ID,Phase,Screener,Status,Final\n7,title,r1,Include,TRUE\n8,title,r1,Exclude,\n")
    ledger = exports.read_ledger(spark, f"{tmp_path}/ledger.csv").collect()
    assert [(r["doc"], r["stage"], r["decision"], r["is_final"]) for r in ledger] == [("7", "title", "Include", True), ("8", "title", "Exclude", None)]
    (tmp_path / "spec.json").write_text('{"flow": {"screened": 5}}')
    assert exports.read_spec(spark, f"{tmp_path}/spec.json", {"flow": {"screened": 1, "found": 9}}) == {"flow": {"screened": 5, "found": 9}}


def test_sample_records_are_whole_and_repeatable(spark):
    sample = exports.sample_records(spark, 60)
    assert sample.count() == 60 and sample.where("title is null or size(authors) = 0 or citations < 0 or year not between 2005 and 2024").count() == 0
    assert sorted(map(str, sample.collect())) == sorted(map(str, exports.sample_records(spark, 60).repartition(7).collect()))
    assert str(exports.sample_records(spark, 60, seed=1).collect()) != str(sample.collect())
