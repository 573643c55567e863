"""Dictionary scans, factorisation, hierarchical clusters and seasonal splits against plain computations."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.operators import clusters, dictionary, factor, seasonal


# Names in texts

ALIASES = [("South Africa", "ZA"), ("Africa", "AF"), ("Republic of South Africa", "ZA"), ("Korea", "KR"), ("South Korea", "KR"), ("Côte d'Ivoire", "CI"), ("Россия", "RU"), ("Georgia", "GE"), ("Georgia", "A-state"), ("of South", "never"), ("!!", "none")]
TEXTS = ["Univ. Cape Town, Republic of South Africa.", "South Africa and Korea; south korea", "COTE D IVOIRE / africa", "г. Москва, Россия", "Georgia Georgia", "south south africa", "", None, "!!", "Koreans"]


def plain_scan(text, aliases):
    words = text.split() if text else []
    found, at = [], 0
    while at < len(words):
        best = max(((len(a), t) for a, t in aliases.items() if words[at : at + len(a)] == list(a)), default=None)
        if best:
            found.append((at + 1, best[0], best[1]))
            at += best[0]
        else:
            at += 1
    return found


def test_longest_names_from_the_left(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    known = dictionary.table(spark.createDataFrame(ALIASES, "alias string, target string"))
    plain = {tuple(r["words"]): r["target"] for r in known.collect()}
    assert plain["GEORGIA",] == "A-state" and len(plain) == 9
    split = {r["id"]: " ".join(r["w"]) for r in frame.select("id", dictionary.words(F.col("text")).alias("w")).collect()}
    found = sorted((r["id"], r["place"], r["size"], r["target"]) for r in dictionary.scan(frame, ["id"], "text", known).collect())
    assert found == sorted((i, *hit) for i in split for hit in plain_scan(split[i], plain))
    assert {(r["id"], r["country"]) for r in dictionary.countries_in_text(frame, ["id"], "text", spark.createDataFrame(ALIASES, "alias string, target string")).collect()} >= {(0, "ZA"), (1, "KR"), (3, "RU")}


def test_nested_names_at_random(spark, monkeypatch):
    rng = np.random.default_rng(0)
    aliases = {tuple("abc"[k] for k in rng.integers(0, 3, n)): f"t{i}" for i, n in enumerate([1, 2, 2, 3, 4, 3, 2])}
    texts = [(i, " ".join("abc"[k] for k in rng.integers(0, 3, 40))) for i in range(30)]
    monkeypatch.setattr(dictionary, "SMALL", 0)
    known = dictionary.table(spark.createDataFrame([(" ".join(a), t) for a, t in aliases.items()], "alias string, target string"))
    found = sorted((r["id"], r["place"], r["size"], r["target"]) for r in dictionary.scan(spark.createDataFrame(texts, "id int, text string"), ["id"], "text", known).collect())
    upper = {tuple(w.upper() for w in a): t for a, t in aliases.items()}
    assert found == sorted((i, *hit) for i, t in texts for hit in plain_scan(t.upper(), upper))


def test_all_countries_by_their_names(spark):
    aliases = dictionary.country_aliases(spark).cache()
    targets = {r["target"] for r in aliases.collect()}
    assert len(targets) > 240 and {"UNITED STATES", "UNITED KINGDOM", "GERMANY", "JAPAN", "BRAZIL"} <= targets
    texts = ["Dept. of Physics, Universität Wien, Österreich", "Papua New Guinea Univ.", "MIT, Cambridge, MA, USA", "Allemagne et États-Unis", "Guinea-Bissau", "no place"]
    found = dictionary.countries_in_text(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), ["id"], "text", aliases).collect()
    got = {i: sorted(r["country"] for r in found if r["id"] == i) for i in range(6)}
    assert got == {0: ["AUSTRIA"], 1: ["PAPUA NEW GUINEA"], 2: ["UNITED STATES"], 3: ["GERMANY", "UNITED STATES"], 4: [got[4][0]], 5: []} and "BISSAU" in got[4][0]


# Factorisation


def test_factors_match_numpy_and_errors_fall(spark):
    rng = np.random.default_rng(1)
    table = rng.random((8, 6)) * (rng.random((8, 6)) < 0.6)
    rows = [(i, f"t{j}", float(table[i, j])) for i in range(8) for j in range(6) if table[i, j]]
    cells = spark.createDataFrame([*rows, (0, None, 1.0), (1, "t0", -3.0)], "doc int, term string, weight double")
    kept = {(i, int(t[1])): w for i, t, w in rows}
    docs, terms, errors = factor.nmf(cells, 2, 4, 0.0)
    scale = (np.mean(list(kept.values())) / 2) ** 0.5
    make = lambda keys, name, seed: np.array([[r[f"f{k}"] for k in range(2)] for r in sorted(factor.start(keys, name, 2, seed, scale).collect(), key=lambda r: r[name])])
    w = make(cells.select("doc").distinct(), "doc", 42)
    h = make(cells.where("term is not null").select("term").distinct(), "term", 43).T
    v = np.zeros((8, 6))
    for (i, j), x in kept.items():
        v[i, j] = x
    expected = []
    for _ in range(4):
        h = h * (w.T @ v) / (w.T @ w @ h + factor.TINY)
        w = w * (v @ h.T) / (w @ h @ h.T + factor.TINY)
        expected.append(((v - w @ h) ** 2).sum())
    assert errors == pytest.approx(expected, abs=1e-9) and all(b <= a + 1e-12 for a, b in itertools.pairwise(errors))
    assert np.array([[r["f0"], r["f1"]] for r in sorted(docs.collect())]) == pytest.approx(w, abs=1e-9)
    shares = factor.topic_terms(terms, 2, 6).groupBy("topic").agg(F.sum("weight").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in shares) and factor.document_topics(docs, 2).count() == 16


def test_no_cells_to_factorise(spark):
    docs, terms, errors = factor.nmf(spark.createDataFrame([], "doc int, term string, weight double"), 2)
    assert docs.count() == terms.count() == 0 and errors == []


# Hierarchical clusters


def plain_tree(d):
    """Complete linkage one pair at a time: (left, right, height, size)."""
    members, out = {i: [i] for i in range(len(d))}, []
    while len(members) > 1:
        height, a, b = min((max(d[x, y] for x in members[a] for y in members[b]), a, b) for a, b in itertools.combinations(sorted(members), 2))
        members[a] += members.pop(b)
        out.append((a, b, round(float(height), 9), len(members[a])))
    return sorted(out)


def test_tree_matches_one_pair_at_a_time(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(14, 3))
    frame = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "item int, x double, y double, z double")
    pairs = clusters.distances(frame, "item", ["x", "y", "z"])
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    assert pairs.count() == 91 and all(r["distance"] == pytest.approx(d[r["a"], r["b"]]) for r in pairs.collect())
    tree = clusters.complete_linkage(pairs)
    expected = plain_tree(d)
    assert sorted((r["left"], r["right"], round(r["height"], 9), r["size"]) for r in tree.collect()) == expected
    three = {r["item"]: r["cluster"] for r in clusters.cut(tree, 3).collect()}
    own = {i: i for i in range(14)}
    for a, b, *_ in sorted(expected, key=lambda m: m[2])[:-2]:
        own = {i: (a if c == b else c) for i, c in own.items()}
    assert three == own and len(set(three.values())) == 3
    assert clusters.complete_linkage(pairs.limit(0)).collect() == []


def test_scores_and_components(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3)) @ np.array([[3, 1, 0], [0, 1, 0.5], [0, 0, 0.1]])
    frame = spark.createDataFrame([(i, *map(float, p), 7.0) for i, p in enumerate(x)] + [(99, None, 1.0, 1.0, 7.0)], "item int, a double, b double, c double, same double")
    scores = clusters.standardised(frame, "item", ["a", "b", "c", "same"])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    found = np.array([[r["a"], r["b"], r["c"]] for r in sorted(scores.collect())])
    assert found == pytest.approx(z, abs=1e-9) and scores.where("same <> 0").count() == 0
    points, described = clusters.principal_components(scores, "item", ["a", "b", "c"])
    values, vectors = np.linalg.eigh(np.cov(z.T))
    assert [d["share"] for d in described] == pytest.approx((values[::-1] / values.sum())[:2])
    first = np.array([r["pc1"] for r in sorted(points.collect())])
    assert np.abs(first) == pytest.approx(np.abs(z @ vectors[:, -1]), abs=1e-9) and max(described[0]["loadings"].values(), key=abs) > 0


# Local lines and seasons


def test_local_lines_in_the_jvm_and_in_numpy(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=25).cumsum()
    frame = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)] + [("b", 0, 3.0)], "g string, year int, articles double")
    for span in (3, 8, 40):
        rows = seasonal.loess(frame, ["g"], span).where("g = 'a'").orderBy("year").collect()
        direct = []
        for i in range(1, 26):
            q = min(span, 25)
            low = max(1, min(i - (q - 1) // 2, 25 - q + 1))
            at = np.arange(low, low + q)
            reach = max(i - low, low + q - 1 - i)
            w = np.clip(1 - (np.abs(at - i) / reach) ** 3, 0, None) ** 3
            line = np.polyfit(at - i, y[at - 1], 1, w=np.sqrt(w)) if (w > 0).sum() > 1 else [0, y[i - 1]]
            direct.append(line[-1])
        assert [r["smooth"] for r in rows] == pytest.approx(direct, abs=1e-6)
        assert seasonal.lines(y, np.ones(25), span, np.arange(1, 26)) == pytest.approx(direct, abs=1e-6)
    assert seasonal.loess(frame, ["g"], 5).where("g = 'b'").first()["smooth"] == 3.0


def test_a_season_and_a_trend_come_apart(spark):
    rng = np.random.default_rng(5)
    month = np.arange(96)
    season = 10 * np.sin(2 * np.pi * month / 12)
    y = 50 + 0.5 * month + season + rng.normal(size=96)
    y[40] += 60
    rows = [("a", int(i), float(v)) for i, v in enumerate(y)] + [("short", i, 1.0) for i in range(23)] + [("flat", i, 2.0) for i in range(24)]
    frame = spark.createDataFrame(rows, "g string, year int, articles double")
    found = seasonal.decompose(frame, ["g"], outer=5)
    a = found.where("g = 'a'").orderBy("year").collect()
    assert all(r["trend"] + r["seasonal"] + r["remainder"] == pytest.approx(r["articles"]) for r in a)
    assert np.array([r["seasonal"] for r in a]) == pytest.approx(season, abs=3) and np.array([r["trend"] for r in a]) == pytest.approx(50 + 0.5 * month, abs=3)
    assert a[40]["remainder"] > 50 and a[0]["trend_strength"] > 0.7
    plain = seasonal.decompose(frame.where("g = 'a' and year <> 40"), ["g"]).first()
    assert plain["seasonal_strength"] > 0.9
    assert {r["g"] for r in found.select("g").distinct().collect()} == {"a", "flat"}
    assert found.where("g = 'flat'").agg(F.max(F.abs("remainder")).alias("m")).first()["m"] < 1e-9
    with pytest.raises(ValueError):
        seasonal.decompose(frame, ["g"], 1)


# Organisations, hidden periods, curves, tested hypotheses


def test_the_longest_organisation_of_an_affiliation(spark):
    from citeloom.sources import exports

    landed = spark.createDataFrame([("https://ror.org/1", "University of York", ["York Univ"], None), ("https://ror.org/2", "York", None, ["YK"]), ("https://ror.org/3", "Max Planck Institute", None, None)], "id string, name string, aliases array<string>, acronyms array<string>")
    names = exports.ror_names(landed)
    assert {(r["ror"], r["alias"]) for r in names.collect()} == {("1", "University of York"), ("1", "York Univ"), ("2", "York"), ("2", "YK"), ("3", "Max Planck Institute")}
    texts = ["Dept. X, University of York, York", "YK, York Univ.", "York", "Max-Planck-Institute; York", "nowhere", None]
    found = dictionary.match_organisations(spark.createDataFrame(list(enumerate(texts)), "id int, a string"), ["id"], "a", names)
    assert {r["id"]: r["ror"] for r in found.collect()} == {0: "1", 1: "1", 2: "2", 3: "3"}


def test_hidden_periods(spark):
    import math

    from citeloom.operators import series

    rng = np.random.default_rng(6)
    t = np.arange(21)
    rows = [("wave", int(i), float(5 + 3 * np.sin(2 * np.pi * 3 * i / 21) + e)) for i, e in zip(t, rng.normal(size=21) * 0.3, strict=True)] + [("noise", int(i), float(v)) for i, v in zip(t, rng.normal(size=21), strict=True)] + [("flat", i, 1.0) for i in range(9)] + [("few", i, float(i)) for i in range(4)]
    found = {r["name"]: r for r in series.fisher_g(spark.createDataFrame(rows, "name string, year int, articles double"), ["name"]).collect()}
    assert set(found) == {"wave", "noise"} and found["wave"]["harmonic"] == 3 and found["wave"]["period"] == 7 and found["wave"]["p_value"] < 1e-6
    g = found["noise"]["g"]
    exact = sum((-1) ** (j - 1) * math.comb(10, j) * (1 - j * g) ** 9 for j in range(1, 11) if j * g < 1)
    assert found["noise"]["p_value"] == pytest.approx(exact, abs=1e-8)


def test_curves_of_diffusion(spark):
    from citeloom.operators import series

    t = np.arange(30.0)
    weibull, richards, bass = (series.CURVES[c][0] for c in ("weibull", "richards", "bass"))
    assert weibull(t, 10.0, 5.0, 2.0)[0] == 0 and bass(t, 10.0, 0.03, 0.4)[0] == 0
    assert weibull(t, 10.0, 5.0, 2.0) == pytest.approx(10 * (1 - np.exp(-((t / 5) ** 2))))
    assert richards(t, 9.0, 0.4, 12.0, 1.0) == pytest.approx(9 / (1 + np.exp(-0.4 * (t - 12))))
    e = np.exp(-0.43 * t)
    assert bass(t, 10.0, 0.03, 0.4) == pytest.approx(10 * (1 - e) / (1 + 0.4 / 0.03 * e))
    frame = spark.createDataFrame([("b", 1990 + int(i), float(v)) for i, v in enumerate(100 * bass(t, 10.0, 0.01, 0.4))], "g string, year int, articles double")
    fit = {r["model"]: r for r in series.fit_curves(frame, ["g"]).collect()}
    assert fit["bass"]["r2"] > 0.999 and fit["richards"]["r2"] > 0.99 and len(fit) == 16


def test_hypotheses_have_p_and_effect(spark):
    from citeloom.functions import stats
    from citeloom.operators import hypotheses

    rng = np.random.default_rng(7)
    rows = [("up", 1990 + i, int(10 + 3 * i + rng.integers(0, 4))) for i in range(30)] + [("noise", 1990 + i, int(rng.integers(0, 50))) for i in range(30)] + [("few", 1990 + i, 5) for i in range(3)]
    found = {(r["g"], r["id"]): r for r in stats.benjamini_hochberg(hypotheses.tested(spark.createDataFrame(rows, "g string, year int, articles long"), ["g"])).collect()}
    names = {"trend", "line", "curve", "regime", "mean_break", "persistence", "normal_values"}
    assert {k for g, k in found if g == "up"} == names == {k for g, k in found if g == "noise"}
    assert all(0 <= r["p_value"] <= 1 and r["p_bh"] >= r["p_value"] - 1e-12 for r in found.values() if r["p_value"] is not None)
    assert found["up", "trend"]["p_bh"] < 1e-6 and found["up", "trend"]["effect"] > 0.95 and found["up", "line"]["effect"] > 0.99
    assert found["noise", "line"]["p_value"] > 0.01 and found["noise", "trend"]["p_value"] > 0.01


def test_few_terms_are_factorised_as_many_are(spark, monkeypatch):
    """The same factors with the terms sent to the tasks, in as many jobs a round as there are sums, beyond a written round too."""
    rng = np.random.default_rng(8)
    rows = [(int(d), f"t{t}", float(w)) for d, t, w in zip(rng.integers(0, 60, 500), rng.integers(0, 25, 500), rng.random(500))]
    cells = spark.createDataFrame(rows + [(1, None, 1.0), (None, "t1", 1.0), (2, "t2", 0.0)], "doc long, term string, weight double")
    few = factor.nmf(cells, 3, factor.KEPT + 2, 0.0)
    monkeypatch.setattr(factor, "_updated", lambda *a, **b: pytest.fail("cells are joined and shuffled in every half round"))
    factor.nmf(cells, 3, 2)
    monkeypatch.undo()
    monkeypatch.setattr(factor, "FEW", 0)
    many = factor.nmf(cells, 3, factor.KEPT + 2, 0.0)
    assert few[2] == pytest.approx(many[2]) and len(few[2]) == factor.KEPT + 2
    for a, b in zip(few[:2], many[:2]):
        one, two = ({r[0]: r[1:] for r in x.collect()} for x in (a, b))
        assert set(one) == set(two) and all(one[k] == pytest.approx(two[k]) for k in one)
