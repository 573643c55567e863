"""From sources to written tables: what to run, checked settings, and a manifest."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import clusters, countries, dedup, descriptive, fits, hypotheses, institutions, networks, organise, regression, seasonal, segments, series, venues
from ..sources import exports
from . import storage

MODULES = ("documents", "description", "growth", "institutions", "countries", "sources", "networks", "hypotheses")


@dataclass
class Settings:
    """Settings of a run; ``check`` says what is wrong with them."""

    sources: list[dict] = field(default_factory=list)
    modules: tuple[str, ...] = MODULES
    fuzzy_titles: float | None = None
    fractional: bool = False
    top: int = 20
    horizon: int = 5
    #: Nodes of the keyword and author networks, the most frequent ones; None: all.
    keyword_nodes: int | None = None
    author_nodes: int | None = None
    priority: tuple[str, ...] = dedup.PRIORITY

    def check(self) -> None:
        if unknown := set(self.modules) - set(MODULES):
            raise ValueError(f"unknown modules: {sorted(unknown)}")
        if self.fuzzy_titles is not None and not 0.5 < self.fuzzy_titles <= 1:
            raise ValueError("fuzzy_titles lies over 0.5 and at most at 1")
        if self.top < 1 or self.horizon < 1:
            raise ValueError("top and horizon are at least 1")
        if any(n is not None and n < 2 for n in (self.keyword_nodes, self.author_nodes)):
            raise ValueError("a network has at least two nodes")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        held = json.loads(text)
        return cls(**{**held, "modules": tuple(held["modules"]), "priority": tuple(held["priority"])})


_PROFILE = ["articles", "citations", "average", "single", "several"]


def analyse(records: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """All tables of the chosen modules over merged records, by name and lazily."""
    settings.check()
    star = organise.organise(records)
    authors, places = star["author_documents"].select("doc", "author"), star["country_documents"].select("doc", "country")
    keywords = star["keywords_long"].select("doc", "keyword").distinct()
    panel, annual = countries.panel(places, records, settings.fractional), descriptive.annual(records)
    one_series = annual.select(F.lit("all").alias("series"), "year", "articles")
    by_module = {
        "documents": star,
        "description": {
            "overview": descriptive.overview(records, authors), "annual": annual, "author_productivity": descriptive.productivity(authors, records, "author"), "author_indices": descriptive.author_indices(authors, records, "author"),
            "most_cited": descriptive.most_cited(records, settings.top), "citation_profile": descriptive.citation_profile(records), "lotka": descriptive.lotka(authors, "author"), "keyword_frequency": descriptive.shares(keywords, "keyword"),
        },
        "growth": {"series": series.describe(one_series, ["series"]), "trend_tests": series.with_p_values(series.mann_kendall(one_series, ["series"])), "breaks": series.change_consensus(one_series, ["series"]), "curves": series.fit_curves(one_series, ["series"], settings.horizon), "forecast": series.holt_forecast(one_series, ["series"], settings.horizon), "forecasts": fits.forecasts(one_series, ["series"], settings.horizon), "model_table": fits.model_table(one_series, ["series"]), "partitions": segments.optimal_partition(one_series, ["series"]), "mean_breaks": segments.mean_breaks(one_series, ["series"]), "change_points": segments.change_points(one_series, ["series"]), "phases": segments.segment_phases(one_series, ["series"], segments.optimal_partition(one_series, ["series"])), "dynamic_trend": regression.dynamic_trend(one_series, ["series"]), "hidden_period": series.fisher_g(one_series, ["series"]), "smooth": seasonal.loess(one_series, ["series"])},
        "institutions": {"institution_production": institutions.production(star["affiliations"], records), "institution_sectors": institutions.sectors(star["affiliations"], records), "institution_pairs": institutions.collaboration(star["affiliations"])},
        "countries": {"country_summary": countries.summary(panel), "country_growth": countries.growth_dynamics(panel), "country_ranks": countries.yearly_ranks(panel), "country_collaboration": countries.collaboration(places), "country_papers": descriptive.country_table(places, records), "country_trends": regression.polynomial_trends(panel, ["country"]), "country_similarity": clusters.distances(clusters.standardised(clusters.country_features(places, records), "country", _PROFILE), "country", _PROFILE)},
        "sources": {"source_summary": venues.summary(records), "source_growth": venues.growth_table(venues.panel(records)), "source_specialization": venues.specialization(records, keywords)},
        "networks": {"keyword_pairs": networks.cooccurrence(keywords, "keyword", settings.keyword_nodes), "author_pairs": networks.cooccurrence(authors, "author", settings.author_nodes)},
        "hypotheses": {"corpus_hypotheses": hypotheses.corpus(records, authors, places, keywords), "growth_hypotheses": hypotheses.growth(one_series, ["series"]), "tested_hypotheses": stats.benjamini_hochberg(hypotheses.tested(one_series, ["series"])), "source_hypotheses": hypotheses.venues(venues.summary(records), venues.growth_table(venues.panel(records)))},
    }
    return {name: table for module in settings.modules for name, table in by_module[module].items()}


def run(spark: SparkSession, settings: Settings, out: str) -> dict:
    """Read, merge, analyse and write every table as Parquet under ``out``; the manifest, which is written there too.

    Intermediate tables are deleted at the end, those of lazy results made before in this process included.
    """
    settings.check()
    raw = exports.read_sources(spark, settings.sources)
    merged = dedup.deduplicate(raw, settings.fuzzy_titles, settings.priority)
    merged.write.mode("overwrite").parquet(f"{out}/records")
    records = spark.read.schema(merged.schema).parquet(f"{out}/records")
    tables = {"merge_summary": dedup.summary(raw, records), "field_coverage": exports.coverage(records), **analyse(records, settings)}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{out}/{name}")
    manifest = {"settings": json.loads(settings.to_json()), "tables": {"records": records.columns} | {name: table.columns for name, table in tables.items()}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest")
    storage.clean(spark)
    return manifest
