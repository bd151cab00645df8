"""The finance ontology: 12 classes, accepted spellings of categories, 56 properties with domain and range."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Classes, and spellings of categories beside the classes' own names.
CLASSES = "FINANCIALENTITY COMPANY DERIVATIVE CURRENCY BOND PRODUCT EVENT SECTOR ECONINDICATOR FININSTRUMENTINFO MACROINDICATOR CONCEPT".split()
SPELLINGS = {c: c for c in CLASSES} | {
    "STOCKTICKER": "COMPANY", "STOCK_TICKER": "COMPANY", "FINANCIAL_ENTITY": "FINANCIALENTITY", "FIN_INSTRUMENT_INFO": "FININSTRUMENTINFO", "MACRO_INDICATOR": "MACROINDICATOR", "ECON_INDICATOR": "ECONINDICATOR",
}
# Property, any-of domain, any-of range; "-" is unconstrained.
PROPERTIES_TEXT = """
has_sector: COMPANY FINANCIALENTITY > SECTOR
produces: COMPANY > PRODUCT
offers: COMPANY FINANCIALENTITY > PRODUCT CONCEPT
belongs_to: PRODUCT COMPANY FINANCIALENTITY > SECTOR COMPANY
impacts: CONCEPT MACROINDICATOR EVENT > COMPANY SECTOR FINANCIALENTITY
reports_on: COMPANY FINANCIALENTITY > ECONINDICATOR CONCEPT
announces: COMPANY FINANCIALENTITY > EVENT CONCEPT
expects: COMPANY FINANCIALENTITY > ECONINDICATOR PRODUCT
acquires: COMPANY > COMPANY
partnership_with: COMPANY > COMPANY
has_product_info: PRODUCT > FININSTRUMENTINFO
experiences: COMPANY > EVENT FININSTRUMENTINFO
faces_risk_of: COMPANY > CONCEPT FININSTRUMENTINFO
maintains_rating: FINANCIALENTITY > CONCEPT FININSTRUMENTINFO
raises_target: FINANCIALENTITY > FININSTRUMENTINFO CONCEPT
located_in: COMPANY FINANCIALENTITY EVENT > -
provides: COMPANY FINANCIALENTITY > PRODUCT CONCEPT
influences: CONCEPT EVENT > CONCEPT COMPANY ECONINDICATOR
is: - > -
uses: COMPANY PRODUCT > PRODUCT CONCEPT
produces_output: COMPANY PRODUCT > CONCEPT
causes: EVENT CONCEPT > EVENT ECONINDICATOR
measures: FINANCIALENTITY COMPANY > ECONINDICATOR CONCEPT
participates_in: COMPANY FINANCIALENTITY > EVENT SECTOR
has_financial_metric: COMPANY FINANCIALENTITY > FININSTRUMENTINFO
regulates: FINANCIALENTITY > COMPANY SECTOR
owns: COMPANY FINANCIALENTITY > PRODUCT COMPANY
provides_financing_for: FINANCIALENTITY > COMPANY PRODUCT
reports_earnings: COMPANY > FININSTRUMENTINFO
forecast: COMPANY FINANCIALENTITY > ECONINDICATOR
has_subsidiary: COMPANY > COMPANY
is_listed_on: COMPANY > FINANCIALENTITY
has_credit_rating: BOND COMPANY > FININSTRUMENTINFO
trades_in: FINANCIALENTITY > PRODUCT DERIVATIVE CURRENCY
is_derivative_of: DERIVATIVE > PRODUCT CURRENCY COMPANY
has_maturity_date: BOND DERIVATIVE > -
has_coupon_rate: BOND > ECONINDICATOR
has_exchange_rate: CURRENCY > ECONINDICATOR
is_influenced_by: ECONINDICATOR COMPANY > MACROINDICATOR EVENT
has_regulatory_status: COMPANY FINANCIALENTITY > CONCEPT
affected_by_policy: COMPANY SECTOR > EVENT CONCEPT
has_investment_in: FINANCIALENTITY COMPANY > COMPANY PRODUCT
announces_dividend: COMPANY > FININSTRUMENTINFO
undergoes_restructuring: COMPANY > EVENT
has_market_cap: COMPANY > ECONINDICATOR
has_liquidity: FININSTRUMENTINFO > ECONINDICATOR
has_volatility: FININSTRUMENTINFO > ECONINDICATOR
experiences_inflation_impact: COMPANY SECTOR > MACROINDICATOR
operates_in: COMPANY > -
follows_trend: - > -
has_credit_risk: BOND DERIVATIVE COMPANY FINANCIALENTITY > -
has_counterparty: DERIVATIVE > FINANCIALENTITY
is_hedged_by: COMPANY PRODUCT > DERIVATIVE
has_dividend_yield: COMPANY > ECONINDICATOR
has_earnings_per_share: COMPANY > ECONINDICATOR
has_cash_flow: COMPANY > ECONINDICATOR
"""


def _sides(text: str) -> list[str]:
    return [] if text.strip() == "-" else text.split()


PROPERTIES = [(name.strip(), *map(_sides, rest.split(">"))) for name, rest in (line.split(":") for line in PROPERTIES_TEXT.strip().splitlines())]


def load(path: str) -> list[tuple[str, list[str], list[str]]]:
    """Properties of an RDF/XML ontology in document order, as (name, domain, range)."""
    ns = {"owl": "http://www.w3.org/2002/07/owl#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#"}
    key = lambda e, a: (e.get(f"{{{ns['rdf']}}}{a}") or "").rsplit("#", 1)[-1].rsplit("/", 1)[-1]
    of = lambda e, side: [key(x, "resource") for x in e.findall(f"rdfs:{side}", ns)]
    return [(key(e, "about") or key(e, "ID"), of(e, "domain"), of(e, "range")) for e in ET.parse(path).getroot().findall("owl:ObjectProperty", ns)]


def table(spark: SparkSession, properties=PROPERTIES) -> DataFrame:
    return spark.createDataFrame(properties, "name string, domain array<string>, range array<string>")


def category(col: str | Column) -> Column:
    """The class that a category spelling stands for; null for unknown ones."""
    pairs = [F.lit(x) for kv in SPELLINGS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.col(col) if isinstance(col, str) else col)


def relation_key(col: str | Column) -> Column:
    """A relation as properties are written: small, with underscores."""
    return F.regexp_replace(F.lower(col), r"[\s_]+", "_")


def checked(triplets: DataFrame, properties=PROPERTIES) -> DataFrame:
    """``triplets`` with ``verdict``: 'unknown_class' where a side's category is none, 'free' where the relation is no
    property, else 'valid' or 'invalid' by domain and range (any of; an empty one passes)."""
    prop = F.broadcast(table(triplets.sparkSession, properties)).withColumnsRenamed({"name": "_p", "domain": "_d", "range": "_r"})
    rows = triplets.withColumns({"_s": category("sub_type"), "_o": category("obj_type")}).join(prop, relation_key("rel") == F.col("_p"), "left")
    fits = ((F.size("_d") == 0) | F.array_contains("_d", F.col("_s"))) & ((F.size("_r") == 0) | F.array_contains("_r", F.col("_o")))
    verdict = F.when(F.col("_s").isNull() | F.col("_o").isNull(), "unknown_class").when(F.col("_p").isNull(), "free").when(fits, "valid").otherwise("invalid")
    return rows.withColumn("verdict", verdict).drop("_s", "_o", "_p", "_d", "_r")


def validity(triplets: DataFrame, key: str, properties=PROPERTIES) -> DataFrame:
    """Per ``key``: triplets, valid ones (free ones count as valid, unknown classes not), the score, and the share of
    valid ones among those with a property (null where there is none)."""
    v = checked(triplets, properties).groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("verdict").isin("valid", "free")).alias("n_valid"), F.count_if(F.col("verdict").isin("valid", "invalid")).alias("n_included"), F.count_if(F.col("verdict") == "valid").alias("n_included_valid"))
    return v.select(key, "n", "n_valid", (F.col("n_valid") / F.col("n")).alias("score"), (F.col("n_included_valid") / F.nullif("n_included", F.lit(0))).alias("included_score"))
