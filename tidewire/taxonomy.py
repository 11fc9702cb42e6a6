"""The taxonomy as plain values and small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Labels with their aliases, thresholds and priors.
ASSET_CLASSES = {
    "equities": ["stocks", "shares", "equity"],
    "indices": ["index", "benchmark", "S&P 500", "FTSE", "Nikkei", "DAX"],
    "fx": ["forex", "foreign exchange", "currency", "EUR/USD", "JPY"],
    "rates": ["interest rates", "yields", "Treasuries", "bonds", "Bunds", "Gilts", "Federal Reserve", "FOMC", "Federal Open Market Committee", "monetary policy", "central bank"],
    "credit": ["credit spreads", "corporate bonds", "HY", "IG", "CDS"],
    "commodities": ["oil", "gas", "gold", "silver", "copper", "wheat"],
    "crypto": ["bitcoin", "ethereum", "BTC", "ETH", "altcoin", "stablecoin"],
    "macro": ["GDP", "inflation", "CPI", "PMI", "employment", "trade balance"],
}
REASON_CODES = {
    "earnings": ["earnings", "EPS", "revenue", "profit", "beat", "missed", "quarterly results", "Q1", "Q2", "Q3", "Q4"],
    "guidance": ["guidance", "outlook", "forecast", "raises guidance", "cut guidance", "full-year"],
    "m_and_a": ["merger", "acquisition", "takeover", "deal", "buyout", "M&A"],
    "regulation": ["regulation", "regulatory", "SEC", "FTC", "antitrust", "compliance", "FDA"],
    "litigation": ["lawsuit", "litigation", "court", "ruling", "settlement", "verdict", "judge"],
    "central_bank": ["Fed", "Federal Reserve", "FOMC", "Federal Open Market Committee", "ECB", "BoJ", "BoE", "PBoC", "RBA", "rate hike", "rate cut", "interest rate", "interest rates", "monetary policy", "hawkish", "dovish", "Powell", "Lagarde", "Bailey"],
    "inflation": ["inflation", "CPI", "PPI", "deflation", "disinflation", "core CPI", "sticky inflation"],
    "employment": ["jobs", "payrolls", "unemployment", "labor market", "NFP", "jobless", "wage growth"],
    "growth_recession": ["GDP", "recession", "growth", "slowdown", "expansion", "contraction"],
    "funding_liquidity": ["funding", "liquidity", "repo", "money market", "credit crunch", "discount window"],
    "supply_chain": ["supply chain", "logistics", "shipping", "shortage", "bottleneck", "port"],
    "geopolitics": ["geopolitical", "conflict", "war", "invasion", "diplomatic"],
    "sanctions_trade": ["sanctions", "tariff", "tariffs", "trade war", "export ban", "embargo"],
    "energy": ["oil", "Brent", "WTI", "OPEC", "natural gas", "crude", "barrel", "refinery"],
    "metals": ["gold", "silver", "copper", "platinum", "palladium", "iron ore"],
    "cyber_outage": ["cyber attack", "ransomware", "breach", "outage", "downtime", "data leak"],
    "product_launch": ["launches", "unveils", "release", "new product", "rollout", "debuts"],
    "fraud_governance": ["fraud", "accounting", "restatement", "governance", "scandal", "whistleblower"],
    "esg_reputation": ["ESG", "sustainability", "emissions", "boycott", "climate", "controversy"],
    "natural_disaster": ["earthquake", "hurricane", "flood", "wildfire", "tsunami", "typhoon"],
}
NEGATIVE_CLASSES = ["sports", "celebrity", "lifestyle", "entertainment", "general_human_interest", "irrelevant_local"]
THRESHOLDS = {"asset_class_min": 0.25, "reason_code_min": 0.25, "negative_class_block": 0.65, "finance_relevance_floor": 0.35}
DOMAIN_PRIORS = {
    "bloomberg.com": 0.95, "reuters.com": 0.95, "ft.com": 0.92, "wsj.com": 0.92, "cnbc.com": 0.85, "marketwatch.com": 0.82,
    "coindesk.com": 0.80, "coinmarketcap.com": 0.75, "investing.com": 0.75, "finviz.com": 0.80, "seekingalpha.com": 0.75,
    "yahoo.com": 0.55, "bbc.com": 0.55, "theguardian.com": 0.50, "espn.com": 0.05, "tmz.com": 0.05,
}
SOURCE_PRIORS = {"rss": 0.55, "atom": 0.55, "sitemap": 0.50, "gdelt": 0.65, "tail_recrawl": 0.55, "common_crawl_wet": 0.30, "fineweb": 0.30, "local_fixture": 0.50}
DEFAULT_DOMAIN_PRIOR, DEFAULT_SOURCE_PRIOR = 0.45, 0.40
#: Reason codes by horizon; a code of the first set gives both intraday and one_day.
HORIZONS = {
    "short": ["central_bank", "earnings", "guidance", "cyber_outage", "natural_disaster", "fraud_governance", "litigation", "product_launch"],
    "one_week": ["m_and_a", "regulation", "sanctions_trade", "supply_chain", "energy", "metals"],
    "structural": ["inflation", "growth_recession", "employment", "esg_reputation", "funding_liquidity", "geopolitics"],
}
ASSETS, REASONS = list(ASSET_CLASSES), list(REASON_CODES)


def aliases(spark: SparkSession) -> DataFrame:
    """(term, kind, label): one row for each lower-case alias of a label and for its own name in words."""
    rows = set()
    for kind, group in (("asset", ASSET_CLASSES), ("reason", REASON_CODES), ("negative", dict.fromkeys(NEGATIVE_CLASSES, []))):
        for label, words in group.items():
            rows |= {(w.lower(), kind, label) for w in [label.replace("_", " "), *words]}
    return spark.createDataFrame(sorted(rows), "term string, kind string, label string")
