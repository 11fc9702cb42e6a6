"""Word lists and lookup tables of the enrichment, as plain values."""

from __future__ import annotations

# What a finance text mentions, what other texts mention, and words that say how it went.
FINANCE_KEYWORDS = (
    "earnings", "revenue", "profit", "loss", "guidance", "ipo", "merger", "acquisition", "buyback", "dividend", "stock", "share", "equity", "bond", "yield", "treasury",
    "rate", "rates", "fed", "ecb", "boj", "boe", "central bank", "inflation", "cpi", "ppi", "gdp", "unemployment", "jobs", "payrolls", "oil", "brent", "wti", "gold",
    "silver", "copper", "wheat", "bitcoin", "btc", "ether", "ethereum", "crypto", "stablecoin", "forex", "currency", "dollar", "euro", "yen", "yuan", "pound",
    "sanctions", "tariff", "trade war", "geopolit", "regulation", "lawsuit", "sec ", "fdic", "occ ", "fca ", "$",
)
HARD_NEGATIVE_KEYWORDS = (
    "scoreboard", "touchdown", "goal", "transfer window", "match", "draft pick", "celebrity gossip", "movie review", "film review", "concert review", "recipe", "horoscope", "tarot", "love advice",
)
POSITIVE = (
    "beat", "beats", "exceeded", "surge", "rally", "outperform", "upgrade", "upgraded", "raise", "raised", "raises", "boom", "growth", "gain", "gains", "strong", "robust",
    "record high", "record-high", "record profit", "buyback", "expansion", "expanded", "tailwind", "bullish",
)
NEGATIVE = (
    "miss", "missed", "fell", "slump", "plunge", "sink", "downgrade", "cut", "cuts", "lower", "loss", "losses", "weak", "warn", "warns", "warning", "default", "bankrupt",
    "recession", "headwind", "bearish", "shrink", "shrank", "fraud", "lawsuit", "probe",
)
LABEL_STOPWORDS = (
    "this", "that", "the", "and", "for", "with", "about", "into", "from", "over", "under", "between", "among", "what", "which", "who", "whom", "are", "was", "were", "been",
    "being", "have", "has", "had", "they", "them", "their", "there", "here", "when", "where", "while", "though", "than", "then", "such", "some", "many", "much", "most",
    "more", "less", "few", "any", "all", "primarily", "text", "report", "covers",
)
CURRENCIES = ("USD", "EUR", "JPY", "GBP", "CHF", "CAD", "AUD", "NZD", "CNY", "TRY", "INR", "MXN", "BRL", "ZAR", "KRW", "SEK", "NOK", "PLN", "RUB")
CENTRAL_BANKS = (
    "Federal Reserve", "Fed", "FOMC", "Federal Open Market Committee", "ECB", "European Central Bank", "Bank of Japan", "BoJ", "Bank of England", "BoE", "People's Bank of China", "PBoC",
    "Bank of Canada", "BoC", "Reserve Bank of Australia", "RBA", "Reserve Bank of New Zealand", "RBNZ", "Swiss National Bank", "SNB", "Bank of Korea", "BoK", "Central Bank of Turkey",
)
INDICES = (
    "S&P 500", "S&P500", "S&P", "Dow", "Dow Jones", "Nasdaq", "Russell 2000", "FTSE", "FTSE 100", "DAX", "CAC", "CAC 40", "Nikkei", "Nikkei 225", "Hang Seng", "Shanghai Composite",
    "STOXX 600", "Euro Stoxx", "BIST", "BIST 100", "VIX",
)
COMMODITIES = ("Brent", "WTI", "crude", "natural gas", "gold", "silver", "copper", "platinum", "palladium", "wheat", "corn", "soybeans", "coffee", "sugar", "cocoa")
CRYPTO = ("Bitcoin", "BTC", "Ethereum", "ETH", "Solana", "SOL", "Cardano", "ADA", "Ripple", "XRP", "Dogecoin", "DOGE", "Polkadot", "DOT", "stablecoin")
NOT_TICKERS = (
    "CEO", "CFO", "COO", "CTO", "IPO", "ETF", "ETFS", "GDP", "CPI", "PPI", "SEC", "FTC", "FDA", "FOMC", "ECB", "BOJ", "BOE", "PBOC", "RBA", "USA", "UK", "EU", "UN", "NATO", "WHO",
    "FBI", "CIA", "DOJ", "IRS", "EPA", "NBA", "NFL", "NHL", "MLB", "NCAA", "ESG", "FAQ",
)
# Names of companies and goods, and their symbols.
SYMBOLS = {
    "Apple": "AAPL", "Microsoft": "MSFT", "Alphabet": "GOOGL", "Google": "GOOGL", "Amazon": "AMZN", "Meta Platforms": "META", "Meta": "META", "Facebook": "META", "NVIDIA": "NVDA",
    "Tesla": "TSLA", "Berkshire Hathaway": "BRK.B", "Berkshire": "BRK.B", "JPMorgan": "JPM", "JPMorgan Chase": "JPM", "Goldman Sachs": "GS", "Bank of America": "BAC", "Citigroup": "C",
    "Morgan Stanley": "MS", "Wells Fargo": "WFC", "BlackRock": "BLK", "ExxonMobil": "XOM", "Exxon": "XOM", "Chevron": "CVX", "Shell": "SHEL", "BP": "BP", "Johnson & Johnson": "JNJ",
    "Pfizer": "PFE", "Moderna": "MRNA", "Eli Lilly": "LLY", "Procter & Gamble": "PG", "Coca-Cola": "KO", "PepsiCo": "PEP", "Walmart": "WMT", "Costco": "COST", "Home Depot": "HD",
    "McDonald's": "MCD", "Intel": "INTC", "AMD": "AMD", "Qualcomm": "QCOM", "Broadcom": "AVGO", "Cisco": "CSCO", "Oracle": "ORCL", "Salesforce": "CRM", "Adobe": "ADBE",
    "Netflix": "NFLX", "Disney": "DIS", "Visa": "V", "Mastercard": "MA", "PayPal": "PYPL", "Boeing": "BA", "Lockheed Martin": "LMT", "General Electric": "GE", "Ford": "F",
    "General Motors": "GM", "Toyota": "TM", "Bitcoin": "BTC-USD", "BTC": "BTC-USD", "Ethereum": "ETH-USD", "Ether": "ETH-USD", "ETH": "ETH-USD", "Solana": "SOL-USD", "SOL": "SOL-USD",
    "Ripple": "XRP-USD", "XRP": "XRP-USD", "Cardano": "ADA-USD", "ADA": "ADA-USD", "Dogecoin": "DOGE-USD", "DOGE": "DOGE-USD", "Polkadot": "DOT-USD", "DOT": "DOT-USD",
    "S&P 500": "^GSPC", "Dow Jones": "^DJI", "Nasdaq": "^IXIC", "Russell 2000": "^RUT", "FTSE 100": "^FTSE", "DAX": "^GDAXI", "Nikkei 225": "^N225", "Hang Seng": "^HSI", "VIX": "^VIX",
    "BIST 100": "XU100.IS", "EUR/USD": "EURUSD=X", "USD/JPY": "USDJPY=X", "GBP/USD": "GBPUSD=X", "Brent": "BZ=F", "WTI": "CL=F", "gold": "GC=F", "silver": "SI=F", "copper": "HG=F",
}
#: (asset class, reason code, channel) in order; "*" stands for any reason and adds to the others.
# The channels and what leads to each.
CHANNELS = (
    ("equities", "earnings", "equities.earnings"), ("equities", "guidance", "equities.guidance"), ("equities", "m_and_a", "equities.m_and_a"), ("equities", "product_launch", "equities.product"),
    ("equities", "fraud_governance", "equities.governance"), ("equities", "litigation", "equities.litigation"), ("equities", "regulation", "equities.regulation"), ("equities", "esg_reputation", "equities.esg"),
    ("equities", "*", "equities.general"), ("indices", "*", "indices.macro"), ("rates", "central_bank", "rates.policy"), ("rates", "inflation", "rates.inflation"), ("rates", "employment", "rates.labor"),
    ("rates", "growth_recession", "rates.growth"), ("rates", "*", "rates.general"), ("credit", "funding_liquidity", "credit.funding"), ("credit", "*", "credit.general"), ("fx", "central_bank", "fx.policy"),
    ("fx", "*", "fx.general"), ("commodities", "energy", "commodities.energy"), ("commodities", "metals", "commodities.metals"), ("commodities", "supply_chain", "commodities.logistics"),
    ("commodities", "geopolitics", "commodities.geo"), ("commodities", "*", "commodities.general"), ("crypto", "*", "crypto.general"), ("macro", "inflation", "macro.inflation"), ("macro", "central_bank", "macro.policy"),
    ("macro", "employment", "macro.labor"), ("macro", "labor_market", "macro.labor"), ("macro", "growth_recession", "macro.growth"), ("macro", "geopolitics", "macro.geo"), ("macro", "sanctions_trade", "macro.trade"), ("macro", "*", "macro.general"),
)
