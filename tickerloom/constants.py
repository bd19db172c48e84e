"""Policies, word lists, patterns and labels shared by the operators."""

from __future__ import annotations

PRICE_COLUMNS = ["date", "symbol", "open", "high", "low", "close", "adjusted_close", "volume", "provider"]
OHLC = ["open", "high", "low", "close"]
RAW_CLOSE_PROVIDER = "alpha_vantage"
PRICE_ADJUSTMENT = "splits_and_dividends"

# Stock universe and benchmark symbol used when the caller names none.
DEFAULT_UNIVERSE = [
    "AAPL", "MSFT", "GOOGL", "AMZN", "META",
    "NVDA", "TSLA", "JPM", "V", "MA",
    "WMT", "COST", "KO", "PEP", "DIS",
    "NFLX", "AMD", "INTC", "XOM", "JNJ",
]
DEFAULT_BENCHMARK = "SPY"

MOMENTUM_PERIODS = (21, 63, 126)
BETA_WINDOWS = (60, 126, 252)
TRADING_DAYS = 252

# Filing forms whose facts count as reported, and the frame of one standalone quarter.
FILING_FORMS = ["10-K", "10-Q", "20-F", "40-F"]
QUARTER_FRAME = r"^CY(\d{4})Q([1-4])I?$"

# metric -> (tags in order of preference, unit)
FACT_METRICS = {
    "revenue": (["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"], "USD"),
    "net_income": (["NetIncomeLoss", "ProfitLoss"], "USD"),
    "assets": (["Assets"], "USD"),
    "liabilities": (["Liabilities"], "USD"),
    "equity": (
        ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
        "USD",
    ),
    "eps_diluted": (["EarningsPerShareDiluted"], "USD/shares"),
}
REVENUE_TAGS = [*FACT_METRICS["revenue"][0], "RevenuesNetOfInterestExpense"]
INCOME_TAGS = FACT_METRICS["net_income"][0]

MISSING_NUMBER_WORDS = ["", "None", "-", "N/A"]

WINSOR_FEATURES = [
    "beta_252", "momentum_21d", "momentum_63d", "momentum_126d",
    "volatility_20d_annualized", "revenue_growth_yoy", "profit_margin", "pe_ratio",
]
DISTRIBUTION_FEATURES = [
    "beta_252", "momentum_21d", "momentum_63d", "momentum_126d",
    "volatility_20d_annualized", "rsi_14", "drawdown",
    "revenue_growth_yoy", "profit_margin", "pe_ratio",
]
CORRELATION_FEATURES = {
    "Beta 252": "beta_252_winsorized",
    "Momentum 21D": "momentum_21d_winsorized",
    "Momentum 63D": "momentum_63d_winsorized",
    "Momentum 126D": "momentum_126d_winsorized",
    "Volatility 20D": "volatility_20d_annualized_winsorized",
    "RSI 14": "rsi_14",
    "Drawdown": "drawdown",
    "Revenue Growth YoY": "revenue_growth_yoy_winsorized",
    "Profit Margin": "profit_margin_winsorized",
    "P/E": "pe_ratio_winsorized",
}

# feature -> (column that is ranked, direction, name of the direction-adjusted score)
RANK_POLICY = {
    "momentum_21d": ("momentum_21d_winsorized", "higher", "momentum_21d_score"),
    "momentum_63d": ("momentum_63d_winsorized", "higher", "momentum_63d_score"),
    "momentum_126d": ("momentum_126d_winsorized", "higher", "momentum_126d_score"),
    "revenue_growth_yoy": ("revenue_growth_yoy_winsorized", "higher", "growth_score"),
    "profit_margin": ("profit_margin_winsorized", "higher", "profitability_score"),
    "pe_ratio": ("pe_ratio_winsorized", "lower", "valuation_score"),
    "drawdown": ("drawdown", "higher", "drawdown_resilience_score"),
    "beta_252": ("beta_252_winsorized", "descriptive", None),
    "volatility_20d_annualized": ("volatility_20d_annualized_winsorized", "descriptive", None),
    "rsi_14": ("rsi_14", "descriptive", None),
}

MOMENTUM_WEIGHTS = {"momentum_21d_score": 0.20, "momentum_63d_score": 0.40, "momentum_126d_score": 0.40}
QUALITY_WEIGHTS = {"growth_score": 0.50, "profitability_score": 0.50}
COMPOSITE_WEIGHTS = {"momentum_subscore": 0.40, "quality_subscore": 0.40, "valuation_subscore": 0.20}
MINIMUM_COVERAGE = 0.80

LABEL_FLOORS = [(80.0, "Strong"), (60.0, "Positive"), (40.0, "Neutral"), (20.0, "Weak"), (0.0, "Very Weak")]

# Columns that describe a row rather than measure it; never assessed for missing values.
METADATA_COLUMNS = [
    "symbol", "date", "is_benchmark", "quality_note",
    "revenue_growth_available", "profit_margin_available", "unusual_margin_flag",
    "has_fundamentals", "has_beta", "has_momentum", "has_growth",
]
# Columns that only a company can have, so the benchmark row is outside their denominator.
STOCK_ONLY_COLUMNS = [
    "company_name", "sic", "sic_description", "fiscal_year_end", "exchange",
    "revenue", "net_income", "assets", "liabilities", "equity", "eps_diluted",
    "beta_60", "beta_60_n_obs", "beta_126", "beta_126_n_obs", "beta_252", "beta_252_n_obs",
    "revenue_growth_yoy", "profit_margin", "latest_frame", "comparison_frame",
    "revenue_growth_available", "profit_margin_available", "unusual_margin_flag", "quality_note",
    "has_fundamentals", "has_beta", "has_growth",
]

TIMEFRAME_MONTHS = {"3M": 3, "6M": 6, "1Y": 12, "2Y": 24}
TIMEFRAME_DAYS = {"3M": 92, "6M": 183, "1Y": 366, "2Y": 732}

SCREEN_FIELDS = [
    "composite_score", "momentum_21d_raw_pct", "momentum_63d_raw_pct", "momentum_126d_raw_pct",
    "profit_margin_raw_pct", "revenue_growth_yoy_raw_pct", "pe_ratio_raw", "beta_252_raw", "rsi_14",
    "volatility_pct", "max_drawdown_pct", "momentum_subscore", "quality_subscore",
    "valuation_subscore", "score_coverage",
]
DISPLAY_NAMES = {
    "symbol": "Ticker", "company_name": "Company", "close": "Close",
    "daily_return_pct": "1D return %", "rsi_14": "RSI 14", "signal": "Signal",
    "sma_20": "SMA 20", "sma_50": "SMA 50", "volatility_pct": "Volatility %",
    "drawdown_pct": "Drawdown %", "revenue_billions": "Revenue $B",
    "net_income_billions": "Net income $B", "eps_diluted": "Diluted EPS",
    "momentum_63d_raw_pct": "Momentum 3M %", "profit_margin_raw_pct": "Profit margin %",
    "revenue_growth_yoy_raw_pct": "Revenue growth YoY %", "pe_ratio_raw": "P/E",
    "beta_252_raw": "Beta 252D", "momentum_subscore": "Momentum score",
    "quality_subscore": "Fundamentals score", "valuation_subscore": "Valuation score",
    "composite_score": "Composite score", "score_coverage": "Score coverage",
    "momentum_label": "Momentum signal", "fundamentals_label": "Fundamentals signal",
    "valuation_label": "Valuation signal", "overall_display_label": "Overall signal",
}
DEFAULT_DISPLAY = [
    "symbol", "company_name", "momentum_63d_raw_pct", "profit_margin_raw_pct", "pe_ratio_raw",
    "beta_252_raw", "composite_score", "overall_display_label",
]

# Sentences that are shown to users as they stand.
RSI_LINES = {
    "above": ", above 70. Recent gains are strong, but this can indicate an overextended move.",
    "below": ", below 30. Selling pressure is strong; this is not automatically a buy signal.",
    "between": ", between 30 and 70; neither reference extreme is active.",
}
CONCLUSION_PROMPT = "Form a view only after checking business context, fundamentals, valuation, price/risk, and data gaps."
