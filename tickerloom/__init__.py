"""Panel analytics for daily price bars and company filings, built on Spark DataFrames."""
