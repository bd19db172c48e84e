import datetime as dt


def days(n, start=dt.date(2024, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def series(spark, values, symbol="A", start=dt.date(2024, 1, 1)):
    rows = [(symbol, d, None if v is None else float(v)) for d, v in zip(days(len(values), start), values)]
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def column(df, name, symbol=None):
    if symbol:
        df = df.where(df.symbol == symbol)
    return [r[name] for r in df.orderBy("symbol", "date").collect()]
