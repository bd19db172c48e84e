"""Folders of price files: each line is parsed once, whatever its number of cells."""

import datetime as dt

from tickerloom.plans import chains, queries
from tickerloom.sources import catalog, prices

HEAD = "symbol,date,open,high,low,close,adjusted_close,volume,provider"


def written(folder, **files):
    for name, lines in files.items():
        (folder / f"{name}.csv").write_text("".join(f"{x}\n" for x in lines))
    return str(folder)


def test_a_line_is_parsed_once_and_a_folder_is_listed_once(spark, tmp_path):
    folder = written(tmp_path, a=[HEAD, "A,2024-01-02,1,2,0.5,1.5,1.5,10,x"], nothing=[])
    _, rows = prices.price_lines(prices.price_texts(spark, folder))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1
    manifest = catalog.file_manifest(spark, folder)
    assert "binaryFile" not in manifest._jdf.queryExecution().executedPlan().toString()
    found = {r.path.rsplit("/", 1)[1]: (r.bytes, r.note) for r in manifest.collect()}
    assert found == {"a.csv": (len(HEAD) + 35, ""), "nothing.csv": (0, "empty file")}


def test_short_long_and_quoted_lines(spark, tmp_path):
    folder = written(
        tmp_path,
        a=[
            HEAD, "A,2024-01-01,1,2,0.5,1.5,1.5,10,x", "A,2024-01-02,1,2,0.5,1.5,1.5,10", "A,2024-01-03,1", "A", "A,2024-01-04,1,2,0.5,1.5,1.5,10,x,y,z",
            ' A ,"2024-01-05", 1 ,2,0.5,1.5,1.5,10,"x,y"', 'A,2024-01-06,1,2,0.5,1.5,1.5,10,"open', "A,2024-01-07,1,2,0.5,1.5,1.5,n/a,",
        ],
        wide=[HEAD + "".join(f",m{i}" for i in range(40)), "B,2024-01-08,1,2,0.5,1.5,1.5,10,x,,"],
        further=["more,," + HEAD + ",,", "q,,C,2024-01-09,1,2,0.5,1.5,1.5,10,x,,", "q,,C,2024-01-10,1"],
    )
    rows = prices.price_lines(prices.price_texts(spark, folder))[1].collect()
    assert sorted((str(r.date), r.symbol, r.problem, r.open, r.volume, r.provider) for r in rows) == [
        ("2024-01-01", "A", None, 1.0, 10.0, "x"), ("2024-01-02", "A", None, 1.0, 10.0, None), ("2024-01-03", "A", None, 1.0, None, None),
        ("2024-01-04", "A", None, 1.0, 10.0, "x"), ("2024-01-05", "A", None, 1.0, 10.0, "x,y"), ("2024-01-06", "A", None, 1.0, 10.0, "open"),
        ("2024-01-07", "A", "volume", 1.0, None, None), ("2024-01-08", "B", None, 1.0, 10.0, "x"), ("2024-01-09", "C", None, 1.0, 10.0, "x"),
        ("2024-01-10", "C", None, 1.0, None, None), ("None", "A", "date", None, None, None),
    ]


def test_the_file_manifest_combines_shipments_once(spark, tmp_path, monkeypatch):
    rows = [(k, dt.datetime(2001, 1, d), 1.0, 100.0 + d, 0.0) for k in range(3) for d in range(8, 14)]
    kind = "l_suppkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    reads, read = [], queries.tables.bars
    monkeypatch.setattr(queries.tables, "bars", lambda *a: reads.append(1) or read(*a))
    chains.forget_stages()
    found = {r.file: (r.rows, r.failed_rows, r.note) for r in queries.QUERIES["src_14_file_manifest"](spark, str(tmp_path)).collect()}
    # The market has no bar on the thirteenth, a Saturday.
    assert found == {f"S000000000{k}": (6, 0, "") for k in range(3)} | {
        "TEXT": (5, 0, ""), "COLUMN": (0, 0, "missing columns: adjusted_close"), "NOTHING": (0, 0, "empty file")
    }
    assert len(reads) == 1
