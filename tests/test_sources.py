import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tickerloom.constants import PRICE_COLUMNS
from tickerloom.operators.keys import DataQualityError
from tickerloom.sources import catalog, filings, prices, sinks
from tickerloom.streaming.landing import land_new_files

HEADER = ",".join(PRICE_COLUMNS)


def _write(folder, name, *lines, header=HEADER):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([header, *lines]) + "\n")


def test_price_folder(spark, tmp_path):
    d = tmp_path / "p"
    _write(d, "A.csv", "2024-01-02,A,1,2,0.5,1.5,1.4,100,twelve_data", "2024-01-03,A,1,2,0.5,1.6,1.5,100,twelve_data")
    _write(d, "B.csv", "2024-01-02,B,1,2,0.5,1.5,1.4,100,alpha_vantage")
    df = prices.read_price_files(spark, str(d))
    assert df.columns == PRICE_COLUMNS and df.count() == 3 and dict(df.dtypes)["date"] == "date"


def test_price_folder_rejects_bad_files(spark, tmp_path):
    d = tmp_path / "bad-value"
    _write(d, "A.csv", "2024-01-02,A,1,2,0.5,oops,1.4,100,x")
    with pytest.raises(Exception, match="A.csv|oops"):
        prices.read_price_files(spark, str(d)).collect()
    d = tmp_path / "bad-header"
    _write(d, "A.csv", "2024-01-02,A,1", header="date,symbol,open")
    with pytest.raises(DataQualityError, match="missing columns"):
        prices.read_price_files(spark, str(d))
    d = tmp_path / "mixed-header"
    _write(d, "A.csv", "2024-01-02,A,1,2,0.5,1.5,1.4,100,x")
    _write(d, "B.csv", "2024-01-02,B,1,2,0.5,1.5,1.4,100,x", header=HEADER.replace("volume", "lots"))
    with pytest.raises(Exception, match="[AB].csv"):
        prices.read_price_files(spark, str(d)).collect()


def test_provider_payloads(spark):
    a = {"Meta Data": {"x": "y"}, "Time Series (Daily)": {"2024-01-02": {"1. open": "1", "2. high": "2", "3. low": "0.5", "4. close": "1.5", "5. adjusted close": "1.4", "6. volume": "bad"}}}
    t = {"values": [{"datetime": "2024-01-02", "open": "1", "high": "2", "low": "0.5", "close": "1.5", "volume": "9"}], "status": "ok"}
    left = prices.bars_from_date_maps(spark.createDataFrame([("ibm", json.dumps(a))], "symbol string, payload string")).first()
    right = prices.bars_from_value_lists(spark.createDataFrame([("ibm", json.dumps(t))], "symbol string, payload string")).first()
    assert (left.symbol, left.adjusted_close, left.volume, left.provider) == ("IBM", 1.4, None, "alpha_vantage")
    assert (right.date, right.adjusted_close, right.volume) == (dt.date(2024, 1, 2), 1.5, 9.0)


def test_provider_payload_failures(spark):
    def run(payload):
        df = spark.createDataFrame([("ibm", json.dumps(payload))], "symbol string, payload string")
        return prices.bars_from_value_lists(df).collect()

    with pytest.raises(Exception, match="missing fields: low, volume"):
        run({"values": [{"datetime": "2024-01-02", "open": "1", "high": "2", "close": "1"}]})
    with pytest.raises(Exception, match="unexpected twelve_data response for ibm"):
        run({"status": "error"})


def test_company_documents(spark, tmp_path):
    d = tmp_path / "sec"
    d.mkdir()
    doc = {"cik": 1, "entityName": "Alpha", "facts": {"us-gaap": {"Revenues": {"label": "x", "units": {"USD": [
        {"val": 5, "start": "2024-01-01", "end": "2024-03-31", "filed": "2024-05-01", "form": "10-Q", "frame": "CY2024Q1", "accn": "z"},
        {"val": 7, "end": "bad", "filed": "", "form": "10-Q"}]}}}, "dei": {}}}
    (d / "AAA_companyfacts.json").write_text(json.dumps(doc, indent=1))
    rows = filings.flatten_company_facts(filings.read_documents(spark, str(d), "_companyfacts.json")).orderBy("seq").collect()
    assert [(r.symbol, r.tag, r.unit, r.val, r.seq) for r in rows] == [("AAA", "Revenues", "USD", 5.0, 0), ("AAA", "Revenues", "USD", 7.0, 1)]
    assert rows[0].filed == dt.date(2024, 5, 1) and rows[1].period_end is None and rows[1].filed is None and rows[1].frame is None


def test_identity_fallbacks(spark):
    docs = [("A", json.dumps({"name": "", "exchanges": []}), json.dumps({"entityName": "Alpha"})), ("B", json.dumps({"name": "Beta", "sic": "1", "exchanges": ["NYSE", "X"]}), "{}")]
    a, b = filings.company_identity(spark.createDataFrame(docs, "symbol string, submissions string, facts string")).orderBy("symbol").collect()
    assert (a.company_name, a.exchange, a.sic) == ("Alpha", "", "") and (b.company_name, b.exchange) == ("Beta", "NYSE")


def test_overview_files(spark, tmp_path):
    d = tmp_path / "o"
    d.mkdir()
    (d / "AAA_overview.json").write_text(json.dumps({"PERatio": "None", "EPS": "2", "Beta": "1.1", "Other": {"x": 1}}, indent=1))
    (d / "notes.txt").write_text("skip")
    r = filings.read_overviews(spark, str(d)).first()
    assert (r.symbol, r.PERatio, r.EPS, r.Beta) == ("AAA", "None", "2", "1.1")
    got = {x.symbol: (x.provider_beta, x.provider_status) for x in catalog.provider_betas(spark.createDataFrame([("AAA",), ("B",)], "symbol string"), filings.read_overviews(spark, str(d))).collect()}
    assert got == {"AAA": (1.1, "cached"), "B": (None, "error")}


def test_files_land_once(spark, tmp_path):
    source = tmp_path / "in"
    _write(source, "A.csv", "2024-01-02,A,1,2,0.5,1.5,1.4,100,x")
    args = (spark, str(source), str(tmp_path / "out"), str(tmp_path / "log"), PRICE_COLUMNS)
    assert land_new_files(*args).count() == 1
    assert land_new_files(*args).count() == 1
    _write(source, "B.csv", "2024-01-02,B,1,2,0.5,1.5,1.4,100,x")
    assert sorted(r.symbol for r in land_new_files(*args).collect()) == ["A", "B"]


def test_manifest_and_skips(spark):
    wanted = spark.createDataFrame([("A",), ("Z",)], "symbol string")
    landed = spark.createDataFrame([("A", dt.date(2024, 1, 2), "p")], "symbol string, date date, provider string")
    m = {r.symbol: r for r in catalog.landing_manifest(wanted, landed).collect()}
    assert m["A"].success and m["A"].rows == 1 and not m["Z"].success and m["Z"].note == "no rows landed"
    left = catalog.not_yet_landed(wanted, catalog.landing_manifest(wanted, landed))
    assert [r.symbol for r in left.collect()] == ["Z"]
    assert catalog.universe_table(spark).where("is_benchmark").first().symbol == "SPY"


def test_panel_years_are_pruned(spark, tmp_path):
    df = spark.sql("SELECT 'A' AS symbol, d AS date, 1.0D AS close FROM (SELECT explode(sequence(date'2019-01-01', date'2023-12-31')) AS d)")
    sinks.write_panel(df, str(tmp_path / "panel"))
    back = sinks.read_panel(spark, str(tmp_path / "panel"))
    assert back.count() == df.count() and set(back.columns) == {"symbol", "date", "close"}


def test_csv_quoting_and_ranks(spark, tmp_path):
    df = spark.createDataFrame([("A", 'say "hi", now', None), ("B", "x", 2.0)], "symbol string, company_name string, composite_score double")
    shown = sinks.ranked_screen(df, ["symbol", "company_name", "composite_score"], "composite_score")
    assert [(r["rank"], r.symbol) for r in shown.orderBy("rank").collect()] == [(1, "B"), (2, "A")]
    sinks.write_csv(shown.orderBy("rank").coalesce(1), str(tmp_path / "csv"), quote_all=True)
    text = next((tmp_path / "csv").glob("part-*.csv")).read_text()
    assert '"2","A","say ""hi"", now",""' in text


def test_reports_keep_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b double")
    sinks.write_report(df, str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()[0]) == {"a": 1, "b": None}


def test_dashboard_documents(spark):
    screener = spark.createDataFrame([("A", dt.date(2024, 1, 2), None)], "symbol string, date date, rsi_14 double")
    columns = {c: F.lit(1.0) for c in sinks.HISTORY_FIELDS if c != "date"}
    history = spark.createDataFrame([("A", dt.date(2024, 1, 2)), ("A", dt.date(2024, 1, 1))], "symbol string, date date").withColumns(columns)
    row = sinks.dashboard_documents(screener, history).first()
    assert json.loads(row.stock) == {"symbol": "A", "date": "2024-01-02", "rsi_14": None}
    assert [x["date"] for x in json.loads(row.history)] == ["2024-01-01", "2024-01-02"]
    assert sinks.dashboard_meta(screener, "MKT").first().latest_market_date == "2024-01-02"


def test_raw_inventory(spark, tmp_path):
    import hashlib

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.bin").write_bytes(b"abc")
    r = catalog.raw_inventory(spark, str(tmp_path)).first()
    assert r.bytes == 3 and r.sha256 == hashlib.sha256(b"abc").hexdigest()


def test_price_folder_with_failed_files(spark, tmp_path):
    head = "symbol,date,open,high,low,close,adjusted_close,volume,provider"
    row = "A,2024-01-0{d},1,2,0.5,1.5,1.5,10,x"
    files = {
        "good": [head, row.format(d=2), row.format(d=3)],
        "other order": ["date,symbol,close,open,high,low,adjusted_close,volume,provider,more", '2024-01-05,"B",3,1,4,1,3,7,y,z', ""],
        "text": [head, row.format(d=4), "A,2024-01-05,1,2,n/a,1.5,1.5,10,x", "A,someday,1,2,1,1.5,1.5,10,x", ",2024-01-09,1,2,1,1.5,1.5,10,x"],
        "column": [head.replace("low,", "").replace("volume,", ""), "A,2024-01-02,1,2,1.5,1.5,x"],
        "header": [head], "empty": [],
    }
    for name, lines in files.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + ("\n" if lines else ""))
    (tmp_path / "notes.txt").write_text("not a price file")
    got = {r.path.replace("%20", " ").rsplit("/", 1)[1][:-4]: r for r in catalog.file_manifest(spark, str(tmp_path)).collect()}
    assert {k: (r.success, r.rows, r.failed_rows, r.note) for k, r in got.items()} == {
        "good": (True, 2, 0, ""), "other order": (True, 1, 0, ""), "text": (False, 1, 3, "3 rows failed, first: low"),
        "column": (False, 0, 0, "missing columns: low, volume"), "header": (False, 0, 0, "no rows"), "empty": (False, 0, 0, "empty file"),
    }
    assert got["empty"].bytes == 0 and got["good"].bytes > 100 and str(got["text"].last_date) == "2024-01-04"
    rows = prices.read_price_folder(spark, str(tmp_path)).orderBy("symbol", "date").collect()
    assert [(r.symbol, str(r.date), r.close) for r in rows] == [("A", "2024-01-02", 1.5), ("A", "2024-01-03", 1.5), ("A", "2024-01-04", 1.5), ("B", "2024-01-05", 3.0)]


def test_bucketed_panel_needs_no_exchange(spark, tmp_path):
    import uuid

    from tickerloom.operators import indicators

    rows = [(f"S{i % 7}", dt.date(2024, 1, 1) + dt.timedelta(days=i // 7), float(i)) for i in range(1, 700)]
    panel = spark.createDataFrame(rows, "symbol string, date date, close double")
    table = sinks.write_bucketed(panel, f"t_{uuid.uuid4().hex}", 3, str(tmp_path / "bucketed"))
    plan = indicators.add_all(table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan
    assert sorted(map(tuple, table.collect())) == sorted(rows)


def test_overviews_from_symbol_folders(spark, tmp_path):
    for s in ("A", "B"):
        (tmp_path / f"symbol={s}").mkdir()
        (tmp_path / f"symbol={s}" / "part-0.txt").write_text('{"PERatio": "%s1", "EPS": "2"}' % (s == "B" and "3" or ""))
    got = {r.symbol: r.PERatio for r in filings.read_overviews(spark, str(tmp_path), ".txt").collect()}
    assert got == {"A": "1", "B": "31"}


def test_inventory_reads_streams(spark, tmp_path):
    import hashlib

    data = bytes(range(256)) * 50_000
    (tmp_path / "large file.bin").write_bytes(data)
    (tmp_path / "packed.gz").write_bytes(b"as it is")
    found = catalog.raw_inventory(spark, str(tmp_path))
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.bytes, r.sha256) for r in found.collect()) == sorted((len(x), hashlib.sha256(x).hexdigest()) for x in (data, b"as it is"))
