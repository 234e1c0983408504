from collections import defaultdict

import duckdb

from tallyframe.llm import passages as L


def brute(rows, least=L.LEAST_WORDS):
    where = defaultdict(list)
    for i, t in rows:
        for n, (*_, d) in enumerate(L.units(t or "")):
            if i is not None:
                where[d].append((i, n))
    out = set()
    for i, t in rows:
        seen, run, u = set(), [], L.units(t or "")
        for n, (a, b, w, d) in enumerate([*u, (0, 0, 0, b"")]):
            first = min(where[d])[0] if where[d] else None
            if n < len(u) and (d in seen or i is not None and first < i):
                run.append((a, b, w, first if first is not None else i))
            elif run:
                if sum(r[2] for r in run) >= least:
                    out.add((i, run[0][0], max(r[1] for r in run), len(run), sum(r[2] for r in run), min((r[3] for r in run if r[3] is not None), default=None)))
                run = []
            seen.add(d)
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in L.repeats(df).collect()), key=str)


def test_documents(spark):
    at = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{at}/documents.parquet")
    found = got(df)
    assert found == brute([(r.doc_id, r.text) for r in df.collect()])
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{at}/documents.parquet'")
    assert sorted(con.execute(L.SQL_LINES).fetchall(), key=str) == found
    units = sorted(map(tuple, L.repeated_lines(spark, at).collect()))
    assert units == sorted(con.execute(L.SQL_UNITS).fetchall()) and len(units) > sum(r[3] for r in found)


LONG = "The first sentence of a passage that many share has quite some words. And then a second one follows it here! Does a third one, with a question, make it long enough? Yes it does and so it is repeated."


def test_passage_inside_a_paragraph(spark):
    rows = [(7, f"Its own start. {LONG} Its own end."), (3, f"Other words begin here and {LONG}\nA last line"), (9, LONG.upper().replace(" ", "  ")), (4, "Yes. No. Yes. No. Short ones repeat. Yes.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = got(df)
    assert found == brute(rows) and {r[0] for r in found} == {7, 9}
    seven = next(r for r in found if r[0] == 7)
    assert rows[0][1][seven[1] : seven[2]].startswith("And then") and seven[5] == 3
    clean = {r.doc_id: r.text for r in L.removed(df, L.repeats(df)).collect()}
    assert clean[3] == rows[1][1] and clean[4] == rows[3][1] and "Its own start." in clean[7] and "Its own end." in clean[7] and "second one" not in clean[7]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, LONG), (3, LONG), (3, LONG + " More."), (None, LONG), (None, LONG + LONG), (4, "\U0001f600é\n\n" + LONG * 300), (5, "!!! ... \n")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, unit int")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []
    assert got(spark.createDataFrame([(k, LONG) for k in range(300)], "doc_id long, text string")) == brute([(k, LONG) for k in range(300)])
