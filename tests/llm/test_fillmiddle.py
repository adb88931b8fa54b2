"""Fill-in-the-middle against plain slicing."""

import hashlib
import re

import pytest

from quillspark.llm import fillmiddle
from llm_rows import documents, prose

ODD = ["\u0001", "\u0002", "\u0002d\u0001e\u0002", "\u0002e", "a\u0001b\nc\r\n\u0002\u0002d", "😀é\U0001d11e" * 9, "<", "<P", "P>S>M><", "<P>", "a<S>b", "x<M", "$1\\1$", "\n\n", prose(5, 20000)]


def sliced(doc_id, text):
    text = text or ""
    key = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        form, out = "plain", text
    elif h[3] % 100 < 20:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    cut = (None, None) if form == "plain" else (len(p), len(m))
    return (doc_id, n, form, *cut, sha(out), sha(text))


def test_equals_slicing(spark, sample, tmp_path):
    rows = [*sample, *((100 + 50 * k + i, t, "en", None) for k in range(8) for i, t in enumerate(ODD))]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in fillmiddle.op11(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((sliced(i, t) for i, t, *_ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_sql_gives_the_same(spark, sample, tmp_path):
    import duckdb

    rows = [*sample, *((100 + i, t, "en", None) for i, t in enumerate(ODD))]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [[i, t] for i, t, *_ in rows])
    assert sorted(con.execute(fillmiddle.OP11_SQL).fetchall(), key=repr) == sorted((sliced(i, t) for i, t, *_ in rows), key=repr)


@pytest.mark.parametrize("unit", [r"\s*\S+", r"[^\n]*\n"])
def test_other_units_and_round_trip(spark, unit):
    df = documents(spark, [(i, t, "en", None) for i, t in enumerate([*ODD, "one two  three\nfour\n", None, ""])]).withColumnRenamed("keys", "FIM")
    made = fillmiddle.fill_in_middle(df, unit=unit, plain_from=100)
    assert [c for c in made.columns if c.lower() == "fim"] == ["fim"]
    for r in made.withColumn("back", fillmiddle.restored(made["fim.output"], made["fim.form"])).collect():
        assert r.back == (r.text or "")
        if r.fim.form != "plain" and unit == r"\s*\S+" and ("\u0001" not in r.text):
            assert r.fim.n == len(re.findall(r"(?a:\s*\S+)", r.text))
            assert r.fim.prefix == "" or not r.fim.prefix[-1].isspace()


def test_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert fillmiddle.op11(spark, str(tmp_path)).collect() == []
