"""The table function of parts, from SQL and on frames, and systems side by side."""

import json
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from mailloom.__main__ import main
from mailloom.operators import metrics
from mailloom.sources import parts


def message():
    m = EmailMessage()
    m["Subject"] = "s"
    m.set_content("plain é\n")
    m.add_alternative("<b>h</b>\n", subtype="html")
    m.add_attachment(b"\x00\x01", maintype="application", subtype="pdf", filename="a.pdf")
    inner = EmailMessage()
    inner["Subject"] = "inner"
    inner.set_content("deep\n")
    m.add_attachment(inner)
    return m.as_bytes()


@pytest.fixture(scope="module")
def mails(spark):
    rows = [(1, message(), "k"), (2, b"", None), (3, None, "x"), (4, b"no header at all", "y"), (5, b"From a@b x\nContent-Type: text/plain; charset=nonsense\n\n\xff!", "z"), (5, b"X: y\n\n", "z")]
    return spark.createDataFrame(rows, "id int, raw binary, extra string")


def test_all_other_columns_stay(spark, mails):
    df = parts.parts_of(mails)
    assert df.columns == ["id", "extra", "part", "depth", "content_type", "charset", "file_name", "is_attachment", "size", "content"]
    got = sorted((r["id"], r["part"], r["depth"], r["content_type"], r["file_name"], r["is_attachment"], r["content"]) for r in df.collect() if r["id"] == 1)
    assert got == [(1, 0, 2, "text/plain", None, False, "plain é\n"), (1, 1, 2, "text/html", None, False, "<b>h</b>\n"), (1, 2, 1, "application/pdf", "a.pdf", True, "\x00\x01"), (1, 3, 2, "text/plain", None, False, "deep\n")]
    rest = sorted((r["id"], r["extra"], r["content"]) for r in df.collect() if r["id"] != 1)
    assert rest == [(4, "y", "no header at all"), (5, "z", ""), (5, "z", "�!")]


def test_from_sql(spark, mails):
    parts.register(spark)
    mails.createOrReplaceTempView("mails_of_test")
    one = spark.sql("SELECT id, count(*) AS n, sum(size) AS s FROM mails_of_test, LATERAL mail_parts(raw, body => 'none') GROUP BY id").collect()
    assert {r["id"]: (r["n"], r["s"]) for r in one} == {1: (4, 9 + 9 + 2 + 5), 4: (1, 16), 5: (2, 2)}
    text = spark.sql("SELECT content FROM mail_parts('A: b\n\nhello')").collect()
    assert [r[0] for r in text] == ["hello"]
    named = spark.sql("SELECT * FROM mail_parts(TABLE(SELECT raw AS m, id FROM mails_of_test), raw => 'm', body => 'bytes')")
    assert named.columns[0] == "id" and dict(named.dtypes)["content"] == "binary" and named.count() == 7
    assert spark.sql("SELECT * FROM mail_parts(TABLE(SELECT raw FROM mails_of_test WHERE id < 0))").count() == 0


@pytest.mark.parametrize("call", ["mail_parts(raw, body => 'all')", "mail_parts(id)", "mail_parts(TABLE(SELECT id FROM mails_of_test))", "mail_parts(TABLE(SELECT raw, id AS part FROM mails_of_test))"])
def test_refused(spark, mails, call):
    parts.register(spark)
    mails.createOrReplaceTempView("mails_of_test")
    with pytest.raises(Exception, match="body is one of|text or bytes|no column raw|rename"):
        spark.sql(f"SELECT 1 FROM {'mails_of_test, LATERAL ' if 'TABLE' not in call else ''}{call}").collect()


def test_deep_and_many(spark):
    deep = "Content-Type: text/plain\n\nx"
    for k in range(60):
        deep = f'Content-Type: multipart/mixed; boundary="b{k}"\n\n--b{k}\n{deep}\n--b{k}--\n'
    assert [r[:2] for r in parts.message_parts(deep)] == [(0, 60)]
    many = 'Content-Type: multipart/mixed; boundary="b"\n\n' + "".join(f"--b\nContent-Type: text/plain\n\n{k}\n" for k in range(2000)) + "--b--\n"
    assert [r[-1] for r in parts.message_parts(many)] == [str(k) for k in range(2000)]


def test_systems(spark):
    rows = [("a", 1, True, 2.0), ("a", 3, False, 4.0), ("a", 0, None, None), ("a", 2, True, 0.0), ("a", None, True, 9.0), (None, 3, True, None), ("b", 0, False, 1.0)]
    got = {r["system"]: r for r in metrics.side_by_side(spark.createDataFrame(rows, "system string, y_true int, flagged boolean, latency_ms double")).collect()}
    a = got["a"]
    assert (a["n"], a["unanswered"], a["tp"], a["fp"], a["tn"], a["fn"]) == (4, 1, 1, 1, 1, 1)
    assert (a["human_phishing_recall"], a["generated_phishing_bypass"], a["generated_benign_alarms"], a["mean_ms"], a["median_ms"]) == (1.0, 1.0, 1, 3.0, 3.0)
    assert got[None]["generated_phishing_recall"] == 1.0 and got[None]["mean_ms"] == 0.0 and got["b"]["recall"] == 0.0 and got["b"]["per_second"] == 1000.0
    wide = metrics.transposed(metrics.side_by_side(spark.createDataFrame(rows, "system string, y_true int, flagged boolean, latency_ms double"))).collect()
    assert [r["measure"] for r in wide][:2] == ["n", "unanswered"] and wide[0]["a"] == 4.0 and wide[0]["unknown"] == 1.0


def test_baseline_of_two(spark, tmp_path, capsys):
    def put(name, rows):
        (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        return str(tmp_path / name)

    d = put("d", [{"record_id": "1", "y_true": 1, "reply": "Spam: True ; 9 / 5", "latency_ms": 2.0}, {"record_id": "2", "y_true": 0, "latency_ms": 4.0}])
    s = put("s", [{"record_id": "1", "y_true": 1, "reply": '{"score": 1, "action": "no action"}', "latency_ms": 1.0}, {"record_id": "2", "y_true": 0, "reply": '{"action": "reject"}', "latency_ms": 1.0}])
    p = put("p", [{"doc_id": "1", "is_phishing": True}])
    assert main(["baseline", "--input", d, s, "--engine", "spamd", "rspamd", "--predictions", p, "--out", str(tmp_path / "o")]) == 0
    got = {r["system"]: (r["tp"], r["fp"], r["tn"], r["fn"], r["unanswered"]) for r in spark.read.json(str(tmp_path / "o")).collect()}
    assert got == {"spamd": (1, 0, 1, 0, 1), "rspamd": (0, 1, 0, 1, 0), "classifier": (1, 0, 1, 0, 1)}
    assert "generated_phishing_bypass" in capsys.readouterr().out
    with pytest.raises(ValueError):
        main(["baseline", "--input", d, s])
