"""Golden cases, worked out by hand."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from mailloom.functions import features as fx
from mailloom.functions import lookalikes as la
from mailloom.functions import masking as mk
from mailloom.functions import text as tx
from mailloom.operators import dedup, generation, heads, metrics, records, sampling, tfidf
from mailloom.plans import flows
from mailloom.sources import html, mail, sinks
from mailloom.streaming import ingest


def one(spark, expr, value=None, **more):
    df = spark.createDataFrame([(value, *more.values())], ", ".join(f"{c} string" for c in ("s", *more)))
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("hi\n-----Original Message-----\nold", "hi"),
        ("hi\n---------- Forwarded by X on", "hi"),
        ("a\n--- Begin Forwarded Message ---\nb", "a"),
        ("a\nOn Mon, Jan 1, 2001 at 12:00, Jane wrote:\n> q", "a"),
        ("top\n> quoted", "top"),
        ("top\n_____\nfoot", "top"),
        ("x\n From: a@b.c", "x"),
        ("x\nFrom: John Doe\nSent: today", "x"),
        ("x transcript of session follows", "x"),
        ("x\nTo: someone\ncc: other", "x"),
        ("x Original Message Excluded: y", "x"),
        ("x Possibly truncated original message follows", "x"),
        ("x --- Inline attachment follows ---", "x"),
        ("x\nForwarded-by: z", "x"),
        ("x\nBob wrote on 1/2", "x"),
        ("x *** ATTENTION *** y", "x"),
        ("> all quoted", ""),
        ("  plain \n", "plain"),
        (None, ""),
    ],
)
def test_slice(spark, body, want):
    assert one(spark, tx.slice_thread(F.col("s")), body) == want


@pytest.mark.parametrize(
    ("rule", "s", "want"),
    [
        ("email", "to a.b@c.org.", "to [EMAIL_ADDRESS]."),
        ("url", "see https://x.y/z?a=1).", "see [URL])."),
        ("bare_url", "at evil.ru/pay, now", "at [URL], now"),
        ("ip", "host 10.0.0.1 up", "host [IP_ADDRESS] up"),
        ("windows_path", r"in C:\tmp\a.txt now", "in [FILE_PATH] now"),
        ("unix_path", "run /usr/local/a.sh now", "run [FILE_PATH] now"),
        ("file_name", "read report.pdf now", "read [FILE_NAME] now"),
        ("file_label", "file: x1 y", "[FILE] y"),
        ("card", "pay 1234 5678 9012 3456 now", "pay [FINANCIAL_INFO]now"),
        ("iban", "to DE44500105175407324931.", "to [FINANCIAL_INFO]."),
        ("reference", "see TKT-99887766", "see [REFERENCE_NUMBER]"),
        ("phone", "call +1-800-555-0199 now", "call [PHONE_NUMBER] now"),
        ("username", "hi @bob_1!", "hi [USERNAME]!"),
        ("initials", "by J.R.R. T", "by [INITIALS] T"),
        ("placeholder_name", "Dear [receiver]", "Dear [NAME]"),
        ("placeholder_link", "go [ACTION_LINK]", "go [URL]"),
        ("symbol_line", "a\n=====\nb", "a\n[SYMBOL]\nb"),
        ("emoji", "a 😀😀 b", "a [EMOJI] b"),
        ("pgp_signature", "-----BEGIN PGP SIGNATURE-----\nx\n-----END PGP SIGNATURE-----", "[PGP]"),
        ("pgp_block", "-----BEGIN PGP MESSAGE-----\nx\n-----END PGP MESSAGE-----", "[PGP]"),
        ("pgp_signed", "-----BEGIN PGP SIGNED MESSAGE-----\nHash: SHA1\nhi", "[PGP]\n\nhi"),
    ],
)
def test_mask_rule(spark, rule, s, want):
    assert one(spark, mk.mask_one(F.col("s"), rule), s) == want


def test_mask_chain_keeps_tokens(spark):
    s = "mail a@b.org http://x.y 10.0.0.1 [SENDER]"
    first = one(spark, mk.mask(F.col("s")), s)
    assert first == one(spark, mk.mask(F.col("s")), first) == "mail [EMAIL_ADDRESS] [URL] [IP_ADDRESS] [NAME]"
    assert one(spark, mk.mask(F.col("s")), None) == ""
    assert one(spark, mk.mask(F.col("s"), enabled=False), s) == s


def python_rule(name, s):
    """A rule as Python's own expressions have it."""
    import re

    _, flags, body, token = mk.RULES[mk.NAMES.index(name)]
    body = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), body)
    return re.sub(body, lambda m: token, s, flags=sum(getattr(re, f.upper()) for f in flags))


@pytest.fixture(scope="module")
def whole_bodies(spark):
    from mailloom.plans import fixtures

    extra = ["-----BEGIN PGP SIGNED MESSAGE-----\nHash: SHA1\nhi", "WWW.x.org FTP://a.b/c", "order # A1B2C3 case: 99x77", "1.2.3.4 5 ١.٢.٣.٤", "see a.zip, b.COM/x?y.", "=====\n  *****  ", "A.B. c.D.", "é@ü.de ☃️ 12 34 567 8901", "", None]
    have = fixtures.bodies(spark, "/root/testdata/sf0.001").select("doc_id", "subject", "body")
    return have.unionByName(spark.createDataFrame([(10**6 + i, "Ref: ABC-12345", t) for i, t in enumerate(extra)], have.schema)).cache()


def test_mask_chain_on_whole_texts(whole_bodies):
    rows = whole_bodies.select("body", mk.mask(F.col("body")).alias("all"), mk.mask_one(F.col("body"), "reference").alias("reference")).collect()
    changed = 0
    for r in rows:
        want = r["body"] or ""
        for name in mk.NAMES:
            want = python_rule(name, want)
        assert r["all"] == want
        assert r["reference"] == (None if r["body"] is None else python_rule("reference", r["body"]))
        changed += want != r["body"]
    assert changed > 100


def test_mask_queries_on_whole_texts(spark, whole_bodies):
    from collections import Counter
    import re

    from mailloom.plans import catalogue

    got = {r["token"]: r["n"] for r in catalogue.QUERIES["mask_token_histogram"](spark, "/root/testdata/sf0.001").collect()}
    want = Counter()
    for r in whole_bodies.filter("doc_id < 1000000").collect():
        s = r["body"]
        for name in mk.NAMES:
            s = python_rule(name, s)
        want.update(re.findall(mk.TOKEN, s))
    assert got == want and {"[PHONE_NUMBER]", "[URL]", "[FILE_PATH]"} <= set(got)


def test_entity_masks_on_whole_texts(spark, whole_bodies):
    import re

    from mailloom.plans import catalogue

    got = {r["doc_id"]: r["body"] for r in catalogue.QUERIES["mask_entities"](spark, "/root/testdata/sf0.001").collect()}
    for r in whole_bodies.filter("doc_id < 1000000").collect():
        assert got[r["doc_id"]] == mk.replace_entities(r["body"], [(m.start(1), m.end(1), "PERSON") for m in re.finditer(r"\bThe\s+(\w+)", r["body"])])


def test_normal_texts(spark, whole_bodies):
    """Normalisation, the service's chain and MIME, on whole texts against plain Python."""
    import email
    import email.policy

    from mailloom.plans import catalogue

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["subject"], r["body"]) for r in whole_bodies.filter("doc_id < 1000000").collect()}
    normal = {r["doc_id"]: r["body"] for r in catalogue.QUERIES["unicode_normal"](spark, sf).collect()}
    assert normal == {i: la.normal_text(b) for i, (_, b) in texts.items()}
    served = {r["doc_id"]: r for r in catalogue.QUERIES["serve_clean"](spark, sf).collect()}
    sliced = {r["doc_id"]: r["b"] for r in whole_bodies.select("doc_id", tx.slice_thread(F.when(tx.is_html(F.col("body")), html.clean_payload("body")).otherwise(F.col("body"))).alias("b")).collect()}
    for i, (subject, _) in texts.items():
        masked, title = la.normal_text(sliced[i]), la.normal_text(subject)
        for name in mk.NAMES:
            masked, title = python_rule(name, masked), python_rule(name, title)
        r = served[i]
        assert (r["clean_body"], r["masked_body"], r["text"]) == (sliced[i], masked, f"Subject: {title.strip()}. Body: {masked.strip()}")
    read = {r["doc_id"]: (r["subject"], r["body"]) for r in catalogue.QUERIES["mime_round_trip"](spark, sf).collect()}
    parsed = {r["doc_id"]: r for r in catalogue.QUERIES["mime_parse"](spark, sf).collect()}
    for i, (subject, body) in texts.items():
        m = email.message_from_bytes(mail.build_message(str(i), subject, body), policy=email.policy.default)
        assert read[i] == (" ".join(subject.split()), m.get_content()) and read[i][1].split() == body.split()
        assert (parsed[i]["subject"], parsed[i]["content_types"], parsed[i]["attachment_count"], parsed[i]["parse_error"]) == (" ".join(subject.split()), ["text/plain"], 0, None)
        if body.isascii():  # text that a string holds beyond ASCII is escaped, as Python's parser has it
            assert parsed[i]["plain"].split() == body.split()


def test_pages_parsed(spark):
    from mailloom.plans import catalogue

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = {r["page_id"]: r["body"] for r in catalogue.QUERIES["html_text_parsed"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: html.clean(h) for i, h in pages.items()}
    assert html.clean("<p>a</p><style>x{}</style><p>b<br>c") == "a\nb\nc"


def test_quantiles(spark):
    import random

    import numpy as np

    r = random.Random(1)
    rows = [(g, r.choice([r.gauss(0, 10), r.expovariate(0.001), 0.0, -3.5, 7.0, 1e-30, 1e18])) for g in "ab" for _ in range(400)] + [("c", 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {x["g"]: x for x in metrics.quantiles(df, "x", {"q0": 0.0, "q5": 0.5, "q95": 0.95, "q1": 1.0}, ["g"]).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, x in got.items():
        want = np.quantile([v for k, v in rows if k == g and v is not None], [0, 0.5, 0.95, 1])
        assert np.allclose([x["q0"], x["q5"], x["q95"], x["q1"]], want, rtol=1e-12)
    assert metrics.latency_stats(df.limit(0).withColumnRenamed("x", "latency_ms")).first().asDict() == {"mean_ms": 0.0, "median_ms": 0.0, "p95_ms": 0.0, "per_second": 0.0}


def test_ngrams(spark):
    s = "a bb  c a é日x"
    words = ["a", "bb", "c", "a", "é日x"]
    assert one(spark, tfidf.word_ngrams(F.col("s")), s) == words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    assert one(spark, tfidf.char_ngrams(F.col("s")), s) == [s[i : i + n] for n in (3, 4, 5) for i in range(len(s) - n + 1)]
    for short in ("", "a", None):
        assert one(spark, tfidf.char_ngrams(F.col("s")), short) == [] and one(spark, tfidf.word_ngrams(F.col("s")), short) == ([short] if short else [])


def test_entities():
    assert mk.replace_entities("Bob saw [URL] in Rome", [(0, 3, "PERSON"), (8, 13, "ORG"), (17, 21, "GPE"), (4, 7, "XX")]) == "[NAME] saw [URL] in [ADDRESS]"


@pytest.mark.parametrize("s", ["Returned mail: x", "Delivery Status Notification (Failure)", "Undeliverable: y", "Automatic reply: z", "Out of the Office", "NDR: q", "Undelivered Mail Returned", "Message status - failed", "Mail delivery failed"])
def test_bounce(spark, s):
    assert one(spark, tx.is_bounce(F.col("s")), s)
    assert not one(spark, tx.is_bounce(F.col("s")), "hello")


def test_text(spark):
    assert one(spark, tx.normalise_space(F.col("s")), " a  \r\nb\n\n\n\nc ") == "a\nb\n\nc"
    assert one(spark, tx.strip_from_line(F.col("s")), "From x\nbody") == "body"
    assert one(spark, tx.one_line(F.col("s")), " a\r\n\tb ") == "a b"
    assert one(spark, tx.is_html(F.col("s")), "a <BR> b") and not one(spark, tx.is_html(F.col("s")), "a < b")


def test_lookalikes(spark):
    assert la.normal_text("pаypаl \u200b\u00a0Ж ﬁ") == "paypal  ZH fi"
    assert la.normal_text("ԱաՒւ") == "AaUu" and la.normal_text("\u0460") == "O" and la.normal_text("") == ""
    assert one(spark, la.replace_lookalikes(F.col("s")), "ЖыЮ") == "ZHblIO"


def test_features(spark):
    assert one(spark, fx.address(F.col("s")), "A B <X@Y.Z>") == "x@y.z"
    assert one(spark, fx.address_domain(F.col("s")), "nobody") == ""
    assert one(spark, fx.urls(F.col("s")), "b www.b.c. http://a.b/c), http://a.b/c") == ["http://a.b/c", "www.b.c"]
    assert one(spark, fx.subdomains(F.col("s")), "http://sub.domain.co.uk/p") == 2
    assert one(spark, fx.subdomains(F.col("s")), "http://10.0.0.1/p") == 0
    assert one(spark, fx.model_hash_column(F.col("s")), "some-model") == fx.model_hash("some-model")
    assert fx.guess_language("short") == "unknown" and fx.guess_language("der Hund und die Katze ist auf dem Dach") == "de"


def test_html():
    assert html.clean("<html><head><title>T</title></head><body><p>a &amp; b</p><script>x</script></body></html>") == "a & b"
    assert html.clean(None) == "" and html.clean("plain  \ntext") == "plain\ntext"


RAW = b"From: A <a@b.org>\nTo: c@d.org\nSubject: =?utf-8?q?h=C3=A9?=\nDate: today\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nhello\n--B\nContent-Type: text/html\n\n<p>hi</p>\n--B\nContent-Type: image/png; name=x.png\nContent-Disposition: inline; filename=x.png\n\nzz\n--B--\n"


def test_mime():
    m = mail.parse_message(RAW)
    assert (m["subject"], m["plain"].strip(), m["html"].strip(), m["attachment_count"], m["attachment_types"]) == ("hé", "hello", "<p>hi</p>", 1, ["image/png"])
    assert mail.service_parse(RAW)[1].strip() == "hello"
    assert mail.service_parse(mail.build_message("1", "a\nb", "text"))[0] == "a b"


def test_mbox_scan(spark, tmp_path):
    for name in ("phishing0.mbox", "box-2021.mbox", "box-2023.mbox", "a-b-2023.mbox"):
        (tmp_path / name).write_bytes(b"From x\nSubject: a\n\none\nFrom y\nSubject: b\n\ntwo\n")
    got = mail.mbox(spark, str(tmp_path), last_year=2022)
    assert got.count() == 6 and got.filter("ordinal = 1").count() == 3


def split_mbox(content):
    """Messages of a mailbox file in one pass: each begins with a line ``From ``, which isn't part of it."""
    starts = [m.start() for m in re.finditer(rb"^From ", content, re.MULTILINE)]
    for a, b in zip(starts, [*starts[1:], len(content)], strict=bool(starts)):
        body = content[a:b]
        yield body[body.find(b"\n") + 1 :] if b"\n" in body else b""


def awkward_boxes():
    r = random.Random(3)
    pieces = [b"From a\n", b"From ", b"\n", b"text line\n", b">From q\n", b"\xff\xfe\n", "wörld 日\r\n".encode(), b"FromX\n", b" From y\n", b"Subject: s\n\n"]
    yield b"preamble\n\nFrom x\nSubject: a\n\none\n\nFrom y\nb"
    yield b"From only the line\n"
    yield b"no message\n"
    for _ in range(25):
        yield b"".join(r.choice(pieces) for _ in range(r.randrange(300))) + b"end"


@pytest.mark.parametrize("split", [64, 1000, 1 << 27])
def test_mbox_in_splits(spark, tmp_path, split):
    """More tasks than files; the messages and their numbers are those of one pass over each file's bytes."""
    want = set()
    for k, content in enumerate(awkward_boxes()):
        (tmp_path / f"b{k}.mbox").write_bytes(content)
        want |= {(f"b{k}.mbox", i, m) for i, m in enumerate(split_mbox(content))}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        df = mail.mbox(spark, str(tmp_path))
        got = [(r["path"].rsplit("/", 1)[1], r["ordinal"], bytes(r["raw"])) for r in df.collect()]
        if split < 1000:
            assert spark.read.option("lineSep", mail.FROM_LINE).text(str(tmp_path)).rdd.getNumPartitions() > len(list(tmp_path.iterdir()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(want) and set(got) == want


def test_mbox_years_are_not_opened(spark, tmp_path):
    for name in ("box-2021.mbox", "box-2023.mbox"):
        (tmp_path / name).write_bytes(b"From x\nS: a\n\none\n")
    df = mail.mbox(spark, str(tmp_path), last_year=2022)
    assert df.count() == 1 and "box-2021" in df.first()["path"]
    assert len(df.inputFiles()) == 2 and "file_name" in df._jdf.queryExecution().executedPlan().toString()


def test_seed_rows(spark, tmp_path):
    """Positions are places among the records, whatever blank lines and ids of their own stand between them."""
    (tmp_path / "s.jsonl").write_text("\n".join(["", '{"subject": "a"}', " ", '{"id": "own", "subject": "b"}', *('{"subject": "c%d"}' % k for k in range(9000)), ""]))
    got = sorted((r["position"], r["id"], r["subject"]) for r in mail.seed_rows(spark, str(tmp_path / "s.jsonl")).collect())
    assert [g[0] for g in got] == list(range(9002)) and got[:3] == [(0, "s_1", "a"), (1, "own", "b"), (2, "s_4", "c0")] and got[-1][2] == "c8999"


def test_labelled_and_indexed(spark, tmp_path):
    md5 = "0" * 32
    for folder, name in (("spam", f"0001.{md5}"), ("easy_ham", "0001." + "1" * 32), ("hard_ham", f"0002.{md5}"), ("other", "0003.x")):
        (tmp_path / "l" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "l" / folder / name).write_text("Subject: s\n\nbody")
    assert mail.labelled_folders(spark, str(tmp_path / "l")).count() == 2
    assert mail.labelled_folders(spark, str(tmp_path / "l"), "stem").count() == 2
    (tmp_path / "data").mkdir()
    for i in (1, 2, 3):
        (tmp_path / "data" / f"inmail.{i}").write_text("Subject: s\n\nbody")
    (tmp_path / "index").write_text("spam ../data/inmail.1\nHAM ../data/inmail.2\nbad line here\njunk ../data/inmail.3\n")
    got = {r["path"].rpartition("/")[2]: r["label"] for r in mail.indexed(spark, str(tmp_path / "data"), str(tmp_path / "index")).collect()}
    assert got == {"inmail.1": 1, "inmail.2": 0}


def test_preprocess(spark, tmp_path):
    body = "This is a body that is surely long enough to be kept by the filter on length."
    for k, (subject, text) in enumerate([("ok", body), ("ok", body), ("Returned mail: x", body), ("short", "tiny"), ("auto", "This message was automatically generated " + body), ("html", f"<html><body><p>{body}</p></body></html>")]):
        (tmp_path / f"{k}").write_text(f"From: a@b.org\nTo: c@d.org\nSubject: {subject}\n\n{text}")
    kept, counts = flows.preprocess(spark, flows.Config({"enron": {"enabled": True, "path": str(tmp_path)}, "trec": {}}, masking=True))
    assert kept.count() == 2 and kept.columns == records.RECORD.names
    assert {r["status"]: r["n"] for r in counts.collect()} == {"kept": 3, "bounce": 1, "short": 1, "system": 1}
    with pytest.raises(ValueError):
        flows.scan(spark, "nope", "x")
    sinks.write_by_label(kept, str(tmp_path / "out"), "overwrite")
    assert mail.json_lines(spark, str(tmp_path / "out")).count() == 2


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"subject": null, "body": "b", "label": 1, "source": "s"}\n\nbad\n{"body": "c", "label": 0, "source": "s", "extra": 1}\n')
    assert mail.json_lines(spark, str(tmp_path)).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        mail.json_lines(spark, str(tmp_path), strict=True).collect()


def test_cohort_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"subject": "a", "body": "b", "k": 1}\n\n{"id": "x", "body": "c"}\n')
    got = {r["id"]: r["text"] for r in mail.cohort_lines(spark, str(tmp_path / "c.jsonl"), 0).collect()}
    assert got == {"c_0": "Subject: a. Body: b", "x": "Subject: . Body: c"}


def test_records(spark):
    df = spark.createDataFrame([("s", "b", 0), ("s", " ", 0), ("", "b", 1), ("s", "b", 2), (None, None, None)], "source string, body string, label int")
    assert records.validation_counts(df).first().asDict() == {"valid": 1, "invalid": 4, "total": 5}
    assert records.exported(df.withColumn("subject", F.lit("")), "custom", compat=True).columns == [*df.columns, "subject"]
    assert records.exported(df, "custom").columns == ["label"]


def test_dedup_idempotent(spark):
    df = spark.createDataFrame([(1, "a", "bc", "x"), (2, "ab", "c", "x"), (3, "a", "bc", "y")], "doc_id long, subject string, body string, source string")
    first = dedup.by_fingerprint(df)
    assert sorted(r["doc_id"] for r in first.collect()) == [1, 3] == sorted(r["doc_id"] for r in dedup.by_fingerprint(first).collect())


def test_sampling(spark):
    assert sampling.quotas(10, ["a", "b", "c"]) == {"a": 4, "b": 3, "c": 3} and sampling.quotas(10, ["a", "b", "c"], False) == {"a": 3, "b": 3, "c": 3}
    long, short = sampling.pool_positions(100, 20, "m"), sampling.pool_positions(100, 10, "m")
    assert long[: len(short)] == short
    assert sampling.exact_sample(3, 5, 1) == [0, 1, 2] and len(set(sampling.exact_sample(100, 10, 1))) == 10
    df = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("g"))
    n = {r["split"]: r["count"] for r in sampling.stratified_split(df, "g").groupBy("split").count().collect()}
    assert n == {"train": 80, "val": 10, "test": 10}


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 3), (3, 3)], "y_true int, y_pred int")
    assert metrics.summary(df).first()["accuracy"] == 0.75
    b = metrics.binary_metrics(df).first()
    assert (b["tp"], b["fp"], b["tn"], b["fn"], b["fpr"]) == (2, 1, 1, 0, 0.5)
    assert [tuple(r) for r in metrics.confusion_matrix(df).orderBy("y_true").collect()] == [(0, 1, 0, 0, 0), (1, 0, 1, 0, 0), (2, 0, 0, 0, 1), (3, 0, 0, 0, 1)]


class Fake:
    def __init__(self):
        self.calls = 0

    def complete(self, system, user):
        self.calls += 1
        if self.calls == 1:
            raise generation.Retry(after=0)
        n = user.count("--- Email ")
        rows = [{"subject": "s", "body": f"b{i}"} for i in range(n if self.calls != 3 else n - 1)]
        return "Sure:\n```json\n" + json.dumps(rows) + "\n```"


def test_records_of_generated_rows(spark):
    row = {"subject": "Hi", "body": "see http://a.b.example.com/x, or www.c.org. " + "the and of " * 5}
    r = generation.enriched(row, "m", 1, 4, 42)
    df = spark.createDataFrame([(r["body"],)], "body string").withColumn("urls", fx.urls(F.col("body")))
    same = df.select("urls", *(c.alias(k) for k, c in fx.url_metrics(F.col("urls")).items()), fx.language_native(F.col("body")).alias("language")).first().asDict()
    assert {k: r[k] for k in same} == same and set(r) == set(records.RECORD.names)
    assert generation.enriched({"subject": " ", "body": "x"}, "m", 1, 0, 1) is None and generation.enriched("x", "m", 1, 0, 1) is None and generation.enriched(row, "m", 2, 0, 1) is None
    want = {"source": "m", "label": 1}
    assert generation.parsed_record(want) == generation.parsed_record(json.dumps(want)) == generation.parsed_record("source: m\nlabel: 1") == generation.parsed_record("{'source': 'm', 'label': 1,}") == want
    with pytest.raises(ValueError):
        generation.parsed_record("[1, 2]")
    with pytest.raises(TypeError):
        generation.parsed_record(3)
    made = {(k, v): generation.prompt(k, [row, {"subject": None, "body": "x" * 2000}], v) for k in ("benign", "phishing") for v in generation.VERSIONS}
    assert len({u for _, u in made.values()}) == 4 and len({s for s, _ in made.values()}) == 2
    for (kind, version), (_, user) in made.items():
        assert "exactly 2 objects" in user and user.endswith("--- Email 2 ---\nSubject: \n\n" + "x" * 1500) and "--- Email 1 ---\nSubject: Hi\n\nsee" in user
        assert ("[URL]" in user) == (version == "v3") and ("[ACTION_LINK]" in user) == ((kind, version) == ("phishing", "v2")) and "[SENDER]" in user
    for bad in (("x", "v2"), ("benign", "v9")):
        with pytest.raises(ValueError):
            generation.prompt(bad[0], [row], bad[1])


def test_semantic(spark, tmp_path):
    from mailloom.operators import semantic

    rows = [(i, f"{w} {w} number{i}", c) for c, w in enumerate(["alpha", "bravo", "charlie", "delta"]) for i in range(20)] + [(99, None, 0)]
    df = spark.createDataFrame(rows, "doc_id int, text string, label int")
    e = semantic.as_vectors(semantic.embed(df, semantic.hashed_encoder(64)))
    assert all(abs(r["sem"].norm(2) - 1) < 1e-6 for r in e.filter("text is not null").collect()) and e.filter("text is null").first()["sem"].norm(2) == 0
    model = semantic.fit(e.filter("text is not null"))
    got = semantic.probabilities(e, model).filter("text is not null").collect()
    assert all(max(range(4), key=r["probs"].__getitem__) == r["label"] and abs(sum(r["probs"]) - 1) < 1e-9 for r in got)
    both = tfidf.Stylometric(20, 20).fit(df, "text").transform(e, "text", "stylo")
    sizes = {mode: flows.with_features(both, mode).first()["features"].size for mode in ("fusion", "semantic", "stylometric")}
    assert sizes["semantic"] == 64 and sizes["fusion"] == 64 + sizes["stylometric"]
    with pytest.raises(ValueError):
        flows.features_for("other")
    for n in (5, 40, 7):
        (tmp_path / f"checkpoint-{n}").mkdir()
    assert semantic.latest_checkpoint(spark, str(tmp_path)).endswith("checkpoint-40") and semantic.latest_checkpoint(spark, str(tmp_path / "no")) is None
    scores = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9), (4, None)], "step int, macro_f1 double")
    assert semantic.best_checkpoint(scores).first()["step"] == 2


@pytest.mark.parametrize("name", ["logistic", "mlp", "rf"])
def test_portable_heads(spark, name):
    """What an ONNX file gives is what the head gives."""
    import random

    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    from mailloom.operators import portable

    r = random.Random(2)
    df = spark.createDataFrame([(Vectors.dense([round(c + r.gauss(0, 0.8), 3) if k == 0 else round(r.gauss(0, 1), 3) for k in range(5)]), c) for c in range(4) for _ in range(40)], ["features", "label"])
    model = heads.train(df, name, **{"rf": {"numTrees": 7, "maxDepth": 6}, "mlp": {"layers": (8, 6), "maxIter": 20}}.get(name, {}))
    both = portable.score(model.transform(df), portable.to_onnx(model), out="onnx").select(vector_to_array("probability").alias("a"), "onnx").collect()
    assert len(both) == 160 and all(abs(x - y) < 1e-4 for b in both for x, y in zip(b["a"], b["onnx"], strict=True))
    with pytest.raises(ValueError):
        portable.to_onnx(object())


def test_counts_of_lines(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "x")], "k string, v string")
    assert sinks.write_json_lines(df, str(tmp_path / "o")) == 2 and sinks.write_json_lines(df.limit(0), str(tmp_path / "e")) == 0
    (tmp_path / "f.jsonl").write_text("{}\n\n{}\n")
    assert mail.count_lines(spark, str(tmp_path / "f.jsonl")) == 2 and mail.count_lines(spark, str(tmp_path / "no.jsonl")) == 0


def test_atomic_batches(spark, tmp_path):
    rows = [{"source": m, "seed_idx": i, "body": "b", "is_valid": not (m == "x" and i == 3)} for m in "xy" for i in range(6)] + [{"source": "z", "seed_idx": 0, "body": "b"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    stream = spark.readStream.schema("source string, seed_idx int, body string, is_valid boolean").json(str(tmp_path / "in"))
    ingest.atomic_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"), batch=2).awaitTermination()
    got = sorted((r["source"], r["seed_idx"]) for r in spark.read.json(str(tmp_path / "out")).collect())
    assert got == [("x", 0), ("x", 1), ("x", 4), ("x", 5)] + [("y", i) for i in range(6)]
    ingest.atomic_batches(stream, str(tmp_path / "out2"), str(tmp_path / "cp2")).awaitTermination()
    assert not (tmp_path / "out2").exists()


def test_http_provider():
    """Both forms against a server of our own; it is busy first, then answers, and refuses a wrong key."""
    import threading
    import urllib.error
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            code = 401 if "bad" in (self.headers.get("Authorization") or "") else 429 if len(seen) == 1 else 200
            text = json.dumps([{"subject": "s", "body": "b"}])
            answer = {"choices": [{"message": {"content": text}}]} if "system" not in body else {"content": [{"type": "text", "text": text}]}
            self.send_response(code)
            self.send_header("Retry-After", "0.5")
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url, waits = f"http://127.0.0.1:{server.server_port}/", []
        for form in ("chat", "messages"):
            client = generation.provider("http", url=url, model="m", key="k", form=form)
            reply = generation.with_retries(lambda c=client: c.complete("sys", "user"), sleep=waits.append)
            assert generation.objects_in(reply) == [{"subject": "s", "body": "b"}]
        assert waits == [0.5] and seen[-1]["system"] == "sys" and [x["role"] for x in seen[1]["messages"]] == ["system", "user"]
        with pytest.raises(urllib.error.HTTPError):
            generation.HttpChat(url, "m", "bad").complete("s", "u")
    finally:
        server.shutdown()
    with pytest.raises(generation.Retry):
        generation.HttpChat(url, "m", timeout=0.5).complete("s", "u")


def test_generation():
    client = Fake()
    batches = list(generation.generate(generation.Job("m", 20, batch=5), [{"subject": "a", "body": "b"}] * 7, client, 1, sleep=lambda s: None))
    assert sum(map(len, batches)) == 20 and {len(b) for b in batches} == {5}
    assert generation.objects_in('{"subject": "a", "body": "b"}') == [{"subject": "a", "body": "b"}] and generation.objects_in("none") is None
    assert generation.api_key(None, "c", "X") == "c"
    with pytest.raises(TypeError):
        generation.register_provider("bad", object)


def test_heads(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense([float(c == k) + 0.01 * i for k in range(4)]), c) for c in range(4) for i in range(10)], "features vector, label int") if False else spark.createDataFrame([(Vectors.dense([float(c == k) + 0.01 * i for k in range(4)]), c) for c in range(4) for i in range(10)], ["features", "label"])
    got = heads.compare(df, df, ["logistic", "rf"], {"rf": {"numTrees": 5, "maxDepth": 4}})
    rows = got.collect()
    assert {r["head"]: r["accuracy"] for r in rows} == {"logistic": 1.0, "rf": 1.0} and all(r["model_bytes"] > 0 and 0 < r["median_s"] <= r["slowest_s"] for r in rows)
    with pytest.raises(ValueError):
        heads.head("nope", 3)
    split = df.withColumn("text", F.lit("t")).withColumn("split", F.when(F.monotonically_increasing_id() % 5 == 0, "val").otherwise("train"))
    model = heads.train(split, "gbt", "split = 'val'", maxIter=30, maxDepth=2)
    noise = heads.train(split.withColumn("label", (F.monotonically_increasing_id() * 7 % 11 % 4).cast("int")), "gbt", "split = 'val'", maxIter=30, maxDepth=2)
    assert min(m.getNumTrees for m in noise.models) < 30  # nothing gets better on held rows
    out = flows.predict(split, model).collect()
    assert all(r["predicted_class"] == r["label"] and abs(sum(r["probabilities"].values()) - 1) < 1e-9 for r in out)
    assert heads.train(split, "logistic", "split = 'val'").transform(df).filter("label = prediction").count() == 40


def test_stylometric(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "")], "doc_id long, text string")
    with pytest.raises(RuntimeError):
        tfidf.Stylometric().transform(df)
    model = tfidf.Stylometric(10, 10).fit(df)
    model.save(str(tmp_path / "m"))
    for m in (model, tfidf.Stylometric.load(spark, str(tmp_path / "m"))):
        v = {r["doc_id"]: r["stylo"] for r in m.transform(df).collect()}
        assert v[3].numNonzeros() == 0 and abs(v[1].norm(2) - 2**0.5) < 1e-9


def test_mask_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    row = {"subject": "s", "body": "mail a@b.org", "label": 1, "source": "x"}
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(row) + "\n")
        ingest.mask_stream(spark, src, out, cp).awaitTermination()
        got = spark.read.json(out)
        assert got.count() == k + 1 and got.first()["body"] == "mail [EMAIL_ADDRESS]"


def test_event_windows(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id*20) AS ts, 'a' AS event_type, id AS user_id, 1.0 AS value FROM range(6)").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "e")).schema).parquet(str(tmp_path / "e"))
    q = ingest.windowed_events(stream).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("w").collect()) == [3, 3]


def test_training_is_not_reduced(spark, monkeypatch):
    from mailloom.plans import catalogue, training

    t = training.Training()
    assert (t.word_terms, t.char_terms) == (tfidf.MAX_TERMS, tfidf.MAX_TERMS)
    given = []

    def train(df, name, **parameters):
        given.append((name, parameters))
        raise InterruptedError

    monkeypatch.setattr(heads, "train", train)
    rows = spark.createDataFrame([(0, [0.0])], "vec_id long, features array<double>").selectExpr("*", "'train' as split")
    monkeypatch.setattr(catalogue, "_vectors", lambda spark, d: rows)
    for name in ("head_logistic", "head_random_forest"):
        with pytest.raises(InterruptedError):
            catalogue.QUERIES[name](spark, "")
    assert given == [("logistic", {}), ("rf", {})]


def test_pool_is_drawn_from_all_documents(spark, tmp_path):
    from mailloom.plans import catalogue

    langs = ["de", "en", "fr"]
    spark.createDataFrame([(3 * i, langs[i % 3], "src0") for i in range(50)], "doc_id long, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(m, k): 3 * p for m, quota in (("m-one", 7004), ("m-two", 7003)) for k, p in enumerate(sampling.pool_positions(50, quota, m))}
    got = {(r["model"], r["seed_idx"]): r["doc_id"] for r in catalogue.QUERIES["seed_pool_lookup"](spark, str(tmp_path)).collect()}
    assert got == want
    traced = sorted((r["source"], r["seed_doc_id"]) for r in catalogue.QUERIES["trace_join"](spark, str(tmp_path)).collect())
    assert traced == sorted((m, d) for (m, _), d in want.items())
