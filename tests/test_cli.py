"""The command line from files to files."""

import json

import pytest

from mailloom.__main__ import main
from mailloom.sources import runs


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def record(k, label=1):
    return {"subject": f"s{k}", "body": f"mail a{k}@b.org about it", "label": label, "source": "x"}


def test_validate_mask_stats(spark, tmp_path, capsys):
    good = lines(tmp_path / "g.jsonl", [record(k) for k in range(3)])
    assert main(["validate", "--input", good]) == 0
    assert main(["validate", "--input", lines(tmp_path / "b.jsonl", [record(1), record(2, 7)])]) == 1
    assert main(["mask", "--input", good, "--out", str(tmp_path / "m")]) == 0
    assert {r["body"] for r in spark.read.json(str(tmp_path / "m")).collect()} == {"mail [EMAIL_ADDRESS] about it"}
    assert main(["stats", "--input", good]) == 0 and "unknown" not in capsys.readouterr().out


def test_preprocess(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1").write_text("From: a@b.org\nSubject: s\n\n" + "A body that is long enough to be kept by the filter. " * 2)
    (tmp_path / "c.yaml").write_text(f"sources:\n  enron:\n    enabled: true\n    path: {tmp_path}/in\nout: {tmp_path}/out\n")
    assert main(["preprocess", "--config", str(tmp_path / "c.yaml")]) == 0
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    for _ in range(2):  # a run again replaces itself
        assert main(["preprocess", "--config", str(tmp_path / "c.yaml"), "--out", str(tmp_path / "runs"), "--run-name", "r1"]) == 0
    assert runs.read_runs(spark, str(tmp_path / "runs")).count() == 1
    with pytest.raises(FileNotFoundError):
        main(["preprocess", "--config", "nope.yaml"])


def http(spark, stylo, head):
    """The server's answers and refusals."""
    import threading
    import urllib.error
    import urllib.request

    from pyspark.ml import PipelineModel

    from mailloom import serving
    from mailloom.operators.tfidf import Stylometric

    blocks, service = Stylometric.load(spark, stylo), serving.Service(spark)
    server = serving.server(service, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, data=None):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/api/v1/{path}", data) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as x:
            return x.code, json.load(x)

    try:
        assert ask("health")[1]["status"] == "initializing" and ask("predict", b'{"body": "x"}')[0] == ask("predict/raw", b"x")[0] == 503
        service.modes["stylometric"] = (lambda df: blocks.transform(df, "text", "features"), PipelineModel.load(head))
        assert ask("health")[1] == {"status": "healthy", "version": "1.0.0", "classifier": "rf", "device": "cpu", "available_modes": ["stylometric"], "models_loaded": {"fusion": False, "semantic": False, "stylometric": True}}
        status, got = ask("predict", json.dumps({"subject": "bravo", "body": "bravo <b>text</b> 1 http://a.b/c"}).encode())
        assert status == 200 and got["prediction"] == "Human Phishing" and got["is_phishing"] and not got["is_llm_generated"] and abs(sum(got["confidence_scores"].values()) - 1) < 1e-6
        assert got["metadata"]["html_stripped"] and got["metadata"]["detected_urls"] == 1 and got["phishing_probability"] > 0.5
        assert ask("predict/raw", b"Subject: charlie\n\ncharlie text 2")[1]["prediction"] == "LLM Benign"
        assert [ask("predict", b"{}")[0], ask("predict", b"[")[0], ask("predict?mode=fusion", b'{"body": "x"}')[0], ask("predict/raw", b"")[0], ask("other")[0]] == [422, 422, 422, 400, 404]
        service.modes["stylometric"] = (None, None)
        assert ask("predict", b'{"body": "x"}')[0] == 500
    finally:
        server.shutdown()


def test_train_predict(spark, tmp_path, capsys):
    words = ["alpha", "bravo", "charlie", "delta"]
    files = [lines(tmp_path / f"c{c}.jsonl", [{"subject": words[c], "body": f"{words[c]} text {k}"} for k in range(20)]) for c in range(4)]
    for mode in ("fusion",):
        t = tmp_path / mode
        assert main(["train", "--mode", mode, "--size", "6", "--cohorts", *files, "--head", "logistic", "--out", str(t)]) == 0
        assert json.loads(capsys.readouterr().out.splitlines()[-1])["accuracy"] == 1.0
        stylo, dense, head = (next(str(p) for p in t.iterdir() if p.name.startswith(n)) for n in ("stylo", "latent", "head"))
        args = ["predict", "--mode", mode, "--input", files[3], "--stylo", stylo, "--model", head, "--out", str(t / "p")]
        assert main([*args, "--latent", dense]) == 0 and spark.read.json(str(t / "p")).filter("predicted_class = 3").count() == 20
        with pytest.raises(ValueError, match="--latent"):
            main(args)
    args = ["train", "--cohorts", *files, "--head", "logistic", "--out", str(tmp_path / "t")]
    assert main(args) == 0 and main(args) == 0  # the second run resumes
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert out[0] == out[1] and out[0]["accuracy"] == 1.0
    stylo, head = (next(str(p) for p in (tmp_path / "t").iterdir() if p.name.startswith(n)) for n in ("stylo", "head"))
    assert main(["predict", "--input", files[1], "--stylo", stylo, "--model", head, "--out", str(tmp_path / "p")]) == 0
    got = spark.read.json(str(tmp_path / "p"))
    assert got.filter("predicted_class = 1 and is_phishing").count() == 20
    models = ["--stylo", stylo, "--model", head, "--out"]
    (tmp_path / "one.json").write_text(json.dumps({"subject": "charlie", "body": "charlie text 3"}))
    (tmp_path / "plain.txt").write_text("  delta text 4\n")
    for name, want in (("one.json", 2), ("plain.txt", 3)):
        assert main(["predict", "--form", "one", "--input", str(tmp_path / name), *models, str(tmp_path / f"p-{name}")]) == 0
        assert [r["predicted_class"] for r in spark.read.json(str(tmp_path / f"p-{name}")).collect()] == [want]
    assert main(["predict", "--subject", "bravo", *models, str(tmp_path / "ps")]) == 0
    assert spark.read.json(str(tmp_path / "ps")).first()["predicted_class"] == 1
    with pytest.raises(ValueError):
        main(["predict", *models, str(tmp_path / "px")])
    (tmp_path / "inbox").mkdir()
    for k, text in enumerate(["Subject: bravo\n\nbravo text 1", "Subject:\n\n", "Subject: alpha\nContent-Type: text/html\n\n<p>alpha <b>text</b></p>"]):
        (tmp_path / "inbox" / f"{k}.eml").write_text(text)
        assert main(["serve", "--input", str(tmp_path / "inbox"), *models, str(tmp_path / "served")]) == 0
    rows = {r["id"]: r for r in spark.read.json(str(tmp_path / "served")).collect()}
    assert len(rows) == 3 and rows["0.eml"]["predicted_class"] == 1 and rows["2.eml"]["predicted_class"] == 0 and rows["1.eml"]["error"]
    with pytest.raises(ValueError):
        main(["serve", "--stylo", stylo, "--model", head])
    http(spark, stylo, head)
    assert main(["export", "--model", head, "--out", str(tmp_path / "head.onnx")]) == 0 and (tmp_path / "head.onnx").stat().st_size > 100
    assert main(["compare", "--cohorts", *files, "--head", "logistic", "--out", str(tmp_path / "t")]) == 0
    assert spark.read.json(str(tmp_path / "t" / "comparison")).first()["accuracy"] == 1.0


class Echo:
    """A provider that answers with as many messages as it is asked for; every fifth reply is short."""

    calls = 0

    def complete(self, system, user):
        Echo.calls += 1
        n = user.count("--- Email ") - (Echo.calls % 5 == 0)
        return json.dumps([{"subject": f"s{i}", "body": f"text {Echo.calls} {i}"} for i in range(n)])


def test_generate_and_trace(spark, tmp_path, capsys):
    seeds = lines(tmp_path / "seeds.jsonl", [{"subject": f"a{k}", "body": f"b{k}"} for k in range(9)])
    args = ["generate", "--seeds", seeds, "--provider", f"{Echo.__module__}:Echo", "--model", "m", "--batch", "4", "--out", str(tmp_path / "g.jsonl")]
    assert main([*args, "--samples", "12"]) == 0
    first = (tmp_path / "g.jsonl").read_text()
    assert main([*args, "--samples", "40", "--version", "v3"]) == 0  # goes on
    text = (tmp_path / "g.jsonl").read_text()
    rows = [json.loads(x) for x in text.splitlines()]
    assert text.startswith(first) and len(first.splitlines()) == 12 and len(rows) == 40 and len({r["seed_idx"] for r in rows}) == 40
    assert main(["validate", "--input", str(tmp_path / "g.jsonl")]) == 0
    assert main(["trace", "--input", str(tmp_path / "g.jsonl"), "--seeds", seeds, "--samples", "40", "--show", "100"]) == 0
    assert "seeds_" in capsys.readouterr().out


def test_trace_of_two_models(spark, tmp_path, capsys):
    """Every row of both models has the seed that it was made from, with blank lines and own ids among the seeds; a row beyond its pool is an error."""
    seeds = lines(tmp_path / "seeds.jsonl", [{"subject": f"a{k}", "body": f"b{k}", **({"id": f"own{k}"} if k % 3 == 0 else {})} for k in range(7)])
    text = (tmp_path / "seeds.jsonl").read_text().splitlines()
    (tmp_path / "seeds.jsonl").write_text("\n" + "\n\n".join(text) + "\n")
    out = tmp_path / "g.jsonl"
    for model in ("m1", "m2"):
        assert main(["generate", "--seeds", seeds, "--provider", f"{Parrot.__module__}:Parrot", "--model", model, "--batch", "4", "--samples", "20", "--out", str(out)]) == 0
    rows = [json.loads(x) for x in out.read_text().splitlines()]
    out.write_text("".join((repr(r) if k % 2 else json.dumps(r)) + "\n" for k, r in enumerate(rows)))  # Python's own form as well
    args = ["trace", "--input", str(out), "--seeds", seeds, "--out", str(tmp_path / "t")]
    assert main([*args, "--samples", "20"]) == 0
    found = {(r["source"], r["seed_idx"]): (r["subject"], r["body"]) for r in spark.read.json(str(tmp_path / "t")).collect()}
    assert found == {(r["source"], r["seed_idx"]): (r["subject"].removeprefix("re "), r["body"]) for r in rows} and len(found) == 40
    with pytest.raises(ValueError, match="m1: "):
        main([*args, "--samples", "4"])


class Parrot:
    """A provider that gives the seeds back."""

    def complete(self, system, user):
        import re

        return json.dumps([{"subject": "re " + s, "body": b} for s, b in re.findall(r"Subject: (.*)\n\n(b\d+)", user)])


def test_baseline(spark, tmp_path, capsys):
    rows = [{"record_id": "1", "y_true": 1, "reply": "Spam: True ; 9 / 5", "latency_ms": 2.0}, {"record_id": "2", "y_true": 0, "reply": "Spam: False ; 1 / 5", "latency_ms": 4.0}]
    assert main(["baseline", "--input", lines(tmp_path / "r.jsonl", rows)]) == 0
    got = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert got["accuracy"] == 1.0 and got["mean_ms"] == 3.0
