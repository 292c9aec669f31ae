"""Sources, sinks, settings, clients, command line and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright import cli
from tracewright.clients import http, registry
from tracewright.operators import rows as R
from tracewright.plans import replay as P
from tracewright.plans.config import BuildConfig, TrainConfig, build_config, build_config_or, load_build_config, load_env_file, load_train_config, override_from_environment
from tracewright.sinks.publish import payload_json, publish, stage_report
from tracewright.sources import questions as S
from tracewright.sources.prompts import prompt_template, prompt_versions
from tracewright.streaming import feed

RAW = {"round_id": "r", "source_dataset": "d", "hub_dataset_id": "h", "generator": {"model_id": "g"}, "decision": {"model_id": "d"}, "max_units_per_batch": 4}


def config(**more):
    return build_config(RAW | more)


def test_text_source(spark, tmp_path):
    (tmp_path / "q.txt").write_text(" one \n\n two three\n")
    c = config(source_questions_path=str(tmp_path / "q.txt"), source_limit=2)
    assert [r.question for r in S.load_questions(spark, c).orderBy("ord").collect()] == ["one", "two"]
    assert S.load_questions(spark, config(source_questions_path="/none")).count() == 0
    assert S.load_questions(spark, config()).count() == 0
    with pytest.raises(ValueError):
        S.load_questions(spark, config(source_type="ftp"))


def test_jsonl_source(spark, tmp_path):
    f = tmp_path / "q.jsonl"
    f.write_text('{"q": " a "}\n\n{"q": null}\n{"q": ""}\n{"q": 5}\n')
    c = config(source_questions_path=str(f), source_question_field="q")
    assert [r.question for r in S.load_questions(spark, c).orderBy("ord").collect()] == ["a", "None", "5"]
    f.write_text('{"x": 1}\n')
    with pytest.raises(Exception, match="missing q field"):
        S.load_questions(spark, c).collect()


def test_table_source(spark, tmp_path):
    choices = "array<struct<label:string,text:string>>"
    rows = [(0, "m", " q ", " c ", [("A", "1"), (None, None)], "secret"), (1, None, None, " ", [], "secret"), (2, "m", "z", None, None, "secret")]
    spark.createDataFrame(rows, f"ord int, input_mode string, question string, context string, choices {choices}, gold_answer string").write.parquet(str(tmp_path / "t"))
    c = config(source_type="hf_dataset", source_dataset=str(tmp_path / "t"))
    assert [r.question for r in S.load_questions(spark, c).orderBy("ord").collect()] == ["c\n\nq\n\nOptions:\n(A) 1\n(None) None", "None", "z"]
    plain = spark.createDataFrame([(1, " x "), (2, None)], "ord int, body string")
    got = S.load_questions(spark, config(source_type="hf_dataset", source_question_field="body", source_limit=-1), lambda s, c: plain)
    assert [r.question for r in got.collect()] == ["x"]
    with pytest.raises(ValueError):
        S.load_questions(spark, config(source_type="hf_dataset", source_question_field="no"), lambda s, c: plain)


def test_lines_of_large_files_keep_their_order(spark, tmp_path):
    """A file of many blocks; line ends that only Python knows, and blank lines."""
    said = [f"line {i:05d}" for i in range(3000)]
    f = tmp_path / "q.txt"
    f.write_text("".join(x + ("\u2028" if i % 7 == 0 else "\r\n" if i % 5 == 0 else "\n\n") for i, x in enumerate(said)), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = S.load_questions(spark, config(source_questions_path=f"file://{f}"))
        assert got.rdd.getNumPartitions() > 5
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.question for r in sorted(rows, key=lambda r: r.ord)] == said and len({r.ord for r in rows}) == len(said)


def test_data_sets_with_subsets_and_revisions(spark, tmp_path):
    one = spark.createDataFrame([(1, "x")], "ord int, question string")
    one.write.parquet(str(tmp_path / "d@v2/part/train"))
    c = dict(source_type="hf_dataset", source_dataset=f"file://{tmp_path}/d")
    assert S.load_questions(spark, config(**c, source_dataset_revision="v2", source_subset="part")).first().question == "x"
    for missing in ({}, {"source_dataset_revision": "v3"}, {"source_dataset_revision": "v2", "source_subset": "other"}):
        with pytest.raises(RuntimeError):
            S.load_questions(spark, config(**c, **missing))


def test_limits_with_ties(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (2, "d"), (None, "n")], "ord int, question string")
    for less in range(6):
        assert S.limited(df, -less).count() == 5 - less if less else 5
    assert {r.ord for r in S.limited(df, -2).collect()} == {None, 1, 2} and [r.ord for r in S.limited(df, -4).collect()] == [None]


def test_pick(spark):
    df = spark.createDataFrame([(5, "b"), (3, "a")], "ord int, question string")
    assert S.pick(df, 1).first().question == "b"
    for bad in (2, -1):
        with pytest.raises(RuntimeError):
            S.pick(df, bad)
    assert S.limited(df, 0).count() == 0 and S.limited(df, None).count() == 2


def test_prompts(spark, tmp_path):
    (tmp_path / "v1.txt").write_text("{question}|{{x}}|{context}")
    assert prompt_versions(tmp_path) == ["v1"]
    made = R.decision_prompt(prompt_template("v1", tmp_path), question=F.lit("{context}"), context=F.lit("c"))
    assert spark.range(1).select(made.alias("p")).first().p == "{context}|{x}|c"
    with pytest.raises(ValueError):
        R.decision_prompt("{other}", question=F.lit(""))


def test_publish(spark, tmp_path):
    rows = spark.createDataFrame([("x", "y")], "input_x string, target_y string")
    assert publish(rows, str(tmp_path / "o")) and publish(rows, str(tmp_path / "o"))
    assert S.training_rows(spark, str(tmp_path / "o")).first().completion == "y"
    assert publish(rows.limit(0), str(tmp_path / "e"), skip_empty=True) is None
    assert publish(rows, str(tmp_path / "p"), private=True, revision="r1") and (tmp_path / "p@r1").stat().st_mode & 0o77 == 0
    assert S.training_rows(spark, str(tmp_path / "p"), "r1").count() == 1
    assert json.loads(payload_json(rows.limit(0))) == {"canonical": [], "training": []}
    assert json.loads(payload_json(rows))["training"][0]["prompt"].startswith("x\n\nContinue")


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text(json.dumps(RAW))
    c = load_build_config(f)
    assert c.max_retries_per_depth == 2 and c.depths == 1 and c.unit_split_strategy == "numbered_or_lines"
    for bad in ({"round_id": ""}, {"generator": None}, {"generator": {}}, {"generation": None}, {"max_retries_per_depth": 0}, {"max_units_per_batch": 1}):
        with pytest.raises(ValueError):
            config(**bad)
    with pytest.warns(UserWarning):
        BuildConfig("r", "d", "h", {}, {})
    env = {"MAX_NEW_TOKENS": "7", "GENERATOR_MODEL": "", "SOURCE_SUBSET": "", "PRIVATE": "", "SOURCE_LIMIT": "", "ROUND_ID": "z", "MAX_PRUNING_DEPTH": "3"}
    o = override_from_environment(config(source_subset="s", source_limit=4), env)
    assert (o.generation, o.generator, o.source_subset, o.private, o.source_limit, o.round_id, o.max_pruning_depth) == ({"max_new_tokens": 7}, {"model_id": "g"}, None, True, 4, "z", 3)
    f.write_text("base_model: b\nhub_model_id: m\nhub_dataset_id: d\nreport_to: none\nmax_steps: 5\n")
    assert load_train_config(f, {"MAX_STEPS": "9"}) == TrainConfig("b", "m", "d", max_steps=9, report_to=["none"])
    assert build_config_or("/none", RAW, {"ROUND_ID": "q"}).round_id == "q" and build_config_or(None, RAW, {}).round_id == "r"
    f.write_text("# c\nexport A='1'\nB = \"2\" # why\nno\nC=3\nD=a#b c\nE=\"x\\ty\"\nF=\n=5\nG='\"'\n#H=1\n")
    load_env_file(f, env := {"C": "kept"})
    assert env == {"A": "1", "B": "2", "C": "kept", "D": "a#b c", "E": "x\ty", "F": "", "G": '"'}
    load_env_file(tmp_path / "none", env := {})
    assert env == {}


def test_rest_client(monkeypatch, tmp_path):
    (tmp_path / "p.txt").write_text("{question}/{reasoning_units}")
    monkeypatch.setenv("KEY", "k")
    seen = []
    reply = {"candidates": [{"content": {"parts": [{"text": " a"}, {}, {"text": "b "}]}}]}
    client = http.RestClient("m", "http://x", {"top_k": 1, "conservative": True, "top_p": None}, "KEY", lambda url, body: seen.append((url, body)) or reply)
    assert http.RestGenerator(client)()({"context": "c"}) == "ab"
    assert seen[0][1]["generationConfig"] == {"topK": 1} and seen[0][0].endswith("m:generateContent?key=k")
    for nothing in ({}, {"candidates": [{}]}, {"candidates": []}, {"candidates": [{"content": {"parts": None}}]}):
        assert http.RestClient("m", "http://x", {}, "KEY", lambda url, body: nothing)("p") == ""
    judge = registry.judge_from({"provider": "gemini-json", "model_id": "m", "prompt_version": "p"}, {}, str(tmp_path))
    assert judge.template and judge.client.settings["response_mime_type"] == "application/json"
    assert registry.generator_from({"model_id": "m"}, {}).max_units == 2
    with pytest.raises(ValueError):
        registry.generator_from({"provider": "no", "model_id": "m"}, {})
    with pytest.raises(ValueError):
        registry.judge_from({"provider": "no", "model_id": "m"}, {})
    with pytest.raises(RuntimeError):
        http.RestClient("m", "http://x", key_name="UNSET_KEY_NAME")("p")


def test_posting_again(monkeypatch):
    import io
    from urllib import error

    said = []

    def refused(call, timeout):
        said.append(call.full_url)
        code = 503 if len(said) < 3 else 400
        raise error.HTTPError(call.full_url, code, "no", {}, io.BytesIO(b'{"error": {"message": "busy"}}' if code == 503 else b"[1]" * 300))

    monkeypatch.setattr(http.request, "urlopen", refused)
    with pytest.raises(http.ServiceError, match="400") as problem:
        http.Post(tries=5, pause=0)("http://x?key=secret", {})
    assert len(said) == 3 and "secret" not in str(problem.value) and len(str(problem.value)) < 560
    said.clear()
    with pytest.raises(http.ServiceError, match="503: busy"):
        http.Post(tries=2, pause=0)("http://x", {})
    assert http.complaint(b'{"error": 5}') == '{"error": 5}' and http.at({"a": [1]}, "a", 3) is http.at([], "a") is None


def test_model_is_kept(monkeypatch):
    from tracewright.clients import local

    made = []
    monkeypatch.setattr(local, "Model", lambda *a: made.append(a) or local)
    local.loaded.cache_clear()
    for _ in range(3):
        local.LocalGenerator("m")(), local.LocalJudge("j", None, {}, "")()
    assert made == [("m", None, True), ("j", None, False)]
    local.loaded.cache_clear()


def test_cli(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "q.txt").write_text("one?\ntwo?\n")
    (tmp_path / "c.yaml").write_text(json.dumps(RAW | {"source_questions_path": str(tmp_path / "q.txt"), "decision": {"model_id": "d", "prompt_version": "p", "provider": "fixed"}, "generator": {"model_id": "g", "provider": "fixed"}}))
    (tmp_path / "p.txt").write_text("x")
    from tracewright.clients.replay import FixedSpanJudge, StoredTraces

    monkeypatch.setitem(registry.GENERATORS.makers, "fixed", lambda *a: StoredTraces({(0, 0, 1): "a\nb\nc", (1, 0, 1): "a\nb"}))
    monkeypatch.setitem(registry.JUDGES.makers, "fixed", lambda *a: FixedSpanJudge())
    more = ["--config", str(tmp_path / "c.yaml"), "--prompts-dir", str(tmp_path)]
    assert cli.main(["build", "--dry-run", *more], spark) == 0
    assert [r["completion"] for r in json.loads(capsys.readouterr().out)["training"]] == ["b"]
    assert cli.main(["build", "--out", str(tmp_path / "o"), *more], spark) == 0
    assert spark.read.parquet(str(tmp_path / "o/canonical/train")).count() == 1
    assert cli.main(["inspect", *more], spark) == 0
    capsys.readouterr()
    assert cli.main(["trace", "--question-index", "1", "--max-retries", "1", *more], spark) == 0
    said = capsys.readouterr().out
    assert "rejected: it has 2 units" in said and "stops at this depth" in said and "0: a" in said
    assert cli.main(["trace", "--question", "new?", *more], spark) == 0 and "new?" in capsys.readouterr().out
    assert cli.main(["trace", "--question-index", "9", *more], spark) == 1


def test_stage_report(spark, sf):
    from tracewright import queries

    lines = P.audit(queries.attempts(spark, sf), queries.CONFIG).select("status", "stopped", "row_id", stage_report().alias("r")).collect()
    assert {r.status for r in lines} == {"accepted", "rejected_no_span", "rejected_unit_count"}
    for r in lines:
        assert ("accepted as row" in r.r) == (r.status == "accepted") == (r.row_id is not None) and ("stops at this depth" in r.r) == r.stopped


def test_model_card(spark):
    card = R.model_card(F.lit("m"), {"parent": F.lit(None)}, F.create_map().cast("map<string,double>"), F.lit(None).cast("string"))
    assert spark.range(1).select(card.alias("c")).first().c == "# m\n\n## Lineage\n\n- parent: None\n\n## Evaluation Results\n\n- no evaluation metrics recorded\n\n## Acceptance Reason\n\n\n"


def test_streams(spark, sf, tmp_path):
    stored = spark.read.parquet(f"{sf}/transitions.parquet")
    stream = spark.readStream.schema(stored.schema).parquet(f"{sf}/transitions.parquet*")
    split = feed.split_stream(feed.delivered_once(stream, ["run_no", "pruning_depth"], "ingested_at", "400 days"))
    q = split.select("row_no", "units").writeStream.format("memory").queryName("split_out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("split_out").count() == stored.select("run_no", "pruning_depth").distinct().count()
    q = feed.yield_by_window(feed.split_stream(stream), "ingested_at", "30 days", "1 day").writeStream.outputMode("complete").format("memory").queryName("windows_out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows_out").agg(F.sum("rows")).first()[0] == stored.count()
    sink = feed.replay_batches(lambda b: b.select("row_no"), str(tmp_path / "b"))
    sink(stored, 0), sink(stored, 0)
    assert spark.read.parquet(str(tmp_path / "b")).count() == stored.count()
