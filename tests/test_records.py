import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.__main__ import main
from corpusloom.operators import cleaning, dedup, extract
from corpusloom.plans.checkpoints import ensure_checkpoint_dir
from corpusloom.sources import jsonl, settings

LINES = ["", "{bad", "[1]", '{"text":null}', '{"text":123}', '{"text":"यह एक लंबा हिंदी वाक्य है जो ठीक है"}', '{"text":"यह एक लंबा हिंदी वाक्य है जो ठीक है"}', '{"text":"latin only text that is long enough"}', "{'text':'x'}", '{"other":1}']


def test_monolingual_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(LINES) + "\n", encoding="utf-8")
    lines = jsonl.read_lines(spark, f"{tmp_path}/in/*.jsonl", f"{tmp_path}/numbered")
    assert lines.count() == len(LINES)
    out = cleaning.clean_json(lines, "monolingual")
    assert [r.text for r in out.rows.collect()] == ["यह एक लंबा हिंदी वाक्य है जो ठीक है"]
    assert out.stats.head().asDict() == {"seen": 3, "passed": 1, "low_quality": 1, "duplicate": 1}
    jsonl.write_json(out.rows.select("text"), f"{tmp_path}/out")
    assert [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()] == [{"text": "यह एक लंबा हिंदी वाक्य है जो ठीक है"}]
    with pytest.raises(ValueError):
        cleaning.clean_json(lines, "unknown")


def test_instruct(spark):
    said = lambda *m: json.dumps({"messages": [{"role": r, "content": c} for r, c in m]}, ensure_ascii=False)
    rows = [said(("user", "पहला"), ("user", " दूसरा प्रश्न क्या है "), ("assistant", "यह उत्तर है जो लंबा है")), said(("user", "x"), ("assistant", "")), said(("system", "y")), said(("user", "क्या a < b है"), ("assistant", "हाँ यह सच है c > d क्योंकि"))]
    lines = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "line int, value string")
    got = {r.line: (r.instruction, r.output) for r in cleaning.clean_json(lines, "instruct").rows.collect()}
    assert got == {0: ("दूसरा प्रश्न क्या है", "यह उत्तर है जो लंबा है"), 3: ("क्या a d क्योंकि", "")}


def test_key_readers(spark):
    rows = {'{"text": null, "hi": "abcdefghijklmnopqrstu"}': (None, None, "abcdefghijklmnopqrstu"), '{"hi": "abcdefghijkl", "en": "mnopqrstuvwx"}': ("abcdefghijkl", "abcdefghijkl mnopqrstuvwx", None), '{"hi": "abcdefghijklmnopqrstuv", "en": ""}': ("abcdefghijklmnopqrstuv",) * 3, '{"instruction": "do this", "output": "done it"}': ("do this done it", "[INST] do this [/INST] done it", None), "{": (None, None, None), '{"text": "  padded ten  "}': (None, None, None)}
    df = spark.createDataFrame([(k,) for k in rows], "j string")
    got = {r.j: (r.a, r.b, r.c) for r in df.select("j", extract.tokenizer_text(F.col("j")).alias("a"), extract.training_text(F.col("j")).alias("b"), extract.evaluation_text(F.col("j")).alias("c")).collect()}
    assert got == rows


def test_prompt_files_in_any_layout(spark, tmp_path):
    records = [{"prompt": "a [1], {b}", "category": "x"}, {"other": 1}, {"prompt": "c\nd"}]
    for name, text in {"line": json.dumps(records), "pretty": "\n " + json.dumps(records, indent=2), "lines": "\n".join(map(json.dumps, records)) + "\n", "none": "[]"}.items():
        (tmp_path / name).write_text(text)
        got = [tuple(r) for r in jsonl.read_prompts(spark, f"{tmp_path}/{name}").collect()]
        assert got == ([] if name == "none" else [("a [1], {b}", "x"), ("c\nd", None)]), name


def test_prompts(spark):
    array = spark.createDataFrame([("[",), ('  {"prompt": "a", "category": "x"},',), ('{"prompt": null}',), ("]",), ("junk",), ('{"other": 1}',)], "value string")
    assert [tuple(r) for r in jsonl.prompts(array).collect()] == [("a", "x"), (None, None)]
    assert [r.prompt for r in jsonl.plain_prompts(spark.createDataFrame([(" a ",), ("\u3000",), ("b",)], "value string")).collect()] == ["a", "b"]


def test_settings():
    s = settings.resolved({"training": {"batch_size": 16, "peak": 1e-3, "zzz": 1}, "model": {"dim": 768}}, {"dim": 1024, "log_every": None}, {"peak": "learning_rate"})
    assert (s.dim, s.batch_size, s.learning_rate, s.log_every) == (1024, 16, 1e-3, 50)


def simulate(rows, shared=True):
    """One row at a time on a set of seen texts, as a sequential cleaner does."""
    seen, stats, kept = set(), dict.fromkeys(("seen", "passed", "low_quality", "duplicate"), 0), []

    def test(text, valid):
        stats["seen"] += 1
        if not valid:
            stats["low_quality"] += 1
        elif text in seen:
            stats["duplicate"] += 1
        else:
            seen.add(text)
            stats["passed"] += 1
            return True
        return False

    for i, c, h, vc, vh in rows:
        if test(c, vc) and test(h, vh):
            kept.append(i)
            stats["seen"] -= 1
            stats["passed"] -= 1
    return kept, stats


def test_parallel_against_simulation(spark):
    ensure_checkpoint_dir(spark)
    for seed in range(3):
        rng = random.Random(seed)
        valid = {t: rng.random() < 0.8 for t in "abcdefgh"}
        rows = [(i, c, h, valid[c], valid[h]) for i in range(40) for c, h in [rng.choices("abcdefgh", k=2)]]
        df = spark.createDataFrame(rows, "i int, c string, h string, valid_c boolean, valid_h boolean")
        judged = dedup.parallel_keep(df)
        kept, stats = simulate(rows)
        assert sorted(r.i for r in judged.where("kept").collect()) == kept
        assert dedup.parallel_stats(judged).head().asDict() == stats


def test_parallel_records(spark):
    ensure_checkpoint_dir(spark)
    hi, other = "यह पहला हिंदी वाक्य है दोस्त", "यह दूसरा हिंदी वाक्य है भाई"
    tr = [{"hi": hi, "en": "first one"}, {"hi": hi, "en": "again"}, {"hi": other}, {"hi": other, "en": None}, {"hi": " ", "en": "x"}, {"hi": other, "en": " kept  raw <b> "}]
    lines = spark.createDataFrame([(i, json.dumps({"translation": t}, ensure_ascii=False)) for i, t in enumerate(tr)], "line int, value string")
    shared = cleaning.clean_json(lines, "parallel")
    assert sorted((r.line, r.hi, r.en) for r in shared.rows.collect()) == [(0, hi, "first one")]
    alone = cleaning.clean_json(lines, "parallel", dedup_keys="sides")
    assert sorted((r.line, r.hi, r.en) for r in alone.rows.collect()) == [(0, hi, "first one"), (2, other, "")]


def test_command_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(LINES) + "\n", encoding="utf-8")
    got = main(["clean", "--schema", "monolingual", "--input", f"{tmp_path}/a.jsonl", "--output", f"{tmp_path}/clean"], spark)
    assert got == {"n_in": len(LINES), "n_out": 1, "seen": 3, "passed": 1, "low_quality": 1, "duplicate": 1}
    assert main(["tokenizer-corpus", "--input", f"{tmp_path}/a.jsonl", "--output", f"{tmp_path}/corpus", "--max_lines", "2"], spark) == {"written": 2}
