from datetime import datetime
from itertools import product

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.functions.text import changed_lines, numbered_lines, rewrite
from tallyforge.operators import annotate
from tallyforge.sources import files
from tallyforge.streaming.events import event_stream, windowed_counts

SHEET = "pair string, reviewer int, compare_at string, label string, evidence_status string, missing_evidence string, minutes int, received_at timestamp"
T = datetime(2025, 1, 1)


def test_every_combination_has_one_case(spark):
    sides = list(product([None, "related", "non_match"], ["sufficient", "needs_review"]))
    data = []
    for i, (a, b) in enumerate(product(sides, sides)):
        data += [(f"p{i}", 1, "overall", *a, None, 1, T), (f"p{i}", 2, "overall", *b, None, 1, T)]
    cases = annotate.classify_cases(annotate.latest(spark.createDataFrame(data, SHEET))).collect()
    assert len(cases) == 36
    for c in cases:
        want = "blank" if c.label_1 is None or c.label_2 is None else "different" if c.label_1 != c.label_2 else "evidence-only" if c.status_1 != c.status_2 else "agree"
        assert c["case"] == want


def test_rules(spark, rows):
    data = [
        ("p1", 1, "Overall", "RELATED ", "Sufficient", None, 5, T), ("p1", 1, "overall", "related", "sufficient", None, 5, T),
        ("p2", 1, "metric_time__month", None, "sufficient", None, None, T), ("p2", 2, "by week", "guess", "needs_review", None, 3, T), ("p9", 1, "overall", "related", "perhaps", None, 1, T), ("p3", None, "overall", "related", "sufficient", None, 1, T),
    ]
    pairs = spark.createDataFrame([("p1", "ungrouped total"), ("p2", "metric_time__month"), ("p3", "overall")], "pair string, compare_at string")
    sheet = annotate.latest(spark.createDataFrame(data, SHEET))
    assert sheet.count() == 4
    assert rows(annotate.violations(sheet, pairs)) == sorted(
        [("p2", 1, "blank label not under review"), ("p2", 1, "minutes missing"), ("p2", 2, "unknown label"), ("p2", 2, "review without missing evidence"), ("p2", 2, "scope is not the declared one"), ("p9", 1, "unknown status"), ("p9", 1, "unknown pair"), ("p3", None, "not reviewed")],
        key=lambda t: tuple((x is not None, str(type(x)), x) for x in t),
    )
    assert rows(annotate.effort(sheet)) == [(1, 3, 6, 1), (2, 1, 3, 0)]
    empty = annotate.latest(spark.createDataFrame([], SHEET))
    assert annotate.violations(empty, pairs).count() == 3 and annotate.summarize(annotate.classify_cases(empty)).count() == 0


def test_corrections_are_appended(spark, rows):
    log = spark.createDataFrame([("p1", 1, "overall", "related", "sufficient", None, 1, T)], SHEET)
    fix = spark.createDataFrame([("p1", 1, "overall", "non_match", "sufficient", None, 1, datetime(2025, 2, 1))], SHEET)
    both = annotate.correct(log, fix)
    assert both.count() == 2 and rows(annotate.latest(both), "label") == [("non_match",)]


def test_redaction(spark):
    df = spark.createDataFrame([("From Reviewer B, b@x.org, 2025-01-02 10:00",), ("| Reviewer B | b@x.org |",), (None,)], "l string")
    assert [r[0] for r in df.select(annotate.redact(F.col("l"))).collect()] == ["From Reviewer, <e-mail>, <date>", "| Reviewer B | b@x.org |", None]


def test_lines(spark, rows):
    df = spark.createDataFrame([(1, "a NUMBER (3)\r\nb\rnumber_x\n"), (2, ""), (3, None), (4, "x")], "id int, t string")
    assert rows(numbered_lines(df, "id", "t")) == [(1, 1, "a NUMBER (3)"), (1, 2, "b"), (1, 3, "number_x"), (4, 1, "x")]
    both = df.withColumn("u", rewrite(F.col("t")))
    assert rows(changed_lines(both, "id", "t", "u")) == [(1, 1, "a NUMBER (3)", "a decimal(3)")]
    assert changed_lines(both.select("id", F.col("u").alias("t"), rewrite(F.col("u")).alias("u")), "id", "t", "u").count() == 0  # once is enough


def test_markdown(spark, rows):
    lines = spark.createDataFrame([("| Pair | Label |",), ("|---|:--:|",), ("| p1 | related |",), ("|p2||",), ("| p3 | a | b |",), ("text",), (None,)], "l string")
    assert rows(files.markdown_rows(lines, "l", ["pair", "label"])) == [(None, None, 3), ("p1", "related", 2), ("p2", None, 2)]


def test_manifest(spark, rows, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/good.txt").write_text("good")
    (tmp_path / "f/bad.txt").write_text("tampered")
    (tmp_path / "SHA256SUMS").write_text(f"{files.digest('good')}  good.txt\n{files.digest('bad')}  bad.txt\n{files.digest('x')}  gone.txt\n\n")
    got = files.verify_manifest(spark, str(tmp_path / "f"), files.sha256_manifest(spark, str(tmp_path / "SHA256SUMS")))
    assert rows(got, "file", "ok") == [("bad.txt", False), ("gone.txt", False), ("good.txt", True)]


def test_csv_and_tables(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,flag\n1,"x, ""y""",True\n2,,False\n')
    df = files.csv(spark, str(tmp_path / "a.csv"), "id int, name string, flag boolean")
    assert rows(df) == [(1, 'x, "y"', True), (2, None, False)]
    files.create_schema(spark, "test_raw", f"file://{tmp_path}/db")
    for _ in range(2):  # replaced, not appended
        assert files.create_table_as(df, "test_raw", "people", f"file://{tmp_path}/people").count() == 2
    assert spark.table("test_raw.people").count() == 2
    files.register(df, "here")
    assert files.unregister(spark, "here") and not files.unregister(spark, "here")
    made = files.generated(spark, lambda spark: {"t": pd.DataFrame({"a": [1, 2]})})
    assert made["t"].count() == 2
    tree = tmp_path / "m"
    (tree / "x").mkdir(parents=True)
    (tree / "x/b.sql").write_text("number(1)")
    (tree / "a.sql").write_text("one\ntwo")
    (tree / "c.txt").write_text("no")
    assert [r.text for r in files.text_tree(spark, str(tree)).collect()] == ["one\ntwo", "number(1)"]
    files.write_tree(df, str(tmp_path / "new"))
    with pytest.raises(Exception):
        files.write_tree(df, str(tmp_path / "new"))


def test_stream_equals_table(spark, rows, tmp_path):
    data = [(i, datetime(2024, 1, 1 + i % 3, i % 24), "click" if i % 2 else "view", float(i)) for i in range(40)]
    spark.createDataFrame(data, "event_id int, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "e"))
    q = windowed_counts(event_stream(spark, str(tmp_path / "e"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("counts")) == rows(windowed_counts(spark.read.parquet(str(tmp_path / "e"))))


def test_many_files(spark, tmp_path):
    texts = {f"d{n % 7}/e{n % 3}/f{n:03}.sql": f"select {n}\nfrom t" for n in range(300)}
    for name, body in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = files.text_tree(spark, str(tmp_path)).collect()
    assert [r.text for r in got] == [texts[k] for k in sorted(texts)]
    manifest = spark.createDataFrame([(k.rsplit("/", 1)[1], "0" * 64 if k.endswith("5.sql") else files.digest(v)) for k, v in texts.items()], "file string, expected string")
    assert {r.file: r.ok for r in files.verify_manifest(spark, str(tmp_path), manifest).collect()} == {k.rsplit("/", 1)[1]: not k.endswith("5.sql") for k in texts}


def test_build_runs_in_order_and_tests_fail(spark, rows):
    from tallyforge.plans import build as b

    seed = lambda spark: spark.createDataFrame([(1, "x"), (1, None), (2, "y")], "k int, v string")
    nodes = [
        b.Node("twice", "test", ("double",), b.unique("double", ["k"])), b.Node("filled", "test", ("double",), b.not_null("double", "v")), b.Node("words", "test", ("double",), b.accepted("double", "v", ("x",))),
        b.Node("kept", "test", ("double", "seed"), b.related("double", "k", "seed", "k")), b.Node("double", "model", ("seed",), lambda spark, seed: seed.withColumn("k", F.col("k") * 2)), b.Node("seed", "seed", (), seed),
    ]
    assert rows(b.report(nodes, b.build(spark, nodes)), "node", "n_rows", "status") == [("double", 3, "built"), ("filled", 1, "fail"), ("kept", 1, "fail"), ("seed", 3, "built"), ("twice", 1, "fail"), ("words", 1, "fail")]
    with pytest.raises(ValueError):
        b.build(spark, [b.Node("a", "model", ("nowhere",), seed)])
    with pytest.raises(ValueError):  # a circle
        b.build(spark, [b.Node("a", "model", ("c",), seed), b.Node("c", "model", ("a",), seed)])


def test_layout_causes_effort_and_names(spark, rows):
    lines = spark.createDataFrame([(1, 1, "a", 9), (1, 2, "c", 8), (1, 3, "b", 9), (2, 1, "zz", 9), (2, 2, "a", 9)], "reviewer int, line_no int, pair string, cells int")
    packet = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "pair string, ordinal int")
    assert rows(annotate.layout_violations(lines, packet)) == [("b", 1, "out of packet order"), ("c", 1, "not nine cells")]
    record = spark.createDataFrame([("a", "different"), ("b", "different"), ("c", "agree"), ("d", "different")], "pair string, `case` string").withColumn("root_cause", F.lit(None).cast("string"))
    said = spark.createDataFrame([("a", "Root cause of the split is Scope."), ("c", "root cause of the split is judgment"), ("d", "root cause of the split is weather"), ("b", None)], "pair string, text string")
    got = annotate.root_cause_violations(annotate.with_causes(record, said))
    assert rows(got) == [("b", "root cause missing or unknown"), ("c", "root cause without disagreement"), ("d", "root cause missing or unknown")]
    sheet = spark.createDataFrame([(1, 5), (1, 7), (2, None), (3, 1)], "reviewer int, minutes bigint")
    active = spark.createDataFrame([(1, 12), (2, 0)], "reviewer int, active_minutes bigint")
    assert rows(annotate.effort(sheet, active), "reviewer", "mismatch") == [(1, False), (2, True), (3, None)]
    text = spark.createDataFrame([("Dr. Ann Smith wrote to a.b@c.de on 2024-01-02, reviewer R2 and mara quist agreed; Maraquist did not",), ("| Dr. Ann Smith |",)], "t string")
    assert [r[0] for r in text.select(annotate.redact(F.col("t"), ("Mara Quist",))).collect()] == ["<name> wrote to <e-mail> on <date>, Reviewer and <name> agreed; Maraquist did not", "| Dr. Ann Smith |"]


def test_scopes_in_use_are_those_that_parse(spark):
    from tallyforge.plans.semantic import Scope

    texts = ["overall", " Overall  Total", "metric_time__month", "METRIC_TIME__DAY", "metric_time__hour", "by branch", "", None, "ｏｖｅｒａｌｌ"]
    got = {r.scope: r.declared for r in annotate.scopes_in_use(spark.createDataFrame([(t,) for t in texts], "s string"), "s").collect()}
    for t in texts:
        try:
            want = Scope.parse(t or "")
            assert got[t] == (f"metric_time__{want.grain}" if want.grain else "ungrouped total")
        except ValueError:
            assert got[t] is None


def test_manifest_statuses_and_table_lines(spark, rows):
    want = spark.createDataFrame([("a", "F0"), ("b", "11"), ("c", "22")], "file string, expected string")
    there = spark.createDataFrame([("a", "f0"), ("b", "12"), ("d", "33")], "file string, actual string")
    assert rows(files.check_manifest(want, there, "file"), "file", "status") == [("a", "ok"), ("b", "changed"), ("c", "missing"), ("d", "unlisted")]
    lines = files.table_lines(spark.createDataFrame([("b", 1), ("abc", None)], "name string, n int"), ["name"])
    assert [r.line for r in lines.orderBy("no").collect()] == ["name  n", "----  -", "abc    ", "b     1"]


def test_written_tables_are_swept(spark):
    import os

    from tallyforge import session

    session.sweep(spark)
    session.cut(spark.range(3), "kept")
    path = session._PLACES[-1].removeprefix("file://")
    assert os.path.isdir(path) and session.sweep(spark) == 1 and not os.path.exists(path)


def test_load_makes_its_schema(spark):
    from tallyforge import session

    frames = {"a": spark.range(3), "b": spark.range(2)}
    spark.sql("DROP DATABASE IF EXISTS never_made CASCADE")
    names = files.load(spark, frames, "never_made", lambda n: session.place(spark, n))
    assert names == ["`never_made`.`A`", "`never_made`.`B`"] and [spark.table(n).count() for n in names] == [3, 2]
    assert files.load(spark, {"a": spark.range(5)}, "never_made", lambda n: session.place(spark, n)) == names[:1] and spark.table(names[0]).count() == 5
    spark.sql("DROP DATABASE never_made CASCADE")


def test_load_that_fails_unregisters(spark):
    from tallyforge import session

    twice = spark.createDataFrame([(1, 2)], "k int, v int").toDF("k", "k")  # no table holds one name twice
    with pytest.raises(Exception):
        files.load(spark, {"a": twice}, "never_made", lambda n: session.place(spark, n))
    assert not spark.catalog.tableExists("df_in")
    spark.sql("DROP DATABASE never_made CASCADE")
