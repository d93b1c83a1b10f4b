"""Several suites in one job give the same rows as one report per suite."""

from evalspark.plans import suites as SU


def _rows(spark):
    data = []
    for i in range(40):
        data.append((i, f"run{i % 3}", ["en", "de", None][i % 3], ["a", None, "b", "c"][i % 4],
                     i % 2, " Yes" if i % 2 else "NO ", ["Yes.", "**No**", "unclear", "yes?", "(b) no"][i % 5],
                     "ABCD"[i % 4], ["easy", "hard", None][i % 3]))
    cols = ["item_no", "run_id", "subcategory", "subset", "gt_answer", "ground_truth", "verdict",
            "answer_letter", "question_type"]
    return spark.createDataFrame(data, cols)


def _sorted(df):
    return sorted(tuple(r) for r in df.select("suite", "run_id", "metric_group", "metric", "value").collect())


def test_multi_report_equals_separate_reports(spark):
    rows = _rows(spark)
    suites = [SU.HALLUCINATION, SU.OBJECT_PROBE, SU.LETTERED_CHOICE]   # the last one falls back
    together = SU.multi_report(suites, rows, by=["run_id"])
    separate = None
    for s in suites:
        part = s.report(rows, by=["run_id"]).selectExpr(f"'{s.name}' AS suite", "*")
        separate = part if separate is None else separate.unionByName(part)
    got, want = _sorted(together), _sorted(separate)
    assert got == want and len(got) > 0
    assert {r[0] for r in got} == {s.name for s in suites}
