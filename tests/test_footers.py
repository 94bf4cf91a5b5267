"""A footer's lines are found once, whatever of it is asked for."""

from partsmith.functions import text as T


def test_figure_code_of_footers(spark):
    rows = [("21-10-00\nFIG. 3\nPAGE 2\nAPR 11/21\nRF 21-10-00",), ("21-10-00\r\n  FIGURE 1b \n",), ("21-10-00\nPAGE 3",), ("FIG. 2",), ("a\nfig 4 x\nFIG. 5",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(T.figure_code("t").alias("code"), T.footer_meta("t").alias("m"))
    got = [(r["code"], *r["m"]) for r in df.collect()]
    assert [g[0] for g in got] == [g[1] for g in got] == ["21-10-00-03", "21-10-00-01B", None, None, "A-04X", None, None]
    assert [g[2] for g in got] == ["FIG. 3", "FIGURE 1b", None, None, "FIG. 4 x", None, None]
    assert got[0][3:] == ("APR 11/21", "PAGE 2", "RF 21-10-00") and got[2][4] == "PAGE 3"
    plan = spark.createDataFrame(rows, "t string").select(T.figure_code("t").alias("code"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
