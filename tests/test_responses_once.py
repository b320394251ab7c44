"""Search responses are put together once for selection and outcomes."""

from stagesignal.plans import events


def test_query_outcomes_read_the_tables_once(spark):
    d = "/root/testdata/sf0.001"
    out = events.r107_query_outcomes(spark, d)
    assert "FileScan" not in str(out._jdf.queryExecution().executedPlan().toString())
    responses = events._responses(spark, d)
    want = events.trace.query_outcomes(responses, events.trace.select_sources(responses))
    assert out.count() == want.count() > 0 and out.exceptAll(want).isEmpty()
