"""The stateless projections run unchanged on a stream."""
import tempfile

from casekit.sources.cases import case_table, write_table
from casekit.streaming import case_stream, featurize_stream

from conftest import SF_SMALL


def test_features_on_stream(spark):
    src = tempfile.mkdtemp(prefix="casekit-stream-src-")
    cases = case_table(spark, SF_SMALL)
    write_table(cases, src)
    s = featurize_stream(case_stream(spark, src, cases.schema))
    q = s.writeStream.format("memory").queryName("case_stream_test").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("case_stream_test")
    assert got.count() == cases.count()
    assert {"priority", "is_park", "bronx_madrugada", "season"} <= set(got.columns)
