"""What the phrase pass holds in Python workers (F6)."""

import tracemalloc

import pyarrow as pa

from mailtriage.operators import language
from mailtriage.plans import intake_queries


def test_phrase_table_needs_no_python_worker(spark):
    phrases = intake_queries.phrase_table(spark)
    assert sorted(map(tuple, phrases.collect())) == sorted(intake_queries.PHRASES)
    assert "PythonRDD" not in phrases._jdf.queryExecution().toRdd().toDebugString()


def test_objects_do_not_grow_with_a_batch():
    matcher = language.Matcher([("financial", "broad", "invoice")])

    def peak(n: int) -> tuple[int, int]:
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"{i} " + "plain words " * 20 + "Invoices" for i in range(n)])], ["msg_id", "text"])
        tracemalloc.start()
        found = sum(b.num_rows for b in language.matches_of(matcher, [batch]))
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found, held

    (few, small), (many, large) = peak(512), peak(5120)
    assert (few, many) == (512, 5120) and large < 1.5 * small
