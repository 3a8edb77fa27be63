from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

from termforge.llm import decontam
from verify import oracle_rows, spark_rows

ITEM = "what is the capital city of the northern province of the old kingdom"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab ", min_size=1, max_size=7), max_size=8), st.text("ab ", max_size=60), st.integers(1, 4))
def test_wu_manber_finds_every_occurrence(patterns, text, block):
    machine = decontam.WuManber(patterns, block)
    expected = sorted((k, p) for p in set(patterns) for k in range(len(text)) if text.startswith(p, k))
    assert sorted((k, machine.patterns[n]) for k, n in machine.find(text)) == expected


def test_query_is_what_sql_says(spark, sf_dir):
    assert spark_rows(decontam.op6_benchmark_decontamination(spark, sf_dir)) == oracle_rows(sf_dir, decontam.ORACLE_OP6)


def frames(spark):
    benchmark = spark.createDataFrame([(1, ITEM), (2, ITEM), (3, "too short an"), (4, None), (None, ITEM), (5, ""), (6, "five words are an item")], "item_id bigint, text string")
    rows = [
        (1, f"so, {ITEM.upper().replace(' ', ' - ')}?", "a"), (2, "it begins: what is the capital city of the northern, and ends", "a"), (3, "what is the capital city of the southern", None),
        (4, None, None), (5, "", None), (None, ITEM, None), (6, ITEM, "x"), (6, ITEM, "x"), (7, "too short an", None), (8, "say: five words are an item!", None),
        (9, "filler " * 40_000 + ITEM, None), (10, "fivewords are an item", None), (11, "it is too short an item", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, plain string"), benchmark


def test_hard_rows(spark):
    docs, benchmark = frames(spark)
    found = {(r["doc_id"], r["item_id"]): r["strings"] for r in decontam.contaminated(docs, benchmark).collect()}
    windows = len(ITEM.split()) - decontam.WORDS + 1
    assert found == {(d, i): windows for d in (1, 6, 9) for i in (1, 2)} | {(2, i): 1 for i in (1, 2)} | {(8, 6): 1, (7, 3): 1}
    kept = decontam.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 10, 11]


def test_empty_tables(spark):
    docs, benchmark = frames(spark)
    assert decontam.contaminated(docs.limit(0), benchmark).count() == 0 == decontam.decontaminate(docs.limit(0), benchmark).count()
    assert decontam.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontam.decontaminate(docs, benchmark.limit(0)).count() == docs.count()


def test_a_large_benchmark_is_searched_in_parts(spark):
    docs, benchmark = frames(spark)
    whole, parts = (sorted(map(tuple, decontam.contaminated(docs, benchmark, most=m).collect())) for m in (1 << 20, 100))
    assert whole == parts
    assert sorted(r["doc_id"] for r in decontam.decontaminate(docs, benchmark, most=100).collect()) == [3, 4, 5, 10, 11]


def test_rows_of_one_document_count_together(spark):
    """Different rows of a doc_id hold different strings of an item; however many passes, each string counts once. Against substring search."""
    text = "aa bb cc dd ee ff gg hh ii jj kk ll mm"
    benchmark = spark.createDataFrame([(1, text), (2, "five words are an item"), (3, "two words"), (4, "aa bb cc dd ee ff gg hh"), (4, "bb cc dd ee ff gg hh ii")], "item_id bigint, text string")
    rows = [(1, "x aa bb cc dd ee ff gg hh y"), (1, "x ff gg hh ii jj kk ll mm y"), (1, "x aa bb cc dd ee ff gg hh y"), (2, "so five words are an item"), (3, "Two, words!"), (4, "two words more"), (5, "aa bb cc dd ee ff gg")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    passes = [sorted(map(tuple, decontam.contaminated(docs, benchmark, most=m).collect())) for m in (1 << 20, 60, 1)]
    assert passes == [[(1, 1, 2), (1, 4, 1), (2, 2, 1), (3, 3, 1)]] * 3
    assert sorted(r["doc_id"] for r in decontam.decontaminate(docs, benchmark, most=60).collect()) == [4, 5]


def test_sql_says_the_same_of_hard_rows(spark, sf_dir, tmp_path):
    docs, benchmark = frames(spark)
    for other in Path(sf_dir).iterdir():
        if other.stem not in ("documents", "benchmark"):
            (tmp_path / other.name).symlink_to(other)
    for name, df in (("documents", docs), ("benchmark", benchmark)):
        df.toPandas().astype({c: "Int64" for c in df.columns if c.endswith("_id")}).to_parquet(tmp_path / f"{name}.parquet")
    assert spark_rows(decontam.contaminated(docs, benchmark)) == oracle_rows(str(tmp_path), decontam.ORACLE_OP6)
