"""The subsequences of a small file's rows are found in several tasks, by whole numbers instead of arrays a row."""

from loomseries.functions import text as tx
from loomseries.queries.record_queries import lcs_texts


def test_a_small_file_goes_to_several_tasks(spark, tmp_path):
    rows = [(i, "small blue anvil"[i % 7:], "ECONOMY" if i % 3 else None) for i in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    out = lcs_texts(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() > 1
    assert sorted(map(tuple, out.collect())) == [(i, tx._lcs_text(a, b.lower()) if b else None) for i, a, b in rows]


def test_rows_of_the_table_are_whole_numbers():
    place, full = tx._lcs_places("abcab"), 31
    row = full
    for letter in "bca":
        row = tx._lcs_next(row, place(letter), full)
    assert isinstance(row, int) and tx._lcs_length("bca", "abcab") == 5 - row.bit_count() == 3
    long = "ab" * 600
    assert tx._lcs_places(long)("b") == sum(1 << j for j in range(1, 1200, 2)) and tx._lcs_places(long)("z") == 0
