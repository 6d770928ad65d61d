"""Work on rows is dealt to tasks, and done once for each row."""

import pytest

from lineweave.plans import registry
from lineweave.sources import payloads

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["text_moras", "syllable_alignment", "syllable_segments", "vocabulary_substitutes", "syllable_times", "letter_times"])
def test_rows_of_a_small_file_go_to_all_tasks(spark, name):
    assert registry.queries()[name](spark, DIR).rdd.getNumPartitions() == 4


def test_a_page_is_cut_into_cells_once(spark, capsys):
    df = spark.createDataFrame([("<tr>a</tr><tr>b</tr>",), (None,), ("",)], "html string")
    rows = df.select("html", payloads.table_lines(df.html).alias("l"))
    assert [[tuple(x) for x in r.l] for r in rows.where("html > ''").collect()] == [[("a", None, "b")]]
    rows.explain()
    assert capsys.readouterr().out.count("regexp_extract_all") == 1
