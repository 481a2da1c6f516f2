"""Pages by fences against the sorted list."""
import random

from odonto.operators.paging import SortedPages
from odonto.sources.bodies import TEXT, read_bodies


def test_pages_equal_the_sorted_list(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([None, "", "a", "A", "é", "zz"]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "name string, id long")
    pages = SortedPages.write(df, ["name", "id"], str(tmp_path / "list"), rows_per_range=60)
    want = [tuple(r) for r in df.orderBy("name", "id").collect()]
    assert len(pages) == 500 and len(pages.ranges) > 4
    widest = max(b - a for a, b in zip(pages.starts, pages.starts[1:]))
    for offset, size in [(0, 10), (pages.starts[2] - 1, 2), (pages.starts[2], 1), (470, 100), (0, 500), (500, 5), (7, 0), (9_999, 3)]:
        page = pages.page(offset, size)
        assert [tuple(r) for r in page.collect()] == want[offset:offset + size], (offset, size)
        if size <= 10:
            assert len(page.inputFiles()) <= 2 and widest < 200
    assert pages.page(450, 10).columns == ["name", "id"]


def test_empty_list(spark, tmp_path):
    pages = SortedPages.write(spark.createDataFrame([], "name string, id long"), ["name", "id"], str(tmp_path / "none"))
    assert len(pages) == 0 and pages.page(0, 10).count() == 0


def test_nested_list_as_text(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"seq": 1, "t": [1, [2, 3]]}')
    assert read_bodies(spark, str(tmp_path / "in"), {"t": TEXT}).first().t == "1,[2,3]"
