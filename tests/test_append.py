"""An append reads and parses each book once."""

from quire.sources.books import append_books, raw_books_from_files
from tests.test_build_cost import FIELDS, books


def test_append_parses_each_book_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    raw = raw_books_from_files(books(spark))
    again = raw.unionByName(raw).coalesce(2).mapInArrow(counted, raw.schema)
    new, _ = append_books(again, spark.createDataFrame([], FIELDS))
    rows = new.collect()
    assert sorted(r.file_id for r in rows) == [1, 2, 3, 4, 5, 6]
    assert len({r.filename for r in rows}) == 6
    assert read.value == 12
