"""A file holding almost all lines: chunking spreads it over many window
partitions and gives exactly the entries a single chunk gives."""
from pyspark.sql import functions as F

from logweave.operators.parse import parse_entries
from tests.conftest import lines_df


def test_hot_file_split_into_chunks(spark):
    hot = []
    for i in range(4000):
        hot.append(f"2024-01-01 00:00:{i % 60:02d},{i % 1000:03d} WARN [a.B] - m{i}")
        if i % 3 == 0:
            hot += [f"  cont {i}", f"\tat a.B.c(B.java:{i})"]
    files = {"hot.log": "\n".join(hot) + "\n", "small.log": "2024-01-01 00:00:00,000 INFO [x.Y] - s\n"}
    df = lines_df(spark, files)
    chunked = parse_entries(df, chunk_lines=257)
    whole = parse_entries(df, chunk_lines=1 << 30)
    cols = ["file_path", "line_number", "message", "stack_trace"]
    a = sorted(tuple(r) for r in chunked.select(*cols).collect())
    assert a == sorted(tuple(r) for r in whole.select(*cols).collect())
    assert len(a) == 4001
    n_chunks = df.where(F.col("file_path") == "hot.log").select(F.floor(F.col("line_number") / 257)).distinct().count()
    assert n_chunks > 20
