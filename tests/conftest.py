import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logweave.session import get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", 4, app_name="logweave-tests",
                  extra={"spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="logweave-ckpt-"),
                         "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="logweave-wh-"),
                         "spark.sql.execution.arrow.pyspark.enabled": "true"})
    yield s


def lines_df(spark, files: dict):
    """``{file_path: text}`` -> lines(file_path, line_number, value), split
    like a text reader (LF, CRLF, CR)."""
    import re
    rows = []
    for path, text in files.items():
        parts = re.split(r"\r\n|\r|\n", text)
        if parts and parts[-1] == "":
            parts = parts[:-1]
        rows += [(path, i + 1, v) for i, v in enumerate(parts)]
    return spark.createDataFrame(rows, "file_path string, line_number long, value string")
