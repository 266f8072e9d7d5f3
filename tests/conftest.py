import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import local_session, ship

    session = local_session(4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_data():
    if not os.path.isdir(f"{DATA}/sf0.001"):
        pytest.skip("no test data")
    return f"{DATA}/sf0.001"


CANDIDATE = (
    "cand_id long, case_id string, sequence int, record_id string, field string, raw_label string, raw_line string, normalized_value string, "
    "unit string, transformation string, raw_value string, confidence double, authority_rank int, document string, document_type string, location string, "
    "page int, line int, source_span struct<alias_start:int,alias_end:int,value_start:int,value_end:int>, line_sha256 string, document_sha256 string, "
    "extractor string, extracted_at timestamp, ingested_at timestamp"
)


@pytest.fixture(scope="session")
def candidates(spark):
    """A builder of candidate tables: columns that are not given are null; extra may add columns of any name."""

    def build(*rows, extra=""):
        names = [c.strip().split(" ")[0] for c in CANDIDATE.replace("struct<alias_start:int,alias_end:int,value_start:int,value_end:int>", "s").split(", ")]
        schema = CANDIDATE + (f", {extra}" if extra else "")
        extras = len(extra.split(", ")) if extra else 0
        return spark.createDataFrame([tuple(r.get(n) for n in names) + (None,) * extras for r in rows], schema)

    return build
