import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from reelwise.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


LOG_SCHEMA = (
    "event_id long, user_id long, item_id long, date int, timestamp long, watch_ratio double, "
    "label_complete int, label_strong int, label_short int, split string"
)


@pytest.fixture
def make_log(spark):
    def build(rows):
        """Rows (user, item, date, watch_ratio[, short]); labels, order and split follow from them."""
        out = []
        for n, row in enumerate(rows):
            user, item, date, ratio = row[:4]
            short = row[4] if len(row) > 4 else 0
            split = "train" if date <= 20240110 else "valid" if date <= 20240115 else "test"
            out.append((n, user, item, date, date * 1000 + n, ratio, int(ratio >= 1), int(ratio >= 2), short, split))
        return spark.createDataFrame(out, LOG_SCHEMA)

    return build
