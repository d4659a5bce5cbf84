import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks.compare import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4")
    if not (session.conf.get("spark.checkpoint.dir", None) or session.sparkContext.getCheckpointDir()):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("stages")))
    yield session
    session.stop()


@pytest.fixture()
def contribution(spark):
    """Factory for raw contribution rows; every field has a plain default."""
    from datetime import datetime

    from editpulse.sources.readers import CONTRIBUTION_SCHEMA

    def make(*rows):
        full = []
        for row in rows:
            base = {
                "countries": ["AAA"],
                "osm_id": 1,
                "osm_type": "node",
                "user": 1,
                "valid_from": datetime(2020, 1, 1, 12),
                "valid_to": datetime(2020, 1, 2, 12),
                "tags": {"building": "yes"},
                "tags_before": None,
                "contrib_type": "CREATION",
                "changeset": 1,
                "editor": "JOSM/1.5",
                "comment": "abc",
                "closed": datetime(2020, 1, 1, 12, 10),
                "created": datetime(2020, 1, 1, 12),
                "bbox": (0.0, 0.0, 1.0, 1.0),
            } | row
            change_tags = {} if base["comment"] is None else {"comment": base["comment"]}
            full.append(
                (
                    base["countries"], base["osm_id"], base["osm_type"], (base["user"],), base["valid_from"],
                    base["valid_to"], base["tags"], base["tags_before"], base["contrib_type"],
                    (base["changeset"], base["editor"], change_tags, base["created"], base["closed"]), base["bbox"],
                )
            )
        return spark.createDataFrame(full, CONTRIBUTION_SCHEMA)

    return make
