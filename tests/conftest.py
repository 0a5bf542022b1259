import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuswarden.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = build_session("4", 4, **{"spark.checkpoint.dir": shared})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """A files table from {rel: text}, or {repo: {rel: text}}."""
    def make(tree):
        if not tree or isinstance(next(iter(tree.values())), str):
            tree = {"r": tree}
        rows = [(repo, rel, text) for repo, files in tree.items() for rel, text in files.items()]
        return spark.createDataFrame(rows, "repo string, rel string, text string")
    return make
