import contextlib
import io

from stocksieve.__main__ import main
from stocksieve.plans import QUERIES


def test_cli_lists_every_query_and_prints_oracles():
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        assert main(["list"]) == 0
    assert buf.getvalue().split() == sorted(QUERIES)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        assert main(["oracle", "q_13f_weights"]) == 0
    assert "weights as (" in buf.getvalue()


def test_cli_rejects_unknown_query():
    assert main(["no_such_query"]) == 2
