"""The state processor on plain rows: no pandas frame is built for a URL."""

from pyspark.sql import Row

from matricula.streaming.attempts import Attempts


class Kept:
    """A value state in memory."""

    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_earliest_row_of_a_batch_passes_until_the_url_is_settled():
    work = Attempts(most=None)
    work.seen = Kept()
    row = lambda at, tie, failed: Row(profile_url="u", fetched_at=at, html="h", tie__=tie, failed__=failed)
    first = list(work.handleInputRows(("u",), iter([row(None, 1, False), row(5, 9, False), row(5, 2, True)]), None))
    assert first == [Row(profile_url="u", fetched_at=5, html="h", status="failed", attempt=1)]
    again = list(work.handleInputRows(("u",), iter([row(None, 7, True), row(None, 3, False)]), None))
    assert again == [Row(profile_url="u", fetched_at=None, html="h", status="done", attempt=2)]
    assert list(work.handleInputRows(("u",), iter([row(1, 1, False)]), None)) == []


def test_attempts_end():
    work = Attempts(most=1)
    work.seen = Kept()
    bad = Row(profile_url="u", fetched_at=1, html=None, tie__=1, failed__=True)
    assert [r.status for r in work.handleInputRows(("u",), iter([bad]), None)] == ["given_up"]
    assert list(work.handleInputRows(("u",), iter([bad]), None)) == []
