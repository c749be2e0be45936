"""The processor of the keyed load, on plain rows."""

from pyspark.sql import Row

from dumpweave.streaming.keyed import FirstOfTitle


class Seen:
    def __init__(self, known=False):
        self.known = known

    def exists(self):
        return self.known

    def update(self, value):
        self.known = value[0]


def settled(rows, known=False):
    processor = FirstOfTitle()
    processor.seen = Seen(known)
    found = list(processor.handleInputRows(("t",), iter(rows), None))
    assert processor.seen.known
    return {(r.file_start, r.chunk, r.pos): r.status for r in found}


def test_first_place_of_a_title_is_added():
    rows = [Row(title="t", file_start=f, chunk=c, pos=p, file="x") for f, c, p in [(2, 0, 1), (1, 1, 9), (1, 0, 3), (1, 0, 5), (1, None, 9)]]
    want = {(r.file_start, r.chunk, r.pos): "duplicate" for r in rows}
    assert settled(rows, known=True) == want
    assert settled(rows) == want | {(1, 0, 5): "added"}
    assert settled(rows[::-1]) == want | {(1, 0, 5): "added"}
    assert settled(rows[4:]) == {(1, None, 9): "added"}
