"""The bucket step of the substring operators: known hits pass through, the others meet bucket by bucket."""

import pyarrow as pa
import pytest
from tracewell.llm import shared_windows as W
from tracewell.llm.suffix_array import repeated_substrings

K = 6
NAMES = ["kind", "h", "part", "hot", "doc", "did", "start", "n", "s"]
KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


class Plan:
    """Stands for a table: keeps the function of mapInArrow."""

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition

    def mapInArrow(self, run, _):
        self.run = run
        return self


def buckets(rows, size):
    columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), KINDS, strict=True)]
    table = pa.RecordBatch.from_arrays(columns, NAMES)
    plan = W._buckets(Plan(), W.Units(words=False, k=K, m=3), repeated_substrings(K))
    return list(plan.run(table.slice(i, size) for i in range(0, len(rows), size)))


@pytest.mark.parametrize("size", [7, 10_000])
def test_buckets_give_each_window_of_an_earlier_document(monkeypatch, size):
    monkeypatch.setattr(W, "SHARD_BYTES", 60)
    text = b"abcdefghijkl"
    rows = []
    for h in range(40):
        part = bytes([65 + h % 26]) + text[h % 3 :]
        for doc in range(1 + h % 4):
            rows.append((0, h, 0, h % 7 == 3, doc, doc * 10, 100 * h, len(part) - K + 1, part if doc % 2 else part[1:] + b"z"))
        rows.append((1, h, 0, False, 9, 90, 5 + h, 3, None))
    got = sorted((d, s + i) for b in buckets(rows, size) for k, d, _, s, n, _ in zip(*(c.to_pylist() for c in b.columns), strict=True) if k == 1 for i in range(n))
    want = [(9, 5 + h + i) for h in range(40) for i in range(3)]
    # all strings of a shard meet, whatever their bucket; those of one bucket always do
    least = {}
    for kind, _, _, _, doc, _, _, _, s in rows:
        for j in range(len(s or b"") - K + 1):
            least[s[j : j + K]] = min(doc, least.get(s[j : j + K], doc))
    some = {(doc, start + j) for kind, _, _, _, doc, _, start, _, s in rows if kind == 0 for j in range(len(s) - K + 1) if doc > least[s[j : j + K]]}
    own = set()
    for h in range(40):
        mine = [r for r in rows if r[0] == 0 and r[1] == h]
        own |= {(r[4], r[6] + j) for r in mine for j in range(len(r[8]) - K + 1) if any(o[4] < r[4] and r[8][j : j + K] in o[8] for o in mine)}
    assert own <= set(got) - set(want) <= some and set(want) <= set(got)


def test_known_hits_are_passed_on_as_they_come():
    out = buckets([(1, i, 0, False, i, i, i, 2, None) for i in range(5000)], 5000)
    assert [b.num_rows for b in out if b.num_rows] == [5000]
    assert out[0].column(1).to_pylist() == list(range(5000)) and out[0].column(5).null_count == 5000
