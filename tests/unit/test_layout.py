from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from docloom.sources import positioned
from docloom.sources.shared import whole

RUN = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("str", pa.string()), *((c, pa.float64()) for c in ("x", "y", "angle", "size", "width")), ("rtl", pa.bool_()), ("has_eol", pa.bool_())])


def by_hand(page):
    """Lines of one page, run by run."""
    groups, ended = [], True
    for r in page:
        top = groups[-1] if groups else None
        if ended or top[0]["angle"] != r["angle"] or abs(top[0]["y"] - r["y"]) > positioned.SAME_BASELINE * max(x["size"] for x in top):
            groups.append([r])
        else:
            top.append(r)
        ended = r["has_eol"]
    out = []
    for n, g in enumerate(groups):
        rtl = sum(r["rtl"] for r in g) * 2 > len(g)
        order = sorted(g, key=lambda r: -r["x"] if rtl else r["x"])
        text, size = "", max(r["size"] for r in g)
        for k, r in enumerate(order):
            if k:
                gap = (order[k - 1]["x"] - r["x"] - r["width"]) if rtl else (r["x"] - order[k - 1]["x"] - order[k - 1]["width"])
                text += " " if gap > positioned.MISSING_SPACE * size and not text.endswith(" ") and not r["str"].startswith(" ") else ""
            text += r["str"]
        left = min(r["x"] for r in g)
        out.append((g[0]["doc_id"], g[0]["page"], n, int(g[0]["angle"]), g[0]["y"], size, left, max(r["x"] + r["width"] for r in g) - left, text))
    return out


@pytest.mark.parametrize("held", [1, 3, 7, 500])
def test_lines_of_many_pages_by_hand(held):
    """Whole pages at once give the lines of each page told run by run, wherever batches end."""
    draw = random.Random(held)
    pages = [
        [
            {"doc_id": d, "page": p, "str": draw.choice(["a", "b ", " c", "", " ", "dé"]), "x": draw.choice([0.0, 5.0, 10.0, 11.0, 20.0]), "y": draw.choice([10.0, 12.0, 14.0, 20.0]), "angle": draw.choice([0.0, 0.0, 90.0]),
             "size": draw.choice([4.0, 10.0, 30.0]), "width": draw.choice([1.0, 5.0]), "rtl": draw.random() < 0.4, "has_eol": draw.random() < 0.2}
            for _ in range(draw.randrange(1, 12))
        ]
        for d in range(40) for p in (1, 2)
    ]
    rows = [r for p in pages for r in p]
    batches = [pa.RecordBatch.from_pylist(rows[k : k + held], schema=RUN) for k in range(0, len(rows), held)]
    calls = list(whole(("doc_id", "page"), positioned._lined)(iter(batches)))
    got = [tuple(r.values()) for b in calls for r in b.to_pylist()]
    assert got == [line for p in pages for line in by_hand(p)]
    assert held < 500 or len(calls) < 5  # not a call for each page


def test_rows_of_a_key_stay_together():
    keys = [1, 1, 1, 2, 3, 3, 4, 4, 4, 4, 4, 5]
    for held in range(1, 13):
        batches = [pa.RecordBatch.from_pydict({"k": keys[k : k + held]}) for k in range(0, len(keys), held)]
        seen = []
        run = lambda rows, starts: seen.extend(np.split(rows.column("k").to_numpy(), starts[1:])) or rows.to_batches()[0]
        assert sum(b.num_rows for b in whole(("k",), run)(iter(batches))) == len(keys)
        assert [s.tolist() for s in seen] == [[1] * 3, [2], [3] * 2, [4] * 5, [5]]
