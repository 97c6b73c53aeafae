"""op12 puts many texts together at once, and deals records of stretches once for all turns."""

import hashlib
import random
from collections import Counter

import pytest

from cinesift import lineage
from cinesift.llm import alignment
from tests.llm.test_whitening_alignment_language import paths


def test_records_are_dealt_once(spark, monkeypatch):
    kept, plain = [], lineage.Scratch.keep

    def keep(self, df, name):
        kept.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return plain(self, df, name)

    monkeypatch.setattr(lineage.Scratch, "keep", keep)
    df = spark.createDataFrame([(i, f"rare{i} of plain{i * i} words") for i in range(30)], "doc_id long, text string")
    alignment.align(df, *paths(), 2, 4)
    # A join on the stretch in each turn would read and sort all records again.
    assert [name for name, plan in kept if "stretch" in plan and "Join" in plan and name in ("own", "links")] == ["own"]


@pytest.mark.parametrize("light", [1024, 9])
def test_put_together_equals_links_one_by_one(monkeypatch, light):
    rng = random.Random(4)
    monkeypatch.setattr(alignment, "LIGHT", light)
    side = lambda: ",".join(str(rng.randrange(5)) for _ in range(rng.choice([1, 1, 3])))
    groups = {f"s{i}": ";".join(f"{side()}|{side()}" for _ in range(rng.randint(1, 4))) for i in range(60)} | {"bad": None}
    known = alignment.Known([(s, groups[s]) for s in list(groups)[:30]])
    texts = [rng.choices(list(groups), k=rng.randint(0, 12)) for _ in range(80)] + [["bad"], []]
    records = [[(i, groups[s]) for i, s in enumerate(alignment.rare(t, known))] for t in texts]
    numbers, shas, ends, pairs, times = alignment.put_together(texts, known, records)
    low = 0
    for i, t in enumerate(texts):
        want, n = Counter(), [0] * 4
        if t and "bad" not in t:
            for s in t:
                of, p, k = alignment.links(groups[s])
                n = [x + y for x, y in zip(n, of, strict=True)]
                for x, y in zip(p, k, strict=True):
                    want[x] += y
        assert numbers[i].tolist() == n and dict(zip(pairs[low : ends[i]].tolist(), times[low : ends[i]].tolist(), strict=True)) == want
        assert shas[i] == (hashlib.sha256(";".join(groups[s] for s in t).encode()).hexdigest() if want else "")
        low = ends[i]
