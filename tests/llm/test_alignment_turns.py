"""op12 puts texts together in turns."""

from cinesift import lineage
from cinesift.llm import alignment
from tests.llm.test_whitening_alignment_language import paths


def test_no_turn_holds_all_texts(spark, monkeypatch):
    held, plain = [], lineage.Scratch.keep

    def keep(self, df, name):
        out = plain(self, df, name)
        if name == "links":
            held.append([bytes(r.digest) for r in out.select("digest").collect()])
        return out

    texts = [f"rare{i}x{i * i} and plain words of text{i % 7} here" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts[:20])] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lineage.Scratch, "keep", keep)
    got = sorted(map(tuple, alignment.align(df, *paths(), 4, 4).collect()))
    assert len(held) > 1 and max(map(len, held)) < 40
    assert sorted(d for part in held for d in part) == sorted({d for part in held for d in part}) and sum(map(len, held)) == 61
    monkeypatch.setattr(alignment, "TURNS", 1)
    assert sorted(map(tuple, alignment.align(df, *paths(), 4, 4).collect())) == got and len(got) == len(rows)
