"""Postings are made block by block and cut by their number."""

from palimpsest.operators import index
from palimpsest.operators.index import Index


def test_postings_are_cut_by_their_number_and_texts_with_one_id_each_are_not_grouped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "PART_POSTINGS", 40)
    rows = [(i, " ".join(f"w{i % 7} w{j}" for j in range(i % 9))) for i in range(120)] + [(500, None), (501, "")]
    held = Index(spark, str(tmp_path / "i"))
    assert held.update(spark.createDataFrame(rows, "msg_id long, text string")) == 122
    folder = f"{held.path}/{held.segments()[0]['name']}/postings"
    assert spark.read.parquet(folder).select("_metadata.file_path").distinct().count() > 4  # more than the session's partitions
    want = {i: {w for w in (t or "").split()} for i, t in rows}
    got = held.snapshot().blocks().collect()
    assert {(r.token, i) for r in got for i in r.ids} == {(w, i) for i, ws in want.items() for w in ws}
    for r in got:
        assert r.lengths == [len(want[i]) for i in r.ids] and list(zip(r.lengths, r.ids)) == sorted(zip(r.lengths, r.ids)) and r.n == len(r.ids) and r.least == min(r.lengths)
    assert held.update(spark.createDataFrame([(600, "aa bb"), (600, "bb cc"), (1, "zz")], "msg_id long, text string")) == 1
    assert {r.token for r in held.postings().where("msg_id = 600").collect()} == {"aa", "bb"}
