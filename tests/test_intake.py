"""Files that belong together by their names."""

import pytest

from traceforge.sources import intake


def test_discovery_of_a_folder(spark, tmp_path):
    names = [
        "ab_Mg_5nM_010.tif", "ab_Mg_5nM_010.tdat", "ab_Mg_5nM_010.TIFF", "cd_011.mat", "cd_011.txt", "ef_012.tif", "ab_Mg_5nM_099.tmap", "zz.tmap", "ab_Mg_5nM_010.hdf5", "other_012.h5", "other_013.hdf5", "again_012.hdf5", "notes.doc", "plain",
    ]
    for n in names:
        (tmp_path / n).write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "gh_020.tif").write_text("x")
    got = intake.discover(intake.listed(spark, f"file://{tmp_path}"))
    base = lambda p: p.rsplit("/", 1)[-1] if p else p
    a = {r.key: r for r in got.acquisitions.collect()}
    assert set(a) == {"ab_Mg_5nM_010", "cd_011", "ef_012"}
    one = a["ab_Mg_5nM_010"]
    assert [base(one[c]) for c in ("movie", "tdat", "mat", "txt", "smd")] == ["ab_Mg_5nM_010.TIFF", "ab_Mg_5nM_010.tdat", None, None, "ab_Mg_5nM_010.hdf5"]
    assert list(map(base, one.shared_maps)) == ["ab_Mg_5nM_099.tmap"] and one.warnings == ["several movie files: ab_Mg_5nM_010.TIFF, ab_Mg_5nM_010.tif; using ab_Mg_5nM_010.TIFF"] and one.video_index == "010"
    assert a["cd_011"].warnings == ["no movie: no way back from traces to it"] and base(a["cd_011"].txt) == "cd_011.txt"
    assert a["ef_012"].warnings == ["no source of coordinates: traces only"] and base(a["ef_012"].smd) == "again_012.hdf5" and a["ef_012"].shared_maps == []
    assert sorted((base(r.path), r.kind) for r in got.others.collect()) == [("ab_Mg_5nM_099.tmap", "map"), ("notes.doc", "ignored"), ("other_012.h5", "unpaired"), ("other_013.hdf5", "unpaired"), ("plain", "ignored"), ("zz.tmap", "map")]
    deep = intake.discover(intake.listed(spark, f"file://{tmp_path}", recursive=True))
    assert deep.acquisitions.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        intake.listed(spark, f"file://{tmp_path}/nothing").count()
