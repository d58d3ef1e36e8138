"""Tables of archives that several builds bring."""

import glob
import io
import zipfile

from dialspan.plans import build as B


def test_builds_of_many_archives(spark, tmp_path):
    rows, n = [], 12
    for i in range(n):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("App.log", f"2026-01-02 10:00:{i:02d}:000 [App] : Calling number: t{i}")
        rows.append((f"i{i:02d}", f"{i}.zip", out.getvalue()))
    archives = spark.createDataFrame(rows, "import_id string, archive string, content binary")
    target = str(tmp_path)
    B.build_into(spark, archives.where("import_id < 'i08'"), target)
    names = B.build_into(spark, archives.where("import_id > 'i03'"), target, again=True)
    # files follow rows, not archives
    assert all(len(glob.glob(f"{target}/{name}/**/*.parquet", recursive=True)) < n for name in names)
    # what was built again counts once, and a build that was lost before its end doesn't count
    B.read_tables(spark, target, names)["attempts"].write.parquet(f"{target}/attempts/build=b000000009-lost")
    tables = B.read_tables(spark, target, names)
    assert sorted(r.import_id for r in tables["attempts"].collect()) == sorted(r.import_id for r in tables["files"].collect()) == [r[0] for r in rows]
    # the rest is left out, as it was built
    built = len(glob.glob(f"{target}/built/*"))
    B.build_into(spark, archives, target)
    assert B.read_tables(spark, target, ["attempts"])["attempts"].count() == n and len(glob.glob(f"{target}/built/*")) == built + 1
