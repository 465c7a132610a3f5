import os

from loamline.sources import vault
from tests.notes import write


def test_scan(spark, tmp_path):
    write(tmp_path, {n: "x" for n in ("_d.md", ".h.md", "_dir/x.md", ".git/x.md", "z.MD", "n.py", "a/node_modules/q.md", "t.txt", "deep/er/m.mdx")})
    (tmp_path / ".md").write_text("x")
    os.symlink(tmp_path / "t.txt", tmp_path / "link.txt")
    (tmp_path / "bad.md").write_bytes(b"ok \xff\xfe text")
    rows = {r.relative_path: r for r in vault.read(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [".h.md", "_d.md", "_dir/x.md", "bad.md", "deep/er/m.mdx", "t.txt", "z.MD"]
    assert rows["bad.md"].raw == b"ok \xff\xfe text" and rows["t.txt"].mtime is not None


def test_bad_bytes_are_read(spark, tmp_path):
    from loamline.operators import corpus

    (tmp_path / "bad.md").write_bytes(b"# T\n\nok \xff text")
    assert corpus.documents(vault.read(spark, str(tmp_path))).first().title == "T"


def test_empty_folder(spark, tmp_path):
    assert vault.read(spark, str(tmp_path)).count() == 0
