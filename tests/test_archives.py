"""Archive source on a tiny fixture built in a scratch folder."""
import io
import os
import tarfile
import tempfile
import zipfile


def test_archive_members(spark):
    from pkgsieve.sources.archives import archive_corpus, archive_members

    d = tempfile.mkdtemp(prefix="pkgsieve-arch-")
    with tarfile.open(os.path.join(d, "a-1.0.tar.gz"), "w:gz") as tf:
        data = b'exec("x")\n'
        ti = tarfile.TarInfo("a-1.0/a/__init__.py")
        ti.size = len(data)
        tf.addfile(ti, io.BytesIO(data))
    with zipfile.ZipFile(os.path.join(d, "b-1.0-py3-none-any.whl"), "w") as zf:
        zf.writestr("b/setup.py", "print(1)\n")
    with open(os.path.join(d, "bad-1.0.tar.gz"), "wb") as f:
        f.write(b"not a tarball")
    m = archive_members(spark, d)
    rows = {(os.path.basename(r.archive), r.member, r.error is None) for r in m.collect()}
    assert ("a-1.0.tar.gz", "a-1.0/a/__init__.py", True) in rows
    assert ("b-1.0-py3-none-any.whl", "b/setup.py", True) in rows
    assert any(a == "bad-1.0.tar.gz" and not ok for a, _, ok in rows)
    assert archive_corpus(m).count() == 2


def test_small_archives_share_batches(monkeypatch):
    import pandas as pd

    from pkgsieve.sources import archives as A

    files = pd.DataFrame({"archive": [f"p{i}.whl" for i in range(30)], "member": [f"p/{i}.py" for i in range(30)],
                          "content": [f"x = {i}\n" for i in range(30)], "corrupt": [i == 5 for i in range(30)]})
    packed = list(A._pack([files]))
    found = list(A._explode(packed))
    assert len(found) == 1 and len(found[0]) == 30 and found[0]["error"].notna().sum() == 1
    monkeypatch.setattr(A, "BATCH_ROWS", 7)
    assert [len(f) for f in A._explode(packed)] == [7, 7, 7, 7, 2]
    assert pd.concat(A._explode(packed))["member"].tolist() == found[0]["member"].tolist()
