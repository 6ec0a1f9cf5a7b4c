import io
import zipfile

from lodestone.sources import files, trees


def pack(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in entries:
            z.writestr(name, data)


def test_listing_equals_the_folder(spark, tmp_path):
    for name, text in {"a/b/c.java": "x", "a/empty": "", "top.txt": "12345", "a/b/d/e/f/g": "y"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "hollow").mkdir()
    got = {(r.path, r.dir, r.basename, r["size"]) for r in trees.listing(spark, str(tmp_path)).collect()}
    assert got == {("a/b/c.java", "a/b", "c.java", 1), ("a/empty", "a", "empty", 0), ("top.txt", "", "top.txt", 5), ("a/b/d/e/f/g", "a/b/d/e/f", "g", 1)}
    assert {(r.project, r.path) for r in trees.listing(spark, f"file://{tmp_path}", "p").collect()} == {("p", x[0]) for x in got}
    assert {(r.path, r.size) for r in files.inventory(spark, str(tmp_path)).collect()} == {(x[0], x[3]) for x in got}
    read = {r.path: (r.text, len(r.hash)) for r in trees.read(trees.listing(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert read["top.txt"] == ("12345", 64) and read["a/empty"] == ("", 64)


def test_archives_are_unpacked_by_many_tasks_and_judged_by_their_sums(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "CHUNK_BYTES", 50)
    good = [("root/", ""), *[(f"root/d{i % 3}/f{i}.txt", f"text {i}é") for i in range(40)]]
    cases = {
        "good": good, "flat": [("a.txt", "1"), ("b/c.txt", "2")], "out": [("../x", "1")], "slash": [("/x", "1")], "blank": [(" ", "1")], "deep": [("a/b/c/d/e", "1")],
        "many": [(f"f{i}", "1") for i in range(60)], "much": [("f", "1" * 3000)], "sum": [(f"f{i}", "1" * 400) for i in range(6)], "in": [("a/../b.txt", "1")],
    }
    rows = []
    for name, what in cases.items():
        pack(tmp_path / f"{name}.zip", what)
        rows.append((name, str(tmp_path / f"{name}.zip")))
    twice = io.BytesIO()
    with zipfile.ZipFile(twice, "w") as z:
        z.writestr("x", "1")
        z.writestr("x", "2")
    (tmp_path / "twice.zip").write_bytes(twice.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "none.zip").write_bytes(b"")
    (tmp_path / "good.tar").write_bytes((tmp_path / "good.zip").read_bytes())
    damaged = bytearray((tmp_path / "flat.zip").read_bytes())
    damaged[damaged.index(b"a.txt") + 5] ^= 1  # the stored byte, not its checksum
    (tmp_path / "damaged.zip").write_bytes(bytes(damaged))
    rows += [(n, str(tmp_path / f"{n}.zip")) for n in ("twice", "bad", "none", "damaged", "gone")] + [("tar", str(tmp_path / "good.tar"))]
    archives = spark.createDataFrame(rows, "project string, archive string")
    found, judged = trees.unpacked(archives, max_bytes=2000, max_entries=50, max_depth=4)
    faults = {r.project: r.fault for r in judged.collect()}
    assert {k for k, v in faults.items() if v is None} == {"good", "flat", "in"}
    assert faults["out"] == faults["slash"] == faults["blank"] == "entry outside the folder" and faults["deep"] == faults["twice"] == "too deep, or twice"
    assert faults["many"] == "too many entries" and faults["much"] == faults["sum"] == "too much when unpacked" and faults["tar"] == "not a .zip file" and faults["none"] == "empty or too large"
    got = {(r.project, r.path): bytes(r.content).decode() for r in found.collect()}
    want = {("good", name.removeprefix("root/")): text for name, text in good[1:]} | {("flat", "a.txt"): "1", ("flat", "b/c.txt"): "2"}
    assert {k: v for k, v in got.items() if k[0] != "in"} == want
