import base64
import json
import struct
import zlib

import numpy as np
import pytest

from pointlake.schema import ParticleSchema
from pointlake.sources import binary, text, xml


def test_xyz(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("4\ntitle\n# note\nFe 1 2 3\nC 4 5 6\n\nFe 7 8 9\n#\nH 0 0 1.5\nBeyond 9 9 9\n")
    df = text.read_xyz(spark, str(tmp_path / "a.xyz"))
    assert [tuple(r) for r in df.orderBy("pid").collect()] == [(0, 1, 2, 3, 0, "Fe"), (1, 4, 5, 6, 1, "C"), (2, 7, 8, 9, 0, "Fe"), (3, 0, 0, 1.5, 2, "H")]
    text.write_xyz(df.repartition(3), str(tmp_path / "out"))
    joined = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("*/part-*")))
    (tmp_path / "joined.xyz").write_text(joined)
    assert text.read_xyz(spark, str(tmp_path / "joined.xyz")).orderBy("pid").collect() == df.orderBy("pid").collect()
    many = spark.range(5000).selectExpr("id AS pid", "float(id) AS x", "float(1) AS y", "float(-id) AS z", "concat('T', id % 7) AS type")
    text.write_xyz(many, str(tmp_path / "many"))
    assert text.read_xyz_parts(spark, str(tmp_path / "many")).orderBy("pid").collect() == many.collect()


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"points": [1, 2, 3, 4, 5, 6], "attribs": [{"name": "t", "data": [0.5, 1.5]}, {"name": "u", "data": [7, 8]}]}))
    path = str(tmp_path / "a.json")
    assert [tuple(r) for r in text.read_json(spark, path).orderBy("pid").collect()] == [(0, 1, 2, 3, 0.5), (1, 4, 5, 6, 1.5)]
    assert text.read_json(spark, path, "u").columns[-1] == "u"
    (tmp_path / "none.json").write_text(json.dumps({"points": [], "attribs": [{"name": "t", "data": []}]}))
    assert text.read_json(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(KeyError):
        text.read_json(spark, path, "nope")


@pytest.mark.parametrize("rows", [1 << 22, 37])
def test_bp_round_trip(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(binary, "RANGE_ROWS", rows)
    monkeypatch.setattr(binary, "by_rows", lambda n: [(i, min(rows, n - i), 0, "") for i in range(0, n, rows)])
    df = spark.createDataFrame([(i, i / 2, 1.0, -i / 4, i, i * 1.25) for i in range(1000)], "pid long, x double, y double, z double, a int, b double").repartition(3)
    schema = ParticleSchema.of(df)
    made = binary.write_bp(df, str(tmp_path / "bp"), schema).collect()
    assert sum(r.rows for r in made) == 1000 and len(made) == 3
    back = binary.read_bp(spark, str(tmp_path / "bp" / "*.bp"))
    assert sorted((r.x, r.y, r.z, r.a, r.b) for r in back.collect()) == sorted((r.x, r.y, r.z, r.a, r.b) for r in df.collect())
    assert len({(r.file, r.pid) for r in back.collect()}) == 1000


def test_long_headers_and_files_beyond_two_gigabytes(spark, tmp_path):
    """A header of more than a mebibyte, and rows far behind the reach of one array, in a file with a hole."""
    n, far = 3, (1 << 31) + 4096
    head = {"num_points": n, "note": "x" * (1 << 21), "attributes": [{"name": "a", "dtype": "INT_32", "offset": far, "size": 4 * n}]}
    raw = json.dumps(head).encode()
    with open(tmp_path / "a.bp", "wb") as out:
        out.write(struct.pack("<Q", len(raw)) + raw + np.arange(9, dtype="<f4").tobytes())
        out.seek(8 + len(raw) + far)
        out.write(np.array([7, 8, 9], "<i4").tobytes())
    assert [tuple(r)[1:] for r in binary.read_bp(spark, str(tmp_path / "a.bp")).orderBy("pid").collect()] == [(0, 0, 1, 2, 7), (1, 3, 4, 5, 8), (2, 6, 7, 8, 9)]
    with open(tmp_path / "a.bp", "r+b") as out:
        out.truncate(8 + len(raw) + far + 8)
    with pytest.raises(Exception, match="ends before"):
        binary.read_bp(spark, str(tmp_path / "a.bp")).collect()


def test_cosmo(spark, tmp_path):
    rows = np.arange(24, dtype="<f4").reshape(4, 6)
    head = struct.pack("<i3fi3f3if", 4, 1, 2, 3, 5, 1, 2, 3, 1, 2, 3, 9.0)
    (tmp_path / "0.000xv120.dat").write_bytes(head + rows.tobytes())
    got = binary.read_cosmo(spark, str(tmp_path / "*.dat")).orderBy("pid").collect()
    assert len(got) == 4 and (got[0].x, got[0].y, got[0].z, got[0].v_z) == (768, 1 + 1536, 2, 5)


def test_las(spark, tmp_path):
    n, size = 3, 26
    head = bytearray(227)
    head[:4] = b"LASF"
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<BHI", head, 104, 2, size, n)
    struct.pack_into("<12d", head, 131, 0.1, 0.1, 0.1, 5, 5, 5, 15, 5, 15, 5, 15, 5)
    body = b"".join(struct.pack("<iiiHBBbBH3H", 10 * i, 20 * i, 0, 0, 0, c, 0, 0, 0, 65535, 0, 32768) for i, c in enumerate((2, 7, 6)))
    (tmp_path / "a.las").write_bytes(bytes(head) + body)
    got = binary.read_las(spark, str(tmp_path / "a.las")).orderBy("pid").collect()
    assert [(r.pid, r.classification) for r in got] == [(0, 2), (2, 6)] and abs(got[1].x - (2 + 5 - 10)) < 1e-6 and got[0].r == 1.0 and abs(got[0].b - 0.2140) < 1e-3
    assert binary.read_las(spark, str(tmp_path / "a.las"), True).count() == 3


@pytest.mark.parametrize("order", ["<", ">"])
def test_uda(spark, tmp_path, order):
    p, t = np.arange(9.0).reshape(3, 3), np.array([7, 8, 9])
    raw = p.astype(f"{order}f8").tobytes() + t.astype(f"{order}i8").tobytes() + p.astype(f"{order}f8").tobytes()
    (tmp_path / "l0").mkdir()
    (tmp_path / "l0" / "p0.data").write_bytes(raw)
    var = lambda kind, name, a, b, n: f'<Variable type="ParticleVariable<{kind}>"><variable>{name}</variable><filename>p0.data</filename><start>{a}</start><end>{b}</end><patch>0</patch><numParticles>{n}</numParticles></Variable>'.replace("<Point>", "&lt;Point&gt;").replace("<long64>", "&lt;long64&gt;").replace("<Matrix3>", "&lt;Matrix3&gt;")
    (tmp_path / "l0" / "p0.xml").write_text("<Uintah_Output>" + var("Point", "p.x", 0, 72, 3) + var("long64", "p.id", 72, 96, 3) + var("Matrix3", "p.m", 96, 168, 3) + "</Uintah_Output>")
    (tmp_path / "timestep.xml").write_text(f"<Uintah_timestep><Meta><endianness>{'little' if order == '<' else 'big'}_endian</endianness></Meta><Data><Datafile href='l0/p0.xml'/></Data></Uintah_timestep>")
    got = xml.read_uda(spark, str(tmp_path / "timestep.xml")).orderBy("pid").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 1, 2, 7), (1, 0, 3, 4, 5, 8), (2, 0, 6, 7, 8, 9)]


def test_vtu(spark, tmp_path):
    p, a, v = np.arange(6, dtype="<f4"), np.array([3, 4], "<i4"), np.arange(4, dtype="<f8")
    inline = lambda x: base64.b64encode(struct.pack("<I", x.nbytes) + x.tobytes()).decode()
    doc = lambda pts, one, two, tail, attrs="": f'<VTKFile type="UnstructuredGrid" byte_order="LittleEndian" header_type="UInt32"{attrs}><UnstructuredGrid><Piece NumberOfPoints="2" NumberOfCells="0"><PointData><DataArray type="Int32" Name="a" {one}</DataArray><DataArray type="Float64" Name="v" NumberOfComponents="2" {two}</DataArray></PointData><Points><DataArray type="Float32" NumberOfComponents="3" {pts}</DataArray></Points></Piece></UnstructuredGrid>{tail}</VTKFile>'
    ascii_ = doc('format="ascii">0 1 2 3 4 5', 'format="ascii">3 4', 'format="ascii">0 1 2 3', "").encode()
    base = doc(f'format="binary">{inline(p)}', f'format="binary">{inline(a)}', f'format="binary">{inline(v)}', "").encode()
    raw, at = b"", []
    for x in (p, a, v):
        at.append(len(raw))
        raw += struct.pack("<I", x.nbytes) + x.tobytes()
    app = doc(*[f'format="appended" offset="{o}">' for o in at], '<AppendedData encoding="raw">_@@</AppendedData>').encode().replace(b"@@", raw)
    packed = lambda x: base64.b64encode(struct.pack("<IIII", 1, x.nbytes, 0, len(z := zlib.compress(x.tobytes())))).decode() + base64.b64encode(z).decode()
    small = doc(f'format="binary">{packed(p)}', f'format="binary">{packed(a)}', f'format="binary">{packed(v)}', "", ' compressor="vtkZLibDataCompressor"').encode()
    for i, content in enumerate((ascii_, base, app, small)):
        (tmp_path / f"{i}.vtu").write_bytes(content)
        got = xml.read_vtu(spark, str(tmp_path / f"{i}.vtu")).orderBy("pid").collect()
        assert [tuple(r)[1:] for r in got] == [(0, 0, 1, 2, 3, 0, 1), (1, 3, 4, 5, 4, 2, 3)]


def tree_bytes(parts, extra=None):
    """A tree file of treelets (points, values) with one inner node over two leaves each."""
    info = {"num_nodes": 1, "num_treelets": len(parts), "bitmap_dict_size": 1, "num_points": sum(len(p) for p, _ in parts), "num_lod_prims": 2, "min_lod": 1, "max_lod": 2, "attributes": [{"name": "a", "dtype": 5, "range": [0, 1]}], **(extra or {})}
    coarse = bytes(16) + b"@" * 8 * len(parts) + bytes(4) + bytes(2) + bytes(8 if extra else 0)
    blobs, offsets, at = [], [], len(coarse)
    for points, values in parts:
        pad = -at % 4096
        n = len(points)
        half = 2 + (n - 2) // 2
        nodes = struct.pack("<9I", 0, 2 << 2 | 0, 0, 2, half - 2 << 2 | 3, 0xFFFFFFFF, half, n - half << 2 | 3, 0xFFFFFFFF)
        blob = struct.pack("<II", 3, n) + nodes + bytes(3 * (2 + (8 if extra else 0))) + points.astype("<f4").tobytes() + values.astype("<i4").tobytes()
        offsets.append(at + pad)
        blobs.append(bytes(pad) + blob)
        at += pad + len(blob)
    head = json.dumps(info).encode()
    start = 8 + len(head)
    coarse = coarse.replace(b"@" * 8 * len(parts), struct.pack(f"<{len(parts)}Q", *offsets))
    return struct.pack("<Q", len(head)) + head + bytes(-start % 4096) + coarse + b"".join(blobs)


@pytest.mark.parametrize("extra", [None, {"has_ranges": True}])
def test_tree_files(spark, tmp_path, extra):
    from pointlake.sources import tree

    rng = np.random.default_rng(0)
    parts = [(rng.random((n, 3)).astype(np.float32), np.arange(n) + 100 * n) for n in (7, 12)]
    (tmp_path / "run0.bat").write_bytes(tree_bytes(parts, extra))
    (tmp_path / "run2.bat").write_bytes(tree_bytes(parts[:1], extra))
    head = json.dumps({"bat_prefix": "run", "num_aggregators": 3}).encode()
    (tmp_path / "all.pbat").write_bytes(struct.pack("<Q", len(head)) + head)
    got = tree.open_tree(spark, str(tmp_path / "run0.bat")).orderBy("pid").collect()
    want = [(t, *map(float, p), int(v)) for t, (points, values) in enumerate(parts) for p, v in zip(points, values)]
    assert [(r.treelet, r.x, r.y, r.z, r.a) for r in got] == want
    assert [r.lod_level for r in got[:7]] == [0, 0, 1, 1, 1, 1, 1]
    assert tree.open_tree(spark, str(tmp_path / "all.pbat")).count() == 26
    # a header that lists its subfiles: others of that name are not read, and those without rows have no file
    nodes = struct.pack("<fI", 0.5, 2 << 2) + struct.pack("<II", 0, 3) + struct.pack("<II", 1, 3)
    head = json.dumps({"bat_prefix": "run", "num_aggregators": 2, "num_nodes": 3}).encode()
    (tmp_path / "some.pbat").write_bytes(struct.pack("<Q", len(head)) + head + nodes)
    assert tree.open_tree(spark, str(tmp_path / "some.pbat")).count() == 19


def test_convert_by_extension(spark, tmp_path):
    from pointlake.operators.convert import convert, read_any
    from pointlake.operators.table import ParticleTable
    from pointlake.plans.query import QuerySpec

    (tmp_path / "a.xyz").write_text("2\ntitle\nFe 1 2 3\nC 4 5 6\n")
    assert convert(spark, str(tmp_path / "a.xyz"), str(tmp_path / "t")).rows == 2
    assert ParticleTable.open(spark, str(tmp_path / "t")).query(QuerySpec()).columns == ["pid", "x", "y", "z", "atom_id", "type"]
    rng = np.random.default_rng(0)
    for i, n in enumerate((7, 12)):
        (tmp_path / f"run{i}.bat").write_bytes(tree_bytes([(rng.random((n, 3)).astype(np.float32), np.arange(n))]))
    assert convert(spark, str(tmp_path / "run*.bat"), str(tmp_path / "u"), {"bytesPerSubfile": 64}).rows == 19
    assert sorted(r.pid for r in ParticleTable.open(spark, str(tmp_path / "u")).query(QuerySpec()).collect()) == list(range(19))
    with pytest.raises(ValueError):
        read_any(spark, "x.laz")


def found_in_tree(raw, lower, upper):
    """Rows of a tree file in a closed box, by its planes alone: those of its coarse nodes and of its treelets."""
    n = struct.unpack_from("<Q", raw)[0]
    info = json.loads(raw[8 : 8 + n])
    base = -(-(8 + n) // 4096) * 4096
    offsets = np.frombuffer(raw, "<u8", info["num_treelets"], base + 16 * info["num_nodes"])
    attrs, out, todo, seen = len(info["attributes"]), [], [("node", 0)], set()
    while todo:
        kind, i = todo.pop()
        if kind == "node":
            link, position, axis = struct.unpack_from("<QfI", raw, base + 16 * i)
            if lower[axis] < position:
                todo.append(("leaf" if link & 1 else "node", link >> 2))
            if upper[axis] >= position:
                todo.append(("leaf" if link & 2 else "node", (link >> 2) + 1))
            continue
        assert i not in seen
        seen.add(i)
        at = base + int(offsets[i])
        nodes, rows = struct.unpack_from("<II", raw, at)
        kd = np.frombuffer(raw, "<u4", 3 * nodes, at + 8).reshape(nodes, 3)
        points = np.frombuffer(raw, "<f4", 3 * rows, at + 8 + nodes * (12 + 2 * attrs)).reshape(rows, 3)
        below = [0]
        while below:
            j = below.pop()
            first, word, shown = (int(v) for v in kd[j])
            mine = range(first, first + (word >> 2)) if word & 3 == 3 else range(shown, shown + info["num_lod_prims"])
            out += [tuple(map(float, points[k])) for k in mine if all(lower[a] <= points[k, a] <= upper[a] for a in range(3))]
            if word & 3 != 3:
                position, axis = float(kd[j, :1].view("<f4")[0]), word & 3
                below += [j + 1] * bool(lower[axis] < position) + [word >> 2] * bool(upper[axis] >= position)
    return sorted(out)


SHAPES = {
    "one row": lambda rng: np.array([[1.0, 2.0, 3.0]]),
    "one place": lambda rng: np.tile([[1.0, 2.0, 3.0]], (700, 1)),
    "few": lambda rng: rng.random((40, 3)),
    "planar": lambda rng: np.hstack([rng.random((3000, 2)), np.zeros((3000, 1))]),
    "many": lambda rng: rng.normal(size=(6000, 3)),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_trees_are_found_by_their_planes(shape):
    from pointlake.sources import tree_writer

    rng = np.random.default_rng(5)
    points = SHAPES[shape](rng).astype(np.float32)
    values = rng.integers(0, 1000, len(points))
    raw, about = tree_writer.encoded(points, np.arange(len(points)), {"a": ("INT_32", values), "b": ("FLOAT_64", values / 8)})
    assert about["rows"] == len(points) and about["lo"] == [values.min(), values.min() / 8]
    boxes = [(points.min(axis=0), points.max(axis=0))] + [tuple(np.sort(rng.choice(points, 2, axis=0) if len(points) > 1 else np.repeat(points, 2, axis=0), axis=0)) for _ in range(5)]
    for lower, upper in boxes:
        want = sorted(tuple(map(float, p)) for p in points if (p >= lower).all() and (p <= upper).all())
        assert found_in_tree(raw, lower, upper) == want


def test_aggregates_round_trip(spark, tmp_path):
    from pointlake.sources import tree, tree_writer

    rng = np.random.default_rng(2)
    points = np.vstack([rng.random((4000, 3)), rng.normal(5, 0.1, (4000, 3))]).astype(np.float32)
    df = spark.createDataFrame([(i, *map(float, p), i % 97, i / 4, -i) for i, p in enumerate(points)], "pid long, x float, y float, z float, a int, b double, c long")
    schema = ParticleSchema.of(df)
    count = tree_writer.write_trees(df, str(tmp_path), schema, "run", 900 * schema.bytes_per_row())
    back = tree.open_tree(spark, str(tmp_path / "run.pbat"))
    assert count > 4 and back.columns == ["file", "pid", "treelet", "lod_level", "x", "y", "z", "a", "b", "c"]
    row = lambda r: (r.x, r.y, r.z, r.a, r.b, r.c)
    assert sorted(map(row, back.collect())) == sorted(map(row, df.collect()))
    assert {r.lod_level for r in back.select("lod_level").distinct().collect()} >= {0, 1}
    # planes of the header separate the files: a box is in those that its planes lead to
    raw = (tmp_path / "run.pbat").read_bytes()
    n = struct.unpack_from("<Q", raw)[0]
    info = json.loads(raw[8 : 8 + n])
    for _ in range(10):
        lower, upper = np.sort(rng.choice(points, 2, axis=0), axis=0)
        todo, found = [0], []
        while todo:
            j = todo.pop()
            position, word = struct.unpack_from("<fI", raw, 8 + n + 8 * j)
            if word & 3 == 3:
                found += found_in_tree((tmp_path / f"run{struct.unpack_from('<I', raw, 8 + n + 8 * j)[0]}.bat").read_bytes(), lower, upper)
            else:
                todo += [j + 1] * bool(lower[word & 3] < position) + [word >> 2] * bool(upper[word & 3] >= position)
        assert sorted(found) == sorted(tuple(map(float, p)) for p in points if (p >= lower).all() and (p <= upper).all())
    at, words = 8 + n + 8 * info["num_nodes"], info["bitmap_dict_size"]
    used = np.frombuffer(raw, "<u4", words, at)[np.frombuffer(raw, "<u2", 3 * info["num_nodes"], at + 4 * words)].reshape(-1, 3)
    assert used[0].tolist() == [0xFFFFFFFF] * 3 and info["num_points"] == 8000
    assert tree_writer.write_trees(df.limit(0), str(tmp_path / "none"), schema) == 0
