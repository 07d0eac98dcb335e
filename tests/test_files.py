"""Files of tensors: round trips and directed contents."""

import json

import pytest

from loomgrid.operators import formats, generate, stats
from loomgrid.sources import compressed, coordinates, results
from loomgrid.tensor import from_rows


def entries(t):
    return {tuple(r[:-1]): r[-1] for r in t.df.select(*t.modes, "val").collect()}


def test_mtx_symmetric_and_general(spark, tmp_path):
    d = tmp_path / "m"
    d.mkdir()
    (d / "sym.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n1 1 1.5\n2 1 2\n3 3 4\n")
    (d / "gen.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n2 5 1\n2 5 -7\n")
    got, shapes = coordinates.read_mtx(spark, f"{d}/*.mtx")
    assert sorted(tuple(r) for r in got.collect()) == [("gen", 1, 4, -7.0), ("sym", 0, 0, 1.5), ("sym", 0, 1, 2.0), ("sym", 1, 0, 2.0), ("sym", 2, 2, 4.0)]
    assert sorted(tuple(r) for r in shapes.collect()) == [("gen", 2, 5), ("sym", 3, 3)]
    s = {r["name"]: r for r in stats.corpus_stats(got, shapes).collect()}
    assert s["sym"]["nnz"] == 4 and s["sym"]["seg_size"] == 6 and s["gen"]["density"] == 0.1


def test_mtx_tns_round_trip(spark, tmp_path):
    t = generate.random_tensor(spark, ("i", "j"), (9, 11), 0.6, 5)
    coordinates.write_mtx(t, f"{tmp_path}/a.mtx")
    back = coordinates.read_one_mtx(spark, f"{tmp_path}/a.mtx", "long")
    assert entries(back) == entries(t) and back.shape == t.shape
    coordinates.write_tns(t, f"{tmp_path}/b.tns", write_shape=True)
    assert {k: v for k, v in entries(coordinates.read_tns(spark, f"{tmp_path}/b.tns", ("i", "j"), True)).items() if v} == entries(t)
    one = tmp_path / "c.tns"
    one.write_text("598 1\n")
    v = coordinates.read_tns(spark, str(one), ("i",))
    assert entries(v) == {(597,): 1.0} and v.shape == (598,)


@pytest.mark.parametrize("fmt,order", [("ss01", (0, 1)), ("ss10", (1, 0))])
def test_csf_files(spark, tmp_path, fmt, order):
    t = from_rows(spark, [(0, 0, 5), (0, 2, 6), (2, 1, 7)], ["i", "j"], (4, 3))
    compressed.write_csf(t, f"{tmp_path}/x", "B", fmt)
    assert entries(compressed.read_csf(spark, f"{tmp_path}/x", "B", ("i", "j"), order, value="long")) == entries(t)
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/x/tensor_B_mode_{order[1]}_seg").collect()]
    assert sorted(map(int, lines)) == ([0, 2, 3] if fmt == "ss01" else [0, 1, 2, 3])


@pytest.mark.parametrize("fmt", ["dcsr", "dcsc", "csr", "csc", "dense", "denseT"])
def test_combined(spark, tmp_path, fmt):
    t = from_rows(spark, [(0, 0, 5), (0, 2, 6), (2, 1, 7)], ["i", "j"], (4, 3))
    compressed.write_combined(t, f"{tmp_path}/f", fmt)
    levels = {"dcsr": "ss", "dcsc": "ss", "csr": "ds", "csc": "ds", "dense": "dd", "denseT": "dd"}[fmt]
    order = (1, 0) if fmt in ("dcsc", "csc", "denseT") else (0, 1)
    got = entries(compressed.read_combined(spark, f"{tmp_path}/f", ("i", "j"), levels, order, "long"))
    assert {k: v for k, v in got.items() if v} == entries(t)


def test_dump(spark, tmp_path):
    p = tmp_path / "d.txt"
    p.write_text("B (2x3) ({s,s}):\nlevel 0:\n  [0, 1]\n  [1]\nlevel 1:\n  [0, 2]\n  [0, 2]\n[5, 6]\n")
    dims, got = compressed.read_dump(spark, str(p), "ss")
    assert dims == [2, 3]
    assert sorted((r["level"], r["kind"], r["pos"], r["value"]) for r in got.collect() if r["kind"] != "seg") == [(0, "crd", 0, "1"), (1, "crd", 0, "0"), (1, "crd", 1, "2"), (2, "vals", 0, "5"), (2, "vals", 1, "6")]


def test_results(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,time\nx,1\ny,2\n")
    (tmp_path / "b.csv").write_text("name,time\nz,3\n")
    got = results.aggregate_csv(spark, f"{tmp_path}/*.csv").select("name", "time", "original_filename").collect()
    assert sorted((r["name"], r["time"], r["original_filename"][-5:]) for r in got) == [("x", "1", "a.csv"), ("y", "2", "a.csv"), ("z", "3", "b.csv")]
    (tmp_path / "r.json").write_text(json.dumps({"benchmarks": [{"name": "q", "group": "g", "stats": {"mean": 1.5}, "extra_info": {"nnz": 3}}]}))
    assert results.bench_json_to_table(spark, f"{tmp_path}/r.json").select("name", "mean", "nnz").first() == ("q", 1.5, 3)


def test_mtx_in_parts(spark, tmp_path):
    t = generate.random_tensor(spark, ("i", "j"), (40, 50), 0.2, 5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        coordinates.write_mtx(t, f"{tmp_path}/a.mtx")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    assert len([p for p in (tmp_path / "a.mtx").iterdir() if p.name.startswith("part-")]) == 8
    back = coordinates.read_one_mtx(spark, f"{tmp_path}/a.mtx", "long")
    assert entries(back) == entries(t) and back.shape == (40, 50)
    # the parts, one after another, are one file
    (tmp_path / "whole.mtx").write_text("".join(p.read_text() for p in sorted((tmp_path / "a.mtx").glob("part-*"))))
    assert entries(coordinates.read_one_mtx(spark, f"{tmp_path}/whole.mtx", "long")) == entries(t)
    with pytest.raises(ValueError):
        coordinates.read_one_mtx(spark, f"{tmp_path}/*.mtx")


def test_tns_rounds_but_keeps_what_is_stored(spark, tmp_path):
    (tmp_path / "f.tns").write_text("1 0.4\n2 1.6\n3 -0.3\n4 0\n")
    assert entries(coordinates.read_tns(spark, f"{tmp_path}/f.tns", ("i",), cast_int=True)) == {(0,): 1, (1,): 2, (2,): -1, (3,): 0}


@pytest.mark.parametrize("fmt", ["coo", "cooT"])
def test_coordinates_in_one_file(spark, tmp_path, fmt):
    t = from_rows(spark, [(0, 0, 5), (0, 2, 6), (2, 1, 7)], ["i", "j"], (4, 3))
    compressed.write_combined(t, f"{tmp_path}/f", fmt)
    back = compressed.read_coo(spark, f"{tmp_path}/f", ("i", "j"), fmt == "cooT", "long")
    assert entries(back) == entries(t) and back.shape == (4, 3)


@pytest.mark.parametrize("fmt", ["dsd012", "sdd120", "sds201", "ds10"])
def test_dense_and_compressed_levels(spark, tmp_path, fmt):
    """Arrays against plain loops over every position, and back."""
    n = len(fmt) // 2
    dims, modes, order = (4, 3, 5)[:n], ("i", "j", "k")[:n], [int(x) for x in fmt[n:]]
    rows = [r[:n] + r[3:] for r in [(0, 0, 1, 5), (0, 2, 0, 6), (0, 2, 4, 7), (3, 1, 1, 8)]]
    rows = list({r[:n]: r for r in rows}.values())
    t = from_rows(spark, rows, modes, dims)
    (at,) = compressed.write_tensor_inputs(t, f"{tmp_path}/x", (fmt,), shifted=False)
    read = lambda what: [int(r[0]) for r in coordinates.lines_in_order(spark, f"{at}/tensor_B_mode_{what}").orderBy("pos").select("value").collect()]
    nodes = [()]
    for kind, mode in zip(fmt, order, strict=False):
        held = {tuple(r[m] for m in order[: len(nodes[0]) + 1]) for r in rows} if nodes else set()
        children = [[(*p, c) for c in range(dims[mode]) if kind == "d" or (*p, c) in held] for p in nodes]
        if kind == "s":
            ends = [0]
            for c in children:
                ends.append(ends[-1] + len(c))
            assert read(f"{mode}_seg") == ends and read(f"{mode}_crd") == [x[-1] for c in children for x in c]
        nodes = [x for c in children for x in c]
    stored = {tuple(r[m] for m in order): r[-1] for r in rows}
    assert read("vals") == [stored.get(x, 0) for x in nodes]
    got = entries(compressed.read_levels(spark, at, "B", modes, fmt, value="long"))
    assert {k: v for k, v in got.items() if v} == entries(t)


def test_too_many_dense_positions(spark, tmp_path):
    t = from_rows(spark, [(0, 0, 1)], ["i", "j"], (10**6, 10**6))
    with pytest.raises(ValueError, match="positions"):
        compressed.write_csf(t, f"{tmp_path}/x", "B", "dd01")


def test_shifted_input_set_of_third_order(spark, tmp_path):
    t = from_rows(spark, [(0, 1, 4, 9), (2, 0, 0, 3)], ["i", "j", "k"], (4, 3, 5))
    first, second = compressed.write_tensor_inputs(t, f"{tmp_path}/x")
    assert entries(compressed.read_csf(spark, first, "B", ("i", "j", "k"), value="long")) == entries(t)
    assert set(entries(compressed.read_csf(spark, second, "C", ("i", "j", "k"), value="long"))) == {(0, 1, 0), (2, 0, 1)}


def test_numbers_of_base_16(spark, tmp_path):
    for name, lines in {"mode_0_seg": "0x0 2", "mode_0_crd": "0x0 1F", "mode_1_seg": "0 1 0x2", "mode_1_crd": "0xa 0", "mode_vals": "5 6", "mode_shape": "20 0x10"}.items():
        (tmp_path / f"tensor_B_{name}").write_text("\n".join(lines.split()))
    got = compressed.read_csf(spark, str(tmp_path), "B", ("i", "j"), base=16, value="long")
    assert entries(got) == {(0, 10): 5, (31, 0): 6} and got.shape == (32, 16)
    assert entries(compressed.read_levels(spark, str(tmp_path), "B", ("i", "j"), "ss01", 16, "long")) == entries(got)


def test_dump_as_compressed_fibers(spark, tmp_path):
    p = tmp_path / "d.txt"
    p.write_text("B (3x3) ({s,s}):\nlevel 0:\n  [0, 2]\n  [0, 2]\nlevel 1:\n  [0, 2, 3]\n  [0, 2, 1]\n[5, 6, 7]\n")
    dims, crd, seg, vals = compressed.dump_fibers(spark, str(p), "ss", "long")
    assert dims == [3, 3] and sorted(map(tuple, crd.collect())) == [(0, 0, 0, 0), (0, 1, 0, 2), (1, 0, 0, 0), (1, 1, 0, 2), (1, 2, 1, 1)]
    assert entries(formats.from_csf(crd, seg, vals, ("i", "j"))) == {(0, 0): 5, (0, 2): 6, (2, 1): 7}
    with pytest.raises(ValueError, match="dense"):
        compressed.dump_fibers(spark, str(p), "ds")
