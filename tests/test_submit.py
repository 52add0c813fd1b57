"""The workloads from configuration files: inputs, keywords, resumed runs, CSV files."""

import json

import pytest
from test_workloads import NC, TD, long, sample

from netloom.jobs import submit
from netloom.jobs import workloads as wl
from netloom.operators.qc import QcParams
from netloom.sources import mtx

QC = {"min_lib_size": 3, "remove_outlier_cells": False, "min_percent": 0.05}
TD_KWS = {"K": TD["rank"], "max_iter": TD["max_iter"], "n_decimal": TD["decimals"], "method": "parafac", "random_state": 42}
NAMES = [f"g{i:02d}" for i in range(12)]


def write_wide(path, seed, sep=","):
    x = sample(seed, NAMES)
    cells = [f"c{j:02d}" for j in range(x.shape[1])] + ["c99"]
    rows = [sep.join(["gene", *cells]), *(sep.join([g, *(str(v) for v in x[i]), "0"]) for i, g in enumerate(NAMES)), sep.join(["rare", *["0"] * (len(cells) - 1), "50"])]
    path.write_text("\n".join(rows) + "\n")
    return x


def values(df):
    return {r["Gene"]: round(r["Distance"], 6) for r in df.collect()}


class Begun(Exception):
    """Raised in place of a step."""


def first_step(monkeypatch, run):
    """The step that a run would begin with."""

    def begin(spark, folder, step, *rest, **keywords):
        raise Begun(step)

    with monkeypatch.context() as m:
        m.setattr(submit, "run_step", begin)
        with pytest.raises(Begun) as begun:
            run()
    return str(begun.value)


def test_net_from_a_file(spark, tmp_path, capsys, monkeypatch):
    samples = [write_wide(tmp_path / "x.tsv", 4, "\t"), write_wide(tmp_path / "y.csv", 5)]
    config = {"x_data_path": str(tmp_path / "x.tsv"), "y_data_path": str(tmp_path / "y.csv"), "x_label": None, "y_label": "late", "qc_kws": QC, "nc_kws": NC | {"n_cpus": -1, "random_state": 42}, "td_kws": TD_KWS, "ma_kws": {"d": 2, "tol": 1e-8}, "dr_kws": {"sorted_by": "p-value", "ascending": True}}
    (tmp_path / "net.json").write_text(json.dumps(config))
    out = str(tmp_path / "out")
    submit.main(["net", "--config", str(tmp_path / "net.json"), "--output", out])
    assert "steps run: qc nc td ma dr" in capsys.readouterr().out
    pair = long(spark, [("X", NAMES, samples[0]), ("late", NAMES, samples[1])])
    want = values(wl.net(pair, QcParams(**QC), nc=NC, td=TD, ma={"d": 2}, y="late"))
    run = lambda **changes: submit.run(spark, "net", config | changes, out)
    table, ran = run()
    assert ran == [] and values(table) == want
    assert values(mtx.read_csv(spark, f"{out}/csv", "dr")) == want
    manifold = {(r.side, r.gene): r.coords for r in mtx.read_csv(spark, f"{out}/csv", "ma").collect()}
    assert manifold == {(r.side, r.gene): r.coords for r in mtx.read_step(spark, out, "ma")[0].collect()}
    table, ran = run(ma_kws={"d": 3})  # a step that changed, and those after it
    assert ran == ["ma", "dr"] and values(table) != want
    (tmp_path / "out" / "manifest" / "td" / "_SUCCESS").unlink()  # a step that wasn't finished
    assert first_step(monkeypatch, lambda: run(ma_kws={"d": 3})) == "td"
    assert first_step(monkeypatch, lambda: run(nc_kws=NC | {"q": 0.5})) == "nc"
    write_wide(tmp_path / "y.csv", 6)
    assert first_step(monkeypatch, run) == "qc"


def test_knk_from_a_folder(spark, tmp_path, monkeypatch):
    yaml = pytest.importorskip("yaml")
    x = sample(3, NAMES)
    folder = tmp_path / "data"
    folder.mkdir()
    lines = [f"{i + 1} {j + 1} {x[i, j]}" for i in range(12) for j in range(30) if x[i, j]] + ["13 31 50"]
    (folder / "matrix.mtx").write_text("%%comment\n" + f"13 31 {len(lines)}\n" + "\n".join(lines) + "\n")
    (folder / "genes.tsv").write_text("\n".join([*NAMES, "rare"]) + "\n")
    (folder / "barcodes.tsv").write_text("\n".join([*(f"c{j:02d}" for j in range(30)), "c99"]) + "\n")
    config = {"data_path": str(folder), "ko_genes": ["g01"], "ko_method": "default", "strict_lambda": 0, "qc_kws": QC | {"min_exp_avg": 0, "min_exp_sum": 0}, "nc_kws": NC, "td_kws": TD_KWS, "ma_kws": {}, "dr_kws": {"sorted_by": ["p-value", "Z"], "ascending": [True, False]}}
    (tmp_path / "knk.yml").write_text(yaml.safe_dump(config))
    table, ran = submit.run(spark, "knk", submit.read_config(spark, str(tmp_path / "knk.yml")), str(tmp_path / "out"))
    assert ran == ["qc", "nc", "td", "ko", "ma", "dr"]
    assert values(table) == values(wl.knk(long(spark, [("WT", NAMES, x)]), ["g01"], qc=QcParams(**QC), nc=NC, td=TD))
    assert first_step(monkeypatch, lambda: submit.run(spark, "knk", config | {"ko_genes": ["g02"]}, str(tmp_path / "out"))) == "ko"
    spread = submit.step_keywords("knk", config | {"ko_method": "propagation", "strict_lambda": 1, "ko_kws": {"degree": 3}})
    assert spread["ko"] == {"degree": 3, "ko_genes": ["g01"], "method": "propagation", "strict": 1, "nc": NC, "td": spread["ko"]["td"]} and spread["td"]["strict"] == 1


@pytest.mark.parametrize("config", [{"qc_kws": {"none": 1}}, {"other": 1}, {"td_kws": {"method": "tucker"}}, {}])
def test_bad_configurations(spark, config):
    with pytest.raises(ValueError):
        submit.run(spark, "net", config, "/nowhere")
    with pytest.raises(ValueError):
        submit.run(spark, "other", config, "/nowhere")


def test_complex_coordinates_in_csv(spark, tmp_path):
    rows = [("X", "a_b", [1.5, -2e-9], [0.25, -3e-7]), ("Y", "a_b", [0.0, 4.0], [0.0, 0.0])]
    df = spark.createDataFrame(rows, "side string, gene string, coords array<double>, coords_im array<double>")
    mtx.write_csv(df, str(tmp_path), "ma")
    assert sorted(map(tuple, mtx.read_csv(spark, str(tmp_path), "ma").collect())) == sorted(rows)
    with pytest.raises(ValueError):
        mtx.write_csv(df, str(tmp_path), "qc")
