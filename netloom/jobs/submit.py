"""The workloads from a configuration file, for ``spark-submit``:

    spark-submit netloom/jobs/submit.py net --config net.yml --output <folder>
    spark-submit netloom/jobs/submit.py knk --config knk.yml --output <folder>

The file holds the inputs (``x_data_path``, ``y_data_path``, ``x_label``, ``y_label``, or ``data_path``, ``ko_genes``, ``ko_method``,
``strict_lambda``) and the keywords of each step (``qc_kws``, ``nc_kws``, ``td_kws``, ``ko_kws``, ``ma_kws``, ``dr_kws``), as YAML or JSON. An input is a headed table of
genes by cells or a folder of matrix, gene and barcode files. Every step writes its table under the output folder and then notes in
``manifest`` what it was made from; a run skips the steps whose note is the same and goes on with the first that differs.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys

if __name__ == "__main__":  # the folder that holds the package
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.jobs.workloads import run_step
from netloom.sources import mtx
from netloom.sources.tables import expression_table
from netloom.storage import children, listing

#: Keywords of the steps by their names in a configuration, and ours. None: accepted without a meaning here.
KEYWORDS = {
    "qc": {k: k for k in ("min_lib_size", "remove_outlier_cells", "min_percent", "max_mito_ratio", "min_exp_avg", "min_exp_sum", "quartile_accuracy")} | {"plot": None},
    "nc": {k: k for k in ("n_nets", "n_samp_cells", "n_comp", "scale_scores", "symmetric", "q")} | {"random_state": "seed", "n_cpus": None},
    "td": {"K": "rank", "tol": "tol", "max_iter": "max_iter", "n_decimal": "decimals", "random_state": "seed", "method": None},
    "ko": {"degree": "degree"},
    "ma": {"d": "d", "tol": "tol"},
    "dr": {"sorted_by": "sorted_by", "ascending": "ascending", "n_ko_genes": "n_ko_genes", "lmbda": "lmbda"},
}
INPUTS = {"net": ("x_data_path", "y_data_path", "x_label", "y_label"), "knk": ("data_path", "label", "ko_genes", "ko_method", "strict_lambda")}
STEPS = {"net": ("qc", "nc", "td", "ma", "dr"), "knk": ("qc", "nc", "td", "ko", "ma", "dr")}


def read_config(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON file from any file system that Spark reads."""
    (row,) = spark.read.text(path, wholetext=True).collect()
    try:
        return json.loads(row[0])
    except json.JSONDecodeError:
        try:
            import yaml
        except ModuleNotFoundError as missing:
            raise ValueError(f"{path} isn't JSON, and YAML can't be read here") from missing
        return yaml.safe_load(row[0])


def step_keywords(kind: str, config: dict) -> dict[str, dict]:
    """Our keywords of each step of a run of ``kind``; names that no step has, and values that can't be met, raise."""
    if unknown := set(config) - set(INPUTS[kind]) - {f"{s}_kws" for s in STEPS[kind]}:
        raise ValueError(f"unknown in the configuration: {sorted(unknown)}")
    out = {}
    for step in STEPS[kind]:
        given, names = config.get(f"{step}_kws") or {}, KEYWORDS[step]
        if unknown := set(given) - set(names):
            raise ValueError(f"unknown in {step}_kws: {sorted(unknown)}")
        out[step] = {names[k]: v for k, v in given.items() if names[k]}
    if (config.get("td_kws") or {}).get("method", "parafac") != "parafac":
        raise ValueError("only parafac is built")
    if kind == "knk":
        strict, method = config.get("strict_lambda") or 0, config.get("ko_method") or "default"
        if method not in ("default", "propagation"):
            raise ValueError(f"unknown knockout method: {method}")
        out["td"]["strict"] = strict
        own = {k: v for k, v in out["td"].items() if k != "strict"}
        out["ko"] |= {"ko_genes": list(config.get("ko_genes") or []), "method": method} | ({"strict": strict, "nc": out["nc"], "td": own} if method == "propagation" else {})
    return out


def labels_of(kind: str, config: dict) -> tuple[str, ...]:
    return (config.get("x_label") or "X", config.get("y_label") or "Y") if kind == "net" else (config.get("label") or "WT",)


def read_input(spark: SparkSession, path: str, label: str) -> DataFrame:
    """Entries of a folder of matrix files, or of a headed table."""
    if any("matrix" in name for name in children(spark, path)):
        return mtx.read_folder(spark, path, label)
    return expression_table(spark, path, label)


def _note(spark: SparkSession, output: str, step: str) -> str | None:
    if "_SUCCESS" not in children(spark, f"{output}/manifest/{step}"):
        return None
    (row,) = spark.read.text(f"{output}/manifest/{step}", wholetext=True).collect()
    return row[0].strip()


def run(spark: SparkSession, kind: str, config: dict, output: str, csv: bool = True) -> tuple[DataFrame, list[str]]:
    """Run what isn't done yet; the regulation table and the steps that ran.

    A step's note is a hash of its keywords, of the names, sizes and times of the input files, and of all steps before it.
    """
    if kind not in STEPS:
        raise ValueError(f"unknown workload: {kind}")
    keywords, labels = step_keywords(kind, config), labels_of(kind, config)
    paths = [config.get(k) for k in (("x_data_path", "y_data_path") if kind == "net" else ("data_path",))]
    if not all(paths):
        raise ValueError("an input path is missing")
    made_from, ran = json.dumps([kind, labels, [listing(spark, p) for p in paths]]), []
    for step in STEPS[kind]:
        made_from = hashlib.sha256(json.dumps([made_from, step, keywords[step]], sort_keys=True).encode()).hexdigest()
        if not ran and _note(spark, output, step) == made_from:
            continue
        entries = None
        if step == "qc":
            parts = [read_input(spark, p, label) for p, label in zip(paths, labels)]
            entries = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        done = run_step(spark, output, step, entries, labels, **keywords[step])
        if csv and step in mtx.CSV_FILES:
            mtx.write_csv(done, f"{output}/csv", step)
        spark.createDataFrame([(made_from,)], "value string").coalesce(1).write.mode("overwrite").text(f"{output}/manifest/{step}")
        ran.append(step)
    return mtx.read_step(spark, output, "dr")[0], ran


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Compare two samples (net), or knock genes out of one (knk).")
    parser.add_argument("workload", choices=sorted(STEPS))
    parser.add_argument("-c", "--config", required=True)
    parser.add_argument("-o", "--output", required=True)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"netloom-{given.workload}").getOrCreate()
    table, ran = run(spark, given.workload, read_config(spark, given.config), given.output.rstrip("/"))
    print(f"steps run: {' '.join(ran) or 'none'}")
    table.orderBy(F.col("`p-value`"), "Gene").show(20, truncate=False)


if __name__ == "__main__":
    main()
