"""python -m quillon RUN_FILE FOLDER: the queries of a run file over the Parquet tables of a folder, results as they come."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .functions.score import Params
from .operators.topk import prepare, results
from .plans.networks import NetworkIndex
from .sinks.render import lines
from .sources.run_file import read_config, read_queries
from .sources.tables import from_parquet
from .spec import BUILT_IN, SchemaSpec


def main(run_file: str, folder: str, schema_file: str | None = None) -> None:
    """schema_file: a schema as JSON, if the data set isn't built in."""
    with open(run_file, encoding="utf-8") as f:
        text = f.read().splitlines()
    config = read_config(text)
    if schema_file:
        with open(schema_file, encoding="utf-8") as f:
            spec = SchemaSpec.from_json(f.read())
    else:
        spec = BUILT_IN[config.dataset]
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    db = from_parquet(spark, spec, folder)
    index = NetworkIndex(spec, config.max_size)
    if config.offline_networks:
        index.fill()
    for name, words in read_queries(text):
        for algorithm in config.algorithms:
            s = prepare(db, words, config.max_size, Params(alpha=config.alpha), index)
            for line in lines(name, algorithm, results(s, config.k, algorithm)):
                print(line, flush=True)
            print(f"Q{name} A{algorithm}", *(f"{k}={v:.3f}" for k, v in sorted(s.metrics.items())), flush=True)
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
