"""python -m vicinal.build_index: an index from headerless batch files batch_0.csv.gz, batch_1.csv.gz ..."""

from __future__ import annotations

import argparse

from .operators.index_build import TRAINING_SAMPLE, UPDATE_CHUNK, build_index, build_metric
from .functions.scalars import MOST_PARTITIONS
from .retry import BUILD


#: The names and defaults of the options.
def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vicinal.build_index", description=__doc__)
    p.add_argument("--embeddings-prefix", required=True, help="folder or prefix of the batch files")
    p.add_argument("--index-path", required=True)
    p.add_argument("--total-batches", required=True, type=int)
    p.add_argument("--embedding-dim", required=True, type=int)
    p.add_argument("--training-sample-size", type=int, default=TRAINING_SAMPLE)
    p.add_argument("--distance-metric", type=build_metric, default="cosine", help="COSINE or L2, in any case")
    p.add_argument("--normalize", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--max-partitions", type=int, default=MOST_PARTITIONS)
    p.add_argument("--update-chunk-size", type=int, default=UPDATE_CHUNK)
    return p


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .sources.readers import numbered_batches

    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    batches = numbered_batches(spark, a.embeddings_prefix, a.total_batches, a.embedding_dim)
    build_index(batches, a.index_path, metric=a.distance_metric, normalise=a.normalize, sample_size=a.training_sample_size, max_partitions=a.max_partitions, chunk=a.update_chunk_size, retry=BUILD)


if __name__ == "__main__":
    main()
