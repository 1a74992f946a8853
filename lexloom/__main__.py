"""``python -m lexloom QUERY FOLDER [OUT]``: runs a core query and prints JSON lines or writes Parquet."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from lexloom.plans.catalogue import registries


def main(args: list[str]) -> int:
    queries = {n: f for r in registries() for n, f in r.queries.items()}
    if len(args) < 2 or args[0] not in queries:
        print("queries:", *sorted(queries), sep="\n  ", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("lexloom").getOrCreate()
    df = queries[args[0]](spark, args[1])
    if len(args) > 2:
        df.write.mode("overwrite").parquet(args[2])
    else:
        for line in df.toJSON().toLocalIterator():
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
