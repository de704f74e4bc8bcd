"""``python -m lodestar compress|search|audit|inspect|validate ...``: jobs over files, to be submitted to a cluster."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from lodestar.operators import codecs, quality, search
from lodestar.session import session
from lodestar.sources import files, index


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="lodestar", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, args in {"compress": ("input", "output"), "search": ("store", "queries", "output"), "audit": ("input",), "inspect": ("store",), "validate": ("store",)}.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        if name in ("compress", "audit"):
            p.add_argument("--codec", default="int8", choices=sorted(codecs.CODECS))
        if name == "search":
            p.add_argument("-k", type=int, default=10)
    a = top.parse_args(argv)
    spark = session("lodestar")
    if a.command == "compress":
        index.save_dataset(files.read_jsonl(spark, a.input), a.output, a.codec)
    elif a.command == "search":
        queries = files.read_jsonl(spark, a.queries).select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
        files.write_results_json(search.knn(queries, index.load_dataset(spark, a.store).select("id", "vec"), a.k), a.output)
    elif a.command == "audit":
        df = files.read_jsonl(spark, a.input)
        quality.metrics(codecs.decode(codecs.encode(df, a.codec), a.codec)).show(truncate=False, vertical=True)
    elif a.command == "inspect":
        files.inspect(spark, a.store).show(truncate=False)
    else:
        df = index.load_dataset(spark, a.store)
        sizes = df.select("id", F.size("vec").alias("dims"), F.col("vec").alias("codes"))
        ok = files.validate(sizes).first()
        print(ok.asDict())
        return 0 if ok["valid"] else 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
