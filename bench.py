"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from passagedex import adapters
from passagedex.functions.encoders import HashedWords
from passagedex.operators.embedding import embed
from passagedex.operators.neighbours import nearest
from passagedex.operators.passages import flatten_articles
from passagedex.plans.dense import build_vector_index, open_vector_index
from passagedex.plans.lexical import build_index, open_index
from passagedex.session import session
from passagedex.sources import articles as A
from passagedex.streaming.ingest import ingest_folder

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def jobs(spark, sf_dir: str, work: str) -> dict:
    """Named jobs, in an order where each finds what it needs."""

    def passages():
        return flatten_articles(adapters.articles(adapters.documents(spark, sf_dir)))

    queries = adapters.queries(spark, sf_dir)
    vectors = adapters.spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    named = vectors.select(F.col("vec_id").alias("doc_key"), "embedding")
    asking = vectors.select(F.col("vec_id").alias("query_id"), "embedding")

    def index():
        return open_index(spark, f"{work}/index")

    def dump():
        rows = adapters.articles(adapters.documents(spark, sf_dir))
        rows.select("id", "title", "text").write.option("compression", "bzip2").json(f"{work}/dump")

    def scan():
        A.save_articles(A.read_article_lines(spark, f"{work}/dump"), f"{work}/articles")

    def records():
        opened = index()
        consume(opened.records(opened.search(queries, 5)))

    def embed_documents():
        consume(embed(adapters.documents(spark, sf_dir), "doc_id", "text", HashedWords))

    def retrieve():
        consume(open_vector_index(spark, f"{work}/vectors", HashedWords).retrieve(queries, 5))

    return {
        "flatten_passages": lambda: consume(passages()),
        "index_build": lambda: build_index(spark, passages(), f"{work}/index"),
        "bm25_topk": lambda: consume(index().search(queries, 10)),
        "bm25_topk_records": records,
        "bm25_scores": lambda: consume(index().scores(queries)),
        "bm25_weights": lambda: consume(index().weights()),
        "knn_l2_topk": lambda: consume(nearest(named, asking, 5)),
        "embed_corpus": embed_documents,
        "dense_build": lambda: build_vector_index(
            spark, passages(), f"{work}/vectors", HashedWords
        ),
        "dense_retrieve": retrieve,
        "write_bz2_jsonl": dump,
        "scan_bz2_jsonl": scan,
        "ingest_folder": lambda: ingest_folder(
            spark, f"{work}/dump", f"{work}/streamed", glob="*.bz2"
        ),
    }


def main() -> None:
    work = tempfile.mkdtemp(prefix="bench-")
    spark = session(
        f"local[{CPUS}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.sql.warehouse.dir": f"{work}/warehouse",
            "spark.checkpoint.dir": f"{work}/shared",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    # One untimed round on the smallest tables starts workers and warms the JVM.
    smallest = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    if os.path.isdir(smallest):
        for job in jobs(spark, smallest, f"{work}/warm").values():
            job()

    seconds = {}
    for name, job in jobs(spark, SF_DIR, f"{work}/timed").items():
        start = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
