"""Command line: ``python -m toxscan build|train|moderate ...``.

    build    POSTS OUT           labelled dataset: OUT/ratings_labeled{,_train,_test}.csv
    train    POSTS MODEL         fit on the balanced train split, save MODEL, print metrics
    moderate DATASET MODEL OUT   purify a dataset file with a saved model, write OUT (parquet)

POSTS is a table of posts (Parquet, or JSON lines by its suffix) with ``string, label, labeling_confirm``; with
``--tables`` it is a folder with ``documents.parquet`` and ``labels.parquet``.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="toxscan")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build")
    b.add_argument("posts")
    b.add_argument("--tables", action="store_true")
    b.add_argument("out")
    t = sub.add_parser("train")
    t.add_argument("posts")
    t.add_argument("--tables", action="store_true")
    t.add_argument("model")
    m = sub.add_parser("moderate")
    m.add_argument("dataset")
    m.add_argument("model")
    m.add_argument("out")
    m.add_argument("--head", type=int, default=None)
    args = ap.parse_args(argv)

    from toxscan.operators.scorer import AdditiveScorer
    from toxscan.plans.dataset import labelled_dataset, with_post_text
    from toxscan.session import cleanup, get_spark
    from toxscan.sources.files import write_dataset
    from toxscan.sources.posts import progress_counts, read_posts, scan_posts

    spark = get_spark()
    if args.cmd in ("build", "train"):
        posts = scan_posts(spark, args.posts, include_unlabelled=True) if args.tables else read_posts(spark, args.posts)
        ds = labelled_dataset(spark, None, materialize=True, posts=posts)
    if args.cmd == "build":
        write_dataset(with_post_text(ds.split, posts, out="document"), f"{args.out}/ratings_labeled.csv")
        for name, part in (("train", ds.train), ("test", ds.test)):
            rows = with_post_text(part, posts, out="document").withColumn("_id", F.col("position"))
            write_dataset(rows, f"{args.out}/ratings_labeled_{name}.csv")
        told = ds.summary(progress_counts(posts)).collect()
        print(json.dumps({r["split"] + ("" if r["bucket"] is None else f"_{r['bucket']}"): r["n"] for r in told}))
    elif args.cmd == "train":
        from toxscan.plans.training import train, validate

        texts = posts.select("doc_id", F.col("string").alias("text"))
        scorer = train(spark, ds, args.model, texts)
        out = validate(with_post_text(ds.test, posts), scorer)
        metrics = out["metrics"].first().asDict()
        metrics["val_loss"] = out["val_loss"].first()["val_loss"]
        print(json.dumps(metrics))
    else:
        from toxscan.plans.inference import moderate_file

        scorer = AdditiveScorer.load(spark, args.model)
        moderate_file(spark, args.dataset, scorer, args.head).write.mode("overwrite").parquet(args.out)
    cleanup(spark)
    spark.stop()


if __name__ == "__main__":
    main()
