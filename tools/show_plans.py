"""Print the physical plans of the headline operators (``explain("formatted")``).

Usage: python tools/show_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from toxscan.operators.filters import confirmed_only
    from toxscan.operators.purify import purify
    from toxscan.operators.ranking import exact_rank
    from toxscan.operators.scorer import class_token_counts, score
    from toxscan.operators.tokens import with_tokens
    from toxscan.plans import artifacts
    from toxscan.session import get_spark, read_table
    from toxscan.sources.posts import scan_posts

    spark = get_spark("local[8]")
    ds, sc = artifacts.dataset(spark, sf), artifacts.scorer(spark, sf)
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    plans = {
        "confirmed posts (filter pushed into the labels scan)": confirmed_only(scan_posts(spark, sf)).select("doc_id", "label"),
        "score (explode, broadcast weights, partial sums)": score(with_tokens(docs), sc),
        "purify (one shuffle of raw text, one sort, no join)": purify(docs, sc),
        "fit counts (partially aggregated token counts)": class_token_counts(ds.train, docs),
        "exact rank (range partitions, written rows, broadcast offsets)": exact_rank(
            read_table(spark, sf, "labels"), ["doc_id"], ["toxic"], rank_col="rank"),
    }
    for title, df in plans.items():
        print(f"===== {title}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
