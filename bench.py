"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from quire import queries
from quire.operators import index, merge
from quire.session import local_session, scratch

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = (
    "boolean_and", "boolean_cnf", "boolean_not", "boolean_maxdocs", "boolean_weights", "list_union",
    "ranked_topk", "ranked_max_terms", "approx_ranked_topk", "ranked_accumulators", "ranked_paragraphs", "similarity_doc_doc",
    "docnums_query", "heads_projection", "postfilter_regex", "hilite_html", "tokenize_counts", "sgml_strip_tokens", "comp_token_stats",
)


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return round(time.perf_counter() - began, 3)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, int(CPUS), "16g")
    drain(spark.range(1000).groupBy("id").count())  # the session's own start
    seconds: dict[str, float] = {"index_build": timed(lambda: queries.collection(spark, SF_DIR))}
    seconds["paragraph_index_build"] = timed(lambda: queries.paragraph_collection(spark, SF_DIR))
    for name in NAMES:
        seconds[name] = timed(lambda name=name: drain(queries.QUERIES[name](spark, SF_DIR)))
    docs, c = queries.documents(spark, SF_DIR), queries.collection(spark, SF_DIR)
    new = docs.orderBy("docnum").limit(100).selectExpr("docnum + 1000000000 AS docnum", "text")
    path = scratch(spark, "grown")
    index.saved(docs, path)
    seconds["merge_append_100"] = timed(lambda: merge.append_saved(path, new))  # all five tables
    terms = " ".join(r["term"] for r in c.lexicon.orderBy(c.lexicon.f_t.desc()).limit(30).collect())
    from quire.plans import ranked

    seconds["ranked_30_terms"] = timed(lambda: drain(ranked.ranked(c, terms)))
    sizes = {"postings_rows": c.postings.count(), "lexicon_rows": c.lexicon.count()}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), **sizes}))


if __name__ == "__main__":
    main()
