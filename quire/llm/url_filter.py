"""URL filter: rules first, then trust and distrust that spread over the links between hosts, in DataFrame functions alone.

A rule is a host and a path: it fits pages of that host and its subdomains whose path starts with the rule's, and the
longest rule that fits decides. Where none fits, the page's host decides: personalised PageRank carries trust along the
links from hosts with allowed pages, and the same walk against the links carries distrust to hosts that link to ones
with blocked pages. A host's part in the seeds is its share of allowed (blocked) pages. What a host without further links
holds goes back to the seeds; a fixed point without that, divided by its sum, is the same, so it is found that way. A host is
blocked if its distrust is above ``THRESHOLD`` times its trust. The walks go on until no further host is reached and the summed change of
``WRITE_EVERY`` steps is under ``TOLERANCE``; verdicts of scores that are closer than that are not certain.

Links are counted by host pair before they are joined, so the graph grows with pairs of hosts, not with pages.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and the verdict allow; repeated
rows are judged each; a host without seeds or links is allowed; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import written

DAMPING, WRITE_EVERY, THRESHOLD = 0.85, 4, 1.0
#: Steps go on until trust and distrust together change by less than this in WRITE_EVERY steps, summed over all hosts.
TOLERANCE = 1e-9
#: Rules stand in the plan itself, so their number has a bound.
MOST_RULES = 1000
#: Hosts whose scores are broadcast to the pages (about 100 bytes each).
MOST_BROADCAST = 500_000

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: What a page links to, and the start of targets that name a host (others stay on the page's) or are no page.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
FULL, NO_PAGE = "(?i)^[a-z][a-z0-9+.-]*://", "(?i)^[a-z][a-z0-9+.-]*:([^/]|/[^/]|/?$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def fitting(rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, host with path) that fits the columns host and path, as verdict, space, rule."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    tests = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0])):
        name, slash, rest = rule.partition("/")
        own = (F.col("host") == name) | F.col("host").endswith(f".{name}")
        tests.append(F.when(own & F.col("path").startswith(slash + rest), F.lit(f"{verdict} {rule}")))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def resolved(link: Column, own: Column) -> Column:
    """The host that a link on a page of the host ``own`` leads to; null if it leads to no page."""
    there = F.when(link.startswith("//"), host(F.concat(F.lit("x:"), link)))
    return there.when(F.rlike(link, F.lit(FULL)), host(link)).when(F.rlike(link, F.lit(NO_PAGE)), F.lit(None).cast("string")).otherwise(own)


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links from one host to another, relative ones resolved against their page. Links within a host pass nothing on."""
    links = pages.select(host(F.col("url")).alias("src"), F.explode_outer(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("link"))
    ends = links.select("src", resolved(F.col("link"), F.col("src")).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return ends.groupBy("src", "dst").agg(F.count("*").alias("n"))


def _shares(scores: DataFrame) -> DataFrame:
    """Trust and distrust divided by their sums; sums of 0 stay."""
    total = scores.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    part = lambda c, n: (F.col(c) / F.lit(n) if n else F.col(c)).alias(c)
    return scores.select("host", part("trust", total["t"]), part("distrust", total["d"]))


def propagated(seeds: DataFrame, links: DataFrame, *, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust at the fixed point, or after ``rounds`` steps where given. seeds: host, trust, distrust (each summing to 1, or 0 throughout).

    Without links that is the seeds, as it is for hosts that no link reaches, but for what others gain.
    """
    links = written(links, "host-links")
    if links.isEmpty():
        return seeds
    out_of = links.groupBy("src").agg(F.sum("n").alias("n_out"))
    into = links.groupBy("dst").agg(F.sum("n").alias("n_in"))
    share = links.join(out_of, "src").join(into, "dst")
    # trust goes along a link, distrust against it; both in one table, so a round is one join and one aggregate
    along = share.select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("n_out")).alias("t"), F.lit(0.0).alias("d"))
    against = share.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("n") / F.col("n_in")).alias("d"))
    flows = written(along.unionByName(against), "host-flows")
    names = flows.select("host").distinct().join(seeds, "host", "full_outer").na.fill(0.0, ["trust", "distrust"])
    start = written(names, "host-seeds")
    step = lambda seed, more: (F.lit(1 - damping) * F.col(seed) + F.lit(damping) * F.coalesce(more, F.lit(0.0))).alias(seed)
    now, last, k = start, start, 0
    while rounds is None or k < rounds:
        k += 1
        came = flows.join(now, "host").groupBy(F.col("to").alias("host")).agg(F.sum(F.col("trust") * F.col("t")).alias("more_t"), F.sum(F.col("distrust") * F.col("d")).alias("more_d"))
        now = start.join(came, "host", "left").select("host", step("trust", "more_t"), step("distrust", "more_d"))
        if k % WRITE_EVERY:
            continue
        now = written(now, "host-scores")
        if rounds is None:
            before = last.select("host", F.col("trust").alias("was_t"), F.col("distrust").alias("was_d"))
            change = F.sum(F.abs(F.col("trust") - F.col("was_t")) + F.abs(F.col("distrust") - F.col("was_d")))
            any_ = F.sum((F.col("trust") > 0).cast("long") + (F.col("distrust") > 0).cast("long"))
            was_any = F.sum((F.col("was_t") > 0).cast("long") + (F.col("was_d") > 0).cast("long"))
            found = now.join(before, "host").agg(change.alias("change"), any_.alias("n"), was_any.alias("was_n")).first()
            # hosts within k links are reached after k steps, so steps that reach no further host are the last to reach any
            if found["n"] is None or (found["n"] == found["was_n"] and found["change"] < tolerance):
                break
            last = now
    return _shares(now)


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]], *, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    named = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("fit", fitting(rules))
    named = named.select("page_id", "host", "path", F.substring_index("fit", " ", 1).alias("ruled"), F.regexp_extract("fit", "^[a-z]+ (.*)$", 1).alias("rule"))
    shares = named.where("host <> ''").groupBy("host").agg(F.avg(F.coalesce(F.col("ruled") == "allow", F.lit(False)).cast("double")).alias("trust"), F.avg(F.coalesce(F.col("ruled") == "block", F.lit(False)).cast("double")).alias("distrust"))
    totals = shares.agg(F.sum("trust").alias("all_t"), F.sum("distrust").alias("all_d")).first()
    norm = lambda c, total: (F.col(c) / F.lit(total) if total else F.lit(0.0)).alias(c)
    seeds = shares.select("host", norm("trust", totals["all_t"]), norm("distrust", totals["all_d"]))
    scores = written(propagated(seeds, host_links(pages)), "host-scores")
    if scores.count() <= MOST_BROADCAST:  # else a sort-merge join, whose hot hosts Spark splits
        scores = F.broadcast(scores)
    of_host = F.when(F.col("distrust") > F.lit(threshold) * F.col("trust"), F.lit("block")).otherwise(F.lit("allow"))
    return named.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", of_host).alias("verdict"), "trust", "distrust")


def oracle_sql(rules: Sequence[tuple[str, str]], steps: int = 60) -> str:
    """The whole judgement in DuckDB's SQL, with a fixed number of steps: page_id, host, path, rule, verdict, trust, distrust."""
    whens = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0])):
        name, slash, rest = rule.partition("/")
        whens.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}') THEN '{verdict} {rule}'")
    name = lambda url: f"translate(regexp_extract({url}, '{URL}', 1), '{UPPER}', '{LOWER}')"
    quoted = LINK.replace("'", "''")
    return f"""
    WITH RECURSIVE named AS (SELECT page_id, {name("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '{URL}', 2) AS path, coalesce(html, '') AS html FROM pages),
    ruled AS (SELECT *, CASE {' '.join(whens)} END AS fit FROM named),
    shares AS (SELECT host, avg((coalesce(fit, '') LIKE 'allow %')::INT) AS t, avg((coalesce(fit, '') LIKE 'block %')::INT) AS d FROM ruled WHERE host <> '' GROUP BY host),
    own AS (SELECT host, coalesce(t / nullif(sum(t) OVER (), 0), 0) AS t, coalesce(d / nullif(sum(d) OVER (), 0), 0) AS d FROM shares),
    found AS (SELECT host AS src, unnest(regexp_extract_all(html, '{quoted}', 1)) AS link FROM named),
    ends AS (SELECT src, CASE WHEN starts_with(link, '//') THEN {name("'x:' || link")} WHEN regexp_matches(link, '{FULL}') THEN {name('link')}
             WHEN regexp_matches(link, '{NO_PAGE}') THEN NULL ELSE src END AS dst FROM found),
    links AS (SELECT src, dst, count(*)::DOUBLE AS n FROM ends WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
    flows AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS t, n / sum(n) OVER (PARTITION BY dst) AS d FROM links),
    hosts AS (SELECT host FROM own UNION SELECT src FROM links UNION SELECT dst FROM links),
    seeds AS (SELECT host, coalesce(t, 0) AS t, coalesce(d, 0) AS d FROM hosts LEFT JOIN own USING (host)),
    moves AS (SELECT src AS host, dst AS goes, t, 0.0 AS d FROM flows UNION ALL SELECT dst, src, 0.0, d FROM flows UNION ALL SELECT NULL, host, 0.0, 0.0 FROM hosts),
    walk AS (SELECT 0 AS k, host, t, d FROM seeds
             UNION ALL SELECT w.k + 1, s.host, {1 - DAMPING} * any_value(s.t) + {DAMPING} * sum(w.t * m.t), {1 - DAMPING} * any_value(s.d) + {DAMPING} * sum(w.d * m.d)
             FROM seeds s JOIN moves m ON m.goes = s.host JOIN walk w ON w.host = coalesce(m.host, s.host) WHERE w.k < {steps} GROUP BY w.k, s.host),
    scores AS (SELECT host, coalesce(t / nullif(sum(t) OVER (), 0), 0) AS trust, coalesce(d / nullif(sum(d) OVER (), 0), 0) AS distrust FROM walk WHERE k = {steps})
    SELECT page_id, host, path, CASE WHEN fit IS NOT NULL THEN substr(fit, strpos(fit, ' ') + 1) END AS rule,
           coalesce(split_part(fit, ' ', 1), CASE WHEN distrust > {THRESHOLD} * trust THEN 'block' ELSE 'allow' END) AS verdict, round(trust, 9) AS trust, round(distrust, 9) AS distrust
    FROM ruled LEFT JOIN scores USING (host)"""
