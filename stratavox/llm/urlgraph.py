"""URL verdicts: rules first, then trust and distrust that flow over the host graph.

Hosts link where their pages do, and a host links with the nearest domain above it that has
pages of its own, both ways: a public suffix has none, so it joins no strangers. Trust starts from hosts with allowed pages and follows links;
distrust starts from hosts with blocked pages and follows links backwards (who links to a
blocked host is suspect). Both are personalised PageRanks. A page without a rule is blocked
if its host's distrust exceeds its trust.

Scores are whole numbers of 10**-18, so sums do not depend on their order and the result
is the same in every run. A flow is multiplied out before it is divided, and rounded down to
a unit, so a score reaches as far in a large graph as in a small one, until it is less than
10**-18 of all seeds. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm.store import materialize, table

UNIT = 10**18
#: Percent of a score that follows links.
DAMPING = 85
ROUNDS = 8
#: Hosts whose scores are sent to every executor at most; with more, edges and pages are joined with them by host.
MAX_SENT = 300_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def ordered(rules: tuple[Rule, ...]) -> list[Rule]:
    """Longest first; of equal lengths the longer host, then block."""
    return sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "block", r.name))


def _choose(rules: tuple[Rule, ...], what: str) -> Column:
    chain = F
    for r in ordered(rules):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        chain = chain.when(fits, F.lit(r.name if what == "rule" else r.verdict))
    return F.lit(None).cast("string") if chain is F else chain


def _lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust per row of ``pages(page_id, url, html)``.

    A null url or one without ``://`` has an empty host and path; without a rule and without
    scores a page is allowed. Null html has no links. Repeated rows are judged each, and
    their links and seeds count each. Without pages of a verdict there is no such seed.
    """
    parsed = pages.select(
        "page_id",
        _lowered(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))).alias("host"),
        F.coalesce(F.regexp_extract("url", PATH, 1), F.lit("")).alias("path"),
        F.when(F.contains("html", F.lit("//")), F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("links"),
    )
    parsed = parsed.withColumn("rule", _choose(rules, "rule")).withColumn("said", _choose(rules, "verdict"))
    parsed = materialize(parsed, "pages")

    linked = parsed.select("host", F.explode("links").alias("to")).select("host", _lowered(F.col("to")).alias("to"))
    linked = linked.where("host <> '' AND host <> to").groupBy("host", "to").agg(F.count("*").alias("w"))
    hosts = parsed.where("host <> ''").select("host").distinct()
    labels = F.size(F.split("host", "[.]"))
    suffixes = F.expr("transform(sequence(2, size(split(host, '[.]')) - 1), k -> substring_index(host, '.', -k))")
    named = hosts.where((labels > 2) & ~F.col("host").rlike(r"[.]\d+$"))  # the others are addresses
    domains = named.select("host", F.explode(suffixes).alias("to")).join(hosts.withColumnRenamed("host", "to"), "to")
    above = domains.groupBy("host").agg(F.max_by("to", F.length("to")).alias("to")).withColumn("w", F.lit(1).cast("long"))
    forward = linked.union(above).union(above.select("to", "host", "w")).groupBy("host", "to").agg(F.sum("w").alias("w"))
    both = forward.select(F.lit("trust").alias("kind"), F.col("host").alias("src"), F.col("to").alias("dst"), "w").union(
        forward.select(F.lit("distrust"), "to", "host", "w")
    )
    both = materialize(both, "edges")
    out = both.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    edges = materialize(both.join(out, ["kind", "src"]), "edges")
    sent = F.broadcast if out.count() <= MAX_SENT else lambda df: df

    seeds = parsed.where("said IS NOT NULL").groupBy(F.when(F.col("said") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").alias("n"))
    totals = seeds.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = materialize(seeds.join(F.broadcast(totals), "kind").select("kind", "host", F.expr(f"cast({UNIT} as decimal(19, 0)) * n div total").alias("s")), "seeds")

    start = seeds.select("kind", "host", F.expr(f"cast(s as decimal(19, 0)) * {100 - DAMPING} div 100").alias("s"))
    scores = seeds
    for turn in range(1, rounds + 1):
        flow = edges.join(sent(scores.withColumnRenamed("host", "src")), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), F.expr(f"cast(s as decimal(19, 0)) * cast(w as decimal(16, 0)) * {DAMPING} div (all * 100)").alias("s")
        )
        scores = flow.union(start).groupBy("kind", "host").agg(F.sum("s").alias("s"))
        if turn % 4 == 0 or turn == rounds:
            scores = materialize(scores, "scores")

    by_host = scores.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("s")).otherwise(0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("s")).otherwise(0)).alias("distrust"),
    )
    zero = F.lit(0).cast("long")
    judged = parsed.drop("links").join(sent(by_host), "host", "left").withColumns({"trust": F.coalesce("trust", zero), "distrust": F.coalesce("distrust", zero)})
    verdict = F.coalesce("said", F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    return judge(table(spark, sf_dir, "pages"))


def _sql_choice(what: str) -> str:
    parts = []
    for r in ordered(RULES):
        value = r.name if what == "rule" else r.verdict
        parts.append(f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value}'")
    return "CASE " + " ".join(parts) + " END"


def _oracle() -> str:
    link = LINK.replace("'", "''")
    steps = ["s0 AS (SELECT * FROM seeds)"]
    for k in range(1, ROUNDS + 1):
        steps.append(
            f"s{k} AS MATERIALIZED (SELECT kind, host, CAST(sum(s) AS BIGINT) AS s FROM (SELECT e.kind, dst AS host, CAST(s AS HUGEINT) * w * {DAMPING} // (total * 100) AS s "
            f"FROM edges e JOIN s{k - 1} p ON e.kind = p.kind AND e.src = p.host UNION ALL SELECT kind, host, CAST(s AS HUGEINT) * {100 - DAMPING} // 100 FROM seeds) GROUP BY kind, host)"
        )
    return f"""
WITH split AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{HOST}', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '{PATH}', 1), '') AS path, regexp_extract_all(html, '{link}', 1) AS links FROM pages),
parsed AS MATERIALIZED (SELECT *, {_sql_choice("rule")} AS rule, {_sql_choice("verdict")} AS said FROM split),
linked AS (SELECT host, dst, CAST(count(*) AS BIGINT) AS w FROM (SELECT host, translate(unnest(links), '{UPPER}', '{LOWER}') AS dst FROM parsed)
    WHERE host <> '' AND host <> dst GROUP BY host, dst),
hosts AS (SELECT DISTINCT host FROM parsed WHERE host <> ''),
labels AS (SELECT host, string_split(host, '.') AS l FROM hosts WHERE NOT regexp_matches(host, '[.][0-9]+$')),
domains AS (SELECT host, array_to_string(l[i:], '.') AS up FROM (SELECT host, l, unnest(range(2, len(l))) AS i FROM labels)),
above AS (SELECT d.host, max_by(up, length(up)) AS up FROM domains d JOIN hosts h ON h.host = up GROUP BY d.host),
forward AS (SELECT host, dst, CAST(sum(w) AS BIGINT) AS w FROM (SELECT * FROM linked UNION ALL SELECT host, up, 1 FROM above
    UNION ALL SELECT up, host, 1 FROM above) GROUP BY host, dst),
both_ways AS (SELECT 'trust' AS kind, host AS src, dst, w FROM forward UNION ALL SELECT 'distrust', dst, host, w FROM forward),
edges AS MATERIALIZED (SELECT *, CAST(sum(w) OVER (PARTITION BY kind, src) AS BIGINT) AS total FROM both_ways),
counted AS (SELECT CASE WHEN said = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM parsed WHERE said IS NOT NULL GROUP BY ALL),
seeds AS MATERIALIZED (SELECT kind, host, CAST(CAST({UNIT} AS HUGEINT) * n // CAST(sum(n) OVER (PARTITION BY kind) AS BIGINT) AS BIGINT) AS s FROM counted),
{", ".join(steps)},
by_host AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN s ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN s ELSE 0 END) AS distrust
    FROM s{ROUNDS} GROUP BY host)
SELECT page_id, p.host, path, rule,
    coalesce(said, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
    CAST(coalesce(trust, 0) AS BIGINT) AS trust, CAST(coalesce(distrust, 0) AS BIGINT) AS distrust
FROM parsed p LEFT JOIN by_host h ON p.host = h.host"""


OP3_SQL = _oracle()
