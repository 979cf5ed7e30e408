"""Robots files as tables: parse, choose the group that binds us, check urls."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgauge import settings
from pressgauge.functions.text import at, hours, percent_decode, percent_encode, strip, url_domain
from pressgauge.session import materialize

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
RULE_FIELDS = ["allow", "disallow", "crawl-delay", "request-rate"]


def robots_snapshot(
    snapshots: DataFrame, as_of: datetime | str, max_age_hours: int = settings.ROBOTS_MAX_AGE_HOURS
) -> DataFrame:
    """Newest usable snapshot per domain and whether it is still fresh (age strictly below the limit).

    Failed fetches (neither 200 nor 404) are never kept, so they do not hide an
    older good snapshot. The rank limit prunes repeats before the exchange.
    """
    newest = Window.partitionBy("domain").orderBy(F.desc("fetched_at"), "http_status", "body")
    usable = snapshots.filter(F.col("http_status").isin(200, 404) & (F.col("fetched_at") <= at(as_of)))
    latest = usable.withColumn("rank", F.row_number().over(newest)).filter("rank <= 1").drop("rank")
    return latest.withColumn("fresh", F.col("fetched_at") + hours(max_age_hours) > at(as_of))


def fresh_robots(snapshots: DataFrame, as_of: datetime | str) -> DataFrame:
    """The files to check urls against; a stale or failed domain is absent and thus permissive."""
    return robots_snapshot(snapshots, as_of).filter("fresh").drop("fresh")


def refetch_list(snapshots: DataFrame, urls: DataFrame, as_of: datetime | str) -> DataFrame:
    """Domains about to be crawled that have no fresh snapshot."""
    fresh = fresh_robots(snapshots, as_of).select("domain")
    domains = urls.select(url_domain(F.col("url")).alias("domain")).distinct()
    return domains.join(fresh, "domain", "left_anti")


def _lines(snapshots: DataFrame) -> DataFrame:
    """Meaningful lines of the files that were found: domain, pos, kind, field, value."""
    found = snapshots.filter(F.col("http_status") == 200)
    lines = found.select("domain", F.posexplode(F.split("body", LINE_BREAK)).alias("pos", "line"))
    content = strip(F.substring_index("line", "#", 1))
    lines = lines.select("domain", "pos", "line", content.alias("content"))
    field = F.lower(strip(F.substring_index("content", ":", 1)))
    value = strip(F.expr("substring(content, instr(content, ':') + 1)"))
    lines = lines.select(
        "domain", "pos", "line",
        F.when(F.col("content").contains(":"), field).alias("field"),
        F.when(F.col("content").contains(":"), percent_decode(value)).alias("value"),
    )
    kind = (
        F.when(F.col("line") == "", "blank").when(F.col("field") == "user-agent", "agent")
        .when(F.col("field").isin(RULE_FIELDS), "rule")
    )
    return lines.withColumn("kind", kind).filter("kind IS NOT NULL").drop("line")


def _rule_path(value: Column) -> Column:
    """Comparable form of a rule's path: empty fragment and query marks go, the rest is encoded."""
    return percent_encode(F.regexp_replace(F.regexp_replace(value, "#$", ""), r"\?$", ""))


def robots_rules(snapshots: DataFrame, user_agent: str = settings.USER_AGENT) -> DataFrame:
    """All groups of all files: domain, group_no, is_default, applies, rules, crawl_delay.

    A group is a run of user-agent lines with the rule lines that follow; an empty
    line closes it, and rule lines outside any group are ignored. Windows and both
    aggregations share one exchange on domain, and a domain is one file.
    """
    in_file = Window.partitionBy("domain").orderBy("pos")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    lines = _lines(snapshots)
    opens = (F.col("kind") == "agent") & F.coalesce(F.lag("kind").over(in_file) != "agent", F.lit(True))
    boundary = F.last(F.when(F.col("kind") != "rule", F.col("kind")), ignorenulls=True).over(before)
    lines = lines.withColumns({"opens": opens, "boundary": boundary})
    lines = lines.withColumn("group_no", F.sum(F.col("opens").cast("int")).over(in_file))
    lines = lines.filter("kind = 'agent' OR (kind = 'rule' AND boundary = 'agent')")

    token = user_agent.split("/")[0].lower()
    agent, rule = F.col("kind") == "agent", F.col("kind") == "rule"
    named = agent & F.lit(token).contains(F.lower("value"))
    allowed = F.when(F.col("field") == "allow", True).when(F.col("field") == "disallow", F.col("value") == "")
    path_rule = F.when(
        F.col("field").isin("allow", "disallow"),
        F.struct("pos", allowed.alias("allow"), _rule_path(F.col("value")).alias("path")),
    )
    delay = F.when((F.col("field") == "crawl-delay") & F.col("value").rlike(r"^\d+$"), F.col("value").cast("double"))
    return (
        lines.groupBy("domain", "group_no")
        .agg(
            F.bool_or(agent & (F.col("value") == "*")).alias("is_default"),
            F.bool_or(named).alias("applies"),
            F.count_if(rule).alias("n_lines"),
            F.sort_array(F.collect_list(path_rule)).alias("rules"),
            F.max_by(delay, F.when(delay.isNotNull(), F.col("pos"))).alias("crawl_delay"),
        )
        .filter("n_lines > 0")
        .drop("n_lines")
    )


def robots_policies(groups: DataFrame) -> DataFrame:
    """The one group per domain that binds us: the first named match, else the first default group."""
    rank = F.when(~F.col("is_default") & F.col("applies"), 0).when(F.col("is_default"), 1)
    bound = groups.withColumn("rank", rank).filter("rank IS NOT NULL")
    best = bound.groupBy("domain").agg(F.min(F.struct("rank", "group_no", "rules", "crawl_delay")).alias("g"))
    return best.select("domain", F.col("g.rules").alias("rules"), F.nullif("g.crawl_delay", F.lit(0.0)).alias("crawl_delay"))


def _target(url: Column) -> Column:
    """What rule paths are compared with: everything after the authority, decoded and encoded again."""
    rest = F.regexp_replace(percent_decode(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?", "")
    path = _rule_path(rest)
    return F.when(path == "", "/").otherwise(path)


def first_by_prefix(targets: DataFrame, policies: DataFrame) -> DataFrame:
    """For each distinct (domain, target): what the first rule by position that begins it says, as column ``_found``.

    The rules are an index by (domain, path). A target asks for its own beginnings, at the lengths its domain's rules
    have, so the work depends on the length of urls and not on the number of rules.
    """
    paths = policies.select("domain", F.explode("rules").alias("r"))
    paths = paths.groupBy("domain", F.col("r.path").alias("_prefix")).agg(F.min(F.struct("r.pos", "r.allow")).alias("_rule"))
    lengths = policies.select("domain", F.array_distinct(F.transform("rules", lambda r: F.char_length(r["path"]))).alias("_lengths"))
    # Repeated urls shrink to one before they ask.
    asked = targets.join(lengths.select("domain"), "domain", "left_semi").distinct().join(lengths, "domain")
    fitting = F.filter("_lengths", lambda n: n <= F.char_length("_target"))
    asked = asked.select("domain", "_target", F.explode(fitting).alias("_n"))
    asked = asked.select("domain", "_target", F.expr("left(_target, _n)").alias("_prefix"))
    first = asked.join(paths, ["domain", "_prefix"]).groupBy("domain", "_target").agg(F.min("_rule").alias("_rule"))
    return first.select("domain", "_target", F.col("_rule.allow").alias("_found"))


def robots_check(
    urls: DataFrame, snapshots: DataFrame, user_agent: str = settings.USER_AGENT, on_missing: str = "allow",
    rules_in_row: int = settings.ROBOTS_RULES_IN_ROW,
) -> DataFrame:
    """urls plus domain, allowed, reason, crawl_delay. ``snapshots`` has one file per domain.

    Up to ``rules_in_row`` rules of a domain travel as one array and are tested inside the url's row; longer files are
    looked up by prefix, and only their urls pay for it. The parsed files are written once, so their sizes and whether
    any is long are known. Spark broadcasts the domains while they are small by bytes; otherwise the shuffle join has one
    right row per domain, so AQE can split a hot domain. ``on_missing`` says what a file answered with 404 means.
    """
    files = snapshots.select("domain", F.col("http_status").alias("_status"))
    policies = materialize(files.join(robots_policies(robots_rules(snapshots, user_agent)), "domain", "left"))
    long = policies.filter(F.size("rules") > rules_in_row)
    rows = urls.withColumn("domain", url_domain(F.col("url"))).withColumn("_target", _target(F.col("url")))
    rows = rows.join(policies.withColumn("rules", F.when(F.size("rules") <= rules_in_row, F.col("rules"))), "domain", "left")
    first = F.get(F.filter("rules", lambda r: F.col("_target").startswith(r["path"])), 0)["allow"]
    if not long.isEmpty():
        rows = rows.join(first_by_prefix(rows.select("domain", "_target"), long), ["domain", "_target"], "left")
        first = F.coalesce(first, "_found")
    verdict = (
        F.when(F.col("_status") == 200, F.coalesce(first, F.lit(True)))
        .when(F.col("_status") == 404, F.lit(on_missing == "allow"))
        .otherwise(F.lit(True))
    )
    rows = rows.withColumn("allowed", verdict)
    reason = (
        F.when(~F.coalesce(F.col("_status").isin(200, 404), F.lit(False)), settings.MESSAGES["permissive"])
        .when(F.col("allowed"), settings.MESSAGES["allowed"])
        .otherwise(settings.MESSAGES["denied"].format(agent=user_agent))
    )
    added = ["allowed", "reason", "crawl_delay"]
    kept = [c for c in urls.columns if c not in ["domain", *added]]
    return rows.withColumn("reason", reason).select(*kept, "domain", *added)
